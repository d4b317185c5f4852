"""Data quality and market statistics, each one aggregation or a join of two."""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import is_index
from ..shared import durable
from .bars import stocks
from .indicators import YEAR

QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def last_dates(daily: DataFrame) -> DataFrame:
    return daily.groupBy("code").agg(F.max("date").alias("last_date"))


def coverage(daily: DataFrame) -> DataFrame:
    """Rows, codes, first and last date of stocks, and codes and rows of indices, in one pass."""
    stock, index = F.when(~is_index(F.col("code")), F.col("code")), F.when(is_index(F.col("code")), F.col("code"))
    return daily.agg(
        F.count(stock).alias("stock_rows"), F.count_distinct(stock).alias("stock_codes"), F.min(F.when(stock.isNotNull(), F.col("date"))).alias("first_date"), F.max(F.when(stock.isNotNull(), F.col("date"))).alias("last_date"),
        F.count(index).alias("index_rows"), F.count_distinct(index).alias("index_codes"),
    )


def fundamentals_coverage(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("code").alias("codes"), F.count_distinct("period").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def boards(instruments: DataFrame) -> DataFrame:
    return instruments.groupBy("board").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "board")


def listings_by_year(instruments: DataFrame, newest: int = 8) -> DataFrame:
    years = instruments.where("listed_date IS NOT NULL").groupBy(F.year("listed_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return years.orderBy(F.desc("year")).limit(newest)


def bars_by_year(daily: DataFrame) -> DataFrame:
    return stocks(daily).groupBy(F.year("date").alias("year")).agg(F.count_distinct("date").alias("sessions"), F.count_distinct("code").alias("codes"), F.count(F.lit(1)).alias("bars"))


def limit_counts_by_year(daily: DataFrame) -> DataFrame:
    near = F.when(F.substring("code", 1, 3).isin("300", "301", "688", "689"), F.lit(19.5)).otherwise(F.lit(9.8))
    return stocks(daily).groupBy(F.year("date").alias("year")).agg(F.count_if(F.col("pct_chg") >= near).alias("limit_up"), F.count_if(F.col("pct_chg") <= -near).alias("limit_down"))


def index_yearly(index: DataFrame) -> DataFrame:
    """Return inside each year: last close over the first."""
    return index.groupBy("code", F.year("date").alias("year")).agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("ret"))


def yearly_return_distribution(daily: DataFrame, least_bars: int = 100) -> DataFrame:
    each = stocks(daily).groupBy(F.year("date").alias("year"), "code").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_bars)
    return each.groupBy("year").agg(
        F.count(F.lit(1)).alias("codes"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"), F.percentile("r", F.lit(0.1)).alias("p10"), F.percentile("r", F.lit(0.9)).alias("p90"),
        F.count_if(F.col("r") > 0).alias("up"), F.count_if(F.col("r") <= 0).alias("down"), F.count_if(F.col("r") > 1).alias("doubled"), F.count_if(F.col("r") < -0.5).alias("halved"), F.max("r").alias("best"),
    )


def recent_profile(daily: DataFrame, sessions: int = 90) -> DataFrame:
    """Per code over the store's last sessions: mean amount, annualised volatility, last close."""
    days = stocks(daily).select("date").distinct().orderBy(F.desc("date")).limit(sessions)
    return stocks(daily).join(F.broadcast(days), "date", "left_semi").groupBy("code").agg(F.avg("amount").alias("amount"), (F.stddev_samp("pct_chg") * sqrt(YEAR) / 100).alias("volatility"), F.max_by("close", "date").alias("price"))


def quantiles_of(df: DataFrame, columns: list[str], at: list[float] = QUANTILES, error: float | None = None) -> DataFrame:
    """(measure, quantile, value): exact and linearly interpolated, which holds a group's distinct values in one buffer.

    With ``error``, a mergeable summary of some 1/error values instead: the value's rank is off by at most error times the
    number of rows, whatever their number, and nothing is interpolated.
    """
    points = F.array(*[F.lit(q) for q in at])
    one = (lambda c: F.percentile(c, points)) if error is None else (lambda c: F.percentile_approx(c, points, round(1 / error)))
    sums = df.agg(*[one(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(q).alias("quantile"), F.col(c)[i].alias("value")) for c in columns for i, q in enumerate(at)]))
    return sums.select(rows.alias("x")).select("x.*")


def suspension(daily: DataFrame) -> DataFrame:
    """Among codes that traded on the store's first and last session: the share of sessions without a bar."""
    s = stocks(daily)
    span = s.agg(F.count_distinct("date").alias("sessions"), F.min("date").alias("d0"), F.max("date").alias("d1"))
    each = s.groupBy("code").agg(F.count(F.lit(1)).alias("bars"), F.min("date").alias("first"), F.max("date").alias("last"))
    gone = each.crossJoin(F.broadcast(span)).where("first = d0 AND last = d1").select((1 - F.col("bars") / F.col("sessions")).alias("r"))
    return gone.agg(F.count(F.lit(1)).alias("codes"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"), F.percentile("r", F.lit(0.9)).alias("p90"), F.count_if(F.col("r") > 0.1).alias("over_10pct"))


def stale_codes(daily: DataFrame, sessions: int = 20) -> DataFrame:
    """Codes whose last bar is older than the sessions-th last session."""
    days = stocks(daily).select("date").distinct().orderBy(F.desc("date")).limit(sessions).agg(F.min("date").alias("cut"))
    return last_dates(stocks(daily)).crossJoin(F.broadcast(days)).where("last_date < cut").select("code", "last_date")


def find_gaps(instruments: DataFrame, daily: DataFrame, lag_days: int = 3) -> DataFrame:
    """(code, kind, last_date, days_behind): codes behind the market's last date, longest first, and codes without any bar."""
    s = stocks(daily)
    market = s.agg(F.max("date").alias("market"))
    behind = last_dates(s).crossJoin(F.broadcast(market)).withColumn("days_behind", F.datediff("market", "last_date")).where(F.col("days_behind") > lag_days)
    none = without_bars(instruments, daily).select("code", F.lit("no_data").alias("kind"), F.lit(None).cast("date").alias("last_date"), F.lit(None).cast("int").alias("days_behind"))
    return behind.select("code", F.lit("lagging").alias("kind"), "last_date", "days_behind").unionByName(none).orderBy(F.col("days_behind").desc_nulls_last(), "code")


def without_bars(instruments: DataFrame, daily: DataFrame) -> DataFrame:
    return instruments.join(daily.select("code").distinct(), "code", "left_anti")


def search(instruments: DataFrame, daily: DataFrame, query: str = "", limit: int = 50) -> DataFrame:
    """Instruments that have bars and whose code or name contains the query."""
    hit = instruments.where(F.col("code").contains(query) | F.col("name").contains(query)) if query else instruments
    return hit.join(daily.select("code"), "code", "left_semi").orderBy("code").limit(limit)


def duplicate_keys(daily: DataFrame) -> DataFrame:
    return daily.groupBy("code", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ohlc_problems(daily: DataFrame) -> DataFrame:
    rules = {"low_over_high": "low > high", "low_over_open": "low > open", "low_over_close": "low > close", "high_under_open": "high < open", "high_under_close": "high < close", "non_positive": "close <= 0 OR open <= 0 OR low <= 0"}
    return daily.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in rules.items()])


def amount_missing_by_month(daily: DataFrame) -> DataFrame:
    return stocks(daily).groupBy(F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("amount").isNull() | (F.col("amount") <= 0)).alias("missing")).withColumn("share", F.col("missing") / F.col("bars"))


def unit_ratio(daily: DataFrame, days: int = 60) -> DataFrame:
    """Mean of amount / (volume * close) over the last calendar days."""
    market = stocks(daily).agg(F.max("date").alias("market"))
    recent = stocks(daily).crossJoin(F.broadcast(market)).where(F.col("date") > F.date_sub("market", days))
    return recent.agg(F.avg(F.col("amount") / F.nullif(F.col("volume") * F.col("close"), F.lit(0.0))).alias("ratio"), F.count(F.lit(1)).alias("bars"))


def source_compatibility(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("code", "date")) -> DataFrame:
    """``close_compatibility`` of two tables. ``on`` tells bars apart in each: where names share a code, add what does, or each meets all."""
    both = a.select(*on, F.col("close").alias("a")).join(b.select(*on, F.col("close").alias("b")), list(on))
    return close_compatibility(both)


def close_compatibility(both: DataFrame) -> DataFrame:
    """Per code: range of the ratio of two sources' closes (a, b), which stand side by side, and the largest difference of their returns."""
    w = Window.partitionBy("code").orderBy("date")
    step = both.select("code", "date", "a", "b").withColumns({"ratio": F.col("a") / F.nullif("b", F.lit(0.0)), "d": F.abs(F.col("a") / F.lag("a").over(w) - F.col("b") / F.lag("b").over(w))})
    return step.groupBy("code").agg((F.max("ratio") - F.min("ratio")).alias("ratio_range"), F.max("d").alias("return_diff"), F.count(F.lit(1)).alias("sessions"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself; raises where a required column is missing or wholly null. One pass, one row to the driver."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]).first()
    empty = [c for c in columns if row["_rows"] and not row[c]]
    if empty:
        raise ValueError(f"columns without any value: {empty}")
    return df


def market_profile(instruments: DataFrame, daily: DataFrame, least_bars: int = 100, sessions: int = 90, stale: int = 20, newest: int = 8) -> DataFrame:
    """The whole statistics report as one table (part, key, measure, value): boards, listings, years, limits, index, returns,
    recent quantiles, suspension, stale codes.

    The bars are read once: one aggregation with two grouping sets gives a row per (code, year) and one per date, and all parts
    come from those, but for the quantiles of the last sessions, which read the bars of their dates only.
    """
    index, year = is_index(F.col("code")), F.year("date")
    near = F.when(F.substring("code", 1, 3).isin("300", "301", "688", "689"), F.lit(19.5)).otherwise(F.lit(9.8))
    marked = daily.select("code", "date", year.alias("year"), "close", index.alias("index"), (F.col("pct_chg") >= near).alias("up"), (F.col("pct_chg") <= -near).alias("down"))
    sets = marked.groupingSets([["code", "index", "year"], ["index", "date"]], "code", "index", "year", "date").agg(
        F.grouping("date").alias("by_code"), F.count(F.lit(1)).alias("bars"), F.min_by("close", "date").alias("first"), F.max_by("close", "date").alias("last"), F.count_if("up").alias("up"), F.count_if("down").alias("down"), F.min("date").alias("d0"), F.max("date").alias("d1"),
    )
    sets = durable(sets, "profile")
    codes, days = sets.where("by_code = 1"), sets.where("by_code = 0 AND NOT index").select(F.col("d0").alias("date"), F.year("d0").alias("year"))
    stock = codes.where("NOT index")

    def long(part: str, df: DataFrame, key: Column, *measures: str) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
        return df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), rows.alias("x")).select("part", "key", "x.measure", "x.value")

    none, y = F.lit(""), F.col("year")
    parts = [long("boards", boards(instruments), F.col("board"), "n"), long("listings", listings_by_year(instruments, newest), y, "n")]
    years = stock.groupBy("year").agg(F.count_distinct("code").alias("codes"), F.sum("bars").alias("bars"), F.sum("up").alias("limit_up"), F.sum("down").alias("limit_down")).join(days.groupBy("year").agg(F.count_distinct("date").alias("sessions")), "year")
    parts.append(long("years", years, y, "sessions", "codes", "bars", "limit_up", "limit_down"))
    parts.append(long("index", codes.where("index").withColumn("ret", F.col("last") / F.col("first") - 1), F.concat_ws(" ", "code", "year"), "ret"))
    returns = stock.where(F.col("bars") >= least_bars).withColumn("r", F.col("last") / F.col("first") - 1).groupBy("year").agg(
        F.count(F.lit(1)).alias("codes"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"), F.percentile("r", F.lit(0.1)).alias("p10"), F.percentile("r", F.lit(0.9)).alias("p90"),
        F.count_if(F.col("r") > 0).alias("up"), F.count_if(F.col("r") <= 0).alias("down"), F.count_if(F.col("r") > 1).alias("doubled"), F.count_if(F.col("r") < -0.5).alias("halved"), F.max("r").alias("best"),
    )
    parts.append(long("returns", returns, y, "codes", "mean", "median", "p10", "p90", "up", "down", "doubled", "halved", "best"))
    recent = days.select("date").distinct().orderBy(F.desc("date")).limit(max(sessions, stale)).collect()  # at most that many dates
    newest_first = [r["date"] for r in recent]
    each = stock.groupBy("code").agg(F.sum("bars").alias("bars"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    span = days.agg(F.count_distinct("date").alias("sessions"), F.min("date").alias("m0"), F.max("date").alias("m1"))
    gone = each.join(F.broadcast(span), (F.col("d0") == F.col("m0")) & (F.col("d1") == F.col("m1"))).select((1 - F.col("bars") / F.col("sessions")).alias("r"))
    gone = gone.agg(F.count(F.lit(1)).alias("codes"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"), F.percentile("r", F.lit(0.9)).alias("p90"), F.count_if(F.col("r") > 0.1).alias("over_10pct"))
    parts.append(long("suspension", gone, none, "codes", "mean", "median", "p90", "over_10pct"))
    if newest_first:
        cut = newest_first[: stale][-1]
        parts.append(long("stale", each.where(F.col("d1") < F.lit(cut)).withColumn("days_behind", F.datediff(F.lit(newest_first[0]), "d1")), F.col("code"), "days_behind"))
        last = stocks(daily).where(F.col("date") >= F.lit(newest_first[: sessions][-1])).groupBy("code").agg(F.avg("amount").alias("amount"), (F.stddev_samp("pct_chg") * sqrt(YEAR) / 100).alias("volatility"), F.max_by("close", "date").alias("price"))
        q = quantiles_of(last, ["amount", "volatility", "price"])
        parts.append(q.select(F.lit("recent").alias("part"), F.col("measure").alias("key"), F.format_string("p%02d", (F.col("quantile") * 100).cast("int")).alias("measure"), "value"))
    return reduce(DataFrame.unionByName, parts)
