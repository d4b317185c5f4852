"""Ingest from files: parsing vendor rows, adjusting prices, choosing sources, planning increments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import avail_date, classify_board, is_st, to_number


def own() -> Window:
    return Window.partitionBy("code").orderBy("date")


def whole() -> Window:
    return own().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def pick(df: DataFrame, *candidates: str) -> Column:
    """The first of the candidate names that some column contains, as a column; null if none does."""
    for name in candidates:
        for c in df.columns:
            if name.lower() in c.lower():
                return F.col(f"`{c}`")
    return F.lit(None)


def clean_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+", "")


def instruments_from(*frames: DataFrame) -> DataFrame:
    """(code, name, board, is_st, listed_date) from exchange lists (code, name, listed): the first list that has a code wins."""
    out = None
    for i, df in enumerate(frames):
        part = df.select(F.lpad(F.col("code").cast("string"), 6, "0").alias("code"), clean_name(F.col("name")).alias("name"), F.coalesce(F.try_to_timestamp(F.col("listed"), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.col("listed"), F.lit("yyyyMMdd"))).cast("date").alias("listed_date"), F.lit(i).alias("_i"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("code").agg(F.min_by(F.struct("name", "listed_date"), F.struct("_i", "name")).alias("x"))
    return first.select("code", "x.name", classify_board(F.col("code")).alias("board"), is_st(F.col("x.name")).cast("int").alias("is_st"), "x.listed_date")


def bars_from_json(lines: DataFrame) -> DataFrame:
    """Bars from (code, json) where json lists [date, open, close, high, low, volume] texts; amount and pct_chg are imputed."""
    rows = lines.select("code", F.explode(F.from_json("json", "array<array<string>>")).alias("r"))
    bars = rows.select("code", F.to_date(F.col("r")[0]).alias("date"), *[to_number(F.col("r")[i]).alias(n) for i, n in ((1, "open"), (3, "high"), (4, "low"), (2, "close"), (5, "volume"))])
    return impute(bars.where("date IS NOT NULL AND close IS NOT NULL").dropDuplicates(["code", "date"]))


def impute(bars: DataFrame) -> DataFrame:
    """pct_chg from the previous bar, amount from lots times the close."""
    return bars.withColumns({"pct_chg": 100 * (F.col("close") / F.nullif(F.lag("close").over(own()), F.lit(0.0)) - 1), "amount": F.col("volume") * 100 * F.col("close")})


def stitch(*spans: DataFrame) -> DataFrame:
    """Spans of one source in one series: a date is taken from the first span that has it, pct_chg is computed across seams."""
    out = None
    for i, s in enumerate(spans):
        part = s.select("code", "date", "open", "high", "low", "close", "volume").withColumn("_i", F.lit(i))
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("code", "date").agg(F.min_by(F.struct("open", "high", "low", "close", "volume"), "_i").alias("x")).select("code", "date", "x.*")
    return impute(one)


def pick_source(candidates: DataFrame, priority: list[str]) -> DataFrame:
    """All bars of each code's best source: the first of the priority list that has any bar. Sources are never mixed in a code."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    best = candidates.where(rank > 0).groupBy("code").agg(F.min(rank).alias("_best"))
    return candidates.withColumn("_rank", rank).join(best, "code").where("_rank = _best").drop("_rank", "_best")


def forward_adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times the day's adjustment factor over the last one; missing factors are carried forward, then backward.

    Of several factors of a code and day the greatest counts, so that each bar stays one row. Both ways of carrying are running
    values, backward along the line turned round: the work grows with the rows of a code, not with their square.
    """
    joined = bars.join(factors.groupBy("code", "date").agg(F.max("adj_factor").alias("adj_factor")), ["code", "date"], "left")
    ahead = F.last("adj_factor", ignorenulls=True).over(own().rowsBetween(Window.unboundedPreceding, 0))
    back = F.last("adj_factor", ignorenulls=True).over(Window.partitionBy("code").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0))
    step = joined.withColumn("_f", F.coalesce(ahead, back))
    ratio = F.coalesce(F.col("_f") / F.nullif(F.last("_f").over(whole()), F.lit(0.0)), F.lit(1.0))
    out = step.withColumn("_r", ratio)
    return out.withColumns({c: F.col(c) * F.col("_r") for c in ("open", "high", "low", "close")}).drop("_f", "_r", "adj_factor")


def fundamentals_from(rows: DataFrame) -> DataFrame:
    """Reports with texts turned into numbers, and the date from which each is known. Of several reports of a (code, period) one
    stays whole: the one with the most values, then the greatest ones."""
    values = ["eps", "bps", "roe", "gross_margin", "ocfps", "revenue", "revenue_yoy", "profit", "profit_yoy"]
    out = rows.select(F.lpad(F.col("code").cast("string"), 6, "0").alias("code"), "period", *[to_number(F.col(v).cast("string")).alias(v) for v in values])
    full = sum(F.col(v).isNotNull().cast("int") for v in values)
    one = out.groupBy("code", "period").agg(F.max(F.struct(full.alias("full"), *values)).alias("x")).select("code", "period", *[f"x.{v}" for v in values])
    return one.withColumn("avail_date", avail_date(F.col("period")))


def periods(spark, start_year: int, end) -> DataFrame:
    """(period, avail_date): quarter ends from start_year whose report is out on ``end``."""
    years = spark.range(start_year, end.year + 1).select(F.explode(F.array(*[F.concat(F.col("id").cast("string"), F.lit(q)) for q in ("0331", "0630", "0930", "1231")])).alias("period"))
    return years.withColumn("avail_date", avail_date(F.col("period"))).where(F.col("avail_date") <= F.lit(end))


def sync_plan(instruments: DataFrame, daily: DataFrame, today, overlap_days: int = 7, full: bool = False, only_missing: bool = False, history_start=None) -> DataFrame:
    """(code, start): what to fetch. Known codes are fetched again from a week before their last bar, so late corrections arrive."""
    last = daily.groupBy("code").agg(F.max("date").alias("last_date"))
    plan = instruments.select("code").distinct().join(last, "code", "left")
    if only_missing:
        plan = plan.where("last_date IS NULL")
    begin = F.lit(history_start).cast("date")
    start = begin if full else F.coalesce(F.date_sub("last_date", overlap_days), begin)
    return plan.select("code", start.alias("start")).where(F.col("start").isNull() | (F.col("start") <= F.lit(today)))


def spot(daily: DataFrame) -> DataFrame:
    """(code, price): the last close of each code."""
    return daily.where("close IS NOT NULL").groupBy("code").agg(F.max_by("close", "date").alias("price"))


def delisted_missing(delisted: DataFrame, daily: DataFrame) -> DataFrame:
    return delisted.join(daily.select("code").distinct(), "code", "left_anti").withColumn("is_st", F.lit(1))


# Feed symbols of the benchmark indices, their names and codes in the store.
BENCHMARKS = {
    "sh000300": ("沪深300", "IDX000300"),
    "sh000905": ("中证500", "IDX000905"),
    "sh000001": ("上证指数", "IDX000001"),
    "sz399006": ("创业板指", "IDX399006"),
}


def index_bars_from(raw: DataFrame, start: dt.date | None = None) -> DataFrame:
    """Bars of indices from raw rows (symbol, date, open, high, low, close, volume), as the store's daily table has them.

    Codes get the prefix that keeps them apart from stocks: those of the benchmarks, else the symbol's last six characters.
    Returns are taken over the whole history and only then is it cut at ``start``; rows without a close go.
    """
    known = F.create_map(*[F.lit(x) for symbol, (_, code) in BENCHMARKS.items() for x in (symbol, code)])
    code = F.coalesce(F.try_element_at(known, F.col("symbol")), F.concat(F.lit("IDX"), F.right("symbol", F.lit(6))))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    rows = raw.select(code.alias("code"), F.col("date").try_cast("date").alias("date"), *[number(c) for c in ("open", "high", "low", "close", "volume")])
    before = F.last("close", ignorenulls=True).over(Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"amount": F.lit(None).cast("double"), "pct_chg": 100 * (F.col("close") / F.nullif(before, F.lit(0.0)) - 1)})
    return rows.where(F.col("close").isNotNull() & (F.lit(True) if start is None else F.col("date") >= F.lit(start)))
