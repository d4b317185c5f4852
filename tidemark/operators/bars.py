"""Bars, sessions, the dense grid, and the point-in-time universe."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import UNKNOWN, is_index, prefix_limit

#: Code lists up to this length become a pushed-down IN filter; longer ones a semi-join.
PUSHED_CODES = 500


def load_daily(daily: DataFrame, codes: list[str] | DataFrame | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Bars of the codes (None: all; an empty list: none) between two dates inclusive. Dates and short lists reach the scan."""
    out = daily
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end))
    if isinstance(codes, DataFrame):
        return out.join(codes.select("code").distinct(), "code", "left_semi")
    if codes is None:
        return out
    if len(codes) <= PUSHED_CODES:
        return out.where(F.col("code").isin(*codes)) if codes else out.where(F.lit(False))
    return out.join(daily.sparkSession.createDataFrame([(c,) for c in codes], "code string"), "code", "left_semi")


def usable_history(bars: DataFrame) -> DataFrame:
    """Each code's bars after its last bar with a non-positive close, low or open."""
    bad = (F.col("close") <= 0) | (F.col("low") <= 0) | (F.col("open") <= 0)
    last_bad = F.max(F.when(bad, F.col("date"))).over(Window.partitionBy("code"))
    return bars.withColumn("_bad", last_bad).where(F.col("_bad").isNull() | (F.col("date") > F.col("_bad"))).drop("_bad")


def sessions(daily: DataFrame) -> DataFrame:
    """(date, session): every date of the store, numbered. A calendar has a few thousand rows, so one task may sort it."""
    days = daily.select("date").distinct()
    return days.withColumn("session", F.row_number().over(Window.orderBy("date")) - 1)


def dense_grid(bars: DataFrame) -> DataFrame:
    """Every session of these codes x every code, with null values where a code did not trade."""
    days = bars.select("date").distinct()
    return bars.select("code").distinct().crossJoin(F.broadcast(days)).join(bars, ["code", "date"], "left")


def last_complete_day(daily: DataFrame, min_ratio: float = 0.5, lookback: int = 30) -> DataFrame:
    """One row: the newest session on which at least min_ratio of the upper median of the last sessions' names reported."""
    counts = daily.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    recent = counts.orderBy(F.desc("date")).limit(lookback)
    middle = recent.agg(F.sort_array(F.collect_list("n")).alias("a")).select(F.element_at("a", (F.size("a") / 2).cast("int") + 1).alias("middle"))
    return recent.crossJoin(F.broadcast(middle)).where(F.col("n") >= F.col("middle") * min_ratio).agg(F.max("date").alias("date"))


class InsufficientHistory(ValueError):
    """The store has too few sessions before the asked date for a universe to mean anything."""


@dataclass(frozen=True)
class UniverseFilter:
    exclude_boards: tuple[str, ...] = ()
    include_st: bool = False
    min_listed_days: int = 250
    min_amount: float = 5e7
    min_price: float = 2.0
    max_price: float = 1e9
    window: int = 20
    min_bars: int = 15
    blacklist: tuple[str, ...] = field(default=(UNKNOWN,))


def universe(instruments: DataFrame, daily: DataFrame, as_of: dt.date, flt: UniverseFilter = UniverseFilter()) -> DataFrame:
    """code, name, board, industry, avg_amount, last_close, bars of the names that may be traded on as_of, most liquid first."""
    days = daily.where(F.col("date") <= F.lit(as_of)).select("date").distinct().orderBy(F.desc("date")).limit(flt.window)
    known = [r["date"] for r in days.collect()]  # flt.window dates
    if len(known) < flt.min_bars:
        raise InsufficientHistory(f"{len(known)} sessions up to {as_of}; {flt.min_bars} are needed")
    names = instruments.where(~F.col("board").isin(*flt.exclude_boards, *flt.blacklist)).where(F.col("delisted_date").isNull() | (F.col("delisted_date") > F.lit(as_of)))
    if not flt.include_st:
        names = names.where("is_st = 0")
    names = names.where(F.datediff(F.lit(as_of), "listed_date") >= flt.min_listed_days)
    recent = daily.where((F.col("date") >= F.lit(min(known))) & (F.col("date") <= F.lit(as_of)))
    liquid = recent.groupBy("code").agg(F.avg("amount").alias("avg_amount"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_close"), F.count(F.lit(1)).alias("bars"))
    return (
        names.join(liquid, "code")
        .where((F.col("avg_amount") >= flt.min_amount) & F.col("last_close").between(flt.min_price, flt.max_price) & (F.col("bars") >= flt.min_bars))
        .select("code", "name", "board", "industry", "avg_amount", "last_close", "bars")
        .orderBy(F.desc("avg_amount"), "code")
    )


def members(instruments: DataFrame, daily: DataFrame, flt: UniverseFilter = UniverseFilter(), top: int | None = None) -> DataFrame:
    """(date, code): the universe of every session at once, as ``universe`` would give it on that date; with ``top``, only the most
    liquid names. A name without a bar on a session is not listed there: nothing can be entered on it anyway.
    """
    numbered = daily.join(F.broadcast(sessions(daily)), "date")
    last = Window.partitionBy("code").orderBy("session").rangeBetween(-(flt.window - 1), 0)
    seen = numbered.select("code", "date", F.avg("amount").over(last).alias("avg_amount"), F.last("close", ignorenulls=True).over(last).alias("last_close"), F.count(F.lit(1)).over(last).alias("bars"))
    names = instruments.where(~F.col("board").isin(*flt.exclude_boards, *flt.blacklist))
    names = names if flt.include_st else names.where("is_st = 0")
    liquid = seen.where((F.col("avg_amount") >= flt.min_amount) & F.col("last_close").between(flt.min_price, flt.max_price) & (F.col("bars") >= flt.min_bars)).select("date", "code", "avg_amount")
    terms = names.select(F.col("code").alias("_code"), "listed_date", "delisted_date").distinct()
    may = (F.col("code") == F.col("_code")) & (F.col("delisted_date").isNull() | (F.col("delisted_date") > F.col("date"))) & (F.datediff("date", "listed_date") >= flt.min_listed_days)
    if top is None:
        return liquid.join(terms, may, "left_semi").select("date", "code")
    # Names that share a code multiply rows, so the most liquid rows are taken before they meet, and once more after.
    first = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("avg_amount"), "code"))).where(F.col("_r") <= top).drop("_r")
    each = first(liquid.join(terms, may, "left_semi")).join(names.select(F.col("code").alias("_code"), "listed_date", "delisted_date"), may)
    return first(each.select("date", "code", "avg_amount")).select("date", "code")


def own() -> Window:
    return Window.partitionBy("code").orderBy("date")


def forward_return(h: int) -> Column:
    """Bought at the next session's open, sold h sessions later; for a dense grid."""
    return F.lead("open", 1 + h).over(own()) / F.nullif(F.lead("open", 1).over(own()), F.lit(0.0)) - 1


def tradable() -> Column:
    """Closed today and opens tomorrow below the limit; for a dense grid."""
    ahead = F.lead("open", 1).over(own())
    return F.coalesce(F.col("close").isNotNull() & (ahead < F.col("close") * (1 + prefix_limit(F.col("code"))) - 1e-6), F.lit(False))


def stocks(daily: DataFrame) -> DataFrame:
    return daily.where(~is_index(F.col("code")))
