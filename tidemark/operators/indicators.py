"""Indicators in own-bar time: windows over each code's existing rows, one partitioning and sort for all of them.

Every function takes a frame with (code, date, ...) and adds columns. A trailing window of n rows yields null until it is
full. Nothing looks ahead. Values that depend on where the history starts (EWM, drawdown) start at the frame's first row, so
the caller chooses the load window.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import ratio

YEAR = 252


def own() -> Window:
    return Window.partitionBy("code").orderBy("date")


def last(n: int) -> Window:
    return own().rowsBetween(-(n - 1), 0)


def ever() -> Window:
    return own().rowsBetween(Window.unboundedPreceding, 0)


def full(aggregate: Column, x: Column, n: int) -> Column:
    """The aggregate where all n rows of the window have a value."""
    return F.when(F.count(x).over(last(n)) == n, aggregate.over(last(n)))


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x), x, n)


def highest(x: Column, n: int) -> Column:
    return full(F.max(x), x, n)


def lowest(x: Column, n: int) -> Column:
    return full(F.min(x), x, n)


def deviation(x: Column, n: int) -> Column:
    """Population deviation."""
    return full(F.stddev_pop(x), x, n)


def before(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(own())


def momentum(x: Column, n: int) -> Column:
    return ratio(x, before(x, n)) - 1


def drawdown(x: Column) -> Column:
    return ratio(x, F.max(x).over(ever())) - 1


def slope(x: Column, n: int) -> Column:
    """Least-squares slope over n bars as a share of the window's mean."""
    i = F.col("_i")
    return full(F.covar_pop(i, x), x, n) / F.var_pop(i).over(last(n)) / F.greatest(sma(x, n), F.lit(1e-9))


def with_slope(df: DataFrame, source: str, n: int, out: str) -> DataFrame:
    numbered = df.withColumn("_i", F.row_number().over(own()).cast("double"))
    return numbered.withColumn(out, slope(F.col(source), n)).drop("_i")


def cross_above(a: Column, b: Column) -> Column:
    return F.coalesce((a > b) & (before(a) <= before(b)), F.lit(False))


def cross_below(a: Column, b: Column) -> Column:
    return F.coalesce((a < b) & (before(a) >= before(b)), F.lit(False))


#: Rows of a block. Over a block of this many rows most recursions forget what lies before, and none leaves the doubles' range.
BLOCK = 1024
#: Decay over a block, as an exponent: at least FORGET, so that one block back is enough, at most RANGE.
FORGET, RANGE = 40.0, 600.0


def block_of(rate: float) -> int:
    """Rows of a block for a decay of exp(-rate) a row: the common size where it fits, so that recursions share their order."""
    return BLOCK if FORGET <= rate * BLOCK <= RANGE else max(1, int(RANGE / rate))


def blocked(size: int) -> Window:
    """Each code's line in blocks. All windows of a recursion follow this one order, which needs a single sort."""
    return Window.partitionBy("code").orderBy(f"_b{size}", "date")


def with_blocks(df: DataFrame, size: int) -> DataFrame:
    """Number each code's rows (_i) and blocks (_b<size>), unless the frame has them."""
    if "_i" not in df.columns:
        df = df.withColumn("_i", F.row_number().over(own()) - 1)
    return df if f"_b{size}" in df.columns else df.withColumn(f"_b{size}", F.floor(F.col("_i") / size))


def drop_blocks(df: DataFrame, but: list[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if (c == "_i" or c.startswith("_b") and c[2:].isdigit()) and c not in but])


def with_ewm(df: DataFrame, source: str, alpha: float, min_periods: int, out: str) -> DataFrame:
    """y0 = x0, yt = (1 - alpha) * y(t-1) + alpha * xt from the first value on; null before min_periods values.

    The recursion is a running sum of values scaled by (1-alpha)**-row. The exponent starts anew every block of rows, before it
    leaves the range of doubles; what the block before left behind comes in as one more sum, and what lies further back
    weighs less than exp(-40). So it stays window functions for histories of any length. Inner nulls are not expected (ingest
    drops them); ``with_ewm_over_holes`` is for lines that have them.
    """
    x, decay, had = F.col(source), 1.0 - alpha, df.columns
    if decay <= 0:
        return df.withColumn(out, F.when(F.count(x).over(ever()) >= min_periods, x))
    size = block_of(-log(decay))
    order, block = blocked(size), f"_b{size}"
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    step = with_blocks(df, size).withColumn("_k", F.count(x).over(so_far))
    base, at = F.lit(decay), F.col("_i") % size
    step = step.withColumn("_t", F.when(x.isNotNull(), x * F.when(F.col("_k") == 1, 1.0).otherwise(alpha) * F.pow(base, -at)))
    here = F.sum("_t").over(Window.partitionBy("code", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    step = step.withColumn("_h", here).withColumn("_before", F.sum("_t").over(Window.partitionBy("code").orderBy(block).rangeBetween(-1, -1)))
    value = F.pow(base, at) * (F.col("_h") + F.coalesce("_before", F.lit(0.0)) * F.pow(base, F.lit(float(size))))
    return drop_blocks(step.withColumn(out, F.when(x.isNotNull() & (F.col("_k") >= min_periods), value)).drop("_k", "_t", "_h", "_before"), had)


#: Blocks back that reach into a block of a line with holes.
BACK = 8


def with_ewm_over_holes(df: DataFrame, sources: dict[str, str], alpha: float, min_periods: int) -> DataFrame:
    """Like ``with_ewm`` for several columns (source -> new column) that are null on the same rows, which may lie anywhere.

    Weights decay over a hole: after g rows, y = (d**g * y + alpha * x) / (d**g + alpha) with d = 1 - alpha, an affine map of
    the value before; a row without a value keeps the one before. Maps compose associatively: in a block of rows a map's
    weight is the exponential of a running sum, and what a block leaves behind goes on through the maps of whole blocks.
    Long holes slow the decay per value, so eight blocks back take part; beyond them weighs less than exp(-40) for alpha of
    1/500 or more.
    """
    first, decay, had = next(iter(sources)), 1.0 - alpha, df.columns
    size = max(1, int(RANGE / -log(decay))) if decay > 0 else BLOCK
    order, block = blocked(size), f"_b{size}"
    own_block = Window.partitionBy("code", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(first).isNotNull()
    step = with_blocks(df, size).withColumns({"_k": F.count(first).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.last(F.when(known, F.col("_i")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    kept = F.pow(F.lit(decay), (F.col("_i") - F.col("_last")).cast("double"))  # null at the first value
    step = step.withColumns({"_lam": F.when(known & F.col("_last").isNotNull(), F.least(F.ln(kept + alpha) - F.ln(F.greatest(kept, F.lit(1e-300))), F.lit(50.0))).otherwise(0.0), "_w": F.when(known, F.coalesce(alpha / (kept + alpha), F.lit(1.0)))})
    step = step.withColumns({"_cum": F.sum("_lam").over(own_block), "_end": F.coalesce(F.lead(block).over(order) != F.col(block), F.lit(False))})
    terms = {f"_t{i}": F.coalesce(F.col("_w") * F.col(x), F.lit(0.0)) * F.exp("_cum") for i, x in enumerate(sources)}
    step = step.withColumns(terms).withColumns({f"_h{i}": F.exp(-F.col("_cum")) * F.sum(f"_t{i}").over(own_block) for i in range(len(sources))})
    left = F.when(F.col("_end"), F.struct(F.col("_cum").alias("cum"), *[F.col(f"_h{i}").alias(f"h{i}") for i in range(len(sources))]))
    step = step.withColumn("_left", F.collect_list(left).over(Window.partitionBy("code").orderBy(block).rangeBetween(-BACK, -1)))
    behind = lambda i: F.aggregate("_left", F.lit(0.0), lambda y, x: y * F.exp(-x["cum"]) + x[f"h{i}"])
    out = {name: F.when(F.col("_k") >= min_periods, F.exp(-F.col("_cum")) * behind(i) + F.col(f"_h{i}")) for i, name in enumerate(sources.values())}
    own_names = ["_k", "_last", "_lam", "_w", "_cum", "_end", "_left", *[f"_{c}{i}" for c in "th" for i in range(len(sources))]]
    return drop_blocks(step.withColumns(out).drop(*own_names), had)


def extreme(df: DataFrame, source: str, n: int, out: str, top: bool = True) -> DataFrame:
    """The highest (or lowest) of the last n rows, null until all n have a value.

    Doubling: the extreme of 2**k rows comes from those of 2**(k-1) rows here and further back, so a window of n costs some
    log2(n) lags over the own-bar order instead of a frame of n rows; two overlapping powers of two make up any n.
    """
    pick, x = (F.greatest if top else F.least), F.col(source)
    step = df.withColumns({"_n": F.count(x).over(ever()), "_x": x})
    span = 1
    while 2 * span <= n:
        step = step.withColumn("_x", pick(F.col("_x"), F.coalesce(before(F.col("_x"), span), F.col("_x"))))
        span *= 2
    rest = pick(F.col("_x"), before(F.col("_x"), n - span)) if n > span else F.col("_x")
    step = step.withColumns({"_y": rest, "_m": F.col("_n") - F.coalesce(before(F.col("_n"), n), F.lit(0))})
    return step.withColumn(out, F.when(F.col("_m") == n, F.col("_y"))).drop("_n", "_x", "_y", "_m")


def with_ema(df: DataFrame, source: str, n: int, out: str) -> DataFrame:
    return with_ewm(df, source, 2.0 / (n + 1), n, out)


def changes(df: DataFrame, source: str) -> DataFrame:
    """_up and _down: gains and losses on the row before, null where either is unknown."""
    change = F.col("_d")
    step = df.withColumn("_d", F.col(source) - before(F.col(source)))
    return step.withColumns({"_up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}).drop("_d")


def strength(gain: Column, loss: Column) -> Column:
    return F.lit(100.0) - F.lit(100.0) / (1 + ratio(gain, loss))


def with_rsi(df: DataFrame, source: str, n: int, out: str, warm: bool = True) -> DataFrame:
    """Wilder's RSI. With ``warm`` it is 0 while it warms up and on flat series, 100 where there was no loss; else null there."""
    had = df.columns
    step = with_blocks(changes(df, source), block_of(-log(1 - 1 / n)) if n > 1 else BLOCK)
    step = with_ewm(with_ewm(step, "_up", 1.0 / n, n, "_g"), "_down", 1.0 / n, n, "_l")
    rsi = strength(F.col("_g"), F.col("_l"))
    if warm:
        rsi = F.coalesce(rsi, F.when(F.col("_g") > 0, 100.0).otherwise(0.0))
    return drop_blocks(step.withColumn(out, rsi).drop("_up", "_down", "_g", "_l"), had)


def with_rsi_over_holes(df: DataFrame, source: str, n: int, out: str) -> DataFrame:
    """RSI on a grid with holes: the averages decay over holes, changes next to a hole are unknown, null without losses."""
    step = with_ewm_over_holes(changes(df, source), {"_up": "_g", "_down": "_l"}, 1.0 / n, n)
    return step.withColumn(out, strength(F.col("_g"), F.col("_l"))).drop("_up", "_down", "_g", "_l")


def with_macd(df: DataFrame, source: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    had = df.columns
    step = with_blocks(df, BLOCK)
    step = with_ema(with_ema(step, source, fast, "_fast"), source, slow, "_slow")
    step = with_ema(step.withColumn("dif", F.col("_fast") - F.col("_slow")), "dif", signal, "dea")
    return drop_blocks(step.withColumn("macd_hist", 2 * (F.col("dif") - F.col("dea"))).drop("_fast", "_slow"), had)


def true_range() -> Column:
    close = before(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close))


def with_atr(df: DataFrame, n: int, out: str) -> DataFrame:
    return with_ewm(df.withColumn("_tr", true_range()), "_tr", 1.0 / n, n, out).drop("_tr")


def with_bollinger(df: DataFrame, source: str, n: int = 20, k: float = 2.0) -> DataFrame:
    x = F.col(source)
    mid, width = sma(x, n), k * deviation(x, n)
    return df.withColumns({"boll_low": mid - width, "boll_mid": mid, "boll_up": mid + width})


def with_returns(df: DataFrame) -> DataFrame:
    return df.withColumn("_ret", momentum(F.col("close"), 1))


def with_volatility(df: DataFrame, n: int, out: str) -> DataFrame:
    return with_returns(df).withColumn(out, deviation(F.col("_ret"), n) * sqrt(YEAR)).drop("_ret")


def add_common(df: DataFrame) -> DataFrame:
    """Everything in own-bar order first, then the recursions in the order of their blocks: two sorts in all."""
    c, v, had = F.col("close"), F.col("volume"), df.columns
    step = changes(with_returns(df), "close").withColumns(
        {f"ma{n}": sma(c, n) for n in (5, 10, 20, 60, 120)}
        | {"vol_ma20": sma(v, 20), "vol_ratio": ratio(v, sma(v, 20)), "dd": drawdown(c), "_tr": true_range()}
        | {f"mom{n}": momentum(c, n) for n in (20, 60, 120)}
        | {"vol20": deviation(F.col("_ret"), 20) * sqrt(YEAR)}
    )
    step = with_blocks(extreme(extreme(step, "high", 20, "high20"), "low", 20, "low20", False), BLOCK)
    for source, out in (("_up", "_g"), ("_down", "_l"), ("_tr", "atr14")):
        step = with_ewm(step, source, 1 / 14, 14, out)
    rsi = F.coalesce(strength(F.col("_g"), F.col("_l")), F.when(F.col("_g") > 0, 100.0).otherwise(0.0))
    return drop_blocks(step.withColumns({"rsi14": rsi, "atr_pct": ratio(F.col("atr14"), c)}).drop("_ret", "_up", "_down", "_tr", "_g", "_l"), had)


def add_extended(df: DataFrame) -> DataFrame:
    step = with_bollinger(df, "close").withColumns({"ma250": sma(F.col("close"), 250), "vol_ma5": sma(F.col("volume"), 5)})
    return with_macd(extreme(step, "high", 60, "high60"), "close")
