"""Daily signals: one plan over the loaded history, cut to the asked session only after all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import LOT
from .bars import usable_history
from .rank import blend
from .strategies import Strategy

SIGNAL = ["date", "strategy", "code", "action", "price", "score", "reason"]


def shares_for(budget: Column | float, price: Column) -> Column:
    """Round lots that the budget buys at the price rounded to cents."""
    return (F.floor((budget if isinstance(budget, Column) else F.lit(float(budget))) / F.nullif(F.round(price, 2), F.lit(0.0)) / LOT) * LOT).cast("long")


def with_sizing(buys: DataFrame, value: float, max_positions: int) -> DataFrame:
    budget = value / max(max_positions, 1)
    shares = shares_for(budget, F.col("price"))
    return buys.withColumns({"budget": F.lit(float(budget)), "shares": shares, "affordable": shares > 0, "min_amount": F.round(F.round("price", 2) * LOT, 2)})


def eligible(rows: DataFrame, as_of, warmup: int) -> DataFrame:
    """Codes with enough history whose last bar is on as_of."""
    need = max(130, int(0.9 * warmup))
    w = Window.partitionBy("code")
    return rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_last": F.max("date").over(w)}).where((F.col("_n") >= need) & (F.col("_last") == F.lit(as_of))).drop("_n", "_last")


def generate(strategy: Strategy, daily: DataFrame, index: DataFrame, as_of, codes: DataFrame, holdings: DataFrame | None = None, facts: DataFrame | None = None, load_start=None, max_candidates: int = 10, value: float = 200_000.0, max_positions: int = 5) -> DataFrame:
    """Buy and sell signals of one session with their size.

    codes: the universe; holdings (code): sold on exit even outside it, never bought. A closed regime gate stops buys only.
    """
    wanted = codes.select("code") if holdings is None else codes.select("code").unionByName(holdings.select("code"))
    bars = daily.join(wanted.distinct(), "code", "left_semi").where(F.col("date") <= F.lit(as_of))
    if load_start is not None:
        bars = bars.where(F.col("date") >= F.lit(load_start))
    rows = eligible(usable_history(bars), as_of, strategy.warmup_bars())
    ready = strategy.prepare(rows, facts)
    keep = [f for f, _ in strategy.score_fields]
    now = ready.select("code", "date", "close", *keep, F.coalesce(strategy.entry(), F.lit(False)).alias("entry"), F.coalesce(strategy.exit(), F.lit(False)).alias("exit"), strategy.score().alias("score"), strategy.reason("BUY").alias("why_buy"), strategy.reason("SELL").alias("why_sell")).where(F.col("date") == F.lit(as_of))
    held = (holdings.select("code").distinct() if holdings is not None else now.sparkSession.createDataFrame([], "code string")).withColumn("held", F.lit(True))
    now = now.join(codes.select("code", F.lit(True).alias("listed")), "code", "left").join(held, "code", "left")
    gate = strategy.market_regime(now.select("date").distinct(), index)
    buys = now.where("entry AND listed AND held IS NULL")
    if gate is not None:
        buys = buys.join(F.broadcast(gate.where("regime").select("date")), "date", "left_semi")
    if strategy.score_fields:
        present = F.lit(True)
        for f in keep:
            present = present & F.col(f).isNotNull()
        buys = blend(buys, strategy.score_fields, present, "score", missing=0.0)
    best = buys.orderBy(F.col("score").desc_nulls_last(), "code").limit(max_candidates)
    picked = best.select("date", F.lit(strategy.name).alias("strategy"), "code", F.lit("BUY").alias("action"), F.col("close").alias("price"), "score", F.col("why_buy").alias("reason"))
    sells = now.where("held AND exit").select("date", F.lit(strategy.name).alias("strategy"), "code", F.lit("SELL").alias("action"), F.col("close").alias("price"), "score", F.col("why_sell").alias("reason"))
    return with_sizing(picked, value, max_positions).unionByName(sells, allowMissingColumns=True)


def freshness(index: DataFrame, as_of) -> DataFrame:
    """One row: the benchmark's last date, and whether it is behind as_of."""
    return index.agg(F.max("date").alias("index_last")).withColumn("stale", F.coalesce(F.col("index_last") < F.lit(as_of), F.lit(True)))


def position_pnl(positions: DataFrame, live: DataFrame | None, cached: DataFrame) -> DataFrame:
    """Positions with price, its source (live, cache, none), cost, value and profit; ``live`` and ``cached``: (code, price)."""
    out = positions.join(cached.select("code", F.col("price").alias("_cached")), "code", "left")
    out = out.join(live.select("code", F.col("price").alias("_live")), "code", "left") if live is not None else out.withColumn("_live", F.lit(None).cast("double"))
    price = F.coalesce("_live", "_cached")
    paid, value = F.col("shares") * F.col("cost"), F.col("shares") * F.col("price")
    out = out.withColumns({"price": price, "price_source": F.when(F.col("_live").isNotNull(), "live").when(F.col("_cached").isNotNull(), "cache").otherwise("none")})
    return out.withColumns({"paid": paid, "value": value, "pnl": value - paid, "pnl_pct": (value - paid) / F.nullif(paid, F.lit(0.0))}).drop("_live", "_cached")


def position_totals(valued: DataFrame) -> DataFrame:
    known = valued.where("price IS NOT NULL")
    return known.agg(F.sum("paid").alias("paid"), F.sum("value").alias("value"), F.sum("pnl").alias("pnl")).withColumn("pnl_pct", F.col("pnl") / F.nullif("paid", F.lit(0.0)))
