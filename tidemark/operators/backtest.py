"""Portfolio simulation: signals are prepared by Spark for all runs at once, each run's session loop is one grouped fold.

A fold is sequential by nature (cash and positions of one session decide the next), so runs, i.e. combinations of strategy,
parameters and configuration, are what is parallel. Before the fold, rows are cut to the few columns it reads and sorted by
session; a fold streams them, holds two sessions, and gives equity, trades and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions.market import price_limit
from ..functions.portfolio import ORDER, Config, fold_runs
from ..shared import durable
from .bars import sessions, usable_history
from .rank import blend
from .strategies import Strategy

EQUITY = "run_id string, date date, equity double, cash double, positions int"
TRADES = "run_id string, code string, open_date date, close_date date, shares long, open_price double, close_price double, pnl double, pnl_pct double, hold_days int, close_reason string"
STATS = "run_id string, suspended int, limit_up int, limit_down int, insufficient int, error string"
MIN_BARS = 60


def prepare(strategy: Strategy, daily: DataFrame, days: DataFrame, run_id: str, start, end, facts: DataFrame | None = None, codes: DataFrame | None = None, names: DataFrame | None = None, min_bars: int = MIN_BARS) -> DataFrame:
    """The rows a fold reads: signals in own-bar time over the loaded history, put on the sessions of [start, end].

    Score fields are blended across all codes of a session by ordinal rank. Of several names of a code the greatest counts, so
    that rows do not multiply.
    """
    bars = daily if codes is None else daily.join(codes.select("code").distinct(), "code", "left_semi")
    usable = usable_history(bars.where(F.col("date") <= F.lit(end)))
    usable = usable.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("code"))).where(F.col("_n") >= min_bars).drop("_n")
    sig = strategy.signals(usable, facts).join(F.broadcast(days), "date").where(F.col("date").between(F.lit(start), F.lit(end)))
    if strategy.score_fields:
        present = F.lit(True)
        for f, _ in strategy.score_fields:
            present = present & F.col(f).isNotNull()
        sig = blend(sig, strategy.score_fields, present, "score", ties="ordinal", single=0.5, missing=-9.9)
    sig = sig.join(names.groupBy("code").agg(F.max("name").alias("name")), "code", "left") if names is not None else sig.withColumn("name", F.lit(""))
    limit = price_limit(F.col("code"), F.coalesce("name", F.lit("")))
    return sig.select(F.lit(run_id).alias("run_id"), "session", "code", "open", "close", "atr14", "entry", "exit", "score", limit.alias("limit"))


def calendar(daily: DataFrame, start, end) -> DataFrame:
    return sessions(daily.where(F.col("date").between(F.lit(start), F.lit(end))))


def run(rows: DataFrame, days: DataFrame, configs: dict[str, Config], gates: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(equity, trades, stats) of all runs, folded once and written. The calendar and the gates are a few thousand rows and travel
    with the function. A run without sessions or bars has no equity and says so in its stats.
    """
    spark = rows.sparkSession
    ship(spark)
    dates = [r["date"] for r in days.orderBy("session").collect()]
    open_days = {k: {r["date"]: r["regime"] for r in g.collect()} for k, g in (gates or {}).items()}
    kinds = {"equity": EQUITY, "trades": TRADES, "stats": STATS}
    columns = {k: [c.split()[0] for c in schema.split(", ")][1:] for k, schema in kinds.items()}
    tagged = ", ".join(["run_id string", "kind string", *dict.fromkeys(c for schema in kinds.values() for c in schema.split(", ")[1:])])

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run_id, equity, trades, state in fold_runs(frames, dates, open_days, configs):
            b = state.blocked
            stats = [(b["suspended"], b["limit_up"], b["limit_down"], b["insufficient"], "fewer than two sessions" if len(dates) < 2 else None)]
            parts = [pd.DataFrame(found, columns=columns[k]).astype(object).assign(run_id=run_id, kind=k) for k, found in (("equity", equity), ("trades", trades), ("stats", stats))]
            out = pd.concat(parts).reindex(columns=[c.split()[0] for c in tagged.split(", ")])
            yield out.astype(object).where(out.notna(), None)

    done = durable(rows.repartition("run_id").sortWithinPartitions(*ORDER).mapInPandas(go, tagged), "fold")
    of = {k: done.where(F.col("kind") == k).select("run_id", *columns[k]) for k in kinds}
    runs = spark.createDataFrame([(r,) for r in configs], "run_id string")
    stats = runs.join(of["stats"], "run_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    missing = F.lit("fewer than two sessions") if len(dates) < 2 else F.when(F.col("suspended").isNull(), F.lit("no bars in this span"))
    return of["equity"], of["trades"], stats.select("run_id", *[count(c) for c in columns["stats"][:-1]], F.coalesce("error", missing).alias("error"))


def backtest(strategy: Strategy, daily: DataFrame, index: DataFrame, start, end, cfg: Config = Config(), facts: DataFrame | None = None, codes: DataFrame | None = None, names: DataFrame | None = None, run_id: str = "run") -> tuple[DataFrame, DataFrame, DataFrame]:
    days = calendar(daily, start, end)
    gate = strategy.market_regime(days, index)
    rows = prepare(strategy, daily, days, run_id, start, end, facts, codes, names)
    equity, trades, stats = run(rows, days, {run_id: cfg}, {run_id: gate} if gate is not None else None)
    return with_benchmark(equity, index), trades, stats


def with_benchmark(equity: DataFrame, index: DataFrame) -> DataFrame:
    return equity.join(F.broadcast(index.select("date", F.col("close").alias("benchmark"))), "date", "left").select("run_id", "date", "equity", "cash", "positions", "benchmark")
