"""Performance of equity curves and trades; a curve is one run_id's few thousand rows, so windows partition by run_id."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import YEAR

# Edges of the histogram of trade returns.
EDGES = [-1.0, -0.30, -0.20, -0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 10.0]


def curve() -> Window:
    return Window.partitionBy("run_id").orderBy("date")


def ever() -> Window:
    return curve().rowsBetween(Window.unboundedPreceding, 0)


def drawdowns(equity: DataFrame, digits: int = 5) -> DataFrame:
    return equity.select("run_id", "date", F.round(F.col("equity") / F.max("equity").over(ever()) - 1, digits).alias("drawdown"))


def exposure(equity: DataFrame) -> DataFrame:
    share = (F.col("equity") - F.col("cash")) / F.nullif("equity", F.lit(0.0))
    return equity.select("run_id", "date", F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), 4).alias("exposure"), "positions")


def _last_of(equity: DataFrame, unit: str) -> DataFrame:
    return equity.groupBy("run_id", F.trunc("date", unit).alias("date")).agg(F.max_by("equity", "date").alias("equity"))


def monthly_returns(equity: DataFrame, initial_cash: float) -> DataFrame:
    """(run_id, year, month, ret); the first month is measured against the initial cash."""
    last = F.lag("equity", 1).over(curve())
    months = _last_of(equity, "month").withColumn("ret", F.round(F.col("equity") / F.coalesce(last, F.lit(initial_cash)) - 1, 4))
    return months.select("run_id", F.year("date").alias("year"), F.month("date").alias("month"), "ret")


def yearly_returns(equity: DataFrame, initial_cash: float) -> DataFrame:
    """(run_id, year, ret, bench): chained on year ends; the benchmark starts from its first value."""
    held = equity.withColumn("b", F.last("benchmark", ignorenulls=True).over(ever()))
    years = held.groupBy("run_id", F.year("date").alias("year")).agg(F.max_by("equity", "date").alias("e"), F.max_by("b", "date").alias("b"), F.min_by("b", F.when(F.col("b").isNotNull(), F.col("date"))).alias("first"))
    w = Window.partitionBy("run_id").orderBy("year")
    base = F.coalesce(F.lag("b").over(w), F.first("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return years.select("run_id", "year", F.round(F.col("e") / F.coalesce(F.lag("e").over(w), F.lit(initial_cash)) - 1, 4).alias("ret"), F.round(F.col("b") / base - 1, 4).alias("bench"))


def underwater(equity: DataFrame) -> DataFrame:
    """(run_id, longest_underwater): the longest run of sessions below the running peak."""
    step = equity.withColumn("under", F.col("equity") < F.max("equity").over(ever()))
    step = step.withColumn("island", F.sum((~F.col("under")).cast("int")).over(ever()))
    runs = step.where("under").groupBy("run_id", "island").agg(F.count(F.lit(1)).alias("n"))
    return step.select("run_id").distinct().join(runs.groupBy("run_id").agg(F.max("n").alias("m")), "run_id", "left").select("run_id", F.coalesce("m", F.lit(0).cast("long")).alias("longest_underwater"))


def equity_metrics(equity: DataFrame, initial_cash: float) -> DataFrame:
    """One row a run. Returns start at the second point; volatility is a population deviation; the risk-free rate is 0."""
    step = equity.withColumns({"r": F.col("equity") / F.lag("equity").over(curve()) - 1, "dd": F.col("equity") / F.max("equity").over(ever()) - 1})
    agg = step.groupBy("run_id").agg(
        F.max_by("equity", "date").alias("final_equity"), F.count(F.lit(1)).alias("days"), F.avg("r").alias("m"), (F.stddev_pop("r") * sqrt(YEAR)).alias("volatility"),
        (F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))) * sqrt(YEAR)).alias("down"), F.min("dd").alias("max_drawdown"),
    )
    total = F.col("final_equity") / initial_cash - 1
    cagr = F.when(F.col("final_equity") > 0, F.pow(F.col("final_equity") / initial_cash, F.lit(float(YEAR)) / F.col("days")) - 1).otherwise(F.lit(0.0))
    over = lambda d: F.when(d > 0, F.col("m") * YEAR / d).otherwise(F.lit(0.0))
    return agg.join(underwater(equity), "run_id").select(
        "run_id", F.round(total, 4).alias("total_return"), F.round(cagr, 4).alias("cagr"), F.round("volatility", 4).alias("volatility"), F.round(over(F.col("volatility")), 3).alias("sharpe"), F.round(over(F.col("down")), 3).alias("sortino"),
        F.round("max_drawdown", 4).alias("max_drawdown"), "longest_underwater", F.round(F.when(F.col("max_drawdown") < 0, cagr / -F.col("max_drawdown")).otherwise(F.lit(0.0)), 3).alias("calmar"), F.round("final_equity", 2).alias("final_equity"), "days",
    )


def trade_metrics(trades: DataFrame) -> DataFrame:
    """One row a run: wins are trades with a profit, everything else is a loss; profit_factor is null without losses."""
    win, lost = F.col("pnl") > 0, F.col("pnl") <= 0
    return trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.avg(win.cast("double")), 4).alias("win_rate"), F.round(F.avg("pnl_pct"), 4).alias("avg_return"), F.round(F.avg(F.when(win, F.col("pnl_pct"))), 4).alias("avg_win"),
        F.round(F.avg(F.when(lost, F.col("pnl_pct"))), 4).alias("avg_loss"), F.round(F.sum(F.when(win, F.col("pnl"))) / F.nullif(F.abs(F.sum(F.when(lost, F.col("pnl")))), F.lit(0.0)), 2).alias("profit_factor"),
        F.round(F.avg("hold_days"), 1).alias("avg_hold_days"), F.round(F.max("pnl_pct"), 4).alias("best"), F.round(F.min("pnl_pct"), 4).alias("worst"),
    )


def benchmark_metrics(equity: DataFrame, initial_cash: float) -> DataFrame:
    held = equity.withColumn("b", F.last("benchmark", ignorenulls=True).over(ever())).where("b IS NOT NULL")
    step = held.withColumn("dd", F.col("b") / F.max("b").over(ever()) - 1)
    agg = step.groupBy("run_id").agg((F.max_by("b", "date") / F.min_by("b", "date") - 1).alias("r"), F.min("dd").alias("dd"), (F.max_by("equity", "date") / initial_cash - 1).alias("own"))
    return agg.select("run_id", F.round("r", 4).alias("benchmark_return"), F.round("dd", 4).alias("benchmark_drawdown"), F.round(F.col("own") - F.col("r"), 4).alias("excess"))


def bucket_of(x: Column, edges: list[float] = EDGES) -> Column:
    """Index of the half-open bin [a, b) that holds x, the last bin closed; null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = F.when((x >= a) & ((x <= b) if i == len(edges) - 2 else (x < b)), F.lit(i)).otherwise(out)
    return out


def trade_histogram(trades: DataFrame, edges: list[float] = EDGES) -> DataFrame:
    """(run_id, bucket, low, high, count) with every bin present."""
    runs = trades.select("run_id").distinct()
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]))
    all_bins = runs.select("run_id", bins.alias("x")).select("run_id", "x.*")
    n = trades.groupBy("run_id", bucket_of(F.col("pnl_pct"), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    return all_bins.join(n, ["run_id", "bucket"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
