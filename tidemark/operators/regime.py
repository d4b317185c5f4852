"""Market regime: the index against its moving average, with confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import carry_forward
from .indicators import sma


def hysteresis(df: DataFrame, flag: str, confirm: int, out: str, order: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """The flag's state, which flips after ``confirm`` equal flags in a row; the flipping row has the new state.

    Runs of equal flags are islands; one that grows to ``confirm`` rows commits its value from there on.
    """
    f = F.coalesce(F.col(flag), F.lit(False))
    w = Window.partitionBy(*by).orderBy(order)
    if confirm <= 1:
        return df.withColumn(out, f)
    step = df.withColumn("_f", f)
    step = step.withColumn("_new", (F.col("_f") != F.coalesce(F.lag("_f").over(w), ~F.col("_f"))).cast("int"))
    step = step.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = step.withColumn("_len", F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order)))
    held = F.last(F.when(F.col("_len") >= confirm, F.col("_f")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn(out, F.coalesce(held, F.first("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_f", "_new", "_run", "_len")


def index_above_ma(days: DataFrame, index: DataFrame, n: int, out: str = "above") -> DataFrame:
    """For each date whether the index closed above its n-session average, carried forward; false where unknown."""
    flags = index.select("code", "date", (F.col("close") > sma(F.col("close"), n)).alias("_above"))
    return carry_forward(days, flags, "_above", out).withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def regime(days: DataFrame, index: DataFrame, n: int, confirm: int = 1) -> DataFrame:
    """(date, regime). n <= 0 switches the gate off: every session is open."""
    if n <= 0:
        return days.select("date", F.lit(True).alias("regime"))
    return hysteresis(index_above_ma(days.select("date"), index, n), "above", confirm, "regime").select("date", "regime")


def index_last_date(index: DataFrame) -> DataFrame:
    return index.agg(F.max("date").alias("last_date"))


