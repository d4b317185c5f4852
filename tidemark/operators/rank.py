"""Cross-sectional ranks per date and what is built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import durable


def average_rank(x: Column, *by: Column | str) -> Column:
    """1-based rank among non-null values of the partition, ties sharing their mean rank."""
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x.asc_nulls_last())) + (ties - 1) / 2)


def cross_rank(x: Column, valid: Column, ties: str = "average", single: float = 0.0, invalid: float = 0.0, by: tuple = ("date",)) -> Column:
    """(rank - 1) / (n - 1) among the valid rows of a date.

    ``ties='ordinal'`` breaks ties by code. A lone row gets ``single``, rows outside the population ``invalid``.
    """
    y = F.when(valid, x)
    w = Window.partitionBy(*by)
    n = F.count(y).over(w)
    rank = average_rank(y, *by) if ties == "average" else F.row_number().over(w.orderBy(y.asc_nulls_last(), F.col("code")))
    return F.when(y.isNull(), F.lit(invalid)).when(n <= 1, F.lit(single)).otherwise((rank - 1) / (n - 1))


def value_places(df: DataFrame, x: str, by: tuple[str, ...]) -> DataFrame:
    """(by..., x, n, _part): how often each value occurs, laid out in ranges of (by, x); written, so that parts stay what they are.

    Equal values meet by aggregation, first inside each task, so a value that many rows share costs no task more than others.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    return durable(counts.repartitionByRange(*by, x).sortWithinPartitions(*by, x).withColumn("_part", F.spark_partition_id()), "places")


def ranged_rank(df: DataFrame, x: str, by: tuple[str, ...] = ("date",), out: str = "rank", total: str = "total") -> DataFrame:
    """``average_rank`` and the number of ranked rows, for cross sections too large for one task.

    A cross section's values stand in ranges; a value's rank is the number of rows in the ranges before its own, which are
    added up once a range, plus those before it in its range. Ties are exact across ranges, since a value stands in one.
    """
    places = value_places(df, x, by)
    parts = places.groupBy(*by, "_part").agg(F.sum("n").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_at"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.sum("_rows").over(Window.partitionBy(*by)).alias(total))
    here = places.withColumn("_run", F.sum("n").over(Window.partitionBy("_part", *by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))
    same = lambda a, b: a.eqNullSafe(b)
    on = F.col("_part") == F.col("_at")
    for c in by:
        on = on & same(F.col(c), F.col(f"_{c}"))
    ranked = here.join(parts, on).select(*[F.col(c).alias(f"_{c}") for c in by], F.col(x).alias("_value"), (F.col("_offset") + F.col("_run") - (F.col("n") - 1) / 2).alias(out), total)
    on = F.col(x) == F.col("_value")
    for c in by:
        on = on & same(F.col(c), F.col(f"_{c}"))
    return df.join(ranked, on, "left").drop("_value", *[f"_{c}" for c in by])


def ranged_cross_rank(df: DataFrame, x: Column, valid: Column, out: str, single: float = 0.0, invalid: float = 0.0, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """``cross_rank`` with shared ties over cross sections of any size."""
    ranked = ranged_rank(df.withColumn("_y", F.when(valid, x)), "_y", by, "_rank", "_total")
    value = F.when(F.col("_y").isNull(), F.lit(invalid)).when(F.col("_total") <= 1, F.lit(single)).otherwise((F.col("_rank") - 1) / (F.col("_total") - 1))
    return ranked.withColumn(out, value).drop("_y", "_rank", "_total")


def blend(df: DataFrame, fields: list[tuple[str, float]], valid: Column, out: str = "score", ties: str = "average", single: float = 0.0, missing: float | None = None) -> DataFrame:
    """Weighted mean of the fields' cross-sectional ranks; rows outside the population get ``missing``."""
    total = sum(w for _, w in fields)
    names = {f"_r{i}": cross_rank(F.col(f), valid, ties, single) for i, (f, _) in enumerate(fields)}
    score = sum((F.col(f"_r{i}") * w for i, (_, w) in enumerate(fields)), F.lit(0.0)) / (total or 1.0)
    return df.withColumns(names).withColumn(out, F.when(valid, score).otherwise(F.lit(missing))).drop(*names)


def rank_ic(df: DataFrame, f: str, r: str, mask: Column, by: tuple = ("date",), least: int = 30) -> DataFrame:
    """Rank correlation of two columns per date, over dates with at least ``least`` values of f.

    Both sides are ranked and centred over their own non-null rows; products are summed over the rows that have both.
    """
    ranked = df.select(*by, F.when(mask, F.col(f)).alias("_f"), F.when(mask, F.col(r)).alias("_r"))
    ranked = ranked.withColumns({"_f": average_rank(F.col("_f"), *by), "_r": average_rank(F.col("_r"), *by)})
    w = Window.partitionBy(*by)
    centred = ranked.withColumns({"_f": F.col("_f") - F.avg("_f").over(w), "_r": F.col("_r") - F.avg("_r").over(w)})
    sums = centred.groupBy(*by).agg(F.count("_f").alias("n"), F.sum(F.col("_f") * F.col("_r")).alias("fr"), F.sum(F.col("_f") * F.col("_f")).alias("ff"), F.sum(F.col("_r") * F.col("_r")).alias("rr"))
    return sums.where(F.col("n") >= least).select(*by, "n", (F.col("fr") / F.nullif(F.sqrt(F.col("ff") * F.col("rr")), F.lit(0.0))).alias("ic")).where("ic IS NOT NULL")
