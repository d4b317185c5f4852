"""Two lists of trades held against one another, run by run, as an ordered zip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(trades: DataFrame, order: list[str], fields: list[str], side: str) -> DataFrame:
    """(run_id, k, <side>_field...): a run's trades numbered in order; equal places are ordered by all fields."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(*order, *[f for f in fields if f not in order]))
    return trades.select("run_id", place.alias("k"), F.lit(True).alias(f"_{side}"), *[F.col(f).alias(f"{side}_{f}") for f in fields])


def differs(field: str, kind: str, tolerance: float) -> Column:
    """Unlike values; null equals null only, and doubles may differ by the tolerance, relative to the larger one from one on."""
    a, b = F.col(f"left_{field}"), F.col(f"right_{field}")
    if kind in ("double", "float"):
        far = F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
        return (a.isNull() != b.isNull()) | F.coalesce(far, F.lit(False))
    return ~a.eqNullSafe(b)


def zipped(left: DataFrame, right: DataFrame, order: list[str], fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(run_id, k, status, field, left_..., right_...): trades of both lists at one place; ``field`` is the first that differs.

    status: same, different, left_only, right_only. Runs and places that one list lacks are kept.
    """
    kinds = dict(left.dtypes)
    both = numbered(left, order, fields, "left").join(numbered(right, order, fields, "right"), ["run_id", "k"], "full_outer")
    field = F.coalesce(*[F.when(differs(f, kinds[f], tolerance), F.lit(f)) for f in fields])
    status = F.when(F.col("_right").isNull(), "left_only").when(F.col("_left").isNull(), "right_only").when(field.isNotNull(), "different").otherwise("same")
    step = both.withColumn("status", status).withColumn("field", F.when(F.col("status") == "different", field))
    return step.select("run_id", "k", "status", "field", *[f"{side}_{f}" for side in ("left", "right") for f in fields])


def reconcile(left: DataFrame, right: DataFrame, order: list[str], fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row a run: trades of each list, places that agree, unmatched trades, and the first place that does not agree.

    first_k, first_status and first_field are null where the lists are the same; ``equal`` says so.
    """
    z = zipped(left, right, order, fields, tolerance)
    count = lambda s: F.count_if(F.col("status") == s)
    bad = F.when(F.col("status") != "same", F.col("k"))
    out = z.groupBy("run_id").agg(
        (F.count(F.lit(1)) - count("right_only")).alias("n_left"), (F.count(F.lit(1)) - count("left_only")).alias("n_right"), count("same").alias("same"), count("different").alias("different"),
        count("left_only").alias("left_only"), count("right_only").alias("right_only"), F.min(bad).alias("first_k"), F.min_by("status", bad).alias("first_status"), F.min_by("field", bad).alias("first_field"),
    )
    return out.withColumn("equal", F.col("first_k").isNull())
