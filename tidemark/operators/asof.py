"""Backward as-of joins: values are carried along a line per code, or spans of a short series are looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def load_reports(facts: DataFrame, codes: list[str] | DataFrame | None = None, start=None) -> DataFrame:
    """Reports of the codes (None or an empty list: all) that became known on ``start`` or later."""
    out = facts if start is None else facts.where(F.col("avail_date") >= F.lit(start))
    if isinstance(codes, DataFrame):
        return out.join(codes.select("code").distinct(), "code", "left_semi")
    return out.where(F.col("code").isin(*codes)) if codes else out


def known_values(facts: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(code, date, _v_field...): what became known of a code on a day; of several reports the later period (yyyyMMdd) counts."""
    period = F.col("period").try_cast("int")
    return facts.groupBy("code", F.col("avail_date").alias("date")).agg(*[F.max_by(F.col(f).cast("double"), F.when(F.col(f).isNotNull(), period)).alias(f"_v_{f}") for f in fields])


def point_in_time(rows: DataFrame, facts: DataFrame, fields: dict[str, str], bucket: Column | None = None) -> DataFrame:
    """Add to rows (code, date, ...) the latest known value of each field; ``fields`` maps fields to new names.

    Each field carries its own last non-null report; of reports that become known on one day the later period counts. Rows
    and reports stand in one line per code and day, reports first, and the last value so far is carried along: one shuffle by
    code and one pass whatever the number of fields, rows or reports.

    ``bucket``, a rising function of the date such as its year, splits a code's line into pieces for different tasks: what was
    last known in each bucket is handed on to the buckets after it, one row a bucket.
    """
    line = rows.withColumn("_row", F.lit(1)).unionByName(known_values(facts, fields).withColumn("_row", F.lit(0)), allowMissingColumns=True)
    values = [f"_v_{f}" for f in fields]
    if bucket is None:
        so_far = Window.partitionBy("code").orderBy("date", "_row").rowsBetween(Window.unboundedPreceding, 0)
        carried = line.select(*rows.columns, "_row", *[F.last(v, ignorenulls=True).over(so_far).alias(out) for v, out in zip(values, fields.values())])
        return carried.where("_row = 1").drop("_row")
    line = line.withColumn("_bucket", bucket)
    ends = line.groupBy("code", "_bucket").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("date"))).alias(v) for v in values])
    earlier = Window.partitionBy("code").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(F.col("code").alias("_code"), F.col("_bucket").alias("_at"), *[F.last(v, ignorenulls=True).over(earlier).alias(f"_e{v}") for v in values])
    so_far = Window.partitionBy("code", "_bucket").orderBy("date", "_row").rowsBetween(Window.unboundedPreceding, 0)
    carried = line.select(*rows.columns, "_row", "_bucket", *[F.last(v, ignorenulls=True).over(so_far).alias(f"_c{v}") for v in values]).where("_row = 1")
    joined = carried.join(handed, F.col("code").eqNullSafe(F.col("_code")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_c{v}", f"_e{v}").alias(out) for v, out in zip(values, fields.values())])


def carry_forward(rows: DataFrame, series: DataFrame, value: str, out: str) -> DataFrame:
    """Add to rows (date) the last value of a short series (date, value) at or before the date."""
    spans = series.select(F.col("date").alias("_from"), F.col(value).alias(out)).withColumn("_to", F.lead("_from").over(Window.orderBy("_from")))
    return rows.join(F.broadcast(spans), (F.col("date") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("date") < F.col("_to"))), "left").drop("_from", "_to")
