"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..shared import durable, shared_folder

__all__ = ["ascii_lower", "broadcast_if_small", "durable", "shared_folder", "ship", "table", "text_of", "weight"]

#: ASCII capitals and their small letters (fixed values).
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take Spark's fast path; the rest are translated letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Most bytes of a table that is broadcast.
SMALL = 96 << 20


def weight(df: DataFrame) -> int:
    """Bytes that the rows of ``df``, a table of plain columns, take in a hash table: counted, not estimated."""
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    found = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.octet_length(F.col(c))).alias(f"b{i}") for i, c in enumerate(wide)]).first()
    return found["n"] * (48 + 8 * len(df.columns)) + sum(found[f"b{i}"] or 0 for i in range(len(wide)))


def broadcast_if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, a table that was written before, to be broadcast if its counted bytes are at most ``most``."""
    return F.broadcast(df) if weight(df) <= most else df
