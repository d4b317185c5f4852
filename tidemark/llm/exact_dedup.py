"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition of the input lays out one run: its distinct digests in order, each with the identifier to retain and the
number of copies. Runs are then merged in binomial rounds. In a round, ``fan_in`` neighbouring groups of partitions
exchange runs: each cuts its run into ``fan_in`` ranges of digests and keeps one of them, so that a cell (group, range)
receives ``fan_in`` sorted runs and merges them in one pass over their common order. After the last round one group is
left, cut into as many ranges as there are partitions, and every digest stands in one place. The number of partitions
grows with the input, a cell holds about as much as a partition, and a text that a third of all rows hold arrives
anywhere as at most ``fan_in`` entries.

An entry is a 64-bit digest verified by the text's SHA-256 and byte length, so entries merge only when the texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, text_of

#: An entry's key, in the order in which runs are sorted.
ENTRY = ["digest", "sha", "bytes"]


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seq, leaf, digest, sha, bytes): each row's digest, its number, and the partition it lies in. Texts are read once."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("seq"))
    return durable(rows.select("id", "seq", F.shiftright("seq", 33).alias("leaf"), F.xxhash64("text").alias("digest"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("bytes")), "digests")


def merge_runs(runs: DataFrame, group: Column, ranges: int, best) -> DataFrame:
    """One round: cells (group, range of digests) receive sorted runs and merge neighbouring entries of one text."""
    part = F.floor((F.shiftrightunsigned("digest", 32) * ranges) / F.lit(2.0**32)).cast("long")
    cells = runs.select(group.alias("cell"), part.alias("part"), *ENTRY, "keep", "n").repartition("cell", "part").sortWithinPartitions("cell", "part", *ENTRY)
    same = Window.partitionBy("cell", "part", *ENTRY)  # the order of the runs; at most one entry of each merged run
    first = F.row_number().over(same.orderBy(F.lit(1)))
    merged = cells.select("cell", *ENTRY, best("keep").over(same).alias("keep"), F.sum("n").over(same).alias("n"), first.alias("at"))
    return merged.where("at = 1").select(F.col("cell").alias("leaf"), *ENTRY, "keep", "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts of any length are hashed whole. Null ids count in group_size but are retained only
    where a group has no other id. Of repeated rows (same id, same text) exactly one is kept. An empty table gives an empty
    result; other columns are not read, so their names cannot clash.
    """
    best = F.max if largest else F.min
    rows = digest_rows(docs, id_col, text_col)
    known = F.col("id").isNotNull() if largest else F.col("id").isNull()  # null ids lose either way
    keep = F.struct(known.alias("known"), "id", "seq")
    leaf_runs = durable(rows.groupBy("leaf", *ENTRY).agg(best(keep).alias("keep"), F.count(F.lit(1)).alias("n")), "runs")
    runs, width, ranges = leaf_runs, (rows.agg(F.max("leaf").alias("m")).first()["m"] or 0) + 1, 1
    while width > 1:
        width, ranges = -(-width // fan_in), ranges * fan_in
        runs = merge_runs(runs, F.floor(F.col("leaf") / fan_in).cast("long"), ranges, best)
    copies = durable(runs.where("n > 1").select(*ENTRY, F.col("keep.id").alias("keep_id"), F.col("keep.seq").alias("keep_seq"), "n"), "copies")
    small = broadcast_if_small(copies)
    if small is copies:  # beyond that the way back goes root -> leaf -> rows, so that a huge group stays spread over the leaves
        on = ["leaf", *ENTRY]
        small = leaf_runs.select(*on).join(copies, ENTRY)
    else:
        on = ENTRY
    return rows.join(small, on, "left").select(
        F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("seq") == F.col("keep_seq"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The documents, all columns, with one row of each group of equal texts, as ``exact_dedup`` keeps it."""
    report = exact_dedup(docs, id_col, text_col, largest).where("NOT kept")
    gone = durable(report.select(F.col(id_col).alias("_gone_id"), F.unhex("text_sha256").alias("_gone_sha"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("_repeats")), "gone")
    others = durable(gone.where("NOT _repeats").drop("_repeats").distinct(), "others")
    rest = docs.join(broadcast_if_small(others), F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.unhex(F.sha2(text_of(text_col), 256)) == F.col("_gone_sha")), "left_anti")
    if gone.where("_repeats").isEmpty():
        return rest
    return rest.withColumn("_text", text_of(text_col)).dropDuplicates([id_col, "_text"]).drop("_text")
