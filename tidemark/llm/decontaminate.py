"""Benchmark decontamination with a broadcast hash set of test n-grams.

The windows of the benchmark (n consecutive words; a shorter item is one window) are hashed and broadcast. Every
document's words are scanned: the hash of each position's window probes the set, and a hit counts only after the words
themselves were compared. The distinct windows go out in blocks whose counted bytes stay within ``block_bytes`` (one
window's list of items may exceed it alone); a larger benchmark takes more scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, durable, text_of

#: What separates words: every ASCII character but digits and letters (fixed value).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def window_hashes(words: Column, n: int) -> Column:
    """Hash of the n words from each position on; empty where there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n)))


def benchmark_windows(bench: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(h, size, window, items): each distinct window once, with the sorted ids of the items that hold it."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words_of(text_of(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    cut = items.select("item", F.least(F.size("w"), F.lit(n)).alias("size"), F.explode(F.transform(starts, lambda i: F.slice("w", i, F.least(F.size("w"), F.lit(n))))).alias("window"))
    return cut.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.xxhash64("window").alias("h"), "size", "window", "items")


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", n: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """One row per distinct (id, text) that has a hit: id, digest, spans (sorted [start, end) in words), items (sorted).

    First the hashes of all positions probe the broadcast set; only a position and its hash leave that scan, so the work is
    linear in a text's length. Then the few texts with candidate positions are read again, each candidate window is cut out
    once, and counts where its words equal those of the benchmark.
    """
    windows = durable(benchmark_windows(bench, item_col, bench_text_col, n), "windows")
    size = F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 96
    blocks = max(1, -(-(windows.agg(F.sum(size.cast("long")).alias("b")).first()["b"] or 0) // block_bytes))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # n sizes at most
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("digest"), "text")
    block = F.pmod(F.col("h"), F.lit(blocks))
    parts = [windows.where(block == b) if blocks > 1 else windows for b in range(blocks)]
    words = rows.select("id", "digest", words_of(F.col("text")).alias("words"))
    found = [
        words.select("id", "digest", F.posexplode(window_hashes(F.col("words"), k)).alias("pos", "h")).join(F.broadcast(part.where(F.col("size") == k).select("h").distinct()), "h", "left_semi").select("id", "digest", "pos", F.lit(k).alias("size"))
        for part in parts for k in sizes
    ]
    if not found:
        return rows.select("id", "digest", F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("end"))).alias("spans"), F.array(F.lit("")).alias("items")).where("false")
    at = durable(reduce(DataFrame.unionAll, found).groupBy("id", "digest").agg(F.collect_set(F.struct("pos", "size")).alias("at")).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "at"), "candidates")
    texts = rows.join(F.broadcast(at) if at.count() * 128 + _positions(at) * 16 <= block_bytes else at, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    held = texts.select("id", "digest", "at", words_of(F.col("text")).alias("words"))
    cut = held.select("id", "digest", F.explode(F.transform("at", lambda a: F.struct(a["pos"].alias("pos"), (a["pos"] + a["size"]).alias("end"), F.slice("words", a["pos"] + 1, a["size"]).alias("window")))).alias("c"))
    cut = cut.select("id", "digest", "c.pos", "c.end", "c.window", F.xxhash64("c.window").alias("h"))
    cut = durable(cut, "cut") if blocks > 1 else cut
    true = [cut.join(F.broadcast(part.select("h", "window", "items")), ["h", "window"]).select("id", "digest", "pos", "end", "items") for part in parts]
    return reduce(DataFrame.unionAll, true).groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("pos", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _positions(at: DataFrame) -> int:
    return at.agg(F.sum(F.size("at").cast("long")).alias("n")).first()["n"] or 0


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", n: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words and no hit; null benchmark texts have no window; a null item id is not listed.
    Documents that repeat an id are told apart by their texts. Short items match as one window of their own length.
    """
    found = hits(docs, bench, id_col, text_col, item_col, bench_text_col, n, block_bytes)
    sums = found.select("id", "digest", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("list"))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    on = rows["id"].eqNullSafe(sums["id"]) & (rows["digest"] == sums["digest"])
    n_hit = F.coalesce(sums["n_hit"], F.lit(0).cast("long"))
    return rows.join(sums, on, "left").select(
        rows["id"].alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", n: int = 10, remove: str = "documents", block_bytes: int = 64 << 20) -> DataFrame:
    """The documents, all columns, without contaminated ones (``documents``) or without the hit words (``spans``).

    With ``spans`` the words of a hit and the gaps between them go; everything else of the text stays as it was.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    found = hits(docs, bench, id_col, text_col, item_col, bench_text_col, n, block_bytes).select(F.col("id").alias("_hit_id"), F.col("digest").alias("_hit_digest"), F.col("spans").alias("_hit_spans"))
    on = F.col(id_col).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(text_of(text_col)) == F.col("_hit_digest"))
    if remove == "documents":
        return docs.join(broadcast_if_small(durable(found.drop("_hit_spans"), "hits")), on, "left_anti")
    text, spans = text_of(text_col), F.col("_hit_spans")
    gaps, words = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    inside = lambda i: F.exists(spans, lambda s: (s["pos"] <= i) & (i < s["end"]))
    rest = F.transform(words, lambda w, i: F.when(inside(i), F.when(inside(i + 1), "").otherwise(F.element_at(gaps, i + 2))).otherwise(F.concat(w, F.element_at(gaps, i + 2))))
    clean = F.concat(F.element_at(gaps, 1), F.array_join(rest, ""))
    return docs.join(found, on, "left").select(*[F.when(spans.isNotNull(), clean).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
