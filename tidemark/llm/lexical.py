"""Ranked lexical search by bag deduplication.

A query set (benchmark items) ranks all documents. Only words of the items can score, so a document shrinks to its bag: the
counts of item words in it, and a length class m. Documents with equal bags and m score alike for every item; they form one
class, which is hashed, verified by the bag itself and scored once. The best classes of each item are then expanded to
their members by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import UPPER, broadcast_if_small, durable, ship, text_of

#: Most bytes of item texts that are searched for in one scan of the documents; what goes to the tasks is bounded by them.
BLOCK = 4 << 20
#: Bytes of a text that are split into words at once, so that long texts stay in bounded memory.
PIECE = 1 << 20
#: Cells (classes times items) and postings that are scored at once.
CELLS = 1 << 21
#: Bytes to bytes: ASCII capitals to small letters, every other ASCII byte but letters and digits to a space.
WORDS = bytes(c + 32 if chr(c) in UPPER else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased terms of a UTF-8 text, in pieces: runs of ASCII letters, digits and characters beyond ASCII."""
    text, at = text.translate(WORDS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, bag): a document's number of terms, and pairs (term number, count) of the vocabulary as 32-bit numbers, sorted."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def bag(text: bytes) -> tuple[int, bytes]:
        n, known, count = 0, sent.value.get, Counter()
        for words in words_of(text):
            n += len(words)
            count.update(map(known, words))
        del count[None]
        return n, np.array(sorted(count.items()), "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [bag(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "n", "bag"])

    return docs.mapInArrow(run, "id long, n long, bag binary")


def frequencies(rows: DataFrame) -> dict[int, int]:
    """Documents that hold each term of the vocabulary: counted in the tasks, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            pairs = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(-1, 2)
            new = np.bincount(pairs[:, 0].astype(np.int64), minlength=len(total))
            new[: len(total)] += total
            total = new
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    found = rows.where("octet_length(bag) > 0").select("bag").mapInArrow(run, "term long, df long")
    return {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Best:
    """The k best classes of each item so far: higher scores first, then the class whose first member comes first."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.most = k, np.zeros(items, np.int64), max(200_000, 4 * k * items)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, item: np.ndarray, score: np.ndarray, *of: np.ndarray) -> None:
        self.held.append((item, score, *of))
        self.size += len(item)
        if self.size > self.most:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...] | None:
        if not self.held:
            return None
        item, score, first, nul, *rest = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((first, ~nul, -score, item))
        item = item[order]
        keep = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        order = order[keep]
        all_of = (item[keep], score[order], first[order], nul[order], *(x[order] for x in rest))
        full = np.bincount(all_of[0], minlength=len(self.least)) == self.k
        last = np.searchsorted(all_of[0], np.nonzero(full)[0], "right") - 1
        self.least[full] = all_of[1][last]
        self.held, self.size = [all_of], len(order)
        return all_of


def best_classes(classes: DataFrame, items: pa.Array, postings: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray, longest: int, k: int, kind: str) -> DataFrame:
    """(item, score, h, m, first, nul): each task's k best classes of every item.

    Each class meets the postings of its own terms only. Sums are exact: in doubles while below 2**53, else in two halves.
    """
    sent = classes.sparkSession.sparkContext.broadcast((postings, weights))
    one = int(weights.max(initial=0)) * 10**6 * longest < 1 << 53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (starts, of, times), w = sent.value
        n, best = len(items), Best(len(items), k)
        for b in batches:
            h, m, first, nul = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            found = b.column(2).to_pylist()
            pairs = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2).astype(np.int64)
            row = np.repeat(np.arange(len(found)), [len(x) // 8 for x in found])
            term, tf = pairs[:, 0], pairs[:, 1]
            value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
            reach = np.concatenate([[0], np.cumsum(starts[term + 1] - starts[term])])
            bounds = np.searchsorted(row, np.arange(len(found) + 1))
            at = 0
            while at < len(found):
                end = max(at + 1, min(at + max(1, CELLS // n), int(np.searchsorted(reach[bounds], reach[bounds[at]] + CELLS, "right")) - 1))
                lo, hi = bounds[at], bounds[end]
                size = starts[term[lo:hi] + 1] - starts[term[lo:hi]]
                post = np.arange(size.sum()) + np.repeat(starts[term[lo:hi]] - (reach[lo:hi] - reach[lo]), size)
                cell = np.repeat(row[lo:hi] - at, size) * n + of[post]
                part = np.repeat(value[lo:hi], size) * times[post]
                if one:
                    score = np.bincount(cell, part, (end - at) * n).astype(np.int64)
                else:
                    score = (np.bincount(cell, part >> 24, (end - at) * n).astype(np.int64) << 24) + np.bincount(cell, part & 0xFFFFFF, (end - at) * n).astype(np.int64)
                score = score.reshape(-1, n)
                i, j = np.nonzero((score > 0) & (score >= best.least))
                best.add(j, score[i, j], first[at + i], nul[at + i], h[at + i], m[at + i])
                at = end
        if (out := best.prune()) is not None:
            j, score, first, nul, h, m = out
            yield pa.RecordBatch.from_arrays([items.take(pa.array(j)), *map(pa.array, (score, h, m, first, nul))], ["item", "score", "h", "m", "first", "nul"])

    return classes.mapInArrow(run, f"item {kind}, score long, h long, m long, first long, nul boolean")


def blocks(items: DataFrame, block: int) -> Iterator[list]:
    """The items' (item, text) rows in blocks of at most ``block`` bytes, or of one item that is larger."""
    size = items.groupBy("item").agg(F.sum(F.octet_length("text")).alias("size"))
    n = max(1, -(-(size.agg(F.sum("size")).first()[0] or 0) // block))
    part = lambda n: F.pmod(F.xxhash64("item"), F.lit(n))
    while n > 1 and size.groupBy(part(n)).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > block) & (F.col("n") > 1)).limit(1).count():
        n *= 2
    for i in range(n):
        yield items.where(part(n) == i).collect()


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Each item's ``k`` highest-scoring documents: item, rank (from 1), id and score; only scores above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that have a term,
    L terms in all and df documents with a term, its weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms
    has m = 75 + 25 n N div L and scores, for each of the item's terms, weight * (10**9 tf div (1000 tf + 12 m)).

    Ids are integers. Equal scores rank by ascending id, a null id first. Every row is a document of its own, so repeated
    rows take a rank each. Null and empty texts have no terms and never score; rows that share an item id (null included)
    form one item, whose terms are those of all its rows; an item without known terms gives no row. Empty tables give an
    empty result. Other columns are not read. Items are searched for in blocks of ``block`` bytes of text, one scan each.
    """
    spark = docs.sparkSession
    ship(spark)
    field = queries.schema[item_col]
    kind, arrow = field.dataType.simpleString(), to_arrow_type(field.dataType)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    found = None
    for rows in blocks(queries.select(F.col(item_col).alias("item"), text_of(item_text_col).alias("text")), block):
        part = _search(texts, rows, kind, arrow, k)
        found = part if found is None else found.unionAll(part)
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search(texts: DataFrame, rows: list, kind: str, arrow: pa.DataType, k: int) -> DataFrame:
    counts: dict[object, Counter] = {}
    for r in rows:
        for words in words_of(r["text"].encode()):
            counts.setdefault(r["item"], Counter()).update(words)
    if not counts:
        return texts.sparkSession.createDataFrame([], f"item {kind}, rank int, id long, score long")
    items = pa.array(list(counts), arrow)
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts.values())))}
    triples = np.array(sorted((vocabulary[t], i, c) for i, of in enumerate(counts.values()) for t, c in of.items()), np.int64).reshape(-1, 3)
    postings = np.searchsorted(triples[:, 0], np.arange(len(vocabulary) + 1)), triples[:, 1], triples[:, 2]

    docs = durable(bags(texts, vocabulary), "bags")
    total = docs.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n, length = total["docs"], max(1, total["terms"] or 0)
    df = frequencies(docs)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)

    m = F.expr(f"75 + (cast(n as decimal(20,0)) * {25 * n}BD) div {length}BD")
    docs = docs.where("octet_length(bag) > 0").select("id", m.alias("m"), "bag").withColumn("h", F.xxhash64("bag", "m"))
    # Equal bags meet by aggregation, first inside each task; grouping by the bag itself verifies the hash.
    classes = docs.groupBy("h", "m", "bag").agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("nul")).select("h", "m", "bag", F.coalesce("first", F.lit(0)).alias("first"), "nul")
    longest = max((sum(c.values()) for c in counts.values()), default=0)
    best = best_classes(classes, items, postings, weights, longest, k, kind)
    # All of an item's k best documents lie in its k best classes, ordered by score and first member.
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.desc("nul"), "first"))
    best = durable(best.withColumn("at", rank).where(F.col("at") <= k).drop("at"), "best")

    key = ["h", "m", "first", "nul"]
    some = docs.join(broadcast_if_small(best.select("h", "m").distinct()), ["h", "m"], "left_semi")
    nul = F.col("id").isNull()
    named = some.join(broadcast_if_small(best.select(*key).distinct()), ["h", "m"]).where(F.when(F.col("nul"), nul).otherwise(F.col("id") == F.col("first")))
    named = durable(named.select(*key, "bag").distinct(), "named")
    members = some.join(broadcast_if_small(named), ["h", "m", "bag"]).select(*key, "id")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("id")))
    members = members.withColumn("at", place).where(F.col("at") <= k).drop("at")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    return best.join(members, key).withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "id", "score")
