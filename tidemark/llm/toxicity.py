"""Toxicity scores from non-negative positive-unlabelled learning.

Only confirmed toxic examples count as labelled; all other training text is unlabelled, a mixture that holds the class
prior's share of toxic text. The classifier is linear on the presence of word pieces. Its risk is
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: the second term estimates the risk on clean text and is kept from
turning negative, where the fit would only be memorising (the step is then taken uphill on it, as the method asks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, ship, text_of

BUCKETS = 1 << 20
#: Letters that are hashed at once, if a word ends there.
STRETCH = 1 << 18
#: Code points up to here may be letters.
POINTS = 0x32400
#: Base of the hash of a piece, an odd number, and its inverse modulo 2**64.
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
BEGIN, END = 1, 2  # stand before and behind a word


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point belongs to words: letters, and numbers that are no decimal digits."""
    return np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(POINTS))] + [False])


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets, with repeats, of the pieces of the words in these code points.

    A word's pieces are itself, its pieces of 4 and 5 letters from end to end and its longer beginnings, its ends marked. A
    piece's hash is that of its letters as digits of a number, so differences of one running sum give all of them at once.
    """
    letter = letters()[np.minimum(codes, POINTS)]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[True], at[1:] != at[:-1] + 1])
    first = np.flatnonzero(begins)
    word = np.cumsum(begins)
    place = np.arange(len(at)) + 2 * word - 1  # in the line of all marked words
    n = len(at) + 2 * len(first)
    start = place[first] - 1
    end = np.append(start[1:], n) - 1
    line = np.zeros(n, np.uint64)
    line[place] = codes[at].astype(np.uint64) + np.uint64(3)
    line[start], line[end] = BEGIN, END
    size = 1 << int(n).bit_length()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * powers(PRIME, size)[:n])])
    back = powers(INVERSE, size)
    last = np.repeat(end, end - start + 1)
    found = [(total[end + 1] - total[start]) * back[start]]
    for k in (4, 5):
        i = np.flatnonzero(np.arange(n) + (k - 1) <= last)
        found.append((total[i + k] - total[i]) * back[i])
    for k in range(6, 10):
        i = start[start + (k - 1) < end]
        found.append((total[i + k] - total[i]) * back[i])
    h = np.concatenate(found)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(44)).astype(np.int64)


class Pieces:
    """The pieces of texts, of those in ``keep`` if it is given. A text is read to its end, in stretches that end with a word."""

    def __init__(self, keep: Iterable[int] | None = None) -> None:
        self.keep = None
        if keep is not None:
            self.keep = np.zeros(BUCKETS, bool)
            self.keep[list(keep)] = True

    def of(self, text: str) -> np.ndarray:
        """Each piece once, in order."""
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        parts, at = [], 0
        while at < len(codes):
            end, step = at + STRETCH, STRETCH
            while end < len(codes) and letters()[min(codes[end], POINTS)]:
                gaps = np.flatnonzero(~letters()[np.minimum(codes[end : end + step], POINTS)])
                end = end + (gaps[0] if len(gaps) else step)
                step *= 2
            found = buckets(codes[at:end])
            parts.append(np.unique(found if self.keep is None else found[self.keep[found]]))
            at = end
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


@dataclass
class Model:
    weights: dict[int, float]  # bucket -> weight
    bias: float
    prior: float

    def scorer(self) -> Callable[[str], float]:
        """text -> probability of toxic; a text without words gets that of no evidence."""
        known, weight = Pieces(self.weights), np.zeros(BUCKETS)
        weight[list(self.weights)] = list(self.weights.values())
        return lambda text: float(1 / (1 + np.exp(-np.clip(self.bias + weight[known.of(text)].sum(), -30, 30))))


@dataclass
class Examples:
    """Patterns of features: how many rows have each, whether these are confirmed, and the features, one pattern after the other."""

    positive: np.ndarray
    n: np.ndarray
    at: np.ndarray  # features of all patterns in one line
    row: np.ndarray  # the pattern that each belongs to

    @classmethod
    def of(cls, positive: pa.Array, n: pa.Array, features: pa.ListArray) -> Examples:
        sizes = np.diff(features.offsets.to_numpy())
        return cls(positive.to_numpy(zero_copy_only=False).astype(bool), n.to_numpy().astype(float), features.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes))

    @classmethod
    def of_matrices(cls, p: np.ndarray, u: np.ndarray) -> Examples:
        row, at = np.nonzero(np.concatenate([p, u]))
        return cls(np.arange(len(p) + len(u)) < len(p), np.ones(len(p) + len(u)), at, row)

    def sums(self, w: np.ndarray, b: float) -> np.ndarray:
        """One line for unlabelled and one for confirmed rows, summed over them: how often each feature occurs, times the
        probability of toxic; the probabilities; the loss of taking the rows for clean; and, without the probability, the
        features and the rows."""
        z = np.bincount(self.row, w[self.at], len(self.n)) + b
        s = self.n / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = self.n * np.logaddexp(0, z)
        out = []
        for k in (False, True):
            rows = self.positive == k
            mine = rows[self.row]
            at, row = self.at[mine], self.row[mine]
            out.append(np.concatenate([np.bincount(at, s[row], len(w)), [s[rows].sum(), loss[rows].sum()], np.bincount(at, self.n[row], len(w)), [self.n[rows].sum()]]))
        return np.stack(out)


def descend(sums: Callable[[np.ndarray, float], np.ndarray], size: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier that minimises the non-negative risk with the logistic loss (Adam, full batch).

    ``sums`` gives what ``Examples.sums`` says for all rows together, so the rows may lie anywhere.
    """
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        u, p = (x / max(x[-1], 1) for x in sums(w, b))
        clean = u[size + 1] - prior * p[size + 1]
        g = u[: size + 1] - prior * p[: size + 1]  # of the risk on clean text
        # it is left uphill where it is negative; else the risk of missing confirmed rows counts too
        g = -g if clean < 0 else g + prior * (p[: size + 1] - p[size + 2 :])
        g[:size] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float, **how: float) -> tuple[np.ndarray, float]:
    """``descend`` on matrices of 0 and 1: confirmed and unlabelled rows."""
    return descend(Examples.of_matrices(p, u).sums, p.shape[1], prior, **how)


def spread_sums(patterns: DataFrame, size: int) -> Callable[[np.ndarray, float], np.ndarray]:
    """``Examples.sums`` of a table of patterns of any size: each task adds up its own, so that only sums are shuffled."""
    width = 2 * size + 3

    def sums(w: np.ndarray, b: float) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * width)
            for x in batches:
                total += Examples.of(*x.columns).sums(w, b).ravel()
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "v"])

        out = np.zeros(2 * width)
        for r in patterns.mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).toLocalIterator():
            out[r["place"]] = r["v"]
        return out.reshape(2, width)

    return sums


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def piece_counts(texts: DataFrame, keep: frozenset[int] | None = None) -> DataFrame:
    """(piece, n): how many of the texts (column text) have each piece; tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Pieces(keep), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                counts[known.of(t)] += 1
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["piece", "n"])

    return texts.select("text").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_patterns(rows: DataFrame, keep: list[int]) -> DataFrame:
    """(positive, n, features): how many of the rows (columns positive, text) have exactly these of the kept pieces, given by their
    places in ``keep``, a sorted list. Rows with the same pieces are one pattern, most of all those that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = Pieces(keep), np.array(keep)
        for b in batches:
            found = [np.searchsorted(places, known.of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "features"])

    shown = rows.select("positive", "text").mapInArrow(run, "positive boolean, features array<int>")
    return shown.groupBy("positive", "features").agg(F.count(F.lit(1)).alias("n")).select("positive", "n", "features")


def chosen_pieces(docs: DataFrame, confirmed: DataFrame, n_u: int, n_p: int, prior: float, min_confirmed: int) -> list[int]:
    """The pieces that tell most: counted in all confirmed rows and, those that may qualify, in all training rows.

    A piece qualifies where at least ``min_confirmed`` confirmed rows have it and it makes a text likelier toxic than not: the
    prior times its rate among confirmed rows, lowered by one standard error, is over half its rate among all training
    rows, raised by one. (Weaker pieces would add up in long clean texts.) All that qualify stay, in order; there are ``BUCKETS`` at most.
    """
    p = durable(piece_counts(confirmed).where(F.col("n") >= min_confirmed), "pieces")
    keep = frozenset(r["piece"] for r in p.select("piece").toLocalIterator())  # BUCKETS at most
    if not keep:
        return []
    u = piece_counts(docs, keep)
    rate = (F.col("p.n") - F.sqrt(F.col("p.n"))) / n_p
    common = F.coalesce(F.col("u.n"), F.lit(0))
    lift = F.log2(F.greatest(rate, F.lit(1e-9)) / ((common + F.sqrt(common) + 1) / n_u))
    best = p.alias("p").join(u.alias("u"), F.col("p.piece") == F.col("u.piece"), "left").where(lift > log2(0.5 / prior))
    return sorted(r["piece"] for r in best.select("p.piece").toLocalIterator())


#: Most bytes of patterns that are fitted in the driver; more stay where they are and are summed there at each step.
PATTERNS = 64 << 20


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", min_confirmed: int = 5, prior: float | None = None, most: int = PATTERNS) -> Model:
    """Fit on all confirmed toxic rows and on all rows of any kind as unlabelled ones; held-out rows give neither labels nor text.

    Rows are counted by their pattern of features, and the risk is that of all rows. Patterns of up to ``most`` bytes, as counted,
    are fitted in the driver; more are summed where they lie, step by step, with the same result. Repeated rows count each.
    Without ``prior`` it is the share of toxic rows among the labelled ones. Null ids are skipped, null texts count as empty,
    texts of any length are read whole; extra columns are not read. Without a single toxic row, or with empty tables, the
    model knows nothing and scores every text with the prior.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    share = known.agg(F.avg((F.col("y") == 1).cast("double")).alias("p")).first()["p"]
    prior = min(max(prior or share or 0.01, 0.001), 0.5)
    toxic = durable(known.where("y = 1").select("id").distinct(), "toxic")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    confirmed = durable(rows.join(broadcast_if_small(toxic), "id", "left_semi"), "confirmed")
    n_p, n_u = confirmed.count(), rows.count()
    unknowing = Model({}, float(np.log(prior / (1 - prior))), prior)
    keep = chosen_pieces(rows, confirmed, n_u, n_p, prior, min_confirmed) if n_p else []
    if not keep:
        return unknowing

    shown = confirmed.select(F.lit(True).alias("positive"), "text").unionAll(rows.select(F.lit(False).alias("positive"), "text"))
    patterns = durable(piece_patterns(shown, keep), "patterns")
    if patterns.agg(F.sum(24 + 4 * F.size("features"))).first()[0] <= most:
        held = patterns.orderBy("positive", "features").toArrow().combine_chunks()
        sums = Examples.of(*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in held.columns]).sums
    else:
        sums = spread_sums(patterns, len(keep))
    w, b = descend(sums, len(keep), prior)
    return Model({k: float(w[i]) for i, k in enumerate(keep) if w[i] != 0}, b, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from ``threshold`` on). Only the text is an input."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights at most
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score_of(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents, all columns, that score below the threshold. Null and empty texts have the score of no evidence; rows
    are independent, so repeated rows stay or go together; an empty table gives an empty one."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = shared.value.scorer()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([score_of(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
