"""Language-model scores from a log-frequency Bloom filter.

Counts of unigrams and bigrams over all training documents are quantised to log_base(count) and stored in a Bloom filter:
an n-gram of level q is entered with the marks 1..q. Its count is read back by probing mark after mark until one misses.
Nothing but bits is kept, so millions of n-grams fit in a broadcast. Probabilities are interpolated from the read counts.
Each n-gram's bits lie in one segment of the filter, so tasks build whole segments and nobody holds all n-grams. The filter
grows with the n-grams without bound: up to ``max_filter_mb`` it is broadcast; a larger one stays a table, of which each
task loads one shelf (a range of segments) and answers the probes that were sent to it. Both ways read the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, ship, text_of

BASE = 2.0
SEGMENT_BITS = 1 << 18
PROBES = 4
#: Bits for an entry; with 4 probes about 2.4 % of absent marks are found by chance.
BITS_PER_ENTRY = 8
LEVELS = 40
#: Buckets that a task sends in one batch, and keys in a row of a bucket's counts: values of some 50 kB are no burden to a JVM.
SENT, STRETCH = 64, 8192
#: Training text, in bytes, whose n-grams make up one bucket, the unit in which n-grams are dealt out to tasks.
BUCKET_BYTES = 1 << 20
#: Segments that a task builds before it hands them on (256 kB each). A bucket covers a few neighbouring ones.
BUILT = 48
#: Weight of the bigram against the unigram.
LAMBDA = 0.6
END = b"\n"  # no word holds white space, so this is no word
#: Tokens looked up at once in a broadcast filter, and tokens whose n-grams are sent to a larger one as one piece: the longer it is,
#: the fewer of them are new.
PIECE, SENT_PIECE = 200_000, 1_000_000
REMEMBERED = 150_000
#: Tokens that a task holds before it adds them up and hands them on.
COUNTED = 600_000


def tokens_of(text: str) -> list[bytes]:
    """Words with A-Z lowered, then one end. bytes.lower and bytes.split know ASCII letters and white space only."""
    words = text.encode().lower().split()
    words.append(END)
    return words


class Hashes(dict):
    """64-bit hash of each token."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a multiply-and-shift finaliser)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: Last bits of a bigram's key that are zero: 48 bits tell bigrams apart far better than the filter does. Bytes of it that are sent.
UNUSED = 16
PACKED = 7 - UNUSED // 8
END_HASH = np.uint64(xxhash.xxh64_intdigest(END, 1))


def bigrams(h: np.ndarray, before_first: np.uint64 = END_HASH) -> np.ndarray:
    """Keys of the pairs (previous token, token). Before a text's first token stands an end, as between texts that follow."""
    before = np.concatenate([[before_first], h[:-1]]).astype(np.uint64)
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + mix(h)) >> np.uint64(UNUSED) << np.uint64(UNUSED)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers without sign as their number and their bytes, all first ones, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def steps(key: np.ndarray) -> bytes:
    """Keys in rising order as the steps between them: some four bytes a bigram of a piece. Bits that no bigram key has are zero and cost nothing."""
    return squeeze(np.diff(key, prepend=np.uint64(0)))


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


# ---- counts ---------------------------------------------------------------------------------------------------------


def _sums(key: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in rising order, with the sum of its counts (None: how often it stands there)."""
    if c is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(c[order], first) if len(key) else np.zeros(0, np.int64)


def _rows(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for each stretch between two cuts of ``values``."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(values)])


def _pack(key: np.ndarray) -> np.ndarray:
    """The bytes of bigram keys that are sent: those between the bucket's first byte and the bits that no bigram key has."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, UNUSED // 8 : 7]


def _unpack(data: bytes, top: int) -> np.ndarray:
    out = np.zeros((len(data) // PACKED, 8), np.uint8)
    out[:, UNUSED // 8 : 7] = np.frombuffer(data, np.uint8).reshape(-1, PACKED)
    out[:, 7] = top
    return out.view("<u8").ravel().astype(np.uint64)


def ngram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each STRETCH keys of a bucket: its n-grams packed (one: unigram keys, c: their counts; two: bigram keys, q: their levels), and the sums that
    size a model (tokens, vocabulary, entries).

    Counts are added up in the task before the one shuffle, which sends a row for each bucket that a task has seen: five bytes
    a bigram and its count, no row for each n-gram. Buckets go by the first bits of the key, so that one holds a whole stretch
    of the filter; their number grows with the text, so that one stays small.
    """
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)).cast("long")).alias("b")).first()["b"] or 0
    bits = max(10, (size // BUCKET_BYTES).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held[0]:
                return
            found = []
            for parts in held:
                found.append(_sums(np.concatenate(parts)))
                parts.clear()
            (one, c), (two, d) = found
            at, bt = one >> np.uint64(64 - bits), two >> np.uint64(64 - bits)
            bucket = np.union1d(at, bt)
            i, j = (np.append(np.searchsorted(x, bucket), len(x)) for x in (at, bt))
            sent = pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), _rows(one, i), _rows(c.astype("<u4"), i), _rows(_pack(two), j), _rows(d.astype("<u4"), j)], ["bucket", "one", "c", "two", "d"])
            for start in range(0, len(bucket), SENT):
                yield sent.slice(start, SENT)

        for b in batches:
            for text in b.column(0).to_pylist():
                h = hashes.of(tokens_of(text))
                held[0].append(h)
                held[1].append(bigrams(h))
                size += len(h)
                if size > COUNTED:
                    yield from out()
                    size = 0
        yield from out()

    def add(group: pa.Table) -> pa.Table:
        bucket, one, c, two, d = (group.column(i).to_pylist() for i in range(5))
        top = bucket[0] >> (bits - 8)
        key, count = _sums(np.frombuffer(b"".join(one), np.uint64), np.frombuffer(b"".join(c), "<u4").astype(np.int64))
        pair, times = _sums(_unpack(b"".join(two), top), np.frombuffer(b"".join(d), "<u4").astype(np.int64))
        q, rows = levels_of(times), []
        for at in range(0, max(len(key), len(pair)), STRETCH):
            k, n, p, m = (x[at : at + STRETCH] for x in (key, count, pair, q))
            rows.append((top, k.tobytes(), n.tobytes(), _pack(p).tobytes(), m.tobytes(), int(n.sum()), len(k), int(levels_of(n).sum(dtype=np.int64) + m.sum(dtype=np.int64))))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3])], ["top", "one", "c", "two", "q", "tokens", "vocabulary", "entries"])

    seen = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "bucket int, one binary, c binary, two binary, d binary")
    return seen.groupBy("bucket").applyInArrow(add, "top int, one binary, c binary, two binary, q binary, tokens long, vocabulary long, entries long")


# ---- the filter -----------------------------------------------------------------------------------------------------


def levels_of(c: np.ndarray) -> np.ndarray:
    """1 + floor(log_base(c)): how many marks a count enters."""
    return np.minimum(np.floor(np.log2(c) / np.log2(BASE) + 1e-9).astype(np.uint8) + 1, LEVELS).astype(np.uint8)


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    """By the first 32 bits of the key, which is a hash, so that keys of a bucket lie in neighbouring segments."""
    return ((key >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def places(key: np.ndarray, mark: int | np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each key and its PROBES bit places in it for a mark."""
    segment = segment_of(key, segments)
    h = mix(key + np.asarray(mark, np.uint64) * np.uint64(0x9FB21C651E98DF25))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return segment, (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(SEGMENT_BITS - 1)


@dataclass
class Filter:
    """The segments from ``first`` on of a filter of ``segments`` segments."""

    bits: np.ndarray  # (segments held, SEGMENT_BITS / 8) bytes
    first: int
    segments: int

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Highest level of each key, whose segment must be held, up to which all marks are found; 0 if none is."""
        found = np.zeros(len(key), np.uint8)
        open_, flat = np.arange(len(key)), self.bits.ravel()
        for mark in range(1, LEVELS + 1):
            segment, bit = places(key[open_], mark, self.segments)
            start = (segment - np.uint64(self.first)) * np.uint64(SEGMENT_BITS // 8)
            for probe in range(PROBES):  # those that miss are not asked again
                b = bit[:, probe]
                hit = (flat[(start + (b >> np.uint64(3))).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                open_, start, bit = open_[hit], start[hit], bit[hit]
            if not len(open_):
                break
            found[open_] = mark
        return found


#: The count that a level stands for: the middle of its range.
MIDDLE = np.array([0.0, 1.0] + [(BASE ** (q - 1) + BASE**q - 1) / 2 for q in range(2, LEVELS + 1)])


@dataclass
class Model:
    table: DataFrame  # (segment, bits), possibly several rows a segment, to be or-ed
    segments: int
    tokens: int
    vocabulary: int

    def load(self) -> Filter:
        """The whole filter, for a broadcast; callers check its size first."""
        bits = np.zeros((self.segments, SEGMENT_BITS // 8), np.uint8)
        for r in self.table.toLocalIterator():
            bits[r["segment"]] |= np.frombuffer(r["bits"], np.uint8)
        return Filter(bits, 0, self.segments)


@dataclass
class Question:
    """The n-grams that a stretch of tokens needs, each once, and the probabilities once their levels are known."""

    keys: np.ndarray  # unigrams, then bigrams
    unigrams: int
    token: np.ndarray  # of the token before the stretch and of each token: place of its unigram
    pair: np.ndarray  # of each token: place of its bigram

    @staticmethod
    def of(h: np.ndarray, before_first: np.uint64) -> Question:
        one, token = np.unique(np.concatenate([np.array([before_first], np.uint64), h]), return_inverse=True)
        two, pair = np.unique(bigrams(h, before_first), return_inverse=True)
        return Question(np.concatenate([one, two]), len(one), token, pair)

    def log10(self, levels: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
        """Of each token after the one before it: the bigram's share, smoothed by the unigram's."""
        c = MIDDLE[levels]
        one, two = c[: self.unigrams][self.token], c[self.unigrams :][self.pair]
        unigram = (one[1:] + 1) / (tokens + vocabulary + 1)
        return np.log10(LAMBDA * np.minimum(two / np.maximum(one[:-1], 1), 1.0) + (1 - LAMBDA) * unigram)


def train(docs: DataFrame, text_col: str = "text", bits_per_entry: int = BITS_PER_ENTRY) -> tuple[Model, DataFrame]:
    """The model of all documents, and the exact unigram counts (key, c) it was read from.

    Every n-gram enters the filter, whose segments grow with their number. An empty table gives an empty model.
    """
    counts = durable(ngram_counts(docs, text_col), "ngrams")
    tokens, vocabulary, entries = (x or 0 for x in counts.agg(F.sum("tokens"), F.sum("vocabulary"), F.sum("entries")).first())
    segments = max(1, ceil(entries * bits_per_entry / SEGMENT_BITS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments as far as this task's keys set their bits; a segment that several tasks touch is or-ed together later."""
        open_: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for at, bits in open_.items():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])
            open_.clear()

        for b in batches:
            for top, one, c, two, many in zip(*(b.column(i).to_pylist() for i in range(5))):
                key = np.concatenate([np.frombuffer(one, np.uint64), _unpack(two, top)])
                q = np.concatenate([levels_of(np.frombuffer(c, np.int64)), np.frombuffer(many, np.uint8)])
                order = np.argsort(key)
                key, q = key[order], q[order]
                for mark in range(1, int(q.max()) + 1 if len(q) else 1):
                    segment, bit = places(key[q >= mark], mark, segments)  # in rising order
                    cuts = np.flatnonzero(np.diff(segment)) + 1
                    for lo, hi in zip([0, *cuts], [*cuts, len(segment)]):
                        if hi > lo:
                            if len(open_) >= BUILT and int(segment[lo]) not in open_:
                                yield from out()
                            open_.setdefault(int(segment[lo]), np.zeros(SEGMENT_BITS, np.uint8))[bit[lo:hi].ravel()] = 1
        yield from out()

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.int64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], ["key", "c"])

    table = durable(counts.select("top", "one", "c", "two", "q").mapInArrow(build, "segment long, bits binary"), "filter")
    return Model(table, segments, tokens, vocabulary), counts.select("one", "c").mapInArrow(unigrams, "key long, c long")


# ---- scores ---------------------------------------------------------------------------------------------------------

#: Text bytes whose tokens are held at once.
HELD = 3 << 18


def head_of(unigrams: DataFrame, words: int) -> int:
    """The smallest count that at most ``words`` words reach: these are the head, all others the tail."""
    exact = 10_000
    rows = unigrams.groupBy(F.least("c", F.lit(exact)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = exact + 1, 0
    for r in sorted(rows, key=lambda r: -r["c"]):
        held += r["n"]
        if held > words:
            break
        least = r["c"]
    return least


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about HELD bytes of text, or one row."""
    at, size = 0, 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + length > HELD:
            yield at, i
            at, size = i, 0
        size += length
    if at < len(texts):
        yield at, len(texts)


#: Bytes of filter that a task loads to answer probes, and of probes (some four bytes each) that it gets, when the filter is no
#: broadcast. A shelf is sent once for every PROBED bytes of its probes, so what is sent of the filter is a fourth of the probes.
SHELF, PROBED = 16 << 20, 64 << 20


def score(docs: DataFrame, model: Model, unigrams: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = 2_000_000, max_filter_mb: float = 256, stretch: int | None = None) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score.

    base_score is exact, so it needs exact counts: those of the ``head_words`` most frequent words are broadcast (16 bytes a
    word, at most that many); the words of a document that are not among them are joined with the tail's counts. So hot words
    never meet in a join, and the tail may have any size. A filter of up to ``max_filter_mb`` is broadcast; of a larger one,
    tasks load a shelf each (``probe``). ``stretch`` tokens are
    looked up at once (None: PIECE, or SENT_PIECE). Null texts count as empty: one token, the end. Rows are independent; repeated rows
    give equal results; columns other than id and text are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    least = head_of(unigrams, head_words)
    parts = list(_arrow_blocks(unigrams.where(F.col("c") >= least)))  # head_words rows at most
    key = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.int64)]).view(np.uint64)
    order = np.argsort(key)
    head = spark.sparkContext.broadcast((key[order], np.concatenate([c for _, c in parts] or [np.zeros(0, np.int64)])[order]))
    has_tail = least > 1
    tokens, vocabulary, segments = model.tokens, model.vocabulary, model.segments
    whole = float(tokens + vocabulary + 1)
    small = segments * (SEGMENT_BITS // 8) <= max_filter_mb * 1e6
    shared = spark.sparkContext.broadcast(model.load()) if small else None
    stretch = stretch or (PIECE if small else SENT_PIECE)
    per_shelf = max(1, min(SHELF, int(max_filter_mb * 1e6)) // (SEGMENT_BITS // 8))
    schema = f"id {kind}, row long, n_tokens long, score double, n_known long, log_c double, rest array<long>, piece long, shelf long, data binary, words binary, rows array<long>, sizes array<long>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, row, piece = Hashes(), TaskContext.get().partitionId() << 33, 0, 0
        waiting: tuple[list[np.ndarray], ...] = ([], [], [])  # tokens, rows and sizes of documents that no piece holds yet

        def pieces() -> Iterator[pa.RecordBatch]:
            nonlocal piece
            if not waiting[0]:
                return
            h, of, sizes = map(np.concatenate, waiting)
            for part in waiting:
                part.clear()
            ends = np.cumsum(sizes)
            starts = ends - sizes
            for at in range(0, len(h), stretch):
                part = h[at : at + stretch]
                held = np.flatnonzero((starts < at + len(part)) & (ends > at))  # the documents of these tokens
                lengths = np.minimum(ends[held], at + len(part)) - np.maximum(starts[held], at)
                q = Question.of(part, h[at - 1] if at else END_HASH)
                one, two = q.keys[: q.unigrams], q.keys[q.unigrams :]  # each in rising order, as are their shelves
                in_one, in_two = (segment_of(x, segments) // np.uint64(per_shelf) for x in (one, two))
                some = np.union1d(in_one, in_two)
                words = [steps(one)] + [steps(x) for x in np.split(one, np.searchsorted(in_one, some[1:]))]
                data = [squeeze(q.token.astype(np.uint32))] + [steps(x) for x in np.split(two, np.searchsorted(in_two, some[1:]))]
                none = [[]] * len(some)
                yield out(len(data), piece=pa.array(np.full(len(data), task + piece)), shelf=pa.array(np.append(-1, some.astype(np.int64))), data=pa.array(data, pa.binary()), words=pa.array(words, pa.binary()), rows=pa.array([of[held].tolist(), *none], pa.list_(pa.int64())), sizes=pa.array([lengths.tolist(), *none], pa.list_(pa.int64())))
                piece += 1

        for b in batches:
            types = [b.schema.field(0).type, *[pa.int64()] * 2, pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), *[pa.int64()] * 2, *[pa.binary()] * 2, *[pa.list_(pa.int64())] * 2]

            def out(n: int, **cols: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(n, t)) for c, t in zip(names, types)], names)

            for lo, hi in portions(b.column(1)):
                docs_tokens = [tokens_of(t) for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                sizes = np.array([len(t) for t in docs_tokens])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                h = hashes.of([w for t in docs_tokens for w in t])
                del docs_tokens
                p, c = np.zeros(len(h)), np.empty(len(h), np.int64)
                for at in range(0, len(h), stretch):
                    part, before = h[at : at + stretch], h[at - 1] if at else END_HASH
                    c[at : at + stretch] = _lookup(head.value, part)
                    if shared is not None:
                        q = Question.of(part, before)
                        p[at : at + stretch] = q.log10(shared.value.levels(q.keys), tokens, vocabulary)
                if shared is None:
                    if sum(map(len, waiting[0])) + len(h) > stretch:
                        yield from pieces()
                    for part, x in zip(waiting, (h, task + row + np.arange(hi - lo), sizes)):
                        part.append(x)
                cols = {"id": b.column(0).slice(lo, hi - lo), "row": pa.array(task + row + np.arange(hi - lo)), "n_tokens": pa.array(sizes), "score": pa.array(np.add.reduceat(p, starts)), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), "log_c": pa.array(np.add.reduceat(np.log10(c + 1.0), starts))}
                if has_tail:
                    cols["rest"] = _lists(np.repeat(np.arange(len(sizes)), sizes)[c == 0], h[c == 0], len(sizes))
                yield out(hi - lo, **cols)
                row += hi - lo
        yield from pieces()

    done = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
    if has_tail or not small:
        written = durable(done, "scored")
        done = written.where("row IS NOT NULL")
        if has_tail:
            words = done.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("tf"))
            tail = unigrams.where(F.col("c") < least)
            sums = words.join(tail, "key").groupBy("row").agg(F.sum("tf").alias("k"), F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(1.0))).alias("l"))
            done = done.join(sums, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "log_c": F.col("log_c") + F.coalesce("l", F.lit(0.0))})
        if not small:
            done = done.drop("score").join(probe(written.where("piece IS NOT NULL").select("piece", "shelf", "data", "words", "rows", "sizes"), model, per_shelf), "row")
    base = F.col("log_c") - F.col("n_tokens") * F.lit(log(whole) / log(10))
    return done.select(F.col("id").alias(id_col), "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def probe(pieces: DataFrame, model: Model, per_shelf: int) -> DataFrame:
    """(row, score) from a filter of any size, by sending the probes to its shelves.

    ``pieces`` has for each piece of text its tokens (shelf -1: words, the keys of its unigrams, and data, the place of each token
    among them, with the documents' rows and sizes) and, for each shelf, the keys to look up in rising order (words: unigrams,
    data: bigrams). A shelf is sent to as many tasks as its probes need; a task loads it and streams its probes past it. The levels
    are written, so that no shuffle holds the probes any longer, and go back to the piece, which then has its probabilities.
    """
    segments, tokens, vocabulary = model.segments, model.tokens, model.vocabulary
    shelves = -(-segments // per_shelf)
    asked = pieces.where("shelf >= 0").select("piece", "shelf", "data", "words")
    size = asked.agg(F.sum((F.octet_length("data") + F.octet_length("words")).cast("long")).alias("b")).first()["b"] or 0
    salts = max(1, -(-size // (shelves * PROBED)))
    of = F.floor(F.col("segment") / per_shelf).cast("long")
    bits = model.table.select(of.alias("shelf"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(None).cast("long").alias("piece"), "segment", F.col("bits").alias("data"), F.lit(None).cast("binary").alias("words"))
    keys = asked.select("shelf", F.pmod(F.xxhash64("piece"), F.lit(salts)).alias("salt"), "piece", F.lit(None).cast("long").alias("segment"), "data", "words")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, filter_ = None, None
        for b in batches:
            shelf, salt, piece, segment, data, words = (b.column(i).to_pylist() for i in range(6))
            found = []
            for i in range(b.num_rows):
                if here != (shelf[i], salt[i]):
                    here, filter_ = (shelf[i], salt[i]), Filter(np.zeros((per_shelf, SEGMENT_BITS // 8), np.uint8), shelf[i] * per_shelf, segments)
                if piece[i] is None:
                    filter_.bits[segment[i] - filter_.first] |= np.frombuffer(data[i], np.uint8)
                else:
                    found.append((piece[i], shelf[i], *(squeeze(filter_.levels(unsteps(x))) for x in (data[i], words[i]))))
            columns = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 2)], ["piece", "shelf", "data", "words"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, None

        def result() -> pa.RecordBatch:
            q, rows, sizes, one, two = held
            p = q.log10(np.concatenate(one + two), tokens, vocabulary)  # shelves, and keys in them, came in rising order
            starts = np.cumsum(sizes) - sizes
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.add.reduceat(p, starts))], ["row", "part"])

        for b in batches:
            for piece, _, data, words, rows, sizes in zip(*(b.column(i).to_pylist() for i in range(6))):
                if piece != here:
                    if held is not None:
                        yield result()
                    h = unsteps(words)[unsqueeze(data, np.uint32)]  # shelf -1 comes first
                    q = Question.of(h[1:], h[0])
                    here, held = piece, (q, rows, np.array(sizes), [], [])
                else:
                    held[3].append(unsqueeze(words, np.uint8))
                    held[4].append(unsqueeze(data, np.uint8))
        if held is not None:
            yield result()

    none = F.lit(None).cast("array<long>")
    # Nulls sort first: a shelf's segments stand before its probes.
    sent = durable(bits.unionAll(keys).repartition("shelf", "salt").sortWithinPartitions("shelf", "salt", "piece").mapInArrow(answer, "piece long, shelf long, data binary, words binary"), "levels")
    back = pieces.where("shelf < 0").select("piece", "shelf", "data", "words", "rows", "sizes").unionAll(sent.select("piece", "shelf", "data", "words", none.alias("rows"), none.alias("sizes")))
    parts = back.repartition("piece").sortWithinPartitions("piece", "shelf").mapInArrow(combine, "row long, part double")
    return parts.groupBy("row").agg(F.sum("part").alias("score"))


def _lookup(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    keys, counts = table
    if not len(keys):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, counts[at], 0)


def _lists(doc: np.ndarray, key: np.ndarray, n: int) -> pa.Array:
    """A list of keys for each of n documents; ``doc`` is sorted."""
    ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))


def _arrow_blocks(unigrams: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (key, c) rows as arrays, a packed row at a time, so that the driver never holds Python objects of all of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().tobytes()], pa.binary())], ["key", "c"])

    for r in durable(unigrams.select("key", "c").mapInArrow(pack, "key binary, c binary"), "head").toLocalIterator():
        yield np.frombuffer(r["key"], np.int64), np.frombuffer(r["c"], np.int64)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: float = 256, head_words: int = 2_000_000) -> DataFrame:
    """Learn from the documents that are not held out and score all of them; adds held_out to the columns of ``score``.

    Null texts count as empty, null ids as an empty id; repeated rows count and are scored each; an empty table gives an empty result.
    """
    model, unigrams = train(docs.where(~held_out(F.col(id_col))), text_col)
    scored = score(docs, model, unigrams, id_col, text_col, head_words, max_filter_mb)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
