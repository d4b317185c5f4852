"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints meet only inside blocks of a shared key. A block stores its fingerprints vertically: one bit plane per bit,
64 lanes a word. A query's distances to all lanes grow together in carry-save bitwise counters; a block of queries is
abandoned for a word of lanes as soon as all its distances exceed the radius. What comes out of a block is linear in it:
a spanning forest of its links, never its pairs. Groups are then joined across blocks by large-star/small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, ship, text_of

SEED = 42
#: Lanes that are compared at once; a key with more fingerprints goes the way of ``flip_stars``.
LANES = 2048
#: Bound of the fingerprints that are broadcast because many documents have them.
FEW = 10_000
#: Shingles hashed at once, so that long texts stay in bounded memory.
PIECE = 200_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, in pieces. bytes.lower and bytes.split know ASCII letters and white space only."""
    words = text.encode().lower().split()
    if 0 < len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    for at in range(0, len(words) - width + 1, PIECE):
        part = words[at : at + PIECE + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width))))
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(part) - width + 1)


def fingerprint(text: str, width: int) -> int:
    """Bit i is 1 if over half of the hashes have it; a text without words has fingerprint zero."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, width):
        total += len(h)
        for at in range(0, len(h), 4096):
            ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): one row per document; null texts count as empty. fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, width) for t in b.column(1).to_pylist()], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


# ---- bit-sliced comparison ------------------------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(lanes, words) fingerprints -> (64 * words, lanes / 64) bit planes; lanes are a multiple of 64."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_pairs(fps: np.ndarray, keys: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of lanes with equal keys and at most ``radius`` differing bits. Lanes are sorted by key."""
    n = len(fps)
    lanes = -(-n // 64) * 64
    full = np.zeros((lanes, fps.shape[1]), np.uint64)
    full[:n] = fps
    planes = planes_of(full)
    bits = np.unpackbits(full.view(np.uint8).reshape(lanes, -1), axis=1, bitorder="little")
    last = np.searchsorted(keys, keys, "right")  # of each lane: one behind its key's lanes
    depth, left, right = max(1, radius.bit_length()), [], []
    for at in range(0, n, rows):
        q = np.arange(at, min(n, at + rows))
        q = q[last[q] - q > 1]
        if not len(q):
            continue
        w0, w1 = q[0] // 64, -(-last[q].max() // 64)  # only words that hold a lane of these keys
        lane = np.arange(w0 * 64, w1 * 64)
        live = (lane[None, :] > q[:, None]) & (lane[None, :] < last[q][:, None])
        dead = ~np.packbits(live, axis=1, bitorder="little").view(np.uint64)
        counters = [np.zeros_like(dead) for _ in range(depth)]
        for b in range(planes.shape[0]):
            carry = planes[b, w0:w1][None, :] ^ np.where(bits[q, b], ALL, np.uint64(0))[:, None]
            for c in counters:  # carry-save: add one bit to every lane's counter
                both = c & carry
                c ^= carry
                carry = both
            dead |= carry  # the counter ran over
            if b % 8 == 7:
                dead |= _over(counters, radius)
                open_rows = (dead != ALL).any(axis=1)
                if not open_rows.all():
                    q, dead, counters = q[open_rows], dead[open_rows], [c[open_rows] for c in counters]
                    if not len(q):
                        break
        if len(q):
            dead |= _over(counters, radius)
            hit = np.unpackbits(~dead.view(np.uint8), axis=1, bitorder="little").astype(bool)
            a, b = np.nonzero(hit)
            left.append(q[a])
            right.append(lane[b])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius: the highest differing bit decides."""
    over, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            over |= same & counters[k]
            same &= ~counters[k]
    return over


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each lane's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new[new]
    return label


def blocks_of(batches: Iterator[pa.RecordBatch], lanes: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by the first column, in blocks that hold whole keys and about ``lanes`` rows."""
    held: list[np.ndarray] | None = None
    for b in batches:
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
        while len(held[0]) > lanes:
            end = np.searchsorted(held[0], held[0][lanes], "left")
            end = end or np.searchsorted(held[0], held[0][0], "right")
            if end == len(held[0]):
                break  # the key may go on in the next batch
            yield [h[:end] for h in held]
            held = [h[end:] for h in held]
    if held is not None and len(held[0]):
        yield held


# ---- exact links within a radius ------------------------------------------------------------------------------------


def band_keys(fp: Column, radius: int) -> Column:
    """Keys of which two fingerprints within the radius share at least one.

    With radius + 2 bands at least two bands agree, so each pair of bands is a key.
    """
    n = radius + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    band = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(i), F.lit(j), band[i], band[j]) for i, j in combinations(range(n), 2)])


def flip_stars(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of fingerprints whatever their number: an exact way without comparing a crowded key's pairs.

    Two fingerprints differ in at most 2 bits just if flipping at most one bit of each gives a common text of bits. So each
    is linked to the smallest one at each of its 65 neighbours; for radius 1, 0 the same holds for one side alone.
    """
    if radius != 2:
        raise ValueError("crowded keys have an exact way for radius 2 only")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    at = fps.select("fp", F.explode(flips).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("hub"))
    hubs = at.groupBy("hub").agg(F.min("fp").alias("b"), F.max("fp").alias("z")).where("b < z").select("hub", "b")
    return at.join(hubs, "hub").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, radius: int = 2, lanes: int = LANES) -> DataFrame:
    """(a, b), a > b: a spanning forest of the fingerprints' links; ``fps`` has distinct fingerprints in column fp."""
    ship(fps.sparkSession)
    rows = fps.select("fp", F.explode(band_keys(F.col("fp"), radius)).alias("key"))
    crowd = rows.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    rows = rows.join(crowd, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fp in blocks_of(batches, lanes):
            a, b = near_pairs(fp.view(np.uint64).reshape(-1, 1), keys, radius)
            root = roots(len(fp), a, b)
            far = np.nonzero(root != np.arange(len(fp)))[0]
            x, y = fp[far], fp[root[far]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    near = rows.where(F.col("crowd") <= lanes).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")
    hot = rows.where(F.col("crowd") > lanes).select("fp").distinct()
    return near.unionAll(flip_stars(hot, radius)).distinct()


# ---- groups ---------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every component, for nodes that have an edge (a, b).

    Alternates large-star and small-star: every node links its larger neighbours, then its smaller ones, to the smallest
    node it knows. Edges only shrink, no node's neighbours are ever gathered, and each round is cut off by a table in the
    shared folder.
    """
    edges = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:  # each round shortens all paths; the last one changes nothing
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges = durable(star, "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, lanes: int = LANES) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null and empty texts have fingerprint zero and link like any other. Null ids take part but name a component only where
    it has no other id. Equal fingerprints meet once, by aggregation, so exact copies cost no comparison; repeated rows
    give equal results. Links are all pairs of fingerprints that differ in at most ``radius`` bits.
    """
    rows = durable(fingerprints(docs, id_col, text_col, width), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    group = durable(components(links(first.select("fp"), radius, lanes)), "groups")
    root = F.coalesce("root", "fp")
    of = first.join(group, first["fp"] == group["node"], "left").select("fp", root.alias("root"), "first", "n")
    named = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = durable(of.select("fp", "root", "n").join(named, "root").select("fp", "component_id", "n"), "components")
    # Fingerprints that many documents have, such as that of empty texts, are broadcast, so that no join has a hot key.
    most = max(FEW, rows.count() // FEW)  # at most FEW fingerprints reach this
    hot, rest = F.broadcast(of.where(F.col("n") >= most)), of.where(F.col("n") < most)
    known = rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(rest, "fp"))
    return known.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near duplicates by similarity ----------------------------------------------------------------------------------

#: Bits of the wide fingerprint (two words) that texts of similarity 0.8 differ in: 19 on average, 33 at most but for 1 in 1000.
WIDE_RADIUS = 33
#: Keys of two min-hashes each; texts of similarity 0.8 share none of them in 1 of 3500 cases.
KEYS = 8
NEAREST = 3
#: Odd multipliers that spread a hash anew (fixed values).
SPREAD = np.array([0x9E3779B97F4A7C15 ^ (0xD1B54A32D192ED03 * i & 0xFFFFFFFFFFFFFFFF) | 1 for i in range(2 * KEYS)], np.uint64)


def signature(text: str, width: int) -> tuple[int, int, list[int]]:
    """Two words of SimHash bits and KEYS block keys of a text's distinct shingles."""
    parts = list(shingle_hashes(text, width))
    h = np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)
    ones = np.zeros(128, np.int64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096]
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        both = np.array([x, y ^ (y >> np.uint64(32))]).T
        ones += np.unpackbits(np.ascontiguousarray(both).view(np.uint8).reshape(len(x), 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)
    low = np.array([((h ^ (h >> np.uint64(32))) * m).min() for m in SPREAD], np.uint64)
    keys = (low[::2] ^ (low[1::2] >> np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD) + np.arange(KEYS, dtype=np.uint64)
    return int(fp[0]), int(fp[1]), keys.view(np.int64).tolist()


def signatures(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, f0, f1, keys); texts without words are no one's near duplicates and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [signature(t, width) for t in b.column(1).to_pylist()]
            f0, f1, keys = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["node", "f0", "f1", "keys"])

    return docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select("node", F.col(text_col).alias("text")).mapInArrow(run, "node long, f0 long, f1 long, keys array<long>")


def shingle_sets(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, set): 32-bit hashes of a text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [np.unique(np.concatenate([p.astype(np.uint32) for p in shingle_hashes(t, width)])).view(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], ["node", "set"])

    return docs.select("node", F.col(text_col).alias("text")).mapInArrow(run, "node long, set array<int>")


def matchable(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, n, m): a set's size and how many of its shingles some other set has too, where a similar set is possible at all.

    A shingle that one set alone has can't be common, so two sets have at most the lesser m in common: n of one and m of the
    other bound their similarity, and a set with m below ``similarity`` times n has no similar one. Sole shingles are found by
    aggregation, so one that all sets have costs no task more than others.
    """
    tasks = max(1, -(-sets.count() // 1000))  # a task's table of shingles stays small
    each = sets.select("node", "set").repartition(tasks, "node").select("node", F.explode("set").alias("h"))
    sole = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("sole"))
    sized = sets.select("node", F.size("set").cast("long").alias("n")).join(sole, "node", "left")
    return sized.select("node", "n", (F.col("n") - F.coalesce("sole", F.lit(0))).alias("m")).where(F.col("m") >= F.lit(similarity) * F.col("n") - 1e-6)


def possible(rows: DataFrame, by: str, similarity: float) -> DataFrame:
    """Rows (by, n, m, ...) whose group may hold a similar set: sizes a, b and a similarity s need s / (1 + s) * (a + b) in common."""
    c = similarity / (1 + similarity)
    best = rows.groupBy(by).agg(F.min("n").alias("_least"), F.max(F.col("m") - c * F.col("n")).alias("_room"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return rows.join(broadcast_if_small(durable(best, "room")), by).where((F.col("m") >= c * (F.col("n") + F.col("_least")) - 1e-6) & (F.col("_room") >= c * F.col("n") - 1e-6)).drop("_least", "_room", "_rows")


def nearest_pairs(rows: DataFrame, lanes: int, similarity: float, low: int = 0, high: int = NEAREST) -> DataFrame:
    """(a, b, block), a > b: of rows (block, side, node, root, f0, f1, n, m), each node's smaller nodes of its block within the
    radius, from the ``low``-th nearest up to before the ``high``-th, that have another root and may be similar by n and m.

    A block of two sides compares one with the other. A row without a and b names a block that has pairs of unequal roots
    from the ``high``-th on. Ranks do not depend on roots, so ranges that follow one another meet all pairs of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = similarity / (1 + similarity)
        for block, node, root, side, f0, f1, n, m in blocks_of(batches, lanes):
            fps = np.ascontiguousarray(np.array([f0, f1]).T).view(np.uint64)
            i, j = near_pairs(fps, block, WIDE_RADIUS)
            some = (node[i] != node[j]) & ((side[i] != side[j]) | (side[i] < 0)) & (np.minimum(m[i], m[j]) >= c * (n[i] + n[j]) - 1e-6)
            i, j = i[some], j[some]
            far = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1)
            order = np.lexsort((far, j))
            i, j = i[order], j[order]
            start = np.concatenate([[True], j[1:] != j[:-1]]) if len(j) else np.zeros(0, bool)
            rank = np.arange(len(j)) - np.maximum.accumulate(np.where(start, np.arange(len(j)), 0)) if len(j) else np.arange(0)
            apart = root[i] != root[j]
            now = apart & (rank >= low) & (rank < high)
            more = np.unique(block[i[apart & (rank >= high)]])
            none = pa.nulls(len(more), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[j][now]), pa.array(node[i][now]), pa.array(block[i][now])], ["a", "b", "block"])
            yield pa.RecordBatch.from_arrays([none, none, pa.array(more)], ["a", "b", "block"])

    return rows.select("block", "node", "root", "side", "f0", "f1", "n", "m").repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, "a long, b long, block long")


def overlaps(sets: list[np.ndarray], of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, number of common elements with each set) for the sets numbered in ``of``, from the elements' postings."""
    size = np.array([len(x) for x in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(element, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(element))])
    for i in of:
        own = element[start[i] : start[i + 1]]
        many = first[own + 1] - first[own]
        at = np.arange(many.sum()) + np.repeat(first[own] - (np.cumsum(many) - many), many)
        yield i, np.bincount(holders[at], minlength=len(sets))


def verified_links(rows: DataFrame, sets: DataFrame, lanes: int, similarity: float) -> DataFrame:
    """(a, b), a > b: of rows (block, side, node, root, f0, f1, n, m), links of similar sets that join roots, as a forest of each block.

    All pairs of a block within the radius are verified where they stand, on the sets themselves, so what comes out is linear in
    the rows, whatever the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = similarity / (1 + similarity)
        for block, node, root, side, f0, f1, n, m, own in blocks_of(batches, lanes):
            i, j = near_pairs(np.ascontiguousarray(np.array([f0, f1]).T).view(np.uint64), block, WIDE_RADIUS)
            some = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] < 0)) & (np.minimum(m[i], m[j]) >= c * (n[i] + n[j]) - 1e-6)
            i, j = i[some], j[some]
            if not len(i):
                continue
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            good = np.zeros(len(i), bool)
            for k, common in overlaps(list(own), np.unique(i)):
                lo, hi = np.searchsorted(i, [k, k + 1])
                o = common[j[lo:hi]]
                good[lo:hi] = o >= similarity * (n[k] + n[j[lo:hi]] - o)
            i, j = i[good], j[good]
            label = np.unique(root, return_inverse=True)[1]
            a, b = [], []
            for x, y in zip(i.tolist(), j.tolist()):
                u, v = label[x], label[y]
                if u != v:
                    label[label == v] = u
                    a.append(max(node[x], node[y]))
                    b.append(min(node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.join(sets, "node").select("block", "node", "root", "side", "f0", "f1", "n", "m", "set")
    return rows.repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, "a long, b long")


def similar_links(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets (node, set) really have the Jaccard similarity."""
    pairs = durable(pairs, "pairs")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b")


def across(rows: DataFrame) -> DataFrame:
    """Rows (key, slot, node, root, ...) in blocks of two slots of a key each, but for those whose nodes all have one root."""
    slots = durable(rows.groupBy("key", "slot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "slots")
    other = slots.select("key", F.col("slot").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    two = slots.join(other, "key").where("slot != other AND least(lo, lo2) < greatest(hi, hi2)").select("key", "slot", "other")
    block = F.xxhash64("key", F.least("slot", "other"), F.greatest("slot", "other"))
    return rows.join(two, ["key", "slot"]).withColumn("block", block).withColumn("side", F.col("slot"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, lanes: int = LANES) -> DataFrame:
    """The documents, all columns, with one document of each group of near duplicates.

    Groups are components over pairs of Jaccard similarity ``similarity`` or more on sets of ``width`` words. Pairs come from
    blocks of a shared key; in a block, distances of 128-bit fingerprints are compared bit-sliced. Each document first proposes
    its nearest smaller ones, which joins a group of any size by links in proportion to its documents. Blocks whose other pairs
    within the radius could still join two groups are then verified whole, where they stand. Links are verified on the whole
    texts' shingles, and groups are the components of all links that were ever verified.

    Only documents with a key that another one has too are looked at further: their shingles are counted, and what no other of
    them has bounds how much two may have in common (``matchable``). Documents and pairs beyond that bound are never compared,
    so many texts that share a passage, but not enough of it, cost time in proportion to their number.

    A crowded key is worked through in slices. Then one document of each group that the key has is compared, again and again
    while that joins groups; this only saves work. Last, in keys that still have several groups, all documents of every
    slice are compared with those of every other, but for two slices of one and the same group. Null and empty texts always
    stay; equal rows (id and text) stay or go together.
    """
    ship(docs.sparkSession)
    node = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_of(text_col))
    own = docs.select(node.alias("node"), text_of(text_col).alias("text"))
    signed = durable(signatures(own, "text", width), "signatures").dropDuplicates(["node"])
    keyed = signed.select("node", "f0", "f1", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1").select("key")
    keyed = durable(keyed.join(durable(shared, "shared"), "key"), "keyed")
    nodes = durable(keyed.select("node").distinct(), "nodes")
    sets = durable(shingle_sets(own.join(broadcast_if_small(nodes), "node", "left_semi"), "text", width).dropDuplicates(["node"]), "sets")
    bounds = durable(matchable(sets, similarity), "bounds")
    keyed = durable(possible(keyed.join(broadcast_if_small(bounds), "node"), "key", similarity), "possible")
    crowd = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    # Slices of a crowded key are so small that two of them fit the lanes.
    slices = F.when(F.col("crowd") > lanes, F.ceil(2 * F.col("crowd") / lanes)).otherwise(1).cast("int")
    rows = durable(keyed.join(durable(crowd, "crowds"), "key").withColumn("slices", slices).withColumn("slot", F.pmod(F.hash("node"), F.col("slices"))).drop("crowd"), "keyed")
    crowded = durable(rows.where("slices > 1"), "crowded")
    group: DataFrame | None = None

    def labelled(part: DataFrame) -> DataFrame:
        """With the root of each node's group as known so far."""
        if group is None:
            return part.withColumn("root", F.col("node"))
        return part.join(broadcast_if_small(group), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def join_groups(part: DataFrame, low: int = 0, high: int = NEAREST) -> tuple[int, DataFrame]:
        """Verify pairs and join their groups; how many links were new, and the blocks that have pairs from ``high`` on."""
        nonlocal group
        found = durable(nearest_pairs(part, lanes, similarity, low, high), "found")
        new = durable(similar_links(sets, found.where("a IS NOT NULL").select("a", "b").distinct(), similarity), "links")
        n = new.count()
        if n or group is None:
            group = durable(components(new if group is None else new.unionAll(group.select(F.col("node").alias("a"), F.col("root").alias("b")))), "groups")
        return n, found.where("a IS NULL").select("block").distinct()

    one_side = F.lit(-1)
    placed = rows.withColumn("block", F.xxhash64("key", "slot", "slot")).withColumn("side", one_side)
    left = durable(join_groups(labelled(placed))[1], "left")
    placed = placed.join(broadcast_if_small(left), "block", "left_semi").select("block", "side", "node", "f0", "f1", "n", "m")
    if not crowded.isEmpty():
        while True:  # one document of each group of a key
            first = labelled(crowded).groupBy("key", "root").agg(F.min_by(F.struct("node", "f0", "f1", "n", "m"), "node").alias("d")).select("key", "root", "d.*")
            count = first.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
            first = first.join(durable(count, "crowds"), "key").withColumn("slot", F.pmod(F.hash("node"), F.ceil(F.col("crowd") / lanes).cast("int")))
            if not join_groups(first.withColumn("block", F.xxhash64("key", "slot")).withColumn("side", one_side))[0]:
                break
        cross = across(labelled(crowded))
        more = durable(join_groups(cross)[1], "left")
        placed = placed.unionAll(cross.join(broadcast_if_small(more), "block", "left_semi").select("block", "side", "node", "f0", "f1", "n", "m"))
        left = left.unionAll(more)
    if not left.isEmpty():  # blocks whose pairs beyond the nearest could still join groups
        part = labelled(placed.join(broadcast_if_small(left), "block", "left_semi"))
        mixed = durable(part.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("block"), "mixed")
        more = durable(verified_links(part.join(broadcast_if_small(mixed), "block", "left_semi"), sets, lanes, similarity), "links")
        if not more.isEmpty():
            group = durable(components(more.unionAll(group.select(F.col("node").alias("a"), F.col("root").alias("b")))), "groups")
    gone = broadcast_if_small(durable(group.where("node != root").select(F.col("node").alias("_gone_node")), "gone"))
    return docs.join(gone, node == F.col("_gone_node"), "left_anti")
