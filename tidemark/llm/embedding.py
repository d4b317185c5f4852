"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors have cosine c just if their squared distance is 2 - 2c. Vectors are rotated and split into blocks of few
dimensions; the squared distance is the sum of the blocks' own. Each block gets a budget in proportion to its spread, the
budgets adding up to the whole, so two near vectors stay within the budget of one block at least. Each block is range-joined
on its own, and the union of its candidates is verified with the vectors themselves, in doubles.

A block's join cuts its leading coordinate into cells of about equal counts, crowded cells into slices, and lets only slices
meet whose ranges come within the budget. A pair counts in the first block whose budget it keeps, so nothing is counted
twice and no pair ever leaves a task: what comes out is each vector's number of links and a forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ship
from .simhash import FEW, components, roots

#: Dimensions of a block: of unrelated pairs, some two in a million stay within its budget at cosine 0.9.
WIDTH = 16
#: Numbers in a slice of vectors; a task compares two slices at a time.
SLICE = 1 << 20
#: Vectors that the rotation and the cells are fitted on. They decide the speed only, never what is linked.
SAMPLE = 4096
CHUNK = 512
#: Slack of 32-bit comparisons, and of sums in doubles.
LOOSE, TIGHT = 1e-4, 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in doubles; scaling by the largest component first keeps huge and tiny ones finite."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Split:
    """A rotation, the columns of each block and the blocks' budgets."""

    def __init__(self, sample: np.ndarray, least: float, width: int):
        dims = sample.shape[1]
        spread, axes = np.linalg.eigh(np.atleast_2d(np.cov(sample.T, bias=True)))
        spread, axes = np.maximum(spread[::-1], 0), axes[:, ::-1]
        n = -(-dims // width)
        self.axes = np.ascontiguousarray(np.concatenate([axes[:, b::n] for b in range(n)], axis=1))  # each block leads with one of the widest axes
        self.at = np.cumsum([0, *(len(range(b, dims, n)) for b in range(n))])
        share = np.array([spread[b::n].sum() for b in range(n)])
        share = share / share.sum() if share.sum() > 0 else np.full(n, 1 / n)
        self.budgets = share * (2 - 2 * least) + TIGHT
        self.blocks = n

    def block(self, units: np.ndarray, b: int) -> np.ndarray:
        return units @ self.axes[:, self.at[b] : self.at[b + 1]]

    def exact(self, units: np.ndarray) -> np.ndarray:
        """All rotated coordinates, added up one by one: the same for a vector wherever it is computed."""
        out = np.zeros((len(units), self.axes.shape[1]))
        for j in range(units.shape[1]):
            out += units[:, j : j + 1] * self.axes[j]
        return out

    def first_block(self, x: np.ndarray, y: np.ndarray, upto: int) -> np.ndarray:
        """The first block up to ``upto`` whose budget each pair keeps, or ``upto + 1``."""
        first = np.full(len(x), upto + 1)
        for b in range(upto, -1, -1):
            total = np.zeros(len(x))
            for d in range(self.at[b], self.at[b + 1]):
                total += (x[:, d] - y[:, d]) ** 2
            first[total <= self.budgets[b]] = b
        return first


def candidates(x: np.ndarray, y: np.ndarray, budget: float, same: bool) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Pairs of rows whose squared distance in a block may keep its budget, by chunks whose boxes come that near.

    Rows are sorted by the leading coordinate. With ``same`` each pair comes once.
    """
    cut = lambda z: [slice(i, min(len(z), i + CHUNK)) for i in range(0, len(z), CHUNK)]
    box = lambda z: (np.array([z[s].min(0) for s in cut(z)]), np.array([z[s].max(0) for s in cut(z)]))
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    xs, ys = (x32 * x32).sum(1), (y32 * y32).sum(1)
    (xl, xh), (yl, yh) = box(x), box(y)
    for i, s in enumerate(cut(x)):
        gap = (np.maximum(0, np.maximum(xl[i] - yh, yl - xh[i])) ** 2).sum(1)
        for j in np.nonzero(gap <= budget)[0]:
            if same and j < i:
                continue
            t = slice(j * CHUNK, min(len(y), (j + 1) * CHUNK))
            far = xs[s][:, None] + ys[t][None, :] - 2 * (x32[s] @ y32[t].T)
            a, c = np.nonzero(far <= budget + LOOSE)
            if same and i == j:
                a, c = a[a < c], c[a < c]
            if len(a):
                yield s, t, a, c


def compare(split: Split, b: int, left: np.ndarray, right: np.ndarray, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (row of left, row of right) with cosine ``least`` or more whose first block is ``b``."""
    whole: list[np.ndarray] = []
    for s, t, a, c in candidates(split.block(left, b), split.block(right, b), split.budgets[b], same):
        if len(a) > 4096:
            near = (left[s] @ right[t].T)[a, c] >= least
        else:
            near = (left[s][a] * right[t][c]).sum(1) >= least
        a, c = a[near] + s.start, c[near] + t.start
        if not len(a):
            continue
        if not whole:
            whole = [split.exact(left), split.exact(right)]
        for at in range(0, len(a), 65536):
            p, q = a[at : at + 65536], c[at : at + 65536]
            own = split.first_block(whole[0][p], whole[1][q], b) == b
            if own.any():
                yield p[own], q[own]


def cells_of(split: Split, sample: np.ndarray, total: int, size: int) -> np.ndarray:
    """(block, edge): edges of at most 1,024 cells of about equal counts on each block's leading coordinate."""
    n = int(np.clip(-(-total // size), 1, 1024))
    return np.array([np.quantile(split.block(sample, b)[:, 0], np.linspace(0, 1, n + 1)[1:-1]) for b in range(split.blocks)]).reshape(split.blocks, n - 1)


def layout(spark, vectors: DataFrame, split: Split, edges: np.ndarray, size: int, read) -> list[dict[str, np.ndarray]]:
    """Of each block's cells: the number of slices, their first number, and the range of cells that come near enough."""
    n = edges.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((split.blocks, n), np.int64)
        low, high = np.full((split.blocks, n), np.inf), np.full((split.blocks, n), -np.inf)
        for batch in batches:
            units = read(batch.column(0))
            for b in range(split.blocks):
                t = split.block(units, b)[:, 0]
                cell = np.searchsorted(edges[b], t, "right")
                count[b] += np.bincount(cell, minlength=n)
                np.minimum.at(low[b], cell, t)
                np.maximum.at(high[b], cell, t)
        b, c = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b, c, count[b, c], low[b, c], high[b, c])], ["b", "c", "n", "low", "high"])

    rows = vectors.select("vec").mapInArrow(run, "b long, c long, n long, low double, high double")
    rows = rows.groupBy("b", "c").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("b", "c").collect()  # at most blocks x 1,024
    out = []
    for b in range(split.blocks):
        own = [r for r in rows if r["b"] == b]
        c, low, high = np.array([r["c"] for r in own]), np.array([r["low"] for r in own]), np.array([r["high"] for r in own])
        slices = np.array([-(-r["n"] // size) for r in own])
        start = np.concatenate([[0], np.cumsum(slices)])
        reach = np.sqrt(split.budgets[b]) + LOOSE
        place = np.zeros(n, np.int64)
        place[c] = np.arange(len(c))
        out.append({"place": place, "slices": slices, "start": start, "to": start[np.searchsorted(low, high + reach, "right")]})
    return out


def linked(vectors: DataFrame, dims: int, letter: str, least: float, width: int, size: int) -> DataFrame:
    """(node, root, links): links of distinct vectors that a task found, and the smallest node that it knows each to reach.

    ``vectors`` has node, n (rows of the vector) and vec, its numbers as bytes. All vectors have ``dims`` components.
    """
    spark = vectors.sparkSession

    def read(column: pa.Array) -> np.ndarray:
        return unit(np.frombuffer(b"".join(column.to_pylist()), letter).reshape(-1, dims))

    total = vectors.count()
    sample = read(pa.array([bytes(r["vec"]) for r in vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()], pa.binary()))
    split = Split(sample, least, width)
    edges = cells_of(split, sample, total, size)
    plan = layout(spark, vectors, split, edges, size, read)
    wide = 1 + max(int(p["start"][-1]) for p in plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector's slice in each block goes to every pair of slices that it is part of."""
        for batch in batches:
            units, node = read(batch.column(2)), batch.column(0).to_numpy()
            for b, p in enumerate(plan):
                t = split.block(units, b)[:, 0]
                at = p["place"][np.searchsorted(edges[b], t, "right")]
                own = p["start"][at] + (node * 0x9E3779B1 >> 7) % p["slices"][at]
                # Later slices up to the reach are the right side; earlier ones whose reach includes this cell the left.
                first = p["start"][np.searchsorted(p["to"], p["start"][:-1], "right")]
                lo, hi = first[at], p["to"][at]
                for low in range(0, len(own), 1024):
                    part = slice(low, low + 1024)
                    many = (hi - lo)[part]
                    who = np.repeat(np.arange(len(many)), many)
                    other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[part][who]
                    mine = own[part][who]
                    tile = (b * wide + np.minimum(mine, other)) * wide + np.maximum(mine, other)
                    taken = pa.array(who + low)
                    yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(mine), pa.array(t[part][who]), *(batch.column(i).take(taken) for i in range(3))], ["tile", "own", "t", "node", "n", "vec"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """The rows of one pair of slices at a time: twice ``size`` or so."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tile = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(tile))[0] + 1).tolist(), len(tile)]
            for i, j in zip(cuts, cuts[1:]):
                if held and i < len(tile) and held[-1].column(0)[0].as_py() != tile[i]:
                    yield held[-1].column(0)[0].as_py(), pa.Table.from_batches(held)
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield held[-1].column(0)[0].as_py(), pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, rows in tiles(batches):
            b, i, j = tile // wide // wide, tile // wide % wide, tile % wide
            own, node, n = (rows.column(c).to_numpy() for c in ("own", "node", "n"))
            units = read(rows.column("vec").combine_chunks())
            here, there = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
            if not len(here) or not len(there):
                continue
            links, label = np.zeros(len(node), np.int64), np.arange(len(node))
            order = np.argsort(node, kind="stable")  # labels are places in this order, so that the smallest node wins
            rank = np.empty(len(node), np.int64)
            rank[order] = np.arange(len(node))
            for p, q in compare(split, b, units[here], units[there], i == j, least):
                p, q = here[p], there[q]
                links += np.bincount(p, n[q], len(node)).astype(np.int64) + np.bincount(q, n[p], len(node)).astype(np.int64)
                u, v = label[rank[p]], label[rank[q]]
                apart = u != v
                if apart.any():
                    label = roots(len(node), u[apart], v[apart])[label]
            some = np.nonzero(links)[0]
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[order][label[rank[some]]]), pa.array(links[some])], ["node", "root", "links"])

    dealt = vectors.select("node", "n", "vec").mapInArrow(deal, "tile long, own long, t double, node long, n long, vec binary")
    return dealt.repartition("tile").sortWithinPartitions("tile", "own", "t").mapInArrow(run, "node long, root long, links long")


def near_groups(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, size: int | None = None) -> DataFrame:
    """One row per row: id, n_links (other rows within cosine ``least``), component_id (smallest id that links reach), kept.

    Vectors that are null, empty or zero, or hold null, NaN or infinite components, link with nothing; so do vectors of
    different lengths. Equal vectors meet once, by aggregation, and count as links of one another. Repeated rows are rows of
    their own. Null ids take part, but name a component only where it has no other id; ``kept`` says whether the id equals
    the component's, so it holds for repeated rows of that id too. An empty table gives an empty result. Other columns are
    not read. A task holds two slices of ``size`` vectors, or of ``SLICE`` numbers.
    """
    spark = rows.sparkSession
    ship(spark)
    letter, one = ("<f4", "float") if rows.schema[vec_col].dataType.simpleString() == "array<float>" else ("<f8", "double")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{one}>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    good = F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = [(x.values.to_numpy() + 0).astype(letter).tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.binary()), b.column(1), b.column(2), b.column(3)], ["vec", "dims", "first", "n"])

    same = rows.where(good).groupBy("embedding").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    kind = rows.schema["id"].dataType.simpleString()
    vectors = same.select("embedding", F.size("embedding").alias("dims"), "first", "n").mapInArrow(packed, f"vec binary, dims int, first {kind}, n long")
    vectors = durable(vectors.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = None
    for r in vectors.select("dims").distinct().orderBy("dims").collect():
        part = linked(vectors.where(F.col("dims") == r["dims"]), r["dims"], letter, least, width, size or max(256, SLICE // r["dims"]))
        found = part if found is None else found.unionAll(part)
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if found is None:
        out = alone
    else:
        found = durable(found, "links")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        group = durable(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "groups")
        of = vectors.join(group, "node", "left").join(links, "node", "left").select("vec", "first", "n", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        named = of.groupBy("root").agg(F.min("first").alias("component_id"))
        of = durable(of.join(named, "root").select("vec", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "components")

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(x.values.to_numpy() + 0).astype(letter).tobytes() for x in b.column(1)], pa.binary())], ["id", "vec"])

        back = rows.where(good).mapInArrow(keyed, f"id {kind}, vec binary")
        # Vectors that many rows have are broadcast, so that no join has a hot key; at most FEW vectors reach this number.
        most = max(FEW, of.agg(F.sum("n")).first()[0] // FEW)
        hot, rest = F.broadcast(of.where(F.col("n") >= most)), of.where(F.col("n") < most)
        known = back.join(hot, "vec").unionByName(back.join(hot, "vec", "left_anti").join(rest, "vec"))
        out = known.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
