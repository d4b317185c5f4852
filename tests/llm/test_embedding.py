"""Near-duplicate embeddings against all pairs."""

import numpy as np
import pytest

from tidemark.llm import embedding

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.9):
    """All pairs in doubles, and components by spreading the least id."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for at, i in enumerate(ok):
        for j in ok[:at]:
            x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((own, len(near[i]), first, own is not None and own == first))
    return sorted(out, key=repr)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "1 AS id", "2 AS node", "3 AS n", "4 AS first", "'v' AS vec")
    return sorted(map(tuple, embedding.near_groups(df.repartition(3), **how).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def cloud(seed, n, dims, groups, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * spread * rng.random((n, 1))
    return [(int(i), [float(v) for v in row]) for i, row in zip(rng.permutation(n * 2)[:n], x.astype(np.float32))]


@pytest.mark.parametrize("dims,width,size", [(64, 16, None), (32, 4, 40), (10, 3, 25), (3, 16, 30), (1, 1, 20)])
def test_equals_all_pairs_at_any_width_and_slice(spark, dims, width, size):
    rows = cloud(dims, 240, dims, 12, 0.6)
    want = brute(rows)
    assert got(spark, rows, width=width, size=size) == want
    assert any(0 < r[1] < 239 for r in want) or dims == 1


def test_hard_rows(spark):
    a = [0.5, -1.0, 0.25, 3.0]
    rows = [
        (5, a), (5, a), (9, [2 * x for x in a]), (2, [-x for x in a]), (None, a), (None, [1e30, 1e30, 0.0, 0.0]), (12, [1e-30, 1e-30, -0.0, 0.0]), (13, [1e-30, 1e-30, 0.0, -0.0]),
        (20, None), (21, []), (22, [0.0, -0.0, 0.0, 0.0]), (23, [1.0, None, 0.0, 0.0]), (24, [float("nan"), 1.0, 0.0, 0.0]), (25, [float("inf"), 1.0, 0.0, 0.0]), (None, None), (26, [1.0, 2.0]), (27, [1.0, 2.0, 0.0]), (28, [1.0, 2.1]),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_a_chain_is_one_component_and_copies_count(spark):
    turn = [[float(np.cos(t)), float(np.sin(t))] for t in np.arange(0, 3, 0.3)]
    rows = [(i + 1, v) for i, v in enumerate(turn)] + [(50 + i, turn[3]) for i in range(7)]
    found = got(spark, rows, size=3)
    assert found == brute(rows) and {r[2] for r in found} == {1}


def test_many_rows_of_one_vector_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(embedding, "FEW", 5)
    rows = cloud(1, 40, 8, 3, 0.3) + [(1000 + i, [1.0] * 8) for i in range(30)]
    assert got(spark, rows, size=7) == brute(rows)


def test_a_pair_counts_once_whatever_blocks_it_shares():
    rng = np.random.default_rng(3)
    x = embedding.unit(rng.normal(size=(1, 24)) + rng.normal(size=(300, 24)) * 0.25)
    split = embedding.Split(x[:50], 0.9, 4)
    pairs = [(int(a), int(c)) for b in range(split.blocks) for p, q in embedding.compare(split, b, x, x, True, 0.9) for a, c in zip(p, q)]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if x[i] @ x[j] >= 0.9}
    assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == want
