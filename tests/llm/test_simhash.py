import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash

from .samples import DOCS, docs


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=2):
    fp = [(i, brute_print(t)) for i, t in rows]
    label = list(range(len(fp)))
    while True:
        old = list(label)
        for a in range(len(fp)):
            for b in range(len(fp)):
                if (fp[a][1] ^ fp[b][1]).bit_count() <= radius:
                    label[a] = min(label[a], label[b])
        if old == label:
            break
    least = {}
    for (i, _), g in zip(fp, label):
        least.setdefault(g, []).append(i)
    return sorted(((i, f"{p:016x}", min((x for x in least[g] if x is not None), default=None)) for (i, p), g in zip(fp, label)), key=str)


def near_rows(n=60):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(n // 6):
        base = [rng.choice(vocab) for _ in range(400)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(400)] = "x"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("lanes", [2048, 2])
def test_groups_brute(spark, lanes):
    rows = near_rows() + [(1000 + (i or 0) if i is not None else None, t) for i, t, *_ in DOCS]
    got = simhash.near_groups(docs(spark, [(i, t, "s", "l") for i, t in rows]), lanes=lanes).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_empty(spark):
    assert simhash.near_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("words,radius", [(1, 2), (1, 0), (1, 7), (4, 60)])
def test_near_pairs_brute(words, radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (40, words), dtype=np.uint64)
    fps = base[rng.integers(0, 40, 700)]
    for _ in range(3):
        fps[np.arange(700), rng.integers(0, words, 700)] ^= np.uint64(1) << rng.integers(0, 63, 700).astype(np.uint64)
    keys = np.sort(rng.integers(0, 9, 700))
    a, b = simhash.near_pairs(fps, keys, radius)
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if keys[i] == keys[j] and int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text, 3) == whole and whole & (2**64 - 1) == brute_print(text)


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1002), (1002, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and got[1001] == got[1002] == 1000
