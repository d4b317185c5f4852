import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, exact_dedup, simhash, toxicity

from .samples import DOCS, docs
from .test_native import brute_hits

SF = "/root/testdata/sf0.001"


def shingles(t, width=5):
    w = t.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(rows, similarity=0.8):
    sets = {i: shingles(t or "") for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    while True:
        old = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return label


@pytest.mark.parametrize("lanes", [2048, 4])
def test_near_copies_brute(spark, lanes):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 400]))]
        for k in range(rng.choice([1, 2, 7])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 12]) if len(w) > 50 else k % 2):
                w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
            rows.append((len(rows), " ".join(w), "s", "l"))
    rows += [(500, None, "s", "l"), (501, "", "s", "l"), (502, " \n", "s", "l")]
    got = [r.doc_id for r in simhash.drop_near_copies(docs(spark, rows), lanes=lanes).collect()]
    groups = brute_groups([r[:2] for r in rows])
    assert len(got) == len(set(got))
    assert sorted(groups[i] for i in got) == sorted(set(groups.values()))  # one document of each group


@pytest.mark.parametrize("copies", [7, 12, 30])
def test_copies_in_a_crowded_key(spark, copies):
    """They differ in one fixed word, so that all keys have the same documents, in several slices."""
    rng = random.Random(copies)
    rows = []
    for g in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for k in range(copies):
            rows.append((len(rows), " ".join(base[:-1] + [f"g{g}no{k}"]), "s", "l"))
    got = [r.doc_id for r in simhash.drop_near_copies(docs(spark, rows), lanes=4).collect()]
    assert sorted(i // copies for i in got) == [0, 1, 2]


@pytest.mark.parametrize("lanes", [2048, 16])
def test_true_pair_among_many_less_similar(spark, lanes):
    """Texts that share a passage, at about 0.75 to one another, and one pair at 0.82 that is seldom among the nearest."""
    rng = random.Random(11)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for _ in range(40):
            rows.append((len(rows), " ".join(base[:345] + [f"x{rng.randrange(10**6)}" for _ in range(55)]), "s", "l"))
        w = rows[-1][1].split()
        rows.append((len(rows), " ".join(w[:362] + [f"x{rng.randrange(10**6)}" for _ in range(38)]), "s", "l"))
    rng.shuffle(rows)
    groups = brute_groups([r[:2] for r in rows])
    assert len(set(groups.values())) == len(rows) - 8
    got = [r.doc_id for r in simhash.drop_near_copies(docs(spark, rows), lanes=lanes).collect()]
    assert sorted(groups[i] for i in got) == sorted(set(groups.values()))


def test_drop_copies(spark):
    rows = DOCS + [DOCS[0], DOCS[7], DOCS[7]]
    kept = [r.doc_id for r in exact_dedup.drop_copies(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([8, 4, 5, 6, 7, 9, None], key=str)


def test_stages_one_by_one(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in d.collect()}
    model = toxicity.train(d, spark.read.parquet(f"{SF}/labels.parquet"))
    score_of = model.scorer()
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, d, SF)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows.items() if score_of(t or "") < 0.7}
    assert clean.columns == d.columns
    one = stages["exact dedup"](spark, d, SF)
    last = {}
    for i, t in rows.items():
        last[t or ""] = max(i, last.get(t or "", i))
    assert {r.doc_id for r in one.collect()} == set(last.values()) and one.columns == d.columns
    near = stages["simhash near-dedup"](spark, one, SF)
    left = [(i, rows[i]) for i in last.values()]
    groups = brute_groups(left)
    got = [r.doc_id for r in near.collect()]
    assert sorted(groups[i] for i in got) == sorted(set(groups.values())) and near.columns == d.columns
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    safe = stages["decontamination"](spark, d, SF)
    assert {r.doc_id for r in safe.collect()} == {h[0] for h in brute_hits(list(rows.items()), bench) if not h[5]} and safe.columns == d.columns


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    own = bpe.Tokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert 0 < len(got) < len(rows)
    for r in got:
        assert r.ids == own.encode(rows[r.doc_id] or "")


def test_empty_documents(spark):
    d = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, SF).count() == 0, name


def text_sets(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    return simhash.shingle_sets(df, "text", 5)


def test_pairs_just_above_the_similarity_are_found(spark):
    rng = random.Random(21)
    rows = []
    for pair in range(2000):
        n = rng.randrange(120, 200)
        base = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        own = lambda: base[: n - round(n * rng.uniform(0.087, 0.107))]
        rows += [(2 * pair + k, " ".join(w + [f"x{rng.randrange(10**7)}" for _ in range(n - len(w))]), "s", "l") for k, w in enumerate((own(), own()))]
    like = [len(a & b) / len(a | b) for a, b in zip((shingles(r[1]) for r in rows[::2]), (shingles(r[1]) for r in rows[1::2]))]
    near = [i for i, x in enumerate(like) if 0.8 <= x <= 0.84]
    kept = {r.doc_id for r in simhash.drop_near_copies(docs(spark, rows)).collect()}
    found = sum(len({2 * i, 2 * i + 1} & kept) == 1 for i in near)
    assert len(near) > 800 and found >= 0.99 * len(near)
    assert all({2 * i, 2 * i + 1} <= kept for i, x in enumerate(like) if x < 0.8)


def test_texts_that_share_too_little_are_not_compared(spark):
    """2,000 texts at about 0.75 to one another: none is left to compare."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**7)}" for _ in range(200)]
    sets = text_sets(spark, [" ".join(base[:172] + [f"x{rng.randrange(10**9)}" for _ in range(28)]) for _ in range(2000)])
    bounds = simhash.matchable(sets, 0.8)
    assert bounds.count() == 2000  # each might be similar to a shorter text
    assert simhash.possible(bounds.withColumn("key", F.lit(1)), "key", 0.8).count() == 0


def test_bounds_never_part_similar_sets(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        texts += [" ".join(w if rng.random() > 0.02 else "y" for w in base[: rng.randrange(5, len(base) + 1)]) for _ in range(6)]
    sets = {r["node"]: set(r["set"]) for r in text_sets(spark, texts).collect()}
    room = {r["node"]: (r["n"], r["m"]) for r in simhash.matchable(text_sets(spark, texts), 0.8).collect()}
    kept = {r["node"] for r in simhash.possible(simhash.matchable(text_sets(spark, texts), 0.8).withColumn("key", F.lit(1)), "key", 0.8).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 50
    for a, b in pairs:
        assert {a, b} <= kept and min(room[a][1], room[b][1]) >= 0.8 / 1.8 * (room[a][0] + room[b][0]) - 1e-6
