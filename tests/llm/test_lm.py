from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from tidemark import shared
from tidemark.llm import lm

from .samples import DOCS, docs


def tokens(t):
    return (t or "").encode().lower().split() + [b"<end>"]


def brute(rows):
    train = [t for i, t in rows if crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        w = tokens(t)
        out[i] = (crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in w))
    return out


@pytest.mark.parametrize("words", [2_000_000, 5, 0])
def test_base_brute(spark, words):
    got = lm.fit_and_score(docs(spark), head_words=words).collect()
    want = brute([r[:2] for r in DOCS])
    assert len(got) == len(DOCS)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score < 0


def test_empty(spark):
    assert lm.fit_and_score(docs(spark, [])).count() == 0


def test_filter_never_reads_too_little(spark):
    rows = [(i, "a " * (1 << (i % 6)) + f"rare{i} b", "s", "l") for i in range(300)]
    model, unigrams = lm.train(docs(spark, rows))
    table = {np.uint64(r.key & (2**64 - 1)): r.c for r in unigrams.collect()}
    key, read_all = np.array(list(table), np.uint64), model.load()
    read, true = lm.MIDDLE[read_all.levels(key)], np.array(list(table.values()))
    assert (read >= 2.0 ** np.floor(np.log2(true))).all()  # no false negatives
    assert np.mean(read > 2 * true) < 0.1
    strange = np.random.default_rng(0).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert np.mean(read_all.levels(strange) > 0) < 0.06


def some_texts(n=30):
    rng = np.random.default_rng(0)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 400) % 3000), "s", "l") for i in range(n)] + [(n, "", "s", "l"), (n + 1, None, "s", "l")]


def test_score_brute(spark):
    """Against dictionaries of exact levels; with many bits an entry no mark is found by chance."""
    rows = some_texts()
    texts = [[w.decode() for w in tokens(t)] for _, t, *_ in rows]
    one, two = Counter(), Counter()
    for w in texts:
        one.update(w)
        two.update(zip(["<end>", *w], w))
    read = lambda c: 0 if c == 0 else 1 if c == 1 else (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2
    n, v = sum(one.values()), len(one)
    model, unigrams = lm.train(docs(spark, rows), bits_per_entry=80)
    got = {r.doc_id: r.score for r in lm.score(docs(spark, rows), model, unigrams).collect()}
    for (i, *_), w in zip(rows, texts):
        want = sum(log10(0.6 * min(read(two[a, b]) / max(read(one[a]), 1), 1.0) + 0.4 * (read(one[b]) + 1) / (n + v + 1)) for a, b in zip(["<end>", *w], w))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_filter_beyond_the_broadcast(spark, monkeypatch):
    """Shelves give the same scores as the broadcast, with documents that go over several pieces."""
    rows = some_texts() + [some_texts()[0]]
    model, unigrams = lm.train(docs(spark, rows), bits_per_entry=400)
    assert model.segments > 4
    whole = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs(spark, rows), model, unigrams).collect())
    model, unigrams = lm.train(docs(spark, rows), bits_per_entry=400)
    small = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs(spark, rows), model, unigrams, head_words=20, max_filter_mb=0.04, stretch=150).collect())
    assert small == whole


def test_held_out_beats_unigrams(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.fit_and_score(d).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert r.s > r.b


def test_pieces(spark):
    model, _ = lm.train(docs(spark))
    f = model.load()

    def log10s(h, before=lm.END_HASH):
        q = lm.Question.of(h, before)
        return q.log10(f.levels(q.keys), model.tokens, model.vocabulary)

    h = lm.Hashes().of(lm.tokens_of(DOCS[0][1]) + lm.tokens_of(DOCS[5][1]))
    whole = log10s(h)
    parts = [log10s(h[a : a + 3], h[a - 1] if a else lm.END_HASH) for a in range(0, len(h), 3)]
    assert np.allclose(np.concatenate(parts), whole)
    alone = log10s(lm.Hashes().of(lm.tokens_of(DOCS[5][1])))
    assert np.allclose(alone, whole[-len(alone) :])


def test_counts_travel_packed(spark):
    """A row a bucket, however many n-grams; unpacked they are the brute-force counts' levels, also over several flushes."""
    rows = some_texts(60)
    got = lm.ngram_counts(docs(spark, rows)).collect()
    one, two = Counter(), Counter()
    for _, t, *_ in rows:
        h = lm.Hashes().of(lm.tokens_of(t or ""))
        one.update(h.tolist())
        two.update(lm.bigrams(h).tolist())
    assert len(two) > 2 * 1024 >= 2 * len(got)
    assert {int(k): int(c) for r in got for k, c in zip(np.frombuffer(r.one, np.uint64), np.frombuffer(r.c, np.int64))} == one
    assert {int(k): int(q) for r in got for k, q in zip(lm._unpack(r.two, r.top), r.q)} == {k: c.bit_length() for k, c in two.items()}
    assert sum(len(r.two) for r in got) == 5 * len(two)


def test_probes_of_a_large_filter_travel_packed(spark, monkeypatch):
    """What is written for pieces and shelves takes less than 10 bytes a token; it was 8 a token and 8 for each n-gram of a piece."""
    rows = [(i, " ".join(f"w{int(x)}" for x in np.random.default_rng(i).zipf(1.3, 4000) % 30000), "s", "l") for i in range(40)]
    model, unigrams = lm.train(docs(spark, rows))
    made = {}

    def kept(df, label):
        made[label] = shared.durable(df, label)
        return made[label]

    monkeypatch.setattr(lm, "durable", kept)
    got = lm.score(docs(spark, rows), model, unigrams, max_filter_mb=0.04)
    assert got.count() == 40 and sum(r.n_tokens for r in got.collect()) == 40 * 4001
    pieces = made["scored"].where("piece IS NOT NULL")
    sent = sum(len(v) for r in pieces.collect() for v in (r["data"], r["words"]) if v is not None)
    assert sent < 10 * 40 * 4001
    key = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (lm.unsteps(lm.steps(key)) == key).all() and len(lm.unsteps(lm.steps(key[:0]))) == 0


def test_shuffles_go_when_their_table_is_written(spark, tmp_path):
    """Spark's setting is on for the write alone."""
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []

    class Writer:
        sparkSession = spark

        @property
        def write(self):
            seen.append(spark.conf.get(name))
            return spark.range(3).repartition(2).write

    before = spark.conf.get(name, None)
    shared.written(Writer(), f"{tmp_path}/t")
    assert seen == ["true"] and spark.conf.get(name, None) == before and spark.read.parquet(f"{tmp_path}/t").count() == 3
