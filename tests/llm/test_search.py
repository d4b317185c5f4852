"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.samples import docs
from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "the quick brown fox"), (2, "Über den RIVER bank bank bank"), (3, None), (4, "zzz unknown"), (None, "null item fox"), (5, "wordy end"), (5, "fin token")]


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, items, k):
    """Scores by the formula, one document at a time."""
    bags = [(i, terms(t)) for i, t in rows]
    n, length = sum(bool(w) for _, w in bags), max(1, sum(len(w) for _, w in bags))
    df = Counter(t for _, w in bags for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, w in bags:
            tf, m = Counter(w), 75 + 25 * len(w) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in ts if tf[t])
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r + 1, x[2] if x[1] else None, -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_of(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS id", "'b' AS bag", "2 AS h", "3 AS score")


@pytest.mark.parametrize("block", [lexical.BLOCK, 30])
def test_equals_brute_force_in_one_block_and_in_many(spark, block):
    df = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for k in (2, 20):
        assert got(lexical.search(df, items_of(spark), k=k, block=block)) == brute(rows, ITEMS, k)


def test_crowded_classes_rank_by_id_and_repeated_rows_take_ranks(spark):
    rows = [(100 - i % 50, "alpha beta beta") for i in range(120)] + [(7, "alpha gamma"), (8, "beta alpha beta"), (None, "alpha beta beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [(1, "alpha beta"), (2, "gamma")]
    assert got(lexical.search(df, items_of(spark, items), k=5)) == brute(rows, items, 5)


def test_sums_beyond_doubles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 4)
    rows, items = [(i, f"a{i} b c " * (i + 1)) for i in range(9)], [(1, "a1 b " * 100_000), (2, "c a8")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(lexical.search(df, items_of(spark, items), k=4)) == brute(rows, items, 4)


def test_long_texts_are_split_at_spaces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 5)
    text = "Ünder_score, ONE two three \x00four" * 3
    assert [w.decode() for ws in lexical.words_of(text.encode()) for w in ws] == terms(text)


def test_empty_tables(spark):
    none, some = docs(spark).limit(0), items_of(spark)
    assert got(lexical.search(none, some)) == []
    assert got(lexical.search(docs(spark), some.limit(0))) == []
    assert got(lexical.search(docs(spark), some.where(F.col("item_id") == 3))) == []
