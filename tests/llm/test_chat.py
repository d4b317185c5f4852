import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")


@pytest.fixture(scope="module")
def model(turns):
    return chat.train(turns.where(~chat.held_out(F.col("conv_id"))))


def test_held_out_roles(turns, model):
    got = chat.format_turns(turns, model).join(turns.withColumnRenamed("role", "given"), ["conv_id", "turn"]).where(chat.held_out(F.col("conv_id")))
    r = got.agg(F.avg((F.col("role") == F.col("given")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.a > 0.95


def test_raw_transcript(spark, model):
    text = "System: be kind\nUser: hello there\nsecond line\n**Assistant:** hi\nmore\n\nHuman: why?\nAI> because"
    got = sorted((r.line, r.role, r.body) for r in chat.format_transcripts(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect())
    assert [r for _, r, _ in got] == ["system", "user", "user", "assistant", "assistant", "assistant", "user", "assistant"]
    assert got[0][2] == "be kind" and got[3][2] == "hi" and got[7][2] == "because"


def brute(model, opens, e):
    steps = chat._steps(model, np.array(opens), True)
    score = lambda p: sum(steps[i][p[i - 1] if i else 0, p[i]] + e[i, p[i]] for i in range(len(p)))
    return max(itertools.product(range(3), repeat=len(opens)), key=score)


def test_segments_equal_the_whole_path(spark, model, monkeypatch):
    texts = ["a?", "b " * 40, "c", "User: d", "e " * 99 + "\nf", "g", "AI: h", "i?"]
    df = spark.createDataFrame([(c, i, t) for c in (1, None) for i, t in enumerate(texts)] + [(1, 0, "a?")], "conv_id long, turn int, text string")
    whole = {(r.conv_id, r.turn): r.role for r in chat.format_turns(df, model).collect()}
    monkeypatch.setattr(chat, "SEGMENT", 1)
    monkeypatch.setattr(chat, "CHAIN", 3)  # eight segments: two levels
    cut = {(r.conv_id, r.turn): r.role for r in chat.format_turns(df, model).collect()}
    assert whole == cut and len(whole) == 16
    shown = df.where("conv_id = 1").distinct().orderBy("turn").select(*[c.alias(f) for f, c in chat.features(F.col("text")).items()]).toPandas()
    e = model.emissions({f: shown[f].to_numpy() for f in chat.FEATURES})
    assert [whole[1, i] for i in range(8)] == [chat.ROLES[s] for s in brute(model, [True] * 8, e)]


def test_odd_rows(spark, model):
    df = spark.createDataFrame([(1, None, None, None), (2, 0, "user", None), (2, 0, "user", None), (3, 5, "x", " Bot: hi ")], "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS c", "2 AS p", "3 AS s", "4 AS opens")
    got = {r.conv_id: r for r in chat.format_report(df).collect()}
    assert len(got) == 3 and got[2].n_chars == len(f"<|{got[2].role}|>\n\n<|end|>\n") and got[2].n_rows == 2
    rendered = f"<|{got[3].role}|>\nhi \n<|end|>\n"
    assert got[3].rendered_sha256 == hashlib.sha256(rendered.encode()).hexdigest()
    assert chat.format_report(df.limit(0)).count() == 0


def test_turns_with_several_speakers(spark, model):
    texts = ["Hello, is anybody there?", "User: what is this?\nsecond line\nAssistant: an answer\nHuman: thanks", "You are welcome.\n\nBye."]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "conv_id string, turn int, text string")
    got = {r.turn: r for r in chat.format_conversations(df, model).collect()}
    assert [got[i].n_messages for i in range(3)] == [1, 3, 1]
    assert got[1].rendered == "<|user|>\nwhat is this?\nsecond line\n<|end|>\n<|assistant|>\nan answer\n<|end|>\n<|user|>\nthanks\n<|end|>\n"
    assert got[2].rendered == f"<|{got[2].role}|>\nYou are welcome.\n\nBye.\n<|end|>\n"


def test_a_null_turn_stands_beside_any_number(spark, model):
    rows = [("a", -1, "User: minus one"), ("a", None, "User: null"), ("a", 10**16 + 7, "AI: far\nsecond"), ("a", -(2**62), "AI: far back"), (None, None, "Human: alone")]
    got = {(r.conv_id, r.turn): (r.role, r.n_messages, r.rendered) for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id string, turn long, text string"), model).collect()}
    assert got == {
        ("a", -1): ("user", 1, "<|user|>\nminus one\n<|end|>\n"), ("a", None): ("user", 1, "<|user|>\nnull\n<|end|>\n"), ("a", 10**16 + 7): ("assistant", 1, "<|assistant|>\nfar\nsecond\n<|end|>\n"),
        ("a", -(2**62)): ("assistant", 1, "<|assistant|>\nfar back\n<|end|>\n"), (None, None): ("user", 1, "<|user|>\nalone\n<|end|>\n"),
    }
    turns = {r.turn for r in chat.format_turns(spark.createDataFrame(rows, "conv_id string, turn long, text string"), model).where("conv_id = 'a'").collect()}
    assert turns == {-1, None, 10**16 + 7, -(2**62)}


def test_one_long_turn_leaves_the_other_segments_alone(spark, model, monkeypatch):
    """Segments follow the order of lines, so they number the lines over their size, whatever a turn's length or number."""
    made = []
    ends = chat.segment_ends
    monkeypatch.setattr(chat, "segment_ends", lambda m: made.append(m.count()) or ends(m))
    short = [(c, t, f"turn {t} of {c}") for c in range(300) for t in range(10)]
    long = [(0, 10, "\n".join(f"line {i}" for i in range(3000)))]
    for rows in (short, short + long):
        chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).count()
    assert made[0] <= 300 + 3000 / chat.SEGMENT + 8 and made[1] - made[0] <= 3000 / chat.SEGMENT + 8
