import hashlib
import json
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer as Library

from tidemark.llm import bpe

from .samples import DOCS, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(open(PATH, encoding="utf-8").read())


def same(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert got == want, text[:200]
    assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_hard_texts(own, library):
    for text in ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaa", "don't I'LL we've 's", "x<|endoftext|>y <|startoftext|>", "ΣΑΣ Σ İstanbul ß ﬁ", "é ́ x\u001cy\u0085z w​v", "😀👩‍👩‍👧 中文字 ١٢٣ ½", "ababababab " * 30, "==>>!!??..--", "\0\x01\x7f", "a" * 3000] + [r[1] or "" for r in DOCS]:
        same(own, library, text)


def test_random_texts(own, library):
    rng = random.Random(1)
    for alphabet in ["ab", "aeiou nrst", "thine", "<|>endoftxt ", "éèüñ ab'", "0123 ab!?."]:
        for _ in range(400):
            same(own, library, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))))


def test_table(spark, library):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode(df, PATH, want=("n_tokens", "ids", "ids_sha256", "decoded_sha256")).collect()}
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g.ids == ids and g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_round_trip(spark, own):
    df = docs(spark)
    enc = bpe.encode(df, PATH, want=("n_tokens", "ids", "decoded"))
    assert enc.count() == len(DOCS) and bpe.encode(docs(spark, []), PATH).count() == 0
    back = {r.doc_id: r.decoded for r in bpe.decode(enc, PATH).collect()}
    assert back == {r.doc_id: r.decoded for r in enc.collect()}
    assert back[3] == back[4] == ""


def test_pieces(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    same(own, library, "some words, ÉCOLE é " * 40)


@pytest.mark.parametrize("change", [("normalizer", {"normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]}), ("decoder", {"type": "ByteLevel"}), ("added_tokens", [{"id": 1, "content": "<x>", "single_word": False, "lstrip": True, "rstrip": False, "normalized": False}])])
def test_unknown_settings_are_refused(change):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec[change[0]] = change[1]
    with pytest.raises(ValueError):
        bpe.Tokenizer(json.dumps(spec))


def test_a_full_memory_keeps_what_is_asked_again(monkeypatch):
    """op1: words that come often are encoded once, however many others come between."""
    from tidemark.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    made = []
    memo = bpe._Memo(lambda w: made.append(w) or (w, w))
    for i in range(500):
        assert memo[f"rare{i}"] == (f"rare{i}",) * 2 and memo["often"] == ("often", "often")
    assert made.count("often") == 1 and len(made) == 501 and len(memo) + len(memo.before) <= 20
