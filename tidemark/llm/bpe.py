"""BPE encoding by dynamic programming over prefixes, and decoding.

The merge procedure gives every prefix of a word one token sequence, whose last token is unique. So one table entry a
prefix is enough: an automaton reports the vocabulary tokens that are suffixes of the prefix; the one that is compatible
with the last token of the prefix before it is stored. Following the entries back from the end of the word gives the
ids that merging would give. Two tokens are compatible if merging their joined text leaves exactly these two, which is
tested by undoing their merges, latest first, along the common border.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

END, NEVER = "\0", 1 << 62
#: Texts are worked through in pieces of about this many characters, cut at white space.
PIECE = 1 << 20
#: Words whose ids a worker remembers at most, and as many of the time before.
REMEMBERED = 150_000
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


# The settings of a tokenizer file that this encoder implements.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def refuse_others(whole: dict) -> None:
    """Raise for any setting that would give other ids than this encoder's."""
    steps, model = whole["pre_tokenizer"]["pretokenizers"], whole["model"]
    wrong = [
        whole["normalizer"]["normalizers"] != NORMALIZERS, steps[0] != SPLIT, len(steps) != 2 or steps[1]["type"] != "ByteLevel" or steps[1]["add_prefix_space"] or steps[1].get("use_regex", True),
        whole["decoder"] is not None, not model["end_of_word_suffix"], any(model.get(k) not in (v, None) for k, v in MODEL.items()), any(t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    ]
    if any(wrong):
        raise ValueError("a word-level BPE file with an end-of-word suffix, no decoder and the settings above is needed")


class Tokenizer:
    """A tokenizer of words with an end-of-word suffix, from the JSON of a tokenizer file."""

    def __init__(self, spec: str) -> None:
        whole = json.loads(spec)
        model = whole["model"]
        refuse_others(whole)
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.name = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.letter = byte_letters()
        self.merged: dict[tuple[int, int], int] = {}  # pair -> rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ids = vocab[left], vocab[right]
            self.merged.setdefault(ids, rank)
            made = vocab[left + right]
            if made not in self.parts:
                self.parts[made], self.rank[made] = ids, rank
        self.known: dict[tuple[int, int], bool] = {}
        sound: dict[int, bool] = {}
        for made in sorted(self.rank, key=self.rank.get):  # a token that merging its own text never yields is no candidate
            a, b = self.parts[made]
            sound[made] = sound.get(a, True) and sound.get(b, True) and self._fits(a, b, True)
        self.suffixes = ahocorasick.Automaton()
        for text, i in vocab.items():
            if sound.get(i, True):
                last = text.endswith(suffix) and len(text) > len(suffix)
                key = text.removesuffix(suffix) + END if last else text
                self.suffixes.add_word(key, (i, len(key) - last))
        self.suffixes.make_automaton()
        self.pair_of = _Memo(self._pair)

    def _fits(self, left: int, right: int, joined: bool = False) -> bool:
        """joined: that left and right themselves merge is no objection."""
        limit = NEVER
        while True:
            rank = self.merged.get((left, right), NEVER)
            if rank < limit and not joined:
                return False
            joined = False
            r_left, r_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if r_left < 0 and r_right < 0:
                return True
            if r_left > r_right:  # undo the later merge; of equal ones the right, as merging goes from left to right
                limit, left = r_left, self.parts[left][1]
            else:
                limit, right = r_right + 1, self.parts[right][0]

    def fits(self, left: int, right: int) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[left, right] = self._fits(left, right)
        return found

    def word_ids(self, word: str) -> list[int]:
        s = "".join(map(self.letter.__getitem__, word.encode()))
        n = len(s)
        last: list = [None] * (n + 1)  # last token of each prefix, and its length
        fits = self.fits
        for at, (token, size) in self.suffixes.iter(s + END):
            end = at + 1 if at < n else n  # the END mark adds no letter
            if (at == n - 1) or last[end] is not None:
                continue  # the whole word must end with a token that has the suffix
            start = end - size
            if start == 0 or (last[start] is not None and fits(last[start][0], token)):
                last[end] = (token, size)
        ids, at = [], n
        while at:
            token, size = last[at]
            ids.append(token)
            at -= size
        return ids[::-1]

    def _pair(self, word: str) -> tuple[str, str]:
        """A word's ids as text ("320 1125") and what they decode to."""
        ids = self.word_ids(word)
        return " ".join(map(str, ids)), " ".join(map(self.name.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def chunks(self, text: str) -> Iterator[list[tuple[str, str]]]:
        """Lists of id texts and what they decode to, one pair a word."""
        at = 0
        for m in self.cut.finditer(text):
            yield from self._plain(text[at : m.start()])
            yield [(str(self.added[m[0]]), self.name[self.added[m[0]]])]
            at = m.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[list[tuple[str, str]]]:
        at = 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end] not in " \n\t":
                end += 1
            yield list(map(self.pair_of.__getitem__, self.words(text[at:end])))
            at = end

    def encode(self, text: str) -> list[int]:
        return [int(i) for chunk in self.chunks(text) for ids, _ in chunk for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts joined by a space, special tokens included: the file has no decoder."""
        return " ".join(map(self.name.__getitem__, ids))


class _Memo(dict):
    """When full it starts anew, but what is asked again comes over from the memory before, so frequent words are made once."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> tuple[str, str]:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        made = self[key] = self.before.get(key) or self.make(key)
        return made


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(spec: str) -> Tokenizer:
    """One tokenizer a worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(spec)
    return _LOADED[key]


def row(t: Tokenizer, text: str, want: tuple[str, ...]) -> list:
    """What is wanted of one text; ids as an array of 32-bit numbers, as Python's would take ten times the memory."""
    n, sep = 0, b""
    ids_sha, text_sha, ids, decoded = hashlib.sha256(), hashlib.sha256(), [], []
    for chunk in t.chunks(text):
        if chunk:
            of_words, texts = zip(*chunk)
            line, plain = " ".join(of_words), " ".join(texts)  # decoded from the ids, word by word
            n += line.count(" ") + 1
            ids_sha.update(sep + line.encode())
            text_sha.update(sep + plain.encode())
            sep = b" "
            if "ids" in want:
                ids.append(np.fromstring(line, np.int32, sep=" "))
            if "decoded" in want:
                decoded.append(plain)
    made = {"n_tokens": n, "ids": np.concatenate(ids) if ids else np.empty(0, np.int32), "decoded": " ".join(decoded), "ids_sha256": ids_sha.hexdigest(), "decoded_sha256": text_sha.hexdigest()}
    return [made[w] for w in want]


#: Texts whose results are held at once, in bytes of text.
HELD = 4 << 20


def portions(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most about HELD bytes of text (column 1), or one row."""
    at, size = 0, 0
    for i, length in enumerate(pc.binary_length(b.column(1)).to_pylist()):
        if size and size + length > HELD:
            yield b.slice(at, i - at)
            at, size = i, 0
        size += length
    if at < b.num_rows:
        yield b.slice(at)


def id_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


TYPES = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", want: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """One row per document: the id and what is wanted of n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    ``path`` names the tokenizer file on the driver; its text (a few MB) is broadcast. Null texts count as empty and have
    no tokens. Rows are independent: repeated rows give equal results, an empty table an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec.value)
        for b in batches:
            for part in portions(b):
                cols = zip(*[row(t, text, want) for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(id_lists(c) if w == "ids" else pa.array(c, TYPES[w][1]) for w, c in zip(want, cols))], ["id", *want])

    schema = f"id {kind}, " + ", ".join(f"{w} {TYPES[w][0]}" for w in want)
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id and ``decoded``. A null or empty list of ids decodes to the empty text."""
    spark = rows.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(ids or []) for ids in b.column(1).to_pylist()], pa.string())], ["id", "decoded"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)
