"""Secret scan: known shapes, plus high-entropy strings found by a sliding window.

Known shapes are regular expressions. Besides them, each candidate string is read once, left to right, by a window of
``WINDOW`` characters: a fold keeps the counts of the window's characters and the sum of c*log2(c), adjusts both for the
character that enters and the one that leaves, and so has the window's Shannon entropy at every position. A candidate is
a secret if some window that the allow-list leaves alone reaches the threshold of its character class. The fold runs where
the text was read, before anything is shuffled.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

# The known shapes, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"  # runs of 24 and more are the runs of [0-9a-f]+ that do not fail
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,}+)"
KINDS = ["assign", "access", "hex", "entropy"]
#: Position of a character in this text is its counter.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Bits a character that some window must reach, by character class of the string.
HEX_BITS, DIGIT_BITS, LETTER_BITS, MIXED_BITS = 2.9, 2.9, 3.85, 3.7
#: Allow-list: strings that look random and are none as a whole (UUID-like groups, paths, rules) ...
ALLOW = [r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^(/[A-Za-z_-]+){2,}/?$", r"^[-_=+/]+$"]
#: ... and parts that no window may touch (placeholders, long repeats, key ranges); the rest of the string still counts.
ALLOW_PARTS = [r"(?i:example|placeholder|changeme|your_|dummy|sample|abcdefgh|01234567|12345678)", r"(.)\1{7,}"]
#: Counters of 5 bits in a long.
PACKED = 12


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Highest entropy, in bits a character, of any window of an ASCII string; strings shorter than the window give 0.

    The counts of the window's characters are packed, 5 bits each, into six longs, so a step touches two counters whatever
    the alphabet, and no step looks at the window again. Each step gets the character that enters and the one that leaves
    from one array made beforehand, so the fold is linear in the string.
    """
    if not 1 <= window <= 31:
        raise ValueError("counters have 5 bits: the window must be 1 to 31")
    longs = range(-(-len(ALPHABET) // PACKED))
    bits = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(33)])

    def f(c: Column) -> Column:
        return F.element_at(bits, (c + 1).cast("int"))

    def count(a: Column, slot: Column) -> Column:
        held = a["w0"]
        for k in longs[1:]:
            held = F.when(slot >= PACKED * k, a[f"w{k}"]).otherwise(held)
        return F.call_function("shiftright", held, slot % PACKED * 5).bitwiseAND(F.lit(31))

    def one(slot: Column, k: int) -> Column:
        return F.when((slot >= PACKED * k) & (slot < PACKED * (k + 1)), F.call_function("shiftleft", F.lit(1).cast("long"), slot % PACKED * 5)).otherwise(F.lit(0).cast("long"))

    def step(a: Column, p: Column) -> Column:
        new, old = p["new"], F.when(p["old"] == p["new"], F.lit(-1)).otherwise(p["old"])
        gone, have = count(a, F.greatest(old, F.lit(0))), count(a, F.greatest(new, F.lit(0)))
        total = a["sum"] + F.when(old >= 0, f(gone - 1) - f(gone)).otherwise(F.lit(0.0)) + F.when(p["old"] != new, f(have + 1) - f(have)).otherwise(F.lit(0.0))
        moved = [(a[f"w{k}"] + F.when(p["old"] != new, one(new, k)).otherwise(F.lit(0).cast("long")) - one(old, k)).alias(f"w{k}") for k in longs]
        best = F.when(p["i"] >= window, F.greatest(a["best"], F.lit(log2(window)) - total / window)).otherwise(a["best"])
        return F.struct(*moved, total.alias("sum"), best.alias("best"))

    slots = F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    pairs = F.transform(F.arrays_zip(slots.alias("new"), F.concat(F.array_repeat(F.lit(-1), window), slots).alias("old")), lambda p, i: F.struct(p["new"].alias("new"), p["old"].alias("old"), (i + 1).alias("i")))
    start = F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in longs], F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(F.filter(pairs, lambda p: p["new"].isNotNull()), start, step, lambda a: a["best"])


def is_secret(s: Column, allow: list[str] = ALLOW, allow_parts: list[str] = ALLOW_PARTS) -> Column:
    """Whether a candidate's entropy is that of a key, by the class of its characters: hex, digits, letters or mixed.

    A match of ``allow`` suppresses the whole candidate, one of ``allow_parts`` the windows that touch it.
    """
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | s.rlike(pattern)

    def high(x: Column) -> Column:
        bits = F.when(x.rlike("^[0-9]+$"), F.lit(DIGIT_BITS)).when(x.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX_BITS)).when(x.rlike("^[^0-9]+$"), F.lit(LETTER_BITS)).otherwise(F.lit(MIXED_BITS))
        return F.when(F.char_length(x) >= WINDOW, window_entropy(x) >= bits).otherwise(F.lit(False))

    parts = F.split(s, "|".join(allow_parts), -1) if allow_parts else F.array(s)
    return F.when(~allowed, F.exists(parts, high)).otherwise(F.lit(False))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: list[str] = ALLOW, allow_parts: list[str] = ALLOW_PARTS) -> DataFrame:
    """One row per span: id, digest (of the text), kind, start, end (code points, end exclusive), value."""
    text = F.col("text")

    def found(kind: str, pattern: str, group: int = 1) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        rows = F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(p["gap"]).alias("gap"), F.char_length(p["whole"]).alias("len"), p["value"].alias("value")))
        return F.when(text.rlike(pattern), rows)

    kinds = [found("assign", ASSIGN, 2), found("access", ACCESS), found("hex", HEX), found("entropy", CANDIDATE)]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("digest"), F.array(*kinds).alias("kinds"))
    rows = rows.select("id", "digest", F.explode(F.flatten(F.filter("kinds", lambda k: k.isNotNull()))).alias("m")).select("id", "digest", "m.*")
    good = (
        F.when(F.col("kind") == "assign", F.char_length("value") >= 6)
        .when(F.col("kind") == "access", F.col("len") >= 20)
        .when((F.col("kind") == "entropy") & F.col("value").isNotNull(), is_secret(F.col("value"), allow, allow_parts))
        .otherwise(F.lit(True))
    )
    rows = rows.select("id", "digest", "kind", "i", "gap", "len", F.when(good & F.col("len").isNotNull(), F.col("value")).alias("value"))
    # Repeated rows give equal matches; sums over them are divided by their number.
    so_far = Window.partitionBy("id", "digest", "kind").orderBy("i").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.sum(F.coalesce(F.col("gap") + F.col("len"), F.lit(0))).over(so_far) / F.sum((F.col("i") == 0).cast("long")).over(so_far)).cast("long")
    placed = rows.withColumn("end", end).where(F.col("value").isNotNull())
    return placed.select("id", "digest", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value").distinct()


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: list[str] = ALLOW, allow_parts: list[str] = ALLOW_PARTS) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Null texts count as empty and have no span. Documents that repeat an id are told apart by their texts; repeated rows
    give equal results. Letters' case is ASCII case. Spans are sorted by start, then kind as listed in KINDS. Texts of any
    length are read whole; an empty table gives an empty result; columns other than id and text are not read.
    """
    found = spans(docs, id_col, text_col, allow, allow_parts)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    marks = F.array_sort(F.collect_list(F.struct("start", order.alias("k"), "end", "kind")))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    sums = found.groupBy("id", "digest").agg(marks.alias("marks"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]).select(
        "id", "digest", *[f"n_{k}" for k in KINDS], F.array_join(F.transform("marks", name), ",").alias("spans"), F.array_join(F.transform(F.filter("marks", lambda s: s["kind"] != "entropy"), name), ",").alias("base"),
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("digest"))
    on = rows["id"].eqNullSafe(sums["id"]) & (rows["digest"] == sums["digest"])
    zero = F.lit(0).cast("long")
    return rows.join(sums, on, "left").select(
        rows["id"].alias(id_col), *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_entropy", zero).alias("n_entropy"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", allow: list[str] = ALLOW, allow_parts: list[str] = ALLOW_PARTS) -> DataFrame:
    """The documents, all columns, with every span of ``secret_report`` replaced by a mark. Null texts stay null."""
    found = spans(docs, id_col, text_col, allow, allow_parts).groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts")).select(F.col("id").alias("_cut_id"), F.col("digest").alias("_cut_digest"), "cuts")
    text = text_of(text_col)

    def cut(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.col("cuts"), start, cut, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))
    on = F.col(id_col).eqNullSafe(F.col("_cut_id")) & (F.xxhash64(text) == F.col("_cut_digest"))
    return docs.join(found, on, "left").select(*[F.when(F.col("cuts").isNotNull(), clean).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
