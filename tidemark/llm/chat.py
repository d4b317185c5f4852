"""Chat formatting: a hidden Markov model recovers the speakers of a transcript, then turns are rendered in one form.

A transcript is a sequence of units, whole messages or single lines. Each unit shows a speaker marker, a length, whether
it asks, whether it has several lines; the hidden state is the role. Units that open a message pass roles by learned
transitions, other units keep the role. Viterbi's best path is exact for any length: transcripts are cut into segments, each
gives a small matrix of best scores from entry to exit role. Neighbouring matrices are multiplied (best score for sum, sum
for product) in groups of ``CHAIN``, level by level, until one is left; on the way back each group tells its members the
roles at their ends, and every segment traces its own part of the best path. No task ever holds a whole long transcript, nor
all its matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, ship

ROLES = ["system", "user", "assistant"]
# How transcripts name their speakers, at the start of a line.
SPEAKERS = {"system": "system|instructions?|context", "user": "user|human|q|question|you|me|customer|prompt", "assistant": "assistant|ai|bot|a|answer|agent|gpt|model|response"}
MARKER = r"^\s*(?:[#>*\[(<|_-]{0,4}\s*)(?i:(%s))\s*(?:[*_\])>|]{0,3}\s*)[:>]\s*(?:\*\*)?\s*"
ANY = MARKER % "|".join(SPEAKERS.values())
FEATURES = {"marker": 4, "size": 12, "asks": 2, "lines": 2}
#: Units in a segment, and matrices that are multiplied at once.
SEGMENT, CHAIN = 128, 1024


def features(text: Column) -> dict[str, Column]:
    """Small integers that a unit shows."""
    marker = F.lit(0)
    for k, words in reversed(list(enumerate(SPEAKERS.values(), 1))):
        marker = F.when(text.rlike(MARKER % words), k).otherwise(marker)
    size = F.least(F.ceil(F.log2(F.char_length(text) + F.lit(1.0))), F.lit(11))
    return {"marker": marker.cast("int"), "size": size.cast("int"), "asks": text.rlike(r"\?\s*$").cast("int"), "lines": text.contains("\n").cast("int")}


@dataclass
class Model:
    start: np.ndarray  # log probabilities, by role
    move: np.ndarray  # [from, to]
    show: dict[str, np.ndarray]  # feature -> [role, value]

    def emissions(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return sum(table[:, columns[f]].T for f, table in self.show.items())


def train(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", smooth: float = 0.5, marker_trust: float = 50.0) -> Model:
    """Count roles' looks and their order over all labelled turns; rows with another or no role are left out.

    Only tables of a few hundred sums reach the driver. Turns pair with their successor by a join on (id, turn + 1), so a
    huge conversation is no hot key. ``marker_trust`` counts as many examples that a marker names its role.
    """
    rows = turns.select(F.col(id_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.lower(role_col).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x")).where(F.col("r").isin(ROLES))
    order = durable(rows.select("c", "t", "r").distinct(), "order")  # repeated rows would meet one another in the join
    place = {r: i for i, r in enumerate(ROLES)}
    show = {f: np.full((3, n), smooth) for f, n in FEATURES.items()}
    for i in range(3):
        show["marker"][i, i + 1] += marker_trust
    for row in rows.select("r", *[c.alias(f) for f, c in features(F.col("x")).items()]).groupBy("r", *FEATURES).count().collect():
        for f in FEATURES:
            show[f][place[row["r"]], row[f]] += row["count"]
    start, move = np.full(3, smooth), np.full((3, 3), smooth)
    after = order.select("c", F.col("r").alias("r0"), (F.col("t") + 1).alias("t"))
    for row in order.join(after, ["c", "t"], "left").groupBy("r0", "r").count().collect():
        if row["r0"] is None:
            start[place[row["r"]]] += row["count"]
        else:
            move[place[row["r0"]], place[row["r"]]] += row["count"]
    return Model(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), {f: np.log(t / t.sum(1, keepdims=True)) for f, t in show.items()})


#: Log probability that a unit which opens no message changes the role all the same.
SLIP = log(1e-6)


def _steps(model: Model, opens: np.ndarray, first: bool) -> list[np.ndarray]:
    """Transition matrix into each unit of a segment; into the first unit of a transcript all rows are the start vector."""
    stay = np.where(np.eye(3, dtype=bool), 0.0, SLIP)
    steps = [model.move if o else stay for o in opens]
    if first and steps:
        steps[0] = np.tile(model.start, (3, 1))
    return steps


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of equal values in the columns ``names``, from sorted rows."""
    held = None
    for b in batches:
        new = b.to_pandas()
        held = new if held is None else pd.concat([held, new], ignore_index=True)
        change = np.zeros(max(len(held) - 1, 0), bool)
        for c in names:
            change |= held[c].to_numpy()[1:] != held[c].to_numpy()[:-1]
        at = 0
        for end in np.flatnonzero(change) + 1:
            yield held.iloc[at:end]
            at = end
        held = held.iloc[at:]
    if held is not None and len(held):
        yield held


def _product(mats: list[np.ndarray]) -> np.ndarray:
    """(2, 3, 3): best scores through all of them, for a start inside a transcript and at its begin."""
    out = mats[0]
    for m in mats[1:]:
        out = (out[:, :, :, None] + m[0][None, None]).max(axis=2)
    return out


def _ends(mats: list[np.ndarray], first: bool, enter: int, leave: int) -> tuple[list[int], list[int]]:
    """Roles before and at the end of each member of a group, on the best path from ``enter`` to ``leave``."""
    own = [m[int(first and i == 0)] for i, m in enumerate(mats)]
    ahead = [np.where(np.arange(3) == enter, 0.0, -np.inf)]
    for m in own:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    before, behind, at = [], [], leave
    for i in range(len(own) - 1, -1, -1):
        behind.append(at)
        at = int(np.argmax(ahead[i] + own[i][:, at]))
        before.append(at)
    return before[::-1], behind[::-1]


MATRIX = "k string, s long, m array<double>"
ENDS = "k string, s long, enter int, leave int, first boolean"


def _levels(spread: int) -> list[int]:
    """Segments that a member of each level spans; the last level has one member a transcript."""
    widths = [1]
    while widths[-1] < spread:
        widths.append(widths[-1] * CHAIN)
    return widths


def segment_ends(matrices: DataFrame) -> DataFrame:
    """(k, s, enter, leave, first) of every segment from the matrices (k, s, m) of all: up the levels, then down."""
    matrices = durable(matrices, "matrices")
    start = durable(matrices.groupBy("k").agg(F.min("s").alias("low"), F.max("s").alias("high")), "start")
    spread = start.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    if spread is None:
        return matrices.select("k", "s", F.lit(0).alias("enter"), F.lit(0).alias("leave"), F.lit(True).alias("first"))
    widths = _levels(spread + 1)
    low = broadcast_if_small(start.select("k", "low"))
    mats = [durable(matrices.join(low, "k").select("k", (F.col("s") - F.col("low")).alias("s"), "m"), "level")]

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["k", "g"]):
            m = _product([np.array(x).reshape(2, 3, 3) for x in g["m"]])
            yield pa.RecordBatch.from_pydict({"k": [g["k"].iloc[0]], "s": [int(g["g"].iloc[0])], "m": [m.ravel().tolist()]}, pa.schema([("k", pa.string()), ("s", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["k", "g"]):
            begin = bool(g["first"].iloc[0])
            enter, leave = _ends([np.array(x).reshape(2, 3, 3) for x in g["m"]], begin, int(g["enter"].iloc[0]), int(g["leave"].iloc[0]))
            n = len(enter)
            yield pa.RecordBatch.from_arrays([pa.array(g["k"], pa.string()), pa.array(g["s"], pa.int64()), pa.array(enter, pa.int32()), pa.array(leave, pa.int32()), pa.array([begin and i == 0 for i in range(n)])], ["k", "s", "enter", "leave", "first"])

    group = F.floor(F.col("s") / CHAIN).cast("long")
    for _ in widths[1:]:
        grouped = mats[-1].select("k", group.alias("g"), "s", "m").repartition("k", "g").sortWithinPartitions("k", "g", "s")
        mats.append(durable(grouped.mapInArrow(up, MATRIX), "level"))
    # The last level's only member starts at the transcript's begin, whose row of scores is the same for any role before.
    best = F.slice("m", 10, 3)
    ends = mats[-1].select("k", "s", F.lit(0).alias("enter"), (F.array_position(best, F.array_max(best)) - 1).cast("int").alias("leave"), F.lit(True).alias("first"))
    for m in reversed(mats[:-1]):
        told = m.select("k", group.alias("g"), "s", "m").join(ends.withColumnRenamed("s", "g"), ["k", "g"])
        ends = durable(told.repartition("k", "g").sortWithinPartitions("k", "g", "s").mapInArrow(down, ENDS), "ends")
    return ends.join(low, "k").withColumn("s", F.col("s") + F.col("low")).drop("low")


def recover(units: DataFrame, model: Model, order: list[str]) -> DataFrame:
    """(c, <order>, opens, text, at, role) for units (c, <order>, opens, text): key, places, whether a message opens, text.

    Units of a transcript follow one another by the columns of ``order``, nulls first, then by text. They are laid out in one
    order over all transcripts, ``at``, whose successive units of a transcript form its segments; so neither gaps nor sizes of
    the places matter. Null texts count as empty. A null key is a transcript like any other.
    """
    spark = units.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = list(FEATURES)
    key = F.when(F.col("c").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("c").cast("string")))
    rows = units.select("c", key.alias("k"), *order, "opens", F.coalesce("text", F.lit("")).alias("text"))
    laid = rows.repartitionByRange("k", *order, F.substring("text", 1, 64)).sortWithinPartitions("k", *order, "text")
    laid = durable(laid.withColumn("at", F.monotonically_increasing_id()), "units")
    # Segments are numbered without gaps: those of a part of the layout follow those of the parts before it.
    sizes = laid.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row a partition
    begin = np.cumsum([0, *(-(-r["n"] // SEGMENT) for r in sizes)]).tolist()
    parts = spark.createDataFrame([(r["part"], n) for r, n in zip(sizes, begin)], "part long, begin long")
    looks = laid.select("k", "at", "opens", *[x.alias(f) for f, x in features(F.col("text")).items()], F.shiftright("at", 33).alias("part")).join(F.broadcast(parts), "part")
    looks = looks.withColumn("s", F.col("begin") + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / SEGMENT)).drop("part", "begin")
    sorted_looks = looks.repartition("k", "s").sortWithinPartitions("k", "s", "at")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for g in _groups(batches, ["k", "s"]):
            e = m.emissions({f: g[f].to_numpy() for f in names})
            both = []
            for is_first in (False, True):
                best = None
                for step, own in zip(_steps(m, g["opens"].to_numpy(), is_first), e):
                    best = step + own if best is None else (best[:, :, None] + step[None]).max(axis=1) + own
                both += best.ravel().tolist()
            yield pa.RecordBatch.from_pydict({"k": [g["k"].iloc[0]], "s": [int(g["s"].iloc[0])], "m": [both]}, pa.schema([("k", pa.string()), ("s", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for g in _groups(batches, ["k", "s"]):
            e = m.emissions({f: g[f].to_numpy() for f in names})
            steps = _steps(m, g["opens"].to_numpy(), bool(g["first"].iloc[0]))
            best, back = steps[0][int(g["enter"].iloc[0])] + e[0], []
            for step, own in zip(steps[1:], e[1:]):
                both = best[:, None] + step
                back.append(both.argmax(axis=0))
                best = both.max(axis=0) + own
            path = [int(g["leave"].iloc[0])]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            yield pa.RecordBatch.from_pydict({"at": g["at"].tolist(), "role": [ROLES[r] for r in path[::-1]]}, pa.schema([("at", pa.int64()), ("role", pa.string())]))

    ends = segment_ends(sorted_looks.mapInArrow(scores, MATRIX))
    known = looks.join(ends, ["k", "s"])
    roles = known.repartition("k", "s").sortWithinPartitions("k", "s", "at").mapInArrow(trace, "at long, role string")
    return laid.join(roles, "at").select("c", *order, "opens", "text", "at", "role")


def render(role: Column, text: Column) -> Column:
    """A turn in canonical form; a speaker marker at its start is dropped, white space around it trimmed."""
    body = F.trim(F.regexp_replace(text, ANY, ""))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>\n"))


def format_turns(turns: DataFrame, model: Model, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per distinct turn: id, turn, role (recovered from text and order alone), rendered.

    Rows with a null turn come first. Rows that repeat one another are one; different texts under one turn are ordered by text.
    Null ids are a conversation of their own, null texts are empty, an empty table gives an empty result, other columns are
    not read.
    """
    units = turns.select(F.col(id_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.lit(True).alias("opens"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    return recover(units, model, ["t"]).select(F.col("c").alias(id_col), F.col("t").alias(turn_col), "role", render(F.col("role"), F.col("text")).alias("rendered"))


def split_lines(rows: DataFrame) -> DataFrame:
    """Units (c, t, d, line, opens, text): the lines of rows (c, t, text); d keeps the lines of a text together."""
    lines = rows.select("c", "t", F.xxhash64("text").alias("d"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("c", "t", "d", "line", ((F.col("line") == 0) | F.col("text").rlike(ANY)).alias("opens"), "text")


def format_transcripts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of raw transcripts: id, line, role, opens, body. A line with a speaker marker opens a message.

    Documents that repeat one another are read once; different texts of one id are one transcript, text after text. Null ids
    are a transcript of their own, null texts one empty line, an empty table gives an empty result, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("c"), F.lit(0).cast("long").alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    found = recover(split_lines(rows), model, ["t", "d", "line"])
    return found.select(F.col("c").alias(id_col), F.col("line").cast("long").alias("line"), "role", "opens", F.regexp_replace("text", ANY, "").alias("body"))


def format_conversations(turns: DataFrame, model: Model, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per (id, turn): id, turn, n_rows, n_messages, role, rendered. Turns are read line by line, as a raw transcript.

    A turn's first line opens a message, and so does every line with a speaker marker, so one turn may hold messages of
    several speakers; role is that of its first line. Lines of a turn are gathered for rendering, never those of a
    conversation. n_rows counts the rows of a turn; rows that repeat one another are read once, different texts under one
    turn text after text. A null turn is a turn of its own and comes first; turn numbers may be any. Null ids are a
    conversation of their own, null texts are empty, an empty table gives an empty result, other columns are not read.
    """
    rows = turns.select(F.col(id_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.col(turn_col).alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = recover(split_lines(rows.select("c", "t", "text").distinct()), model, ["t", "d", "line"])
    each = F.array_sort(F.collect_list(F.struct("at", "text", "opens", "role")))
    done = found.groupBy("c", "t").agg(each.alias("lines")).select("c", "t", F.element_at("lines", 1)["role"].alias("role"), F.size(F.filter("lines", lambda x: x["opens"])).alias("n_messages"), render_lines(F.col("lines")).alias("rendered"))
    counts = rows.groupBy("c", "t", "turn").agg(F.count(F.lit(1)).alias("n_rows"))
    on = counts["c"].eqNullSafe(done["c"]) & counts["t"].eqNullSafe(done["t"])
    return counts.join(done, on).select(counts["c"].alias(id_col), F.col("turn").alias(turn_col), "n_rows", F.col("n_messages").cast("long").alias("n_messages"), "role", "rendered")


def render_lines(lines: Column) -> Column:
    """Messages in canonical form from the sorted lines (opens, role, text) of a turn."""

    def step(a: Column, x: Column) -> Column:
        body = F.regexp_replace(x["text"], ANY, "")
        opened = F.concat(F.when(a == "", "").otherwise("\n<|end|>\n"), F.lit("<|"), x["role"], F.lit("|>\n"), body)
        return F.when(x["opens"], opened).otherwise(F.concat(F.lit("\n"), x["text"]))

    parts = F.transform(lines, lambda x, i: step(F.when(i == 0, "").otherwise("more"), x))
    return F.concat(F.array_join(parts, ""), F.lit("\n<|end|>\n"))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def format_report(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Train on the conversations that are not held out, read all as raw transcripts; the rendered text comes as SHA-256 and length.

    One row per (id, turn). Null ids and turns have rows of their own, null texts count as empty, repeated rows are counted
    in n_rows; an empty table gives an empty result; other columns are not read.
    """
    model = train(turns.where(~held_out(F.col(id_col))), id_col, turn_col, role_col, text_col)
    done = format_conversations(turns, model, id_col, turn_col, text_col)
    return done.select(id_col, turn_col, held_out(F.col(id_col)).alias("held_out"), "n_rows", "n_messages", "role", F.char_length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
