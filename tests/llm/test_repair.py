"""Conversation repair against a recursion over all edits."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from tidemark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) by recursion over what is left; rows are (role, text, gone, cut)."""

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in "0a":
            found.append((0, "", ()))
        follow = "user" if state in "0sa" else "assistant"
        if inserted < 3:
            c, a, out = best(i, follow[0], inserted + 1)
            found.append((c + 3, "I" + a, (follow + ":", *out)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, a, out = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, out))
            if not gone:
                if state + role[:1] in ("0s", "0u", "su", "ua", "au"):
                    c, a, out = best(i + 1, role[:1], 0)
                    found.append((c + 3 * cut, "K" + a, (f"{role}:{text}", *out)))
                c, a, out = best(i + 1, follow[0], 0)
                found.append((c + 3 * cut + 3, "R" + a, (f"{follow}:{text}", *out)))
        return min(found) if found else (1 << 40, "", ())

    return best(0, "0", 0)


def report(rows):
    """The report of (conv, turn, role, text) rows, by hand."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            solid = text.rstrip(WHITE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit, lines = cheapest(tuple(judged))
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(judged, judged[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "2 AS at", "3 AS copies", "4 AS rows", "5 AS conv", "6 AS blank")
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, repair.repair_report(df.repartition(3), **how).select(cols).collect()), key=repr)


def talk(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", None, "umpire", "sys"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "why?  \n", "a. b", " ", "Ünï."]
    return [(conv, rng.choice([None, i, i, i, rng.randrange(-3, 9)]), rng.choice(roles[:2] * 3 + roles), rng.choice([*texts, f"t{i}."])) for i in range(n)]


@pytest.mark.parametrize("segment", [1, 4, 1024])
def test_equals_recursion_in_segments_of_any_length(spark, segment):
    rng = random.Random(segment)
    rows = [r for conv in range(25) for r in talk(rng, conv, rng.randrange(1, 14))] + talk(rng, None, 6) + talk(rng, 99, 60)
    rows += rows[:9]
    assert got(spark, rows, segment=segment) == report(rows)


def test_conversations_that_lose_all_rows_and_empty_tables(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(conv, 0, "user", "Gone.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(spark, []) == []


def test_a_long_text_and_many_copies(spark):
    rows = [(7, 1, "user", "long " * 200_000 + "end.")] + [(7, 2, "assistant", "same.")] * 80
    assert got(spark, rows, segment=4) == report(rows)


def test_prices_are_distances_and_ties_are_least():
    rng = random.Random(5)
    for _ in range(300):
        rows = [{"initial": rng.choice("suax"), "gone": rng.random() < 0.2, "cut": rng.random() < 0.3, "copies": rng.choice([1, 1, 2])} for _ in range(rng.randrange(0, 9))]
        placed = repair.layers_of(rows)
        layers = [x for _, x in placed]
        price = repair.prices(layers, repair.ENDS)
        flat = tuple((r[0], "", r[1], r[2]) for r in layers for _ in range(r[3]))
        labels, tail, _ = repair.trace(layers, price, repair.ENDS, repair.NONE)
        assert (price[0][repair.NONE], "".join(labels) + tail) == cheapest(flat)[:2]
