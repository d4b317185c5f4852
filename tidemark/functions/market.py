"""Market rules as Spark columns: boards, price limits, fees, report dates, number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .portfolio import COMMISSION, COMMISSION_MIN, LOT, STAMP, TRANSFER

# Boards by code prefix in the order in which they are tried, and their daily price limits.
BOARDS = [
    ("sh_main", ("600", "601", "603", "605"), 0.10),
    ("star", ("688", "689"), 0.20),
    ("sz_main", ("000", "001", "002", "003"), 0.10),
    ("chinext", ("300", "301"), 0.20),
    ("bse", ("43", "83", "87", "88", "92", "920"), 0.30),
]
UNKNOWN, DEFAULT_LIMIT, ST_LIMIT = "unknown", 0.10, 0.05
INDEX_PREFIX = "IDX"


def _by_board(code: Column, values: list, other) -> Column:
    full, out = F.lpad(code, 6, "0"), F.lit(other)
    for (_, prefixes, _), value in reversed(list(zip(BOARDS, values))):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | full.startswith(p)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def classify_board(code: Column) -> Column:
    return _by_board(code, [b for b, _, _ in BOARDS], UNKNOWN)


def is_st(name: Column) -> Column:
    return F.coalesce(F.upper(F.replace(name, F.lit(" "), F.lit(""))).contains("ST"), F.lit(False))


def price_limit(code: Column, name: Column) -> Column:
    """Daily limit as a fraction; special-treatment names have 5 % where the board has no wider one."""
    limit = _by_board(code, [x for _, _, x in BOARDS], DEFAULT_LIMIT)
    return F.when(is_st(name) & (limit <= 0.10), F.lit(ST_LIMIT)).otherwise(limit)


def prefix_limit(code: Column) -> Column:
    """The limit that factor research uses: by prefix only."""
    return F.when(F.substring(code, 1, 3).isin("300", "301", "688", "689"), F.lit(0.20)).otherwise(F.lit(0.10))


def is_index(code: Column) -> Column:
    return code.startswith(INDEX_PREFIX)


def buy_cost(amount: Column) -> Column:
    return F.greatest(amount * COMMISSION, F.lit(COMMISSION_MIN)) + amount * TRANSFER


def sell_cost(amount: Column) -> Column:
    return F.greatest(amount * COMMISSION, F.lit(COMMISSION_MIN)) + amount * STAMP + amount * TRANSFER


def avail_date(period: Column) -> Column:
    """Statutory date by which the report of a period (yyyyMMdd) is out; null for dates that end no quarter."""
    year, day = F.substring(period, 1, 4).cast("int"), F.substring(period, 5, 4)
    return (
        F.when(day == "0331", F.make_date(year, F.lit(4), F.lit(30)))
        .when(day == "0630", F.make_date(year, F.lit(8), F.lit(31)))
        .when(day == "0930", F.make_date(year, F.lit(10), F.lit(31)))
        .when(day == "1231", F.make_date(year + 1, F.lit(4), F.lit(30)))
    )


def to_number(text: Column) -> Column:
    """A number with thousands separators; anything else is null."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def safe(condition: Column) -> Column:
    """Unknown is no signal."""
    return F.coalesce(condition, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b, F.lit(0.0))
