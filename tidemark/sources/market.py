"""The market tables that the test tables stand for: weekly bars per pair of suppliers, instruments, index, fundamentals.

Bars are derived from line items once an application and then read from a stored table, as from any store of daily bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.market import avail_date, classify_board
from ..shared import kept

INDEX = "IDX000300"


def place() -> Column:
    """A line item's place in its week as one decimal: day, order, line, part, price in cents, quantity, in that order.

    One number instead of a struct, so that first and last prices come from hash aggregation and no rows are sorted. It holds
    order keys below 10**13 and part keys below 10**10; larger ones are an error, never a wrong order.
    """
    head = (F.weekday(F.col("l_shipdate").cast("date")) * F.lit(10**13) + F.col("l_orderkey")) * 10 + F.col("l_linenumber")
    tail = F.col("l_partkey") * F.lit(10**8) + F.round(F.col("l_extendedprice") * 100).cast("long")
    digits = lambda x, n: x.cast(f"decimal({n},0)")
    return digits(digits(head, 16) * digits(F.lit("1" + 20 * "0"), 21) + digits(tail, 18) * digits(F.lit(100), 3) + digits(F.col("l_quantity"), 2), 38)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def code_of(n: Column) -> Column:
    head = F.when(n % 4 == 0, "600").when(n % 4 == 1, "000").when(n % 4 == 2, "300").otherwise("688")
    return F.concat(head, F.lpad(F.floor(n / 4).cast("string"), 3, "0"))


def _ohlcv(rows: DataFrame, *keys: str) -> DataFrame:
    key, px = F.col("_place"), F.col("px")
    return rows.withColumn("_place", place()).groupBy(*keys, "date").agg(
        F.min_by(px, key).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, key).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


def _priced(items: DataFrame) -> DataFrame:
    return items.withColumns({"n": F.floor(F.col("l_suppkey") / 2), "date": session(F.col("l_shipdate")), "px": 100 + F.col("l_extendedprice") / 10000})


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, n, date, open, high, low, close, volume, amount, pct_chg."""
    return kept(spark, f"bars of {sf_dir}", lambda: derive_bars(spark, sf_dir))


def derive_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle: line items go to their code with the few columns that a bar needs, and bars and returns are made there.

    A supplier's items of a week lie far apart in the table, so adding them up before the shuffle would save no rows and widen each.
    """
    items = read(spark, sf_dir, "lineitem").select(code_of(F.floor(F.col("l_suppkey") / 2)).alias("code"), "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    out = _ohlcv(_priced(items.repartition("code")), "code", "n")
    own = Window.partitionBy("code").orderBy("date")
    return out.withColumn("pct_chg", 100 * (F.col("close") / F.lag("close").over(own) - 1)).select("code", "n", "date", "open", "high", "low", "close", "volume", "amount", "pct_chg")


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, f"index of {sf_dir}", lambda: derive_index(spark, sf_dir))


def derive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ohlcv(_priced(read(spark, sf_dir, "lineitem")).withColumn("code", F.lit(INDEX)), "code")
    own = Window.partitionBy("code").orderBy("date")
    return rows.withColumn("pct_chg", 100 * (F.col("close") / F.lag("close").over(own) - 1)).select("code", F.lit(None).cast("long").alias("n"), "date", "open", "high", "low", "close", "volume", F.lit(None).cast("double").alias("amount"), "pct_chg")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks and the index in one table, as the store keeps them."""
    return bars(spark, sf_dir).unionByName(index_bars(spark, sf_dir))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = bars(spark, sf_dir).groupBy("code", "n").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    nations = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.floor(F.col("s_suppkey") / 2).alias("n"), F.col("s_nationkey").alias("k")).join(F.broadcast(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("industry"))), "k")
    st = F.col("n") % 10 == 3
    return span.join(nations, "n", "left").select(
        "code", F.concat(F.when(st, "ST").otherwise("N"), "code").alias("name"), classify_board(F.col("code")).alias("board"), st.cast("int").alias("is_st"),
        F.date_sub("first", (F.col("n") % 3 * 200).cast("int")).alias("listed_date"), F.when(F.col("n") % 17 == 5, F.date_add("last", 7)).alias("delisted_date"), "industry",
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports with the date from which they are known; gross_margin is missing in one quarter a year."""
    return kept(spark, f"reports of {sf_dir}", lambda: derive_fundamentals(spark, sf_dir))


def derive_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumns({"n": F.floor(F.col("l_suppkey") / 2), "q": F.date_trunc("quarter", "l_shipdate").cast("date")})
    sums = rows.groupBy("n", "q").agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * (F.lit(0.05) - F.col("l_discount"))).alias("profit"), F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount"),
    )
    book = read(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 2).alias("n")).agg((F.min("s_acctbal") / 100).alias("bps"))
    own = Window.partitionBy("n").orderBy("q")
    yoy = lambda c: 100 * (F.col(c) / F.nullif(F.lag(c, 4).over(own), F.lit(0.0)) - 1)
    eps = F.col("profit") / 1e6
    period = F.date_format(F.last_day(F.add_months("q", 2)), "yyyyMMdd")
    margin = F.when(F.quarter("q") != F.col("n") % 4 + 1, 100 * (1 - F.col("discount")))
    return sums.join(book, "n").select(
        code_of(F.col("n")).alias("code"), period.alias("period"), avail_date(period).alias("avail_date"), eps.alias("eps"), "bps", (100 * eps / F.nullif("bps", F.lit(0.0))).alias("roe"), margin.alias("gross_margin"),
        (eps * (1 - F.col("tax"))).alias("ocfps"), "revenue", yoy("revenue").alias("revenue_yoy"), "profit", yoy("profit").alias("profit_yoy"),
    )
