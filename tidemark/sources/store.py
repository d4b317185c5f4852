"""Tables of the store as Parquet folders with keyed upserts.

Plain Parquet has no MERGE, so an upsert is union, newest row per key, rewrite. A small table's new version is written next to
the old one and counts once its marker stands, so readers never see a half-written table. The bars are one Parquet table
partitioned by month and sorted by code in each file: an upsert replaces the months that its rows touch, and ``load_daily``
opens the months of its dates only and, in them, the pages of its codes.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars
from ..shared import durable

# Columns and keys of the tables.
SCHEMAS = {
    "instruments": ("code string, name string, board string, is_st int, listed_date date, delisted_date date, status string, industry string, float_share double, updated_at timestamp", ["code"]),
    "daily": ("code string, date date, open double, high double, low double, close double, volume double, amount double, pct_chg double, turnover double", ["code", "date"]),
    "meta": ("key string, value string", ["key"]),
    "positions": ("id long, code string, name string, shares long, cost double, open_date date, note string", ["id"]),
    "signal_log": ("date date, strategy string, code string, action string, name string, price double, reason string", ["date", "strategy", "code", "action"]),
    "simulator_saves": ("user_name string, payload string, updated_at timestamp", ["user_name"]),
    "sync_errors": ("code string, date date, reason string, attempt int, created_at timestamp", ["code", "date"]),
    "fundamentals": ("code string, period string, avail_date date, eps double, bps double, roe double, gross_margin double, ocfps double, revenue double, revenue_yoy double, profit double, profit_yoy double, industry string", ["code", "period"]),
}


#: Tables kept by month of this column.
BY_MONTH = {"daily": "date"}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in order and type; absent ones are null, NaN becomes null."""
    spark = df.sparkSession
    out = []
    for f in spark.createDataFrame([], schema).schema:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        out.append((F.when(F.isnan(c), None).otherwise(c) if f.dataType.simpleString() in ("double", "float") else c).alias(f.name))
    return df.select(*out)


def latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both; of equal keys among the new ones, the last in ``_order`` if there is one."""
    order = F.col("_order") if "_order" in new.columns else F.lit(0)
    fresh = new.withColumn("_at", F.struct(F.lit(1).alias("v"), order.cast("long").alias("o"))).drop("_order")
    both = old.withColumn("_at", F.struct(F.lit(0).alias("v"), F.lit(0).cast("long").alias("o"))).unionByName(fresh)
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_at")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _names(self, path: str, marker: str = "") -> list[str]:
        """What lies in a folder, with ``marker`` only subfolders that hold such a file."""
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        at = of(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return sorted(str(x.getPath().getName()) for x in fs.listStatus(at) if not marker or fs.exists(of(x.getPath(), marker)))

    def _current(self, path: str) -> str | None:
        done = self._names(path, "_SUCCESS")
        return f"{path}/{done[-1]}" if done else None

    def _by_month(self, name: str) -> DataFrame:
        """A table kept by month, with its month (yyyy-MM) as a column that prunes folders."""
        path, schema = f"{self.root}/{name}", f"{SCHEMAS[name][0]}, month string"
        return self.spark.read.schema(schema).parquet(path) if self._names(path) else self.spark.createDataFrame([], schema)

    def read(self, name: str, months: list[str] | None = None) -> DataFrame:
        """The current version; of a table kept by month, of all months or of those named."""
        schema, _ = SCHEMAS[name]
        if name in BY_MONTH:
            rows = self._by_month(name)
            return (rows if months is None else rows.where(F.col("month").isin(*months))).drop("month")
        at = self._current(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def load_daily(self, codes: list[str] | DataFrame | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """Bars of the codes between two dates inclusive, as ``bars.load_daily``; months outside the dates are not opened."""
        rows = self._by_month("daily")
        if start is not None:
            rows = rows.where(F.col("month") >= f"{start:%Y-%m}")
        if end is not None:
            rows = rows.where(F.col("month") <= f"{end:%Y-%m}")
        return bars.load_daily(rows, codes, start, end).drop("month")

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the table, or, if it is kept by month, the months that the rows fall into. A version's name sorts after those
        before it. A row with a null key is refused."""
        path, (schema, keys) = f"{self.root}/{name}", SCHEMAS[name]
        rows = conform(df, schema)
        rows = rows.withColumns({k: F.coalesce(k, F.raise_error(F.lit(f"{name}: null {k}")).cast(rows.schema[k].dataType)) for k in keys})
        if name in BY_MONTH:
            by = rows.withColumn("month", F.date_format(BY_MONTH[name], "yyyy-MM"))
            laid = by.repartitionByRange("month", "code").sortWithinPartitions("month", *keys)
            laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
            return
        last = self._current(path)
        number = int(last.rsplit("/", 1)[1].split("-")[0][1:]) + 1 if last else 0
        rows.write.parquet(f"{path}/v{number:09d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of their key. Rows of a table kept by month are written aside first, so that they are made once."""
        schema, keys = SCHEMAS[name]
        new = conform(rows, schema if "_order" not in rows.columns else schema + ", _order long")
        months = None
        if name in BY_MONTH:
            new = durable(new, "upsert")
            months = [r["m"] for r in new.select(F.date_format(BY_MONTH[name], "yyyy-MM").alias("m")).distinct().collect() if r["m"]]
        self.write(name, latest(self.read(name, months), new, keys))

    # -- small tables --

    def set_meta(self, key: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, value)], SCHEMAS["meta"][0]))

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row["value"] if row else default

    def add_position(self, code: str, name: str, shares: int, cost: float, open_date: dt.date, note: str = "") -> int:
        last = self.read("positions").agg(F.max("id").alias("m")).first()["m"] or 0
        self.upsert("positions", self.spark.createDataFrame([(last + 1, code, name, shares, cost, open_date, note)], SCHEMAS["positions"][0]))
        return last + 1

    def delete_position(self, position: int) -> None:
        self.write("positions", self.read("positions").where(~F.col("id").eqNullSafe(F.lit(position))))

    def list_positions(self) -> DataFrame:
        return self.read("positions").orderBy(F.desc("open_date"), F.desc("id"))

    def log_signals(self, rows: DataFrame) -> None:
        self.upsert("signal_log", rows)

    def load_signal_log(self, limit: int = 200) -> DataFrame:
        return self.read("signal_log").orderBy(F.desc("date"), "strategy", "action", "code").limit(limit)

    def log_sync_errors(self, rows: DataFrame) -> None:
        """rows (code, date, reason, created_at): one more attempt for a (code, day) that failed before."""
        before = self.read("sync_errors").select("code", "date", F.col("attempt").alias("_a"))
        self.upsert("sync_errors", rows.join(before, ["code", "date"], "left").withColumn("attempt", F.coalesce("_a", F.lit(0)) + 1).drop("_a"))

    def load_sync_errors(self, limit: int = 100) -> DataFrame:
        return self.read("sync_errors").orderBy(F.desc("created_at"), "code").limit(limit)

    def clear_sync_errors(self, codes: list[str] | None = None) -> None:
        """All errors, or those of the codes; an empty list changes nothing."""
        if codes is None:
            self.write("sync_errors", self.read("sync_errors").where("false"))
        elif codes:
            self.write("sync_errors", self.read("sync_errors").where(~F.col("code").isin(*codes)))

    def save_simulator(self, user: str, payload: str, at: dt.datetime) -> None:
        self.upsert("simulator_saves", self.spark.createDataFrame([(user, payload, at)], SCHEMAS["simulator_saves"][0]))

    def load_simulator(self, user: str) -> str | None:
        row = self.read("simulator_saves").where(F.col("user_name") == user).first()
        return row["payload"] if row else None

    def list_simulator_saves(self) -> DataFrame:
        return self.read("simulator_saves").select("user_name", "updated_at").orderBy(F.desc("updated_at"))
