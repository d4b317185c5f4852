"""Sessions of a stream of bar updates in event time: late corrections within an overlap, partial bars, completeness.

An update (code, date, ts, seq, ...) says what a code's bar of a session looked like at ``ts``. Event time is the end of the
session that a bar belongs to, not its arrival: a session stays open for corrections until sessions ``overlap`` days later
have been seen, then it is closed, its bars are final and its state goes. Nothing but open sessions is kept in state.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..deploy import ship

OVERLAP_DAYS = 7


def session_end(date: Column, hour: int = 15, minute: int = 5) -> Column:
    return date.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))


def final_bars(updates: DataFrame, overlap_days: int = OVERLAP_DAYS, hour: int = 15, minute: int = 5) -> DataFrame:
    """(session_end, code, date, partial, ...): the last update of each bar, by (ts, seq), once its session is closed.

    Repeated updates change nothing, later ones win whatever their order of arrival, and an update of a closed session is
    late and dropped. ``partial``: the last update came before the session's end. Works on streams and tables alike.
    """
    rest = [c for c in updates.columns if c not in ("code", "date", "ts", "seq")]
    timed = updates.where("code IS NOT NULL AND date IS NOT NULL").withColumn("session_end", session_end(F.col("date"), hour, minute)).withWatermark("session_end", f"{overlap_days} days")
    last = timed.groupBy("session_end", "code").agg(F.max_by(F.struct("date", "ts", *rest), F.struct("ts", "seq")).alias("x"))
    return last.select("session_end", "code", "x.date", (F.col("x.ts") < F.col("session_end")).alias("partial"), *[F.col(f"x.{c}").alias(c) for c in rest])


def session_counts(bars: DataFrame) -> DataFrame:
    """(session_end, n): whole bars of each closed session."""
    return bars.groupBy("session_end").agg(F.count_if(~F.col("partial")).alias("n"))


def judged(counts: DataFrame, min_ratio: float = 0.5, lookback: int = 30) -> DataFrame:
    """(date, n, complete): closed sessions in order; complete if n is at least min_ratio of the median of those before.

    ``counts`` is a stream of the table that ``session_counts`` went to: closed sessions only, in order from batch to batch.
    State is the last ``lookback`` counts. A session without any before it is complete.
    """
    ship(counts.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("session_end")
        out = []
        for end, n in zip(rows.session_end, rows.n):
            out.append((end.date(), int(n), not before or bool(n >= median(before) * min_ratio)))
            before = [*before, int(n)][-lookback:]
        state.update((before,))
        yield pd.DataFrame(out, columns=["date", "n", "complete"])

    keyed = counts.withColumn("market", F.lit("all"))  # one row a session
    return keyed.groupBy("market").applyInPandasWithState(run, "date date, n long, complete boolean", "counts array<long>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends a stream's rows to Parquet files, each once, with all that is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_sessions(updates: DataFrame, root: str, checkpoint: str, overlap_days: int = OVERLAP_DAYS, min_ratio: float = 0.5, lookback: int = 30) -> DataFrame:
    """Close and judge the sessions of an update stream with all that is there now; the table (date, n, complete) so far.

    Two queries with checkpoints of their own: counts of closed sessions go to a table, which the second one reads as a
    stream. Both go on where they stopped.
    """
    spark = updates.sparkSession
    run_to_table(session_counts(final_bars(updates, overlap_days)), f"{root}/counts", f"{checkpoint}/counts").awaitTermination()
    counts = spark.readStream.schema("session_end timestamp, n long").parquet(f"{root}/counts")
    run_to_table(judged(counts, min_ratio, lookback), f"{root}/sessions", f"{checkpoint}/sessions").awaitTermination()
    return spark.read.schema("date date, n long, complete boolean").parquet(f"{root}/sessions")
