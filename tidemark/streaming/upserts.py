"""Streams into the store: late corrections by overlap, completeness gates, exactly-once upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store


def dedup_latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key; aggregation, so a hot key is reduced before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def upsert_stream(stream: DataFrame, store: Store, table: str, checkpoint: str, keys: list[str], order: list[str], then: Callable[[DataFrame, int], None] | None = None, available_now: bool = True):
    """Start a query that upserts each micro-batch. The batch id is kept with the table, so a batch that is replayed after a
    failure is skipped; ``then`` runs before the id is kept, so at least once for each batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        done = store.get_meta(f"stream:{table}")
        if done is not None and int(done) >= batch_id:
            return
        rows = dedup_latest(batch, keys, order)
        store.upsert(table, rows)
        if then is not None:
            then(rows, batch_id)
        store.set_meta(f"stream:{table}", str(batch_id))

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def complete_sessions(daily: DataFrame, min_ratio: float = 0.5, lookback: int = 30) -> DataFrame:
    """(date, n, complete): whether a session has at least min_ratio of the median count of the sessions before it."""
    counts = daily.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("date").rowsBetween(-lookback, -1)  # one row a session
    usual = F.percentile("n", F.lit(0.5)).over(w)
    return counts.select("date", "n", F.coalesce(F.col("n") >= usual * min_ratio, F.lit(True)).alias("complete"))


def latest_usable_date(daily: DataFrame, now, close_hour: int = 15, close_minute: int = 5, allow_partial: bool = False) -> tuple:
    """(date, skipped): the newest session to act on at the given clock, and the partial one that was left out if any."""
    from ..operators.bars import last_complete_day

    newest = daily.agg(F.max("date").alias("d")).first()["d"]
    if allow_partial or newest is None:
        return newest, None
    rows = daily
    if newest == now.date() and (now.hour, now.minute) < (close_hour, close_minute):
        rows = daily.where(F.col("date") < F.lit(newest))
    usable = last_complete_day(rows).first()["date"]
    return usable, newest if usable != newest else None
