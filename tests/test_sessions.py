"""Event-time sessions: late, repeated and partial bars in a stream."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import sessions, upserts

SCHEMA = "code string, date date, ts timestamp, seq long, close double"
DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(20)]


def at(day, hour, minute=0, late=0):
    return dt.datetime.combine(day + dt.timedelta(days=late), dt.time(hour, minute))


def feed(spark, tmp_path, batches, name="in"):
    """Each batch as one file, read by one micro-batch in this order."""
    source = str(tmp_path / name)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)


def drained(spark, tmp_path, stream, schema, name):
    out, check = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check")
    sessions.run_to_table(stream, out, check).awaitTermination(240)
    return spark.read.schema(schema).parquet(out)


def test_late_repeated_and_partial_bars(spark, tmp_path):
    bar = lambda code, i, close, hour=16, late=0, seq=0: (code, DAYS[i], at(DAYS[i], hour, late=late), seq, close)
    batches = [
        [bar("a", 0, 1.0), bar("b", 0, 5.0), bar("a", 0, 1.0), bar("b", 1, 6.0, hour=11)],
        [bar("a", 1, 2.0), bar("a", 0, 1.5, late=1), bar("b", 2, 7.0)],  # a correction
        [bar("a", 0, 1.2, hour=17), bar("a", 9, 9.0), bar("b", 2, 7.5, seq=1)],  # older than the correction; same time, later in sequence
        [bar("b", 10, 4.0)],  # an update counts as late from the batch after the one that closes its session
        [bar("a", 0, 99.0, late=9), bar("a", 1, 98.0, late=9), bar("b", 12, 8.0), (None, DAYS[12], at(DAYS[12], 16), 0, 1.0)],  # of closed sessions
        [bar("a", 19, 3.0), bar("b", 19, 3.0)],
    ]
    stream = sessions.final_bars(feed(spark, tmp_path, batches))
    got = drained(spark, tmp_path, stream.select("code", "date", "close", "partial"), "code string, date date, close double, partial boolean", "bars").collect()
    assert sorted((r.code, DAYS.index(r.date), r.close, r.partial) for r in got) == [("a", 0, 1.5, False), ("a", 1, 2.0, False), ("a", 9, 9.0, False), ("b", 0, 5.0, False), ("b", 1, 6.0, True), ("b", 2, 7.5, False), ("b", 10, 4.0, False), ("b", 12, 8.0, False)]


def test_completeness_equals_the_batch_and_goes_on_after_a_restart(spark, tmp_path):
    codes = [f"c{i}" for i in range(10)]
    rows = lambda i: [(c, DAYS[i], at(DAYS[i], 16 if (i, c) != (4, "c1") else 10), 0, 1.0) for c in codes[: 3 if i in (5, 11) else 10]]
    first, second = [rows(i) + rows(max(0, i - 2)) for i in range(10)], [rows(i) for i in range(10, 20)]
    run = lambda batches: sessions.run_sessions(feed(spark, tmp_path, batches), str(tmp_path / "out"), str(tmp_path / "check"), overlap_days=2, lookback=5)
    assert run(first).count() == 8  # two sessions are still open
    got = run(second).orderBy("date").collect()
    whole = spark.createDataFrame([r for i in range(18) for r in rows(i)], SCHEMA).where(~((F.col("code") == "c1") & (F.col("date") == F.lit(DAYS[4]))))
    want = upserts.complete_sessions(whole, lookback=5).orderBy("date").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and [r.complete for r in got].count(False) == 2


def test_tables_and_empty_ones(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sessions.session_counts(sessions.final_bars(none)).count() == 0
    one = sessions.final_bars(spark.createDataFrame([("a", DAYS[0], at(DAYS[0], 9), 0, 1.0), ("a", DAYS[0], None, 5, 2.0)], SCHEMA)).first()
    assert (one["close"], one["partial"]) == (1.0, True)
