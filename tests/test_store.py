import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.sources import ingest
from tidemark.sources.store import Store, conform
from tidemark.streaming import upserts

from .synthetic import frame, walk

D = dt.date
SF = "/root/testdata/sf0.001"


def test_upsert_last_write_wins(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    assert st.read("daily").count() == 0
    st.upsert("daily", spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("b", D(2020, 1, 1), float("nan"))], "code string, date date, close double"))
    st.upsert("daily", spark.createDataFrame([("a", D(2020, 1, 1), 2.0, 1), ("a", D(2020, 1, 1), 3.0, 2), ("a", D(2020, 1, 2), 4.0, 1)], "code string, date date, close double, _order long"))
    got = {(r.code, r.date): r.close for r in st.read("daily").collect()}
    assert got == {("a", D(2020, 1, 1)): 3.0, ("a", D(2020, 1, 2)): 4.0, ("b", D(2020, 1, 1)): None}


def test_small_tables(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    assert st.get_meta("x", "none") == "none"
    st.set_meta("x", "1")
    st.set_meta("x", "2")
    assert st.get_meta("x") == "2"
    assert st.add_position("600000", "N", 100, 9.5, D(2020, 1, 2)) == 1 and st.add_position("600001", "M", 200, 8.0, D(2020, 1, 3)) == 2
    assert [r.id for r in st.list_positions().collect()] == [2, 1]
    st.delete_position(2)
    assert [r.id for r in st.list_positions().collect()] == [1]
    err = spark.createDataFrame([("600000", D(2020, 1, 1), "timeout", dt.datetime(2020, 1, 1, 9))], "code string, date date, reason string, created_at timestamp")
    st.log_sync_errors(err)
    st.log_sync_errors(err)
    assert st.load_sync_errors().first()["attempt"] == 2
    st.clear_sync_errors([])
    assert st.load_sync_errors().count() == 1
    st.clear_sync_errors(["600000"])
    assert st.load_sync_errors().count() == 0
    st.save_simulator("u", json.dumps({"a": 1}), dt.datetime(2020, 1, 1))
    assert json.loads(st.load_simulator("u")) == {"a": 1} and st.load_simulator("v") is None and st.list_simulator_saves().count() == 1
    sig = spark.createDataFrame([(D(2020, 1, 1), "s", "600000", "BUY", 1.0), (D(2020, 1, 2), "s", "600000", "SELL", 2.0)], "date date, strategy string, code string, action string, price double")
    st.log_signals(sig)
    st.log_signals(sig)
    assert [r.date for r in st.load_signal_log().collect()] == [D(2020, 1, 2), D(2020, 1, 1)]


def test_conform_adds_missing_columns(spark):
    df = conform(spark.createDataFrame([("a", float("nan"))], "code string, close double"), "code string, date date, close double")
    assert df.collect()[0] == ("a", None, None) and df.columns == ["code", "date", "close"]


def test_ingest(spark):
    one = spark.createDataFrame([("600519", " Kwei  chow ", "2001-08-27"), ("1", "ST Bank", "19910403")], "code string, name string, listed string")
    two = spark.createDataFrame([("600519", "Other", "x"), ("300750", "C", None)], "code string, name string, listed string")
    got = {r.code: (r.name, r.board, r.is_st, r.listed_date) for r in ingest.instruments_from(one, two).collect()}
    assert got == {"600519": ("Kweichow", "sh_main", 0, D(2001, 8, 27)), "000001": ("STBank", "sz_main", 1, D(1991, 4, 3)), "300750": ("C", "chinext", 0, None)}
    text = json.dumps([["2020-01-02", "10", "11", "12", "9", "1,000"], ["2020-01-03", "11", "12.1", "13", "10", "5"], ["bad", "1", "1", "1", "1", "1"]])
    bars = ingest.bars_from_json(spark.createDataFrame([("a", text)], "code string, json string").where(F.col("json").isNotNull()).withColumn("json", F.regexp_replace("json", '\\["bad".*?\\]', '["2020-01-03", "9", "9", "9", "9", "9"]'))).orderBy("date").collect()
    assert len(bars) == 2 and bars[0].amount == 1000 * 100 * 11 and bars[1].pct_chg is not None
    b = spark.createDataFrame([("a", D(2020, 1, i), float(i)) for i in range(1, 6)], "code string, date date, close double").selectExpr("*", "close AS open", "close AS high", "close AS low")
    f = spark.createDataFrame([("a", D(2020, 1, 2), 1.0), ("a", D(2020, 1, 4), 2.0)], "code string, date date, adj_factor double")
    assert [r.close for r in ingest.forward_adjust(b, f).orderBy("date").collect()] == [0.5, 1.0, 1.5, 4.0, 5.0]
    assert [r.period for r in ingest.periods(spark, 2020, D(2021, 4, 29)).orderBy("period").collect()] == ["20200331", "20200630", "20200930"]
    plan = {r.code: r.start for r in ingest.sync_plan(spark.createDataFrame([("a",), ("b",)], "code string"), b, D(2020, 2, 1), history_start=D(2018, 1, 1)).collect()}
    assert plan == {"a": D(2019, 12, 29), "b": D(2018, 1, 1)}
    raw = spark.createDataFrame([("1", "20200331", "1,000.5", "-")], "code string, period string, eps string, bps string").selectExpr("*", *[f"NULL AS {c}" for c in ("roe", "gross_margin", "ocfps", "revenue", "revenue_yoy", "profit", "profit_yoy")])
    r = ingest.fundamentals_from(raw).first()
    assert (r.code, r.eps, r.bps, r.avail_date) == ("000001", 1000.5, None, D(2020, 4, 30))


def test_stream_upserts_once(spark, tmp_path):
    st = Store(spark, str(tmp_path / "store"))
    source = str(tmp_path / "in")
    schema = "code string, date date, close double, seq long"
    rows = [("a", D(2020, 1, 1), 1.0, 1), ("a", D(2020, 1, 1), 2.0, 2), ("b", D(2020, 1, 1), 5.0, 1)]
    for batch in (rows[:2], rows[2:]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upserts.upsert_stream(stream, st, "daily", str(tmp_path / "check"), ["code", "date"], ["seq"]).awaitTermination(120)
    assert {(r.code, r.close) for r in st.read("daily").collect()} == {("a", 2.0), ("b", 5.0)}
    assert st.get_meta("stream:daily") == "1"


def test_partial_session_gate(spark):
    g = walk(30)
    day = max(g.date)
    daily = frame(spark, g).unionAll(frame(spark, g.assign(code="600002")))
    open_, shut = dt.datetime.combine(day, dt.time(11, 0)), dt.datetime.combine(day, dt.time(15, 6))
    assert upserts.latest_usable_date(daily, shut) == (day, None)
    assert upserts.latest_usable_date(daily, open_) == (sorted(g.date)[-2], day)
    assert upserts.latest_usable_date(daily, open_, allow_partial=True) == (day, None)


@pytest.mark.parametrize("name", ["bars_ohlcv", "universe_asof", "ind_rsi", "fundamentals_pit", "strategy_regime_momentum", "metrics_equity", "find_gaps"])
def test_queries_equal_their_oracles(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    show = lambda rows: sorted(str(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)) for r in rows)
    assert show(got.select(*cols).collect()) == show(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["date", "strategy", "code", "action", "price", "score", "shares"]


def test_bars_are_kept_by_month(spark, tmp_path):
    import datetime as dt

    from tidemark.sources.store import Store

    d = lambda m, x: [(c, dt.date(2020, m, 3), float(x)) for c in ("a", "b")]
    store = Store(spark, str(tmp_path))
    frame_of = lambda rows: spark.createDataFrame(rows, "code string, date date, close double")
    store.upsert("daily", frame_of(d(1, 1) + d(2, 2) + d(3, 3)))
    store.upsert("daily", frame_of([("b", dt.date(2020, 2, 3), 9.0), ("c", dt.date(2020, 2, 4), 8.0)]))
    got = sorted((r.code, r.date.month, r.close) for r in store.read("daily").collect())
    assert got == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 1.0), ("b", 2, 9.0), ("b", 3, 3.0), ("c", 2, 8.0)]
    assert store.read("daily", ["2020-02"]).count() == 3


def scanned(df) -> tuple[int, int, str]:
    """Rows, files that the scan read, and its plan."""
    rows = len(df.collect())
    plan = df._jdf.queryExecution().executedPlan()
    return rows, plan.collectLeaves().head().metrics().apply("numFiles").value(), plan.toString()


def test_load_daily_opens_only_the_months_of_its_dates(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    days = spark.range(24).selectExpr("add_months(date'2020-01-15', cast(id as int)) AS date").crossJoin(spark.range(40).selectExpr("lpad(cast(id as string), 6, '0') AS code"))
    store.upsert("daily", days.withColumn("close", F.rand(1)))
    everything, all_files, _ = scanned(store.read("daily"))
    rows, files, plan = scanned(store.load_daily(["000007", "000009"], D(2020, 3, 1), D(2020, 5, 20)))
    assert everything == 24 * 40 and rows == 6 and 0 < files <= all_files * 4 / 24
    assert "PartitionFilters: [isnotnull(month" in plan and "code#" in plan.split("DataFilters: ")[1].split("Format")[0], plan
    assert scanned(store.load_daily(None, D(2021, 12, 1)))[:2] == (40, scanned(store.read("daily", ["2021-12"]))[1])
    assert store.load_daily([]).count() == 0 and store.load_daily().count() == everything
    assert Store(spark, str(tmp_path / "none")).load_daily(["000007"], D(2020, 1, 1)).count() == 0


def test_null_keys_are_refused_and_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame_of = lambda rows: spark.createDataFrame(rows, "code string, date date, close double")
    store.upsert("daily", frame_of([("a", D(2020, 1, 3), 1.0)]))
    for bad in (("b", None, 2.0), (None, D(2020, 1, 4), 2.0)):
        with pytest.raises(Exception, match="daily: null"):
            store.upsert("daily", frame_of([bad, ("c", D(2020, 1, 3), 3.0)]))
    with pytest.raises(Exception, match="meta: null key"):
        store.upsert("meta", spark.createDataFrame([(None, "x")], "key string, value string"))
    assert [(r.code, r.close) for r in store.read("daily").collect()] == [("a", 1.0)]


def test_forward_adjust_keeps_a_row_a_bar(spark):
    """Two bars and two factors of a code and day, as of names that share a code, stay two rows."""
    b = spark.createDataFrame([("a", dt.date(2020, 1, d), 1.0, 1.0, 1.0, 1.0) for d in (1, 2, 2, 3)], "code string, date date, open double, high double, low double, close double")
    f = spark.createDataFrame([("a", dt.date(2020, 1, 2), 2.0), ("a", dt.date(2020, 1, 2), 2.0), ("a", dt.date(2020, 1, 3), 4.0)], "code string, date date, adj_factor double")
    adjusted = ingest.forward_adjust(b, f)
    assert [r.close for r in adjusted.orderBy("date").collect()] == [0.5, 0.5, 0.5, 1.0]
