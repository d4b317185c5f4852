"""Forms for large cross sections, long codes and long lists give what the plain forms give."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, factors, quality, rank, reconcile
from tidemark.plans import catalog
from tidemark.sources import ingest, market

D = dt.date


# ---- ranks from value ranges ----


def ranked_rows(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = [None, float("nan"), -0.0, 0.0, float(rng.integers(0, 40)), float(rng.normal())][rng.integers(0, 6)] if i % 3 else 7.0  # a third of all rows tie
        rows.append((i, None if i % 50 == 0 else D(2020, 1, 1 + (0 if i % 10 else 1)), x))
    return spark.createDataFrame(rows, "id long, date date, x double").selectExpr("*", "1 AS n", "2 AS total_rows")


def test_ranged_rank_equals_the_window_form_with_ties_nulls_and_a_null_date(spark):
    df = ranked_rows(spark)
    got = rank.ranged_rank(df, "x").select("id", "rank", "total").toPandas().set_index("id").sort_index()
    want = df.select("id", rank.average_rank(F.col("x"), "date").alias("rank"), F.count("x").over(rank.Window.partitionBy("date")).alias("total")).toPandas().set_index("id").sort_index()
    assert got["rank"].equals(want["rank"])
    known = want["rank"].notna()
    assert (got.total[known] == want.total[known]).all() and got.total[~known].isna().all() and len(got) == 3000


def test_no_task_holds_a_large_date(spark):
    df = spark.range(20_000).selectExpr("date'2020-01-01' AS date", "cast(hash(id) AS double) AS x").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    try:
        parts = rank.value_places(df, "x", ("date",)).groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 0.5 * 20_000


def test_ranged_cross_rank_of_lone_and_invalid_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 5.0), ("a", D(2020, 1, 2), 1.0), ("b", D(2020, 1, 2), 1.0), ("c", D(2020, 1, 2), 9.0), ("d", D(2020, 1, 2), None)], "code string, date date, x double")
    got = {(r.code, r.date.day): r.r for r in rank.ranged_cross_rank(df, F.col("x"), F.col("x") < 8, "r", single=0.5, invalid=-1.0).collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 0.5, ("b", 2): 0.5, ("c", 2): -1.0, ("d", 2): -1.0}
    assert rank.ranged_rank(df.limit(0), "x").count() == 0


# ---- as-of in pieces ----


@pytest.mark.parametrize("bucket", ["year", "month", "one", "day"])
def test_point_in_time_is_the_same_in_buckets_of_any_size(spark, bucket):
    rng = np.random.default_rng(4)
    day = lambda n: D(2018, 1, 1) + dt.timedelta(days=int(n))
    rows = spark.createDataFrame([(c, day(rng.integers(0, 900))) for c in ("a", "b", "z") for _ in range(150)], "code string, date date").distinct()
    facts = [(c, f"{2018 + k // 4}{('0331', '0630', '0930', '1231')[k % 4]}", day(rng.integers(-50, 950)), None if rng.random() < 0.4 else float(rng.normal()), None if rng.random() < 0.8 else float(k)) for c in ("a", "b", "y") for k in range(10) for _ in range(2)]
    facts = spark.createDataFrame(facts, "code string, period string, avail_date date, roe double, eps double").dropDuplicates(["code", "period"])
    fields = {"roe": "f_roe", "eps": "f_eps"}
    by = {"year": F.year("date"), "month": F.trunc("date", "month"), "one": F.lit(1), "day": F.col("date")}[bucket]
    show = lambda df: sorted(map(str, df.select("code", "date", "f_roe", "f_eps").collect()))
    want = show(asof.point_in_time(rows, facts, fields))
    assert show(asof.point_in_time(rows, facts, fields, by)) == want and len(want) == rows.count()
    assert show(asof.point_in_time(rows, facts.limit(0), fields, by)) == show(asof.point_in_time(rows, facts.limit(0), fields))


# ---- quantiles ----


@pytest.mark.parametrize("error", [0.1, 0.01, 0.001])
def test_quantiles_from_a_summary_keep_their_rank_error(spark, error):
    x = np.random.default_rng(2).lognormal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(8)
    for r in quality.quantiles_of(df, ["x"], error=error).collect():
        assert abs((x <= r["value"]).mean() - r["quantile"]) <= error + 1 / len(x)
    exact = {r["quantile"]: r["value"] for r in quality.quantiles_of(df, ["x"]).collect()}
    assert np.allclose([exact[q] for q in quality.QUANTILES], np.quantile(x, quality.QUANTILES))


# ---- correlation from packed triangles ----


def test_gram_adds_up_outer_products_of_each_date(spark):
    rng = np.random.default_rng(5)
    z = {(d, c): {i: float(rng.normal()) for i in range(4) if rng.random() < 0.8} for d in range(3) for c in range(50)}
    rows = [(D(2020, 1, 1 + d), [(i, v) for i, v in of.items()]) for (d, _), of in z.items()] + [(D(2020, 2, 1), [])]
    df = spark.createDataFrame(rows, "date date, z array<struct<i:int,v:double>>").repartition(5)
    got = {(r.date, r.pos): r.s for r in factors.gram(df, 4).collect()}
    at = [(i, j) for i in range(4) for j in range(i, 4)]
    for d in range(3):
        for p, (i, j) in enumerate(at):
            assert got[D(2020, 1, 1 + d), p] == pytest.approx(sum(of.get(i, 0) * of.get(j, 0) for (e, _), of in z.items() if e == d))
    assert all(got[D(2020, 2, 1), p] == 0 for p in range(10)) and factors.gram(df.limit(0), 4).count() == 0


# ---- reconciliation ----

TRADES = "run_id string, day date, price double, shares long, note string"


def test_reconcile_names_the_first_divergence_of_each_run(spark):
    t = lambda run, day, price=1.0, shares=100, note=None: (run, D(2020, 1, day), price, shares, note)
    left = [t("same", 1), t("same", 2, 3.0), t("price", 1), t("price", 2, 2.0), t("price", 3), t("short", 1), t("short", 2), t("left", 1), t("null", 1), t("nan", 1, float("nan")), t("tie", 1, 2.0), t("tie", 1, 1.0)]
    right = [t("same", 2, 3.0 + 1e-12), t("same", 1), t("price", 1), t("price", 2, 2.1), t("price", 3, shares=1), t("short", 1), t("right", 1), t("null", 1, note="x"), t("nan", 1, float("nan")), t("tie", 1, 1.0), t("tie", 1, 2.0)]
    got = {r.run_id: r for r in reconcile.reconcile(spark.createDataFrame(left, TRADES), spark.createDataFrame(right, TRADES), ["day"], ["day", "price", "shares", "note"]).collect()}
    assert all(got[run].equal and got[run].first_k is None for run in ("same", "tie", "nan"))
    p = got["price"]
    assert (p.n_left, p.n_right, p.same, p.different, p.first_k, p.first_status, p.first_field, p.equal) == (3, 3, 1, 2, 2, "different", "price", False)
    assert (got["short"].left_only, got["short"].first_k, got["short"].first_status, got["short"].first_field) == (1, 2, "left_only", None)
    assert (got["left"].n_left, got["left"].n_right, got["right"].n_left, got["right"].right_only) == (1, 0, 0, 1)
    assert got["null"].first_field == "note"
    none = spark.createDataFrame([], TRADES)
    assert reconcile.reconcile(none, none, ["day"], ["day", "price"]).count() == 0


# ---- the report in one scan ----


def test_report_reads_the_bars_once_and_equals_its_parts(spark, tmp_path):
    rng = np.random.default_rng(8)
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 700, 2)]
    rows = [(f"{c:06d}", d, float(rng.lognormal()), float(rng.normal() * 6), float(rng.random() * 1e6)) for c in (600001, 300002, 3, 4, 5) for d in days if rng.random() < (0.9 if c != 4 else 0.3) and not (c == 5 and d > D(2020, 6, 1))]
    rows += [("600009", d, 1.0 + i, 0.0, 1.0) for i, d in enumerate(days)] + [("IDX000300", d, 3000.0 + i, 0.1, None) for i, d in enumerate(days)]
    spark.createDataFrame(rows, "code string, date date, close double, pct_chg double, amount double").write.parquet(str(tmp_path / "daily"))
    daily = spark.read.parquet(str(tmp_path / "daily"))
    inst = spark.createDataFrame([(c, b, D(2019, 5, 1)) for c, b in (("600001", "sh_main"), ("300002", "chinext"), ("000003", "sz_main"), ("600009", "sh_main"))], "code string, board string, listed_date date")
    got = {(r.part, r.key, r.measure): r.value for r in quality.market_profile(inst, daily, 40).collect()}
    want = {("boards", r.board, "n"): r.n for r in quality.boards(inst).collect()} | {("listings", "2019", "n"): 4}
    for part, df, key in (("years", quality.bars_by_year(daily), "year"), ("years", quality.limit_counts_by_year(daily), "year"), ("returns", quality.yearly_return_distribution(daily, 40), "year")):
        want |= {(part, str(r[key]), m): r[m] for r in df.collect() for m in df.columns if m != key}
    want |= {("index", f"{r.code} {r.year}", "ret"): r.ret for r in quality.index_yearly(daily.where("code LIKE 'IDX%'")).collect()}
    want |= {("suspension", "", m): v for m, v in quality.suspension(daily).first().asDict().items()}
    want |= {("stale", r.code, "days_behind"): (days[-1] - r.last_date).days for r in quality.stale_codes(daily, 20).collect()}
    want |= {("recent", r.measure, f"p{round(100 * r['quantile']):02d}"): r.value for r in quality.quantiles_of(quality.recent_profile(daily), ["amount", "volatility", "price"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)
    assert quality.market_profile(inst.limit(0), daily.limit(0)).where("part NOT IN ('suspension')").count() == 0


# ---- benchmarks ----


def test_benchmark_returns_come_from_before_the_cut(spark):
    raw = [("sh000300", "2020-01-01", "10"), ("sh000300", "2020-01-02", "bad"), ("sh000300", "2020-01-03", "11"), ("sz399006", "2020-01-03", "5"), ("sh000852", "2020-01-03", "7"), ("sh000300", "not a day", "9")]
    df = spark.createDataFrame(raw, "symbol string, date string, close string").selectExpr("*", "close AS open", "close AS high", "close AS low", "'1' AS volume")
    got = {(r.code, r.date): r.pct_chg for r in ingest.index_bars_from(df, D(2020, 1, 2)).collect()}
    assert got.keys() == {("IDX000300", D(2020, 1, 3)), ("IDX399006", D(2020, 1, 3)), ("IDX000852", D(2020, 1, 3))}
    assert got["IDX000300", D(2020, 1, 3)] == pytest.approx(10) and got["IDX399006", D(2020, 1, 3)] is None
    assert len(ingest.BENCHMARKS) == 4 and all(re.fullmatch(r"IDX\d{6}", code) for _, code in ingest.BENCHMARKS.values())


def test_bars_take_one_shuffle(spark):
    """Line items go to their code once; bars and the returns along a code need no second shuffle."""
    from tidemark.sources import market

    plan = market.derive_bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# ---- evaluation with all factors side by side ----


def tied_panel(spark):
    from .synthetic import frame, market

    pdf = market(40, 120)
    pdf["open"], pdf["close"] = pdf.open.round(0), pdf.close.round(0)  # returns that tie
    return factors.build_panel(frame(spark, pdf))


def test_evaluation_ranks_a_date_once_and_never_stacks_factors(spark, monkeypatch):
    """returns are ranked once a date, not once a factor and date, and rows are not multiplied by the factors."""
    plans, durable = [], factors.durable
    monkeypatch.setattr(factors, "durable", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df, label))
    factors.evaluate_all(tied_panel(spark), ["mom_20", "reversal_5", "ma60_dist"], 5, horizons=(1, 5), least=10)
    assert not any("rank(" in p or "Generate explode([array(struct(mom_20" in p or "named_struct(factor" in p for p in plans[:1])


def test_evaluation_equals_its_parts_on_ties(spark):
    panel, names = tied_panel(spark).cache(), ["mom_20", "reversal_5"]
    values = factors.long_values(panel, names, (1, 5))
    got = {r.factor: r for r in factors.evaluate_all(panel, names, 5, horizons=(1, 5), least=10).collect()}
    ic = {(r.factor, r.horizon): r for r in factors.ic_summary(factors.daily_ic(values, (1, 5), 10)).collect()}
    spread = {r.factor: r for r in factors.spread(factors.layers(values, "r_5")).collect()}
    excess = {r.factor: r for r in factors.top_excess_summary(factors.top_excess(values, "r_5")).collect()}
    turn = {r.factor: r.turnover for r in factors.turnover(values).collect()}
    for n in names:
        a, b = got[n], ic[n, 5]
        assert (a.ic, a.ic_1, a.ir, a.t, a.pos_ratio) == pytest.approx((b["mean"], ic[n, 1]["mean"], b.ir, b.t, b.pos_ratio))
        assert (a.spread, a.monotonic, a.turnover) == pytest.approx((spread[n].spread, spread[n].monotonic, turn[n]))
        assert a.top_excess == pytest.approx(excess[n].top_excess) and (a.top_win_years, a.top_years) == (excess[n].top_win_years, excess[n].top_years)


def test_ranks_inside_a_task_are_those_of_the_window(spark):
    df = ranked_rows(spark).where("date = '2020-01-01'")
    rows = df.select("x", rank.average_rank(F.col("x"), "date").alias("r")).toArrow()
    assert np.array_equal(factors.average_ranks(rows["x"]), rows["r"].to_numpy(), equal_nan=True)
    assert len(factors.average_ranks(rows["x"].slice(0, 0))) == 0


@pytest.mark.parametrize("joined", [False, True])
def test_correlation_of_rows_that_share_a_code(spark, joined):
    """names that share a code and date stand for themselves, or meet each other as a join by code and date makes them."""
    rng = np.random.default_rng(6)
    rows = [(f"60000{c // 2}", D(2020, 1, 1 + t), 10.0, 10.0, *map(float, rng.integers(0, 9, 2))) for c in range(8) for t in range(3) if t < 2 or c % 2]  # the last session is not tradable
    panel = spark.createDataFrame(rows, "code string, date date, open double, close double, f_roe double, f_gm double")
    got = {(r.a, r.b): r["corr"] for r in factors.correlation(panel, ["roe", "gross_margin"], joined=joined).collect()}
    want = {}
    for t in range(2):
        day = pd.DataFrame([r for r in rows if r[1].day == 1 + t], columns=["code", "date", "open", "close", "roe", "gross_margin"])
        z = day[["roe", "gross_margin"]].rank() - (len(day) + 1) / 2
        s = z.groupby(day.code).sum() if joined else z
        for a, b in (("roe", "roe"), ("roe", "gross_margin"), ("gross_margin", "gross_margin")):
            want.setdefault((a, b), []).append((s[a] * s[b]).sum() / np.sqrt((z[a] ** 2).sum() * (z[b] ** 2).sum()))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(np.mean(v)) for k, v in want.items())


# ---- names that share a code ----


def test_sources_of_names_that_share_a_code_do_not_multiply(spark, tmp_path):
    """Suppliers 800 and 8000 to 8001 stand for two names of code 600100; each bar counts once, as in the SQL."""
    rows = [(s, dt.datetime(2000, 1, 3 + 7 * w), 10 * s + w, 1, 5, 1000.0 * (w + 1) + s, 3.0) for s in (800, 8000, 8001, 2) for w in range(2)]
    names = "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.code: r for r in catalog.QUERIES["source_compatibility"](spark, str(tmp_path)).collect()}
    assert {c: r.sessions for c, r in got.items()} == {"600100": 4, "000000": 2}
    bars = market.bars(spark, str(tmp_path)).where("code = '600100'").collect()
    ratios = [b.close / round(b.close, 1) for b in bars]
    assert len(bars) == 4 and got["600100"].ratio_range == pytest.approx(max(ratios) - min(ratios), abs=1e-6)


def test_compatibility_of_two_tables_pairs_each_bar_once_where_a_key_tells_names_apart(spark):
    a = spark.createDataFrame([("x", n, D(2020, 1, 1 + d), 10.0 * n + d) for n in (1, 2, 3) for d in (0, 1)], "code string, n long, date date, close double")
    b = a.withColumn("close", F.col("close") * 2)
    assert quality.source_compatibility(a, b, ("code", "n", "date")).first()["sessions"] == 6
