import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import market as rules
from tidemark.operators import asof, bars, factors, quality, rank, regime

from .synthetic import frame, index, market


@pytest.fixture(scope="module")
def pdf():
    return market(40, 120)


@pytest.fixture(scope="module")
def daily(spark, pdf):
    return frame(spark, pdf).cache()


def test_rules(spark):
    rows = [("600519", "A", "sh_main", 0.10), ("300750", "B", "chinext", 0.20), ("600519", "*S T x", "sh_main", 0.05), ("300750", "ST", "chinext", 0.20), ("1", "C", "sz_main", 0.10), ("830001", "ST", "bse", 0.30), ("999999", "st", "unknown", 0.05), ("688001", None, "star", 0.20)]
    df = spark.createDataFrame(rows, "code string, name string, board string, lim double")
    for r in df.select("*", rules.classify_board(F.col("code")).alias("b"), rules.price_limit(F.col("code"), F.col("name")).alias("l")).collect():
        assert (r.b, r.l) == (r.board, r.lim)
    fees = spark.createDataFrame([(1000.0,), (1e6,)], "a double").select(rules.buy_cost(F.col("a")).alias("b"), rules.sell_cost(F.col("a")).alias("s")).collect()
    assert fees[0].b == pytest.approx(5.01) and fees[0].s == pytest.approx(5.51)
    assert fees[1].b == pytest.approx(260) and fees[1].s == pytest.approx(760)
    n = spark.createDataFrame([("1,234.5",), ("-",), (None,)], "v string").select(rules.to_number(F.col("v")).alias("x")).collect()
    assert [r.x for r in n] == [1234.5, None, None]


def test_usable_history(daily, pdf):
    got = {r.code: r.n for r in bars.usable_history(daily).groupBy("code").agg(F.count("*").alias("n")).collect()}
    for code, g in pdf.groupby("code"):
        bad = np.flatnonzero((g.close <= 0) | (g.low <= 0) | (g.open <= 0))
        assert got[code] == len(g) - (bad[-1] + 1 if len(bad) else 0)


def test_load_daily(spark, daily, pdf):
    assert bars.load_daily(daily, []).count() == 0
    codes = sorted(set(pdf.code))[:3]
    assert bars.load_daily(daily, codes).count() == bars.load_daily(daily, spark.createDataFrame([(c,) for c in codes], "code string")).count() == pdf.code.isin(codes).sum()


def test_universe_is_loud_and_sorted(spark, daily, pdf):
    inst = spark.createDataFrame([(c, "N" + c, "sh_main", 0, dt.date(2015, 1, 1), None, "x") for c in sorted(set(pdf.code))], "code string, name string, board string, is_st int, listed_date date, delisted_date date, industry string")
    with pytest.raises(bars.InsufficientHistory):
        bars.universe(inst, daily, sorted(set(pdf.date))[5])
    got = bars.universe(inst, daily, max(pdf.date), bars.UniverseFilter(min_amount=0)).collect()
    assert got and [r.avg_amount for r in got] == sorted((r.avg_amount for r in got), reverse=True)


def test_partial_tail_day_is_rejected(spark, pdf):
    last = max(pdf.date)
    some = set(sorted(set(pdf.code))[:2])
    cut = pdf[(pdf.date != last) | pdf.code.isin(some)]
    assert bars.last_complete_day(frame(spark, cut)).first()["date"] == sorted(set(pdf.date))[-2]
    assert bars.last_complete_day(frame(spark, pdf)).first()["date"] == last


def test_average_rank_and_blend(daily, pdf):
    r = pdf.assign(volume=pdf.close.round(0)).groupby("date").volume
    want = (r.rank() - 1) / np.maximum(r.transform("count") - 1, 1)
    got = daily.withColumn("v", F.round("close", 0)).select("code", "date", rank.cross_rank(F.col("v"), F.lit(True)).alias("x")).toPandas()
    m = got.merge(pdf.assign(w=want), on=["code", "date"])
    assert np.allclose(m.x, m.w)


def series_by_code(pdf, ok):
    """code -> list over all sessions of (open, close) or None, after the last unusable bar of the code."""
    days = sorted(set(pdf.date))
    book = {}
    for code, g in pdf.groupby("code"):
        rows = {x.date: x for x in g.itertuples()}
        bad = [d for d, x in rows.items() if min(x.open, x.low, x.close) <= 0]
        book[code] = [(rows[d].open, rows[d].close) if d in rows and (not bad or d > max(bad)) else None for d in days]
    return days, book


def place(x, values):
    """1-based mean place of x among values, counted one by one."""
    return sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2


def day_of(book, t, back, hold):
    """code -> (factor, return) of the tradable codes of a session, by the rules in words: closed today, opens tomorrow below the limit."""
    out = {}
    for code, s in book.items():
        step = 0.2 if code[:3] in ("300", "301", "688", "689") else 0.1
        if s[t] is None or t + 1 >= len(s) or s[t + 1] is None or s[t + 1][0] >= s[t][1] * (1 + step) - 1e-6:
            continue
        past = s[t][1] / s[t - back][1] - 1 if t >= back and s[t - back] is not None else None
        gain = s[t + 1 + hold][0] / s[t + 1][0] - 1 if t + 1 + hold < len(s) and s[t + 1 + hold] is not None else None
        out[code] = (past, gain)
    return out


def test_factor_research_by_hand(spark, daily, pdf):
    """Rank IC, layers, excess and turnover, session by session with ranks counted by hand."""
    days, book = series_by_code(pdf, None)
    panel = factors.build_panel(daily, rsi=True)
    values = factors.long_values(panel, ["mom_20", "reversal_5"], (5,)).cache()
    ics, buckets, excess, shares, before = {}, {i: [] for i in range(5)}, [], [], None
    for t, day in enumerate(days):
        rows = day_of(book, t, 20, 5)
        fs, rs = [f for f, _ in rows.values() if f is not None], [r for _, r in rows.values() if r is not None]
        at_f = {c: place(f, fs) for c, (f, _) in rows.items() if f is not None}
        at_r = {c: place(r, rs) for c, (_, r) in rows.items() if r is not None}
        if len(fs) >= 10 and rs:
            mf, mr = (len(fs) + 1) / 2, (len(rs) + 1) / 2
            top = sum((at_f[c] - mf) * (at_r[c] - mr) for c in at_f if c in at_r)
            under = sum((x - mf) ** 2 for x in at_f.values()) * sum((x - mr) ** 2 for x in at_r.values())
            if under:
                ics[day] = top / under**0.5
        gains = {i: [] for i in range(5)}
        for c, x in at_f.items():
            layer = next(i for i in range(5) if x / len(fs) <= (i + 1) / 5 + 1e-12)
            if rows[c][1] is not None:
                gains[layer].append(rows[c][1])
        for i, g in gains.items():
            if g:
                buckets[i].append(sum(g) / len(g))
        best = {c for c, x in at_f.items() if x / len(fs) > 0.8}
        won = [rows[c][1] for c in best if rows[c][1] is not None]
        if won:
            excess.append(sum(won) / len(won) - sum(rs) / len(rs))
        if best:
            shares.append(len(best & (before or set())) / len(best))
        before = best
    got = {x.date: x.ic for x in factors.daily_ic(values, (5,), 10).where("factor = 'mom_20'").collect()}
    assert len(got) == len(ics) > 50 and all(got[d] == pytest.approx(v, abs=1e-9) for d, v in ics.items())
    lay = {x.layer: x.ret for x in factors.layers(values, "r_5").where("factor = 'mom_20'").collect()}
    assert all(lay[i] == pytest.approx(sum(b) / len(b), abs=1e-9) for i, b in buckets.items())
    found = factors.top_excess_summary(factors.top_excess(values, "r_5")).where("factor = 'mom_20'").first()
    assert found.top_excess == pytest.approx(sum(excess) / len(excess), abs=1e-9) and found.top_years == 1
    assert factors.turnover(values).where("factor = 'mom_20'").first().turnover == pytest.approx(1 - sum(shares) / len(shares), abs=1e-9)
    cor = {(x.a, x.b): x["corr"] for x in factors.correlation(panel, ["mom_20", "reversal_5"]).collect()}
    assert cor["mom_20", "mom_20"] == pytest.approx(1)


def test_grid_factors_by_hand(daily, pdf):
    """Deviation over carried closes and RSI with decaying averages, one code after the other."""
    days, book = series_by_code(pdf, None)
    got = {(x.code, x.date): x for x in factors.evaluate_columns(factors.build_panel(daily, rsi=True), ["vol_20", "rsi_14"]).collect()}
    for code, s in book.items():
        held, moves, up, down, seen, age = None, [], 0.0, 0.0, 0, 0
        for t, day in enumerate(days):
            x = s[t][1] if s[t] is not None else None
            now = held if x is None else x
            moves.append(now / held - 1 if held is not None else None)
            held = now
            if t and s[t] is not None and s[t - 1] is not None:
                change = s[t][1] - s[t - 1][1]
                gain, loss = max(change, 0.0), max(-change, 0.0)
                old = (13 / 14) ** (age + 1)
                new = 1.0 if not seen else 1 / 14
                up, down = ((up * old + gain * new) / (old + new), (down * old + loss * new) / (old + new)) if seen else (gain, loss)
                seen, age = seen + 1, 0
            else:
                age += 1 if seen else 0
            row, last = got[code, day], moves[-20:]
            if len(last) == 20 and None not in last:
                mean = sum(last) / 20
                assert row.vol_20 == pytest.approx((sum((m - mean) ** 2 for m in last) / 19) ** 0.5 * 252**0.5, abs=1e-9)
            else:
                assert row.vol_20 is None
            if seen >= 14 and down > 0:
                assert row.rsi_14 == pytest.approx(100 - 100 / (1 + up / down), abs=1e-6)


def test_as_of_per_field(spark):
    d = dt.date
    facts = spark.createDataFrame([("a", "20191231", d(2020, 4, 30), 1.0, 5.0), ("a", "20200331", d(2020, 4, 30), 2.0, None), ("a", "20200630", d(2020, 8, 31), None, 7.0)], "code string, period string, avail_date date, eps double, bps double")
    rows = spark.createDataFrame([("a", d(2020, 4, 29)), ("a", d(2020, 4, 30)), ("a", d(2020, 9, 1)), ("b", d(2020, 9, 1))], "code string, date date")
    got = {(r.code, r.date): (r.e, r.b) for r in asof.point_in_time(rows, facts, {"eps": "e", "bps": "b"}).collect()}
    assert got == {("a", d(2020, 4, 29)): (None, None), ("a", d(2020, 4, 30)): (2.0, 5.0), ("a", d(2020, 9, 1)): (2.0, 7.0), ("b", d(2020, 9, 1)): (None, None)}


@pytest.mark.parametrize("confirm", [1, 2, 3, 5])
def test_hysteresis(spark, confirm):
    rng = random.Random(confirm)
    flags = [rng.random() < 0.5 for _ in range(60)]
    state, streak, want = flags[0], 0, []
    for f in flags:
        streak = streak + 1 if f != state else 0
        if confirm <= 1 or streak >= confirm:
            state, streak = f, 0
        want.append(state)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "date int, f boolean")
    assert [r.s for r in regime.hysteresis(df, "f", confirm, "s").orderBy("date").collect()] == want


def test_regime_carries_forward(spark):
    i = index(60)
    days = frame(spark, i).select("date").unionAll(spark.createDataFrame([(i.date.iloc[-1] + dt.timedelta(days=40),)], "date date"))
    got = [r.above for r in regime.index_above_ma(days, frame(spark, i), 20).orderBy("date").collect()]
    ma = i.close.rolling(20).mean()
    assert got[:-1] == (i.close > ma).tolist() and got[-1] == got[-2]


def test_quality(spark, daily, pdf):
    assert quality.duplicate_keys(daily).count() == 0
    assert quality.ohlc_problems(daily).first()["non_positive"] == (pdf.low <= 0).sum()
    with pytest.raises(ValueError):
        quality.require_columns(daily.withColumn("amount", F.lit(None).cast("double")), ["amount"])
    inst = spark.createDataFrame([("600000",), ("999999",)], "code string")
    gaps = {r.code: r.kind for r in quality.find_gaps(inst, daily).collect()}
    assert gaps["999999"] == "no_data" and gaps["000005"] == "lagging"


def test_members_are_the_universe_of_each_day(spark, daily, pdf):
    codes = sorted(set(pdf.code))
    rows = [(c, f"N{c}", "sh_main", int(i == 2), dt.date(2019, 1, 1) if i != 4 else dt.date(2020, 5, 1), dt.date(2020, 4, 1) if i == 6 else None, "x") for i, c in enumerate(codes)]
    names = spark.createDataFrame(rows, "code string, name string, board string, is_st int, listed_date date, delisted_date date, industry string")
    flt = bars.UniverseFilter(min_amount=float(pdf.amount.median()), min_listed_days=30)
    got = {}
    for r in bars.members(names, daily, flt, 5).collect():
        got.setdefault(r.date, set()).add(r.code)
    days = sorted(set(pdf.date))
    have = {(c, d) for c, d in zip(pdf.code, pdf.date)}
    for t in (30, 60, 90, len(days) - 1):
        top = [r.code for r in bars.universe(names, daily, days[t], flt).collect()]
        own = [c for c in top if (c, days[t]) in have]  # a name without a bar is not listed
        assert got.get(days[t], set()) == set(own[:5])


def test_evaluation_says_what_it_could_not_measure(spark, daily):
    panel = factors.build_panel(daily)
    few = {r.factor: r for r in factors.evaluate_all(panel, ["mom_20", "mom_120_20"], 5, horizons=(1, 5), least=10, least_days=30).collect()}
    assert few["mom_20"].error is None and few["mom_20"].ic is not None and sum(few["mom_20"].excess_by_year.values()) == pytest.approx(few["mom_20"].top_excess)
    assert few["mom_120_20"].error.startswith("fewer than") and few["mom_120_20"].ic is None
