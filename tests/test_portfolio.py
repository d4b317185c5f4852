import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import portfolio as pf
from tidemark.operators import backtest, metrics, rank, signals, strategies
from tidemark.streaming.account import ForwardAccount

from .synthetic import frame, index, market


@pytest.fixture(scope="module")
def data(spark):
    m, i = market(14, 340), index(340)
    return m, i, frame(spark, m).cache(), frame(spark, i).cache()


def run(data, strategy, cfg=pf.Config(initial_cash=1e6), start=170, end=339, **kw):
    m, i, daily, idx = data
    days = list(i.date)
    e, t, s = backtest.backtest(strategy, daily, idx, days[start], days[end], cfg, **kw)
    return e.orderBy("date").toPandas(), t.toPandas(), s.toPandas()


@pytest.fixture(scope="module")
def turtle(data):
    return run(data, strategies.get_strategy("turtle_breakout"))


def test_strategies_are_valid():
    assert len(strategies.REGISTRY) == 8
    for name, cls in strategies.REGISTRY.items():
        assert cls.info()["name"] == name and cls().warmup_bars() > 0
    with pytest.raises(ValueError):
        strategies.get_strategy("ma_cross", fast=30, slow=10)
    with pytest.raises(ValueError):
        strategies.get_strategy("ma_cross", nothing=1)
    with pytest.raises(ValueError):
        strategies.get_strategy("ma_cross", ma_type="wma")
    with pytest.raises(KeyError):
        strategies.get_strategy("none")
    assert strategies.get_strategy("ma_cross", fast="5").params["fast"] == 5
    assert strategies.get_strategy("ma_cross", slow=250).warmup_bars() > strategies.get_strategy("ma_cross").warmup_bars()


def test_accounting_identity(data, turtle):
    """Cash and marks from the curve equal initial cash plus all profits from trades and open lots."""
    m, i, daily, idx = data
    cfg = pf.Config(initial_cash=1e6)
    days = list(i.date)[170:340]
    cal = backtest.calendar(daily, days[0], days[-1])
    rows = backtest.prepare(strategies.get_strategy("turtle_breakout"), daily, cal, "r", days[0], days[-1]).toPandas()
    dates = [r["date"] for r in cal.orderBy("session").collect()]
    equity, trades, state = pf.fold(rows, dates, {}, cfg)
    assert trades and state.positions
    last = {c: x for c, x in zip(rows.code[rows.session == len(dates) - 1], rows.close[rows.session == len(dates) - 1])}
    marks = sum((last.get(c, p.cost) - p.cost) * p.shares for c, p in state.positions.items())
    assert equity[-1][1] == pytest.approx(1e6 + sum(t[6] for t in trades) + marks, abs=1e-4)
    assert turtle[0].equity.iloc[-1] == pytest.approx(equity[-1][1])


def test_trades_obey_the_market(data, turtle):
    m = data[0].set_index(["code", "date"])
    e, t, stats = turtle
    assert (t.close_date > t.open_date).all() and (t.hold_days >= 1).all()  # never sold on the day of purchase
    assert (t.shares % pf.LOT == 0).all() and (e.cash >= 0).all() and (e.positions <= 5).all()
    for r in t.itertuples():
        g = data[0][data[0].code == r.code].reset_index(drop=True)
        k = g.index[g.date == r.close_date][0]
        limit = 0.2 if r.code[:3] in ("300", "688") else 0.1
        assert r.close_price == g.open[k] > g.close[k - 1] * (1 - limit)
        assert m.loc[(r.code, r.open_date)].open < g.close[g.index[g.date == r.open_date][0] - 1] * (1 + limit)
    assert stats.suspended.iloc[0] > 0


def test_limits_block_and_fall_through():
    """A name that opens at its limit is passed over for the next one; a holding that opens at the lower limit stays."""
    row = lambda s, c, o, cl, entry=False, exit_=False, score=0.0: (s, c, o, cl, None, entry, exit_, score, 0.10)
    rows = pd.DataFrame(
        [row(0, "a", 10.0, 10.0, True, score=9.0), row(1, "a", 11.0, 11.0), row(0, "b", 10.0, 10.0, True, score=1.0), row(1, "b", 10.0, 10.0, exit_=True), row(2, "b", 9.0, 9.0, exit_=True), row(3, "b", 9.0, 9.0)],
        columns=["session", "code", "open", "close", "atr14", "entry", "exit", "score", "limit"],
    )
    equity, trades, state = pf.fold(rows, [0, 1, 2, 3], {}, pf.Config(initial_cash=1e5, max_positions=1))
    assert state.blocked == {"suspended": 0, "limit_up": 1, "limit_down": 1, "insufficient": 0}
    assert [(t[0], t[1], t[2]) for t in trades] == [("b", 1, 3)] and [e[3] for e in equity] == [1, 1, 0]
    assert pf.fold(rows, [0, 1, 2, 3], {0: False}, pf.Config(initial_cash=1e5, max_positions=1))[1] == []


def test_no_look_ahead(data, turtle):
    short = run(data, strategies.get_strategy("turtle_breakout"), end=280)[0]
    whole = turtle[0]
    assert np.allclose(short.equity, whole.equity[: len(short)])


def test_stops_and_gate(data):
    st = strategies.get_strategy("turtle_breakout")
    _, t, _ = run(data, st, pf.Config(initial_cash=1e6, stop_loss=0.03, take_profit=0.05, max_hold_days=8, trail_stop_atr=1.5))
    assert {"stop loss", "take profit"} <= set(t.close_reason) and t.hold_days.max() <= 25
    gated = strategies.get_strategy("defensive", index_ma=50, max_vol=5.0, max_lottery=99.0, exit_vol=9.0, exit_lottery=999.0)
    e, _, _ = run(data, gated)
    days = list(data[1].date)
    off = data[1].close <= data[1].close.rolling(50).mean()
    closed = {days[k + 1] for k in range(170, 338) if off[k]}
    p = e.set_index("date").positions
    assert all(p[d] <= p[days[days.index(d) - 1]] for d in closed if d in p.index and days[days.index(d) - 1] in p.index)


def test_buy_and_hold_close_to_equal_weight(spark, data):
    m, i, daily, idx = data

    class Hold(strategies.Strategy):
        name, defaults = "hold", {}

        def entry(self):
            return F.lit(True)

        def exit(self):
            return F.lit(False)

    whole = [c for c, g in m.groupby("code") if (g.low > 0).all() and g.date.max() == max(m.date)][:5]
    e, _, _ = run(data, Hold(), pf.Config(initial_cash=1e7, max_positions=5, position_pct=0.19), codes=spark.createDataFrame([(c,) for c in whole], "code string"))
    days = list(i.date)
    ret = [g[g.date <= days[339]].close.iloc[-1] / g[g.date >= days[172]].open.iloc[0] - 1 for c, g in m.groupby("code") if c in whole]
    assert abs(e.equity.iloc[-1] / 1e7 - 1 - 0.95 * np.mean(ret)) < 0.08


def test_too_short_is_a_typed_error(data):
    e, t, s = run(data, strategies.get_strategy("turtle_breakout"), start=339)
    assert e.empty and t.empty and s.error.iloc[0]


def test_account_equals_engine_and_is_idempotent(spark, data, tmp_path):
    m, i, daily, idx = data
    days = list(i.date)
    codes = daily.select("code").distinct()
    acc = ForwardAccount(spark, str(tmp_path))
    acc.reset("ma_cross", {"fast": 5, "slow": 20}, days[170], cash=1e6)
    for at in (200, 201, 260):
        assert acc.advance(daily.where(F.col("date") <= F.lit(days[at])), idx, days[at], codes) > 0
        assert acc.advance(daily, idx, days[at], codes) == 0
    assert acc.advance(daily, idx, days[190], codes) == 0
    cal = backtest.calendar(daily, days[170], days[260])
    rows = backtest.prepare(strategies.get_strategy("ma_cross", fast=5, slow=20), daily, cal, "r", days[170], days[260], min_bars=130)
    e, t, _ = backtest.run(rows, cal, {"r": pf.Config(initial_cash=1e6, sizing="account")})
    a, b = acc.equity().orderBy("date").toPandas(), e.orderBy("date").toPandas()
    assert list(a.date) == list(b.date) and np.allclose(a.equity, b.equity.round(2), atol=0.011)
    x, y = acc.trades().orderBy("opened", "code").toPandas(), t.orderBy("open_date", "code").toPandas()
    assert len(x) and list(x.code) == list(y.code) and np.allclose(x.pnl, y.pnl)
    st = acc.status()
    assert st["sessions"] == 90 and st["trades"] == len(x) and st["last_date"] == days[260]
    with pytest.raises(ValueError):
        acc.reset("ma_cross", {"fast": 50, "slow": 20}, days[0])
    acc.reset("ma_cross", {}, days[170])
    assert acc.equity().count() == 0


def test_score_fields_really_score(spark):
    df = spark.createDataFrame([(f"{i:06d}", "d", float(i), float(7 * i % 40)) for i in range(40)], "code string, date string, f1 double, f2 double")
    got = [r.score for r in rank.blend(df, [("f1", 1.0), ("f2", 2.0)], F.lit(True)).collect()]
    assert len(set(got)) > 20 and all(0 <= s <= 1 for s in got)


def test_signals(spark, data):
    m, i, daily, idx = data
    last = max(m.date)
    codes = daily.select("code").distinct()
    st = strategies.get_strategy("ma_cross", fast=2, slow=5)
    held = spark.createDataFrame([(c,) for c in sorted(set(m.code))[:7]], "code string")
    got = signals.generate(st, daily, idx, last, codes, held, max_candidates=3, value=1e6).toPandas()
    assert (got[got.action == "SELL"].code.isin([r.code for r in held.collect()])).all()
    buys = got[got.action == "BUY"]
    assert len(buys) <= 3 and list(buys.score) == sorted(buys.score, reverse=True) and (buys.shares % 100 == 0).all()
    assert signals.freshness(idx, last).first()["stale"] is False and signals.freshness(idx, last + dt.timedelta(days=1)).first()["stale"] is True
    assert signals.freshness(idx.limit(0), last).first()["stale"] is True


def test_metrics(data, turtle):
    e, t, _ = turtle
    s = data[2].sparkSession
    eq = s.createDataFrame(e.astype(object).values.tolist(), backtest.EQUITY + ", benchmark double")
    r = metrics.equity_metrics(eq, 1e6).first()
    v = e.equity
    ret = v.pct_change().dropna()
    assert r.total_return == pytest.approx(v.iloc[-1] / 1e6 - 1, abs=1e-4) and r.max_drawdown == pytest.approx((v / v.cummax() - 1).min(), abs=1e-4)
    assert r.sharpe == pytest.approx(ret.mean() * 252 / (ret.std(ddof=0) * np.sqrt(252)), abs=1e-3)
    run_len, best = 0, 0
    for under in v < v.cummax():
        run_len = run_len + 1 if under else 0
        best = max(best, run_len)
    assert r.longest_underwater == best
    tr = s.createDataFrame([("r", float(a), float(b), int(h)) for a, b, h in zip(t.pnl, t.pnl_pct, t.hold_days)], "run_id string, pnl double, pnl_pct double, hold_days int")
    q = metrics.trade_metrics(tr).first()
    assert q.trades == len(t) and q.win_rate == pytest.approx((t.pnl > 0).mean(), abs=1e-4)
    counts = [x["count"] for x in metrics.trade_histogram(tr).orderBy("bucket").collect()]
    assert counts == np.histogram(t.pnl_pct, metrics.EDGES)[0].tolist()
    months = metrics.monthly_returns(eq, 1e6).count()
    assert months == len(set(pd.to_datetime(e.date).dt.to_period("M")))


def test_a_run_without_bars_says_so(spark):
    from tidemark.operators import backtest
    from tidemark.operators.strategies import get_strategy

    daily, ix = frame(spark, market(4, 80)), frame(spark, index(80))
    codes = spark.createDataFrame([("999999",)], "code string")
    equity, trades, stats = backtest.backtest(get_strategy("ma_cross"), daily, ix, dt.date(2020, 1, 1), dt.date(2020, 12, 31), codes=codes)
    assert equity.count() == trades.count() == 0
    assert [(r.run_id, r.suspended, r.error) for r in stats.collect()] == [("run", 0, "no bars in this span")]


def test_account_counts_sessions_without_any_ready_code(spark, tmp_path):
    from tidemark.streaming.account import ForwardAccount

    daily, ix = frame(spark, market(4, 40)), frame(spark, index(40))
    days = sorted({r.date for r in daily.select("date").distinct().collect()})
    account = ForwardAccount(spark, str(tmp_path))
    account.reset("ma_cross", {}, days[0])
    codes = daily.select("code").distinct()
    assert account.advance(daily, ix, days[20], codes) == 20 and account.advance(daily, ix, days[20], codes) == 0
    s = account.status()
    assert (s["sessions"], s["equity"], s["last_date"], s["max_drawdown"], s["idle_days"], s["holdings"]) == (20, 200_000.0, days[20], 0.0, 0, []) and s["benchmark_return"] is not None
    assert account.advance(daily, ix, days[25], codes) == 5 and account.equity().count() == 25


def test_fold_holds_two_sessions_and_reads_pieces():
    """Rows in pieces of any size give what the whole gives, and sessions are asked for one after the other."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame([(j, f"c{i}", 10 + rng.random(), 10 + rng.random(), 0.1, bool(rng.random() < 0.3), bool(rng.random() < 0.3), rng.random(), 0.1) for j in range(30) for i in range(8)], columns=["session", "code", *pf.FIELDS])
    whole = pf.fold(rows, list(range(30)), {}, pf.Config(initial_cash=1e5, max_positions=3))
    two = pd.concat([rows.assign(run_id="a"), rows.assign(run_id="b")])
    pieces = [two.iloc[i : i + 7] for i in range(0, len(two), 7)]
    got = list(pf.fold_runs(iter(pieces), list(range(30)), {}, {k: pf.Config(initial_cash=1e5, max_positions=3) for k in "ab"}))
    assert [g[0] for g in got] == ["a", "b"] and whole[1] and all(g[1:3] == (whole[0], whole[1]) for g in got)
    read = []
    found = pf.sessions_of(read.append(i) or p for i, p in enumerate(pieces))
    next(found)
    assert len(read) <= 3
