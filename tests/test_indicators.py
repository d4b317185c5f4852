import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators
from tidemark.operators import indicators as ind

from .synthetic import frame, walk


def column(df, name):
    return df.orderBy("date").toPandas()[name].astype(float)


def same(got, want, tol=1e-9):
    a, b = np.array(got, float), np.array(want, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=tol, atol=tol)


@pytest.fixture(scope="module")
def pdf():
    return walk()


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return frame(spark, pdf).cache()


def test_windows_match_pandas(bars, pdf):
    c = pdf.close
    out = bars.withColumns({"sma": ind.sma(F.col("close"), 20), "hi": ind.highest(F.col("high"), 20), "mom": ind.momentum(F.col("close"), 60), "dd": ind.drawdown(F.col("close"))})
    out = ind.with_slope(ind.with_volatility(out, 20, "vol"), "close", 20, "slope").toPandas().sort_values("date")
    same(out.sma, c.rolling(20).mean())
    same(out.hi, pdf.high.rolling(20).max())
    same(out.mom, c / c.shift(60) - 1)
    same(out.dd, c / c.cummax() - 1)
    same(out.vol, c.pct_change().rolling(20).std(ddof=0) * np.sqrt(252))
    same(out.slope, c.rolling(20).apply(lambda w: np.polyfit(np.arange(20), w, 1)[0] / w.mean()), 1e-6)


@pytest.mark.parametrize("n", [400, 20_000])
def test_ewm_of_any_length(spark, n):
    pdf = walk(n)
    bars = frame(spark, pdf).cache()
    c = pdf.close
    same(column(ind.with_ema(bars, "close", 12, "e"), "e"), c.ewm(span=12, adjust=False, min_periods=12).mean())
    d = c.diff()
    gain, loss = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
    want = (100 - 100 / (1 + gain / loss.where(loss != 0))).fillna(100.0 * (gain > 0))
    same(column(ind.with_rsi(bars, "close", 14, "r"), "r"), want)
    pc = c.shift(1)
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - pc).abs(), (pdf.low - pc).abs()], axis=1).max(axis=1)
    same(column(ind.with_atr(bars, 14, "a"), "a"), tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    dif = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    same(column(ind.with_macd(bars, "close"), "dea"), dif.ewm(span=9, adjust=False, min_periods=9).mean())


def test_no_look_ahead(spark, pdf):
    whole = ind.add_extended(ind.add_common(frame(spark, pdf))).orderBy("date").toPandas()
    part = ind.add_extended(ind.add_common(frame(spark, pdf[:300]))).orderBy("date").toPandas()
    for c in part.columns[9:]:
        same(part[c], whole[c][:300])


def test_simple_series(spark):
    def series(values, **kw):
        d = walk(len(values))
        d["close"] = [float(v) for v in values]
        for k, v in kw.items():
            d[k] = float(v)
        return frame(spark, d)

    flat = column(series([1] * 10).withColumn("s", ind.sma(F.col("close"), 5)), "s")
    assert flat[:4].isna().all() and (flat[4:] == 1).all()
    assert column(ind.with_rsi(series(range(1, 41)), "close", 14, "r"), "r").iloc[-1] > 99
    assert column(ind.with_rsi(series(range(40, 0, -1)), "close", 14, "r"), "r").iloc[-1] < 1
    assert (column(ind.with_rsi(series([5] * 30), "close", 14, "r"), "r") == 0).all()
    assert column(ind.with_atr(series([10] * 30, high=11, low=9), 14, "a"), "a").iloc[-1] == pytest.approx(2)


def test_crosses(bars, pdf):
    out = bars.withColumns({"a": ind.sma(F.col("close"), 5), "b": ind.sma(F.col("close"), 20)})
    got = out.withColumns({"u": ind.cross_above(F.col("a"), F.col("b")), "d": ind.cross_below(F.col("a"), F.col("b"))}).orderBy("date").toPandas()
    a, b = pdf.close.rolling(5).mean(), pdf.close.rolling(20).mean()
    assert (got.u.to_numpy() == ((a > b) & (a.shift() <= b.shift())).to_numpy()).all()
    assert (got.d.to_numpy() == ((a < b) & (a.shift() >= b.shift())).to_numpy()).all() and got.u.any()


def lines(spark, columns: dict, codes: int = 1):
    """Codes with the same columns of numbers (None: no value), one row a day."""
    n = len(next(iter(columns.values())))
    rows = [(f"c{c}", dt.date(1990, 1, 1) + dt.timedelta(days=i), *(None if v is None else float(v) for v in (col[i] for col in columns.values()))) for c in range(codes) for i in range(n)]
    return spark.createDataFrame(rows, "code string, date date, " + ", ".join(f"{k} double" for k in columns))


@pytest.mark.parametrize("holes", ["none", "some", "most", "long", "edges"])
def test_ewm_over_holes_equals_pandas_for_long_lines(spark, holes):
    rng = np.random.default_rng(7)
    n = 20_000
    x = pd.Series(rng.normal(size=n).cumsum() + 50)
    if holes in ("some", "most"):
        x[rng.random(n) < (0.1 if holes == "some" else 0.93)] = np.nan
    if holes == "long":
        x[3000:15000] = np.nan
    if holes == "edges":
        x[:500], x[-700:] = np.nan, np.nan
    want = x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    df = lines(spark, {"x": [None if np.isnan(v) else v for v in x], "y": [None if np.isnan(v) else -2 * v for v in x]})
    got = indicators.with_ewm_over_holes(df, {"x": "a", "y": "b"}, 1 / 14, 14)
    assert got.columns == ["code", "date", "x", "y", "a", "b"]
    got = got.orderBy("date").toPandas()
    assert np.allclose(got.a, want, rtol=1e-9, atol=1e-9, equal_nan=True) and np.allclose(got.b, -2 * want, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_rsi_over_holes_without_python_workers(spark):
    rng = np.random.default_rng(3)
    close = pd.Series(np.exp(rng.normal(size=600) * 0.02).cumprod() * 100)
    close[rng.random(600) < 0.05] = np.nan
    change = close.diff()
    up, down = (part.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for part in (change.clip(lower=0), (-change).clip(lower=0)))
    got = indicators.with_rsi_over_holes(lines(spark, {"close": [None if np.isnan(v) else v for v in close]}), "close", 14, "rsi")
    assert np.allclose(got.orderBy("date").toPandas().rsi, 100 - 100 / (1 + up / down), rtol=1e-9, equal_nan=True)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.split("== Physical Plan ==")[1].count("Exchange") == 1


@pytest.mark.parametrize("alpha,n", [(2 / 13, 5000), (0.9, 3000), (1.0, 50), (0.004, 9000), (2 / 3, 2500)])
def test_ewm_of_any_rate_equals_pandas(spark, alpha, n):
    x = pd.Series(np.random.default_rng(1).normal(size=n) + 5)
    got = indicators.with_ewm(lines(spark, {"x": [None] * 7 + list(x)}), "x", alpha, 3, "y").orderBy("date").toPandas().y[7:].reset_index(drop=True)
    assert np.allclose(got, x.ewm(alpha=alpha, adjust=False, min_periods=3).mean(), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 20, 60, 250])
def test_extremes_by_doubling_equal_a_frame_of_n(spark, n):
    rng = np.random.default_rng(n)
    x = pd.Series(rng.integers(0, 50, 400).astype(float))
    x[rng.random(400) < (0.3 if n < 4 else 0.01)] = np.nan
    df = lines(spark, {"x": [None if np.isnan(v) else v for v in x]}, codes=2)
    got = indicators.extreme(indicators.extreme(df, "x", n, "top"), "x", n, "low", False)
    assert got.columns == ["code", "date", "x", "top", "low"]
    for code in ("c0", "c1"):
        own = got.where(F.col("code") == code).orderBy("date").toPandas()
        assert np.array_equal(own.top, x.rolling(n).max(), equal_nan=True) and np.array_equal(own.low, x.rolling(n).min(), equal_nan=True)


def test_common_indicators_sort_each_code_twice(spark):
    plan = indicators.add_common(frame(spark, walk(50)))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and len(re.findall(r"[+-] \*?(?:\(\d+\) )?Sort \[|:? ?Sort \[", plan)) <= 2, plan
