"""Seeded synthetic series and markets."""

import datetime as dt

import numpy as np
import pandas as pd

BAR = "code string, date date, open double, high double, low double, close double, volume double, amount double, pct_chg double"


def dates(n, start=dt.date(2020, 1, 1)):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def walk(n=400, seed=0, code="600001", start=dt.date(2020, 1, 1), sigma=0.02):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, sigma, n)))
    open_ = close * np.exp(rng.normal(0, 0.004, n))
    df = pd.DataFrame({"code": code, "date": dates(n, start), "open": open_, "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99, "close": close, "volume": 1e6})
    df["amount"] = df.volume * df.close
    df["pct_chg"] = 100 * df.close.pct_change()
    return df


def market(codes=12, n=320, seed=1):
    """Codes of four boards with 3 % holes, jumps to the limit, one name with a non-positive prefix and one that ends early."""
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(codes):
        g = walk(n, seed + i, ("600", "000", "300", "688")[i % 4] + f"{i:03d}")
        keep = rng.random(n) > 0.03
        keep[0] = True
        g = g[keep]
        jump = rng.random(len(g)) < 0.02
        g.loc[jump, "open"] = g.close.shift(1)[jump] * np.where(rng.random(jump.sum()) < 0.5, 1.2, 0.8)
        g["open"] = g.open.fillna(g.close)
        g["high"], g["low"] = g[["high", "open"]].max(axis=1), g[["low", "open"]].min(axis=1)
        if i == 3:
            g.iloc[:20, g.columns.get_loc("low")] = -1.0
        if i == 5:
            g = g.iloc[: n // 2]
        parts.append(g)
    return pd.concat(parts, ignore_index=True)


def frame(spark, df):
    df = df.astype(object).where(df.notna(), None)
    return spark.createDataFrame(df[[c.split()[0] for c in BAR.split(", ")]].values.tolist(), BAR)


def index(n=320, seed=77):
    return walk(n, seed, "IDX000300", sigma=0.01)
