"""Strategies as Spark columns: what to prepare, when to enter and leave, how to rank."""

from __future__ import annotations

from math import sqrt
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market import ratio, safe
from .asof import point_in_time
from .indicators import YEAR, before, cross_above, cross_below, deviation, drawdown, extreme, full, highest, momentum, sma, with_atr, with_ema, with_returns, with_rsi
from .regime import regime

NO_SCORE = -9.9
REGISTRY: dict[str, type[Strategy]] = {}


def register(cls: type[Strategy]) -> type[Strategy]:
    REGISTRY[cls.name] = cls
    return cls


class Strategy:
    """Subclasses name their parameters in ``defaults``; indicators are derived from the parameters' values."""

    name: ClassVar[str]
    label: ClassVar[str] = ""
    defaults: ClassVar[dict[str, Any]] = {}
    score_fields: list[tuple[str, float]] = []

    def __init__(self, **params: Any) -> None:
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        self.params = {}
        for key, default in self.defaults.items():
            value = params.get(key, default)
            try:
                self.params[key] = type(default)(value)
            except (TypeError, ValueError) as e:
                raise ValueError(f"{self.name}: {key} must be a {type(default).__name__}, not {value!r}") from e
        self.validate()

    def __getitem__(self, key: str) -> Any:
        return self.params[key]

    def validate(self) -> None:
        """Raise ValueError on impossible parameters."""

    def warmup_bars(self) -> int:
        return 250

    def prepare(self, df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        """Columns that entry, exit and score read; always has mom60 and atr14."""
        return with_atr(df, 14, "atr14").withColumn("mom60", momentum(F.col("close"), 60))

    def entry(self) -> Column:
        raise NotImplementedError

    def exit(self) -> Column:
        raise NotImplementedError

    def score(self) -> Column:
        return F.coalesce("mom60", F.lit(NO_SCORE))

    def reason(self, action: str) -> Column:
        return F.lit(f"{self.label or self.name}: {'entry' if action == 'BUY' else 'exit'}")

    def market_regime(self, days: DataFrame, index: DataFrame) -> DataFrame | None:
        """(date, regime), or None for no gate."""
        return None

    @classmethod
    def info(cls) -> dict[str, Any]:
        return {"name": cls.name, "label": cls.label, "defaults": dict(cls.defaults), "warmup_bars": cls().warmup_bars()}

    def signals(self, bars: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        """Bars with entry, exit, score, atr14 and the score fields; unknown conditions are no signal."""
        ready = self.prepare(bars, facts)
        keep = [c for c in bars.columns] + ["atr14", *[f for f, _ in self.score_fields]]
        return ready.select(*keep, safe(self.entry()).alias("entry"), safe(self.exit()).alias("exit"), self.score().alias("score"))


@register
class MaTrend(Strategy):
    name, label = "ma_trend", "aligned averages, breakout on volume"
    defaults = {"vol_ratio_min": 1.2, "ma_fast": 5, "ma_mid": 20, "ma_slow": 60}

    def prepare(self, df, facts=None):
        c, v = F.col("close"), F.col("volume")
        out = super().prepare(df, facts).withColumns({"fast": sma(c, self["ma_fast"]), "mid": sma(c, self["ma_mid"]), "slow": sma(c, self["ma_slow"]), "high20": highest(F.col("high"), 20), "vol_ratio": ratio(v, sma(v, 20))})
        return out

    def entry(self):
        return (F.col("fast") > F.col("mid")) & (F.col("mid") > F.col("slow")) & (F.col("slow") > before(F.col("slow"), 5)) & (F.col("close") > before(F.col("high20"))) & (F.col("vol_ratio") >= self["vol_ratio_min"])

    def exit(self):
        return cross_below(F.col("close"), F.col("mid"))

    def reason(self, action):
        if action == "BUY":
            return F.format_string("averages aligned, above the 20-bar high %.2f, volume ratio %.1f", "high20", "vol_ratio")
        return F.format_string("fell below its average %.2f", "mid")


@register
class MaCross(Strategy):
    name, label = "ma_cross", "crossing averages"
    defaults = {"fast": 10, "slow": 30, "ma_type": "sma", "confirm_pct": 0.0, "trend_filter": 0}

    def validate(self):
        if self["fast"] < 2 or self["slow"] < 3:
            raise ValueError("fast must be 2 or more, slow 3 or more")
        if self["fast"] >= self["slow"] or self["slow"] > 500:
            raise ValueError("fast must be below slow, and slow 500 at most")
        if self["ma_type"].lower() not in ("sma", "ema"):
            raise ValueError("ma_type must be sma or ema")

    def warmup_bars(self):
        return max(self["slow"], self["trend_filter"], 120) + 30

    def prepare(self, df, facts=None):
        out = super().prepare(df, facts)
        if self["ma_type"].lower() == "ema":
            out = with_ema(with_ema(out, "close", self["fast"], "ma_fast"), "close", self["slow"], "ma_slow")
        else:
            out = out.withColumns({"ma_fast": sma(F.col("close"), self["fast"]), "ma_slow": sma(F.col("close"), self["slow"])})
        return out.withColumn("ma_filter", sma(F.col("close"), self["trend_filter"])) if self["trend_filter"] > 0 else out

    def entry(self):
        gap = self["confirm_pct"] / 100
        above = safe(F.col("ma_fast") >= F.col("ma_slow") * (1 + gap))
        sig = above & ~safe(before(above)) if gap > 0 else cross_above(F.col("ma_fast"), F.col("ma_slow"))
        return sig & (F.col("close") > F.col("ma_filter")) if self["trend_filter"] > 0 else sig

    def exit(self):
        return cross_below(F.col("ma_fast"), F.col("ma_slow"))

    def reason(self, action):
        verb = "rose above" if action == "BUY" else "fell below"
        return F.format_string(f"average of {self['fast']} (%.2f) {verb} that of {self['slow']} (%.2f)", "ma_fast", "ma_slow")


@register
class RsiReversal(Strategy):
    name, label = "rsi_reversal", "dip in an upward trend"
    defaults = {"rsi_buy": 32.0, "rsi_sell": 68.0, "trend_ma": 120, "stop_ma": 60, "max_dd": -0.30}

    def prepare(self, df, facts=None):
        c = F.col("close")
        out = with_rsi(super().prepare(df, facts), "close", 14, "rsi14")
        return out.withColumns({"trend": sma(c, self["trend_ma"]), "stop": sma(c, self["stop_ma"]), "dd": drawdown(c), "mom120": momentum(c, 120)})

    def entry(self):
        return (F.col("close") > F.col("trend")) & (F.col("rsi14") < self["rsi_buy"]) & (F.col("close") > F.col("open")) & (F.col("dd") > self["max_dd"])

    def exit(self):
        return cross_above(F.col("rsi14"), F.lit(self["rsi_sell"])) | safe(F.col("close") < F.col("stop"))

    def score(self):
        return F.coalesce(100 - F.col("rsi14"), F.lit(0.0)) + F.coalesce("mom120", F.lit(0.0)) * 20

    def reason(self, action):
        if action == "BUY":
            return F.format_string("RSI %.1f in an upward trend, %.1f%% below its high", "rsi14", F.col("dd") * -100)
        return F.format_string(f"RSI %.1f, close %.2f against the average of {self['stop_ma']} (%.2f)", "rsi14", "close", "stop")


@register
class MomentumRotation(Strategy):
    name, label = "momentum_rotation", "momentum over volatility"
    defaults = {"lookback": 60, "keep_rank": 0.10, "drop_rank": 0.30, "min_ma": 60}

    def prepare(self, df, facts=None):
        c = F.col("close")
        out = with_returns(super().prepare(df, facts))
        return out.withColumns({"ma": sma(c, self["min_ma"]), "mom": momentum(c, self["lookback"]), "vol20": deviation(F.col("_ret"), 20) * sqrt(YEAR)}).drop("_ret")

    def entry(self):
        return (F.col("close") > F.col("ma")) & (F.col("ma") > before(F.col("ma"), 10)) & (F.col("mom") > 0)

    def exit(self):
        return safe(F.col("close") < F.col("ma")) | safe(F.col("mom") < 0)

    def score(self):
        return F.coalesce(ratio(F.col("mom"), F.col("vol20")), F.lit(NO_SCORE))

    def reason(self, action):
        if action == "BUY":
            return F.format_string(f"gained %.1f%% in {self['lookback']} bars, volatility %.2f", F.col("mom") * 100, "vol20")
        return F.format_string("close %.2f against its average %.2f, momentum %.1f%%", "close", "ma", F.col("mom") * 100)


@register
class RegimeMomentum(Strategy):
    name, label = "regime_momentum", "skipped momentum under an index gate"
    defaults = {"lookback": 120, "skip_recent": 20, "hold_ma": 60, "exit_ma": 0, "index_ma": 200, "regime_confirm": 1, "min_mom": 0.0, "max_mom": 1.0, "max_vol": 0.60}

    def warmup_bars(self):
        return self["lookback"] + self["skip_recent"] + max(self["hold_ma"], self["exit_ma"] or self["hold_ma"]) + 40

    def market_regime(self, days, index):
        return regime(days, index, self["index_ma"], self["regime_confirm"]) if self["index_ma"] > 0 else None

    def prepare(self, df, facts=None):
        c = F.col("close")
        out = with_returns(super().prepare(df, facts))
        return out.withColumns({
            "mom_sk": ratio(before(c, self["skip_recent"]), before(c, self["skip_recent"] + self["lookback"])) - 1, "ma_hold": sma(c, self["hold_ma"]),
            "ma_exit": sma(c, self["exit_ma"] or self["hold_ma"]), "vol20": deviation(F.col("_ret"), 20) * sqrt(YEAR),
        }).drop("_ret")

    def entry(self):
        sig = (F.col("close") > F.col("ma_hold")) & (F.col("ma_hold") > before(F.col("ma_hold"), 20)) & (F.col("mom_sk") > self["min_mom"])
        if self["max_mom"] > 0:
            sig = sig & (F.col("mom_sk") <= self["max_mom"])
        return sig & (F.col("vol20") <= self["max_vol"]) if self["max_vol"] > 0 else sig

    def exit(self):
        return F.col("close") < F.col("ma_exit")

    def score(self):
        return F.coalesce(ratio(F.col("mom_sk"), F.col("vol20")), F.lit(NO_SCORE))

    def reason(self, action):
        if action == "BUY":
            return F.format_string("skipped momentum %.1f%%, volatility %.2f", F.col("mom_sk") * 100, "vol20")
        return F.format_string("close %.2f fell below its average %.2f", "close", "ma_exit")


@register
class Defensive(Strategy):
    name, label = "defensive", "calm names"
    defaults = {"index_ma": 200, "max_vol": 0.60, "max_lottery": 9.0, "w_vol": 1.0, "w_lottery": 1.0, "w_reversal": 1.0, "exit_vol": 0.90, "exit_lottery": 15.0}
    # Typical sizes of volatility, largest gain and return.
    SCALES = (0.40, 6.0, 0.15)

    def warmup_bars(self):
        return 160

    def market_regime(self, days, index):
        return regime(days, index, self["index_ma"]) if self["index_ma"] > 0 else None

    def prepare(self, df, facts=None):
        c = F.col("close")
        out = with_returns(super().prepare(df, facts))
        return out.withColumns({"ma60": sma(c, 60), "mom20": momentum(c, 20), "vol20": deviation(F.col("_ret"), 20) * sqrt(YEAR), "max_ret20": full(F.max("pct_chg"), F.col("pct_chg"), 20)}).drop("_ret")

    def entry(self):
        return (F.col("vol20") <= self["max_vol"]) & (F.col("max_ret20") <= self["max_lottery"]) & F.col("ma60").isNotNull()

    def exit(self):
        return safe(F.col("vol20") > self["exit_vol"]) | safe(F.col("max_ret20") > self["exit_lottery"])

    def score(self):
        vol, lottery, back = self.SCALES
        s = -self["w_vol"] * F.col("vol20") / vol - self["w_lottery"] * F.col("max_ret20") / lottery - self["w_reversal"] * F.col("mom20") / back
        return F.coalesce(s, F.lit(NO_SCORE))

    def reason(self, action):
        return F.format_string("volatility %.2f, largest gain %.1f%%", "vol20", "max_ret20")


@register
class GrowthValue(Strategy):
    name, label = "growth_value", "growth and book value"
    defaults = {"w_growth": 1.0, "w_value": 1.0, "max_pb": 0.0, "index_ma": 0, "min_amount": 0.0}

    def __init__(self, **params):
        super().__init__(**params)
        self.score_fields = [("f_rev_yoy", self["w_growth"]), ("f_bp", self["w_value"])]

    def warmup_bars(self):
        return 70

    def market_regime(self, days, index):
        return regime(days, index, self["index_ma"]) if self["index_ma"] > 0 else None

    def prepare(self, df, facts=None):
        if facts is None:
            raise ValueError("growth_value needs fundamentals")
        out = point_in_time(super().prepare(df, facts), facts, {"revenue_yoy": "f_rev_yoy", "bps": "f_bps"})
        return out.withColumn("f_bp", ratio(F.col("f_bps"), F.col("close")))

    def entry(self):
        ok = F.col("f_rev_yoy").isNotNull() & F.col("f_bp").isNotNull() & (F.col("f_bps") > 0)
        return ok & (F.col("f_bp") >= 1 / self["max_pb"]) if self["max_pb"] > 0 else ok

    def exit(self):
        return F.lit(False)

    def score(self):
        return F.lit(0.0)

    def reason(self, action):
        return F.format_string("revenue growth %.1f%%, book to price %.2f", "f_rev_yoy", "f_bp")


@register
class TurtleBreakout(Strategy):
    name, label = "turtle_breakout", "channel breakout"
    defaults = {"entry_days": 20, "exit_days": 10}

    def prepare(self, df, facts=None):
        out = extreme(extreme(super().prepare(df, facts), "high", self["entry_days"], "_up"), "low", self["exit_days"], "_dn", False)
        return out.withColumns({"dc_up": before(F.col("_up")), "dc_dn": before(F.col("_dn"))}).drop("_up", "_dn")

    def entry(self):
        return F.col("close") > F.col("dc_up")

    def exit(self):
        return F.col("close") < F.col("dc_dn")

    def reason(self, action):
        if action == "BUY":
            return F.format_string(f"above the {self['entry_days']}-bar high %.2f", "dc_up")
        return F.format_string(f"below the {self['exit_days']}-bar low %.2f", "dc_dn")


def get_strategy(name: str, **params: Any) -> Strategy:
    if name not in REGISTRY:
        raise KeyError(f"no strategy {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**params)
