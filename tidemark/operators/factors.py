"""Factor research on the dense (session x code) grid: every lag counts sessions, every window must be full."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions.market import ratio
from ..shared import durable
from .asof import point_in_time
from .bars import UniverseFilter, dense_grid, forward_return, load_daily, own, tradable, universe, usable_history
from .indicators import YEAR, before, full, sma, with_rsi_over_holes
from .rank import average_rank, rank_ic

# The reports that factors read.
FIELDS = {"roe": "f_roe", "gross_margin": "f_gm", "profit_yoy": "f_pyoy", "revenue_yoy": "f_ryoy", "bps": "f_bps", "eps": "f_eps", "ocfps": "f_ocfps"}


@dataclass(frozen=True)
class Factor:
    name: str
    direction: int
    build: Callable[[], Column]
    note: str = ""


REGISTRY: dict[str, Factor] = {}


def factor(name: str, direction: int = 1, note: str = ""):
    """Register a function that returns the factor's column over the panel."""

    def add(build: Callable[[], Column]) -> Callable[[], Column]:
        REGISTRY[name] = Factor(name, direction, build, note)
        return build

    return add


def _past(n: int, m: int = 0) -> Column:
    c = F.col("close")
    return ratio(before(c, m) if m else c, before(c, n)) - 1


factor("mom_20")(lambda: _past(20))
factor("mom_60")(lambda: _past(60))
factor("mom_120_20", note="skips the latest month")(lambda: _past(140, 20))
factor("reversal_5", -1)(lambda: _past(5))
factor("vol_20", -1, "sample deviation, unlike the indicator")(lambda: full(F.stddev_samp("ret"), F.col("ret"), 20) * sqrt(YEAR))
factor("max_ret_20", -1)(lambda: full(F.max("pct_chg"), F.col("pct_chg"), 20))
factor("amihud", -1)(lambda: sma(F.abs("ret") / F.nullif("amount", F.lit(0.0)), 20) * 1e9)
factor("turnover_20", -1)(lambda: F.ln(F.nullif(sma(F.col("amount"), 20), F.lit(0.0))))
factor("ma60_dist")(lambda: ratio(F.col("close"), sma(F.col("close"), 60)) - 1)
factor("vol_ratio")(lambda: ratio(F.col("volume"), sma(F.col("volume"), 20)))
factor("rsi_14", -1, "null without losses")(lambda: F.col("rsi_14"))
factor("mom_vol")(lambda: ratio(_past(140, 20), full(F.stddev_samp("ret"), F.col("ret"), 20) * sqrt(YEAR)))
factor("roe")(lambda: F.col("f_roe"))
factor("gross_margin")(lambda: F.col("f_gm"))
factor("profit_yoy")(lambda: F.col("f_pyoy"))
factor("revenue_yoy")(lambda: F.col("f_ryoy"))
factor("pb", -1)(lambda: F.col("close") / F.when(F.col("f_bps") > 0, F.col("f_bps")))
factor("ep")(lambda: ratio(F.col("f_eps"), F.col("close")))
factor("ocf_quality")(lambda: F.col("f_ocfps") / F.when(F.abs("f_eps") > 1e-6, F.col("f_eps")))


def build_panel(bars: DataFrame, facts: DataFrame | None = None, fill: str = "pad", rsi: bool = False) -> DataFrame:
    """The grid of these codes' usable bars, with one-session returns, on request RSI, and the reports known on each session.

    ``fill='pad'``: across holes, returns are taken on the last close carried forward; ``'none'``: they are null there.
    """
    grid = dense_grid(usable_history(bars))
    ever = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last("close", ignorenulls=True).over(ever) if fill == "pad" else F.col("close")
    grid = grid.withColumn("_held", held).withColumn("ret", ratio(F.col("_held"), before(F.col("_held"))) - 1).drop("_held")
    if rsi:
        grid = with_rsi_over_holes(grid, "close", 14, "rsi_14")
    return point_in_time(grid, facts, FIELDS) if facts is not None else grid


def universe_panel(instruments: DataFrame, daily: DataFrame, start, end, facts: DataFrame | None = None, top: int = 1200, flt: UniverseFilter = UniverseFilter(), **how) -> DataFrame:
    """The panel of the ``top`` most liquid names that may be traded on ``start``, over [start, end]."""
    codes = universe(instruments, daily, start, flt).limit(top).select("code")
    return build_panel(load_daily(daily, codes, start, end), facts, **how)


def evaluate_columns(panel: DataFrame, names: list[str]) -> DataFrame:
    """code, date and one column a factor, all from one partitioning."""
    return panel.select("code", "date", *[REGISTRY[n].build().alias(n) for n in names])


def long_values(panel: DataFrame, names: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """(factor, code, date, f, mask, r_h...): factor values times direction, stacked."""
    wide = panel.select("code", "date", tradable().alias("mask"), *[forward_return(h).alias(f"r_{h}") for h in horizons], *[(REGISTRY[n].build() * REGISTRY[n].direction).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("f")) for n in names]))
    return wide.withColumn("_p", pairs).select("_p.factor", "code", "date", "_p.f", "mask", *[f"r_{h}" for h in horizons])


def by_horizon(values: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(factor, horizon, code, date, f, mask, r): the returns stacked as the factors are."""
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"r_{h}").alias("r")) for h in horizons]))
    return values.withColumn("_h", pairs).select("factor", "_h.horizon", "code", "date", "f", "mask", "_h.r")


def daily_ic(values: DataFrame, horizons: tuple[int, ...], least: int = 30) -> DataFrame:
    """(factor, horizon, date, n, ic), all horizons in one pass."""
    return rank_ic(by_horizon(values, horizons), "f", "r", F.col("mask"), ("factor", "horizon", "date"), least)


def ic_summary(ic: DataFrame, least_days: int = 30) -> DataFrame:
    """Mean, deviation, information ratio, t value and share of positive days per factor and horizon."""
    sums = ic.groupBy("factor", "horizon").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("pos_ratio"), F.count(F.lit(1)).alias("n"))
    ir = F.when(F.col("std") > 0, F.col("mean") / F.col("std")).otherwise(F.lit(0.0))
    return sums.where(F.col("n") >= least_days).select("factor", "horizon", "mean", "std", ir.alias("ir"), (ir * F.sqrt("n")).alias("t"), "pos_ratio", "n")


def quantile_rank(values: DataFrame, by: tuple = ("factor", "date")) -> DataFrame:
    """q: the factor's average rank among tradable rows as a share, r: the return there."""
    y = F.when(F.col("mask"), F.col("f"))
    step = values.withColumn("_y", y)
    return step.withColumn("q", average_rank(F.col("_y"), *by) / F.count("_y").over(Window.partitionBy(*by))).drop("_y")


def layers(values: DataFrame, r: str, quantiles: int = 5) -> DataFrame:
    """(factor, layer, ret): mean over days of each bucket's mean return; bucket i holds (i/n, (i+1)/n]."""
    ranked = quantile_rank(values).where(F.col("mask") & F.col("q").isNotNull())
    bucket = F.least(F.greatest(F.ceil(F.col("q") * quantiles - 1e-12), F.lit(1)), F.lit(quantiles)).cast("int") - 1
    day = ranked.groupBy("factor", "date", bucket.alias("layer")).agg(F.avg(r).alias("ret")).where("ret IS NOT NULL")
    return day.groupBy("factor", "layer").agg(F.avg("ret").alias("ret"))


def spread(layer_returns: DataFrame, quantiles: int = 5) -> DataFrame:
    """(factor, spread, monotonic): top minus bottom layer, and the share of rising steps."""
    w = Window.partitionBy("factor").orderBy("layer")
    rise = layer_returns.withColumn("up", (F.col("ret") > F.lag("ret").over(w)).cast("double"))
    return rise.groupBy("factor").agg((F.max_by("ret", "layer") - F.min_by("ret", "layer")).alias("spread"), (F.coalesce(F.sum("up"), F.lit(0.0)) / max(quantiles - 1, 1)).alias("monotonic"))


def top_excess(values: DataFrame, r: str, quantiles: int = 5) -> DataFrame:
    """(factor, date, excess): the top bucket's mean return over that of all tradable rows."""
    ranked = quantile_rank(values).where("mask")
    top = F.when(F.col("q") > 1 - 1 / quantiles, F.col(r))
    return ranked.groupBy("factor", "date").agg((F.avg(top) - F.avg(r)).alias("excess")).where("excess IS NOT NULL")


def top_excess_summary(excess: DataFrame) -> DataFrame:
    """(factor, top_excess, top_win_years, top_years)."""
    years = excess.groupBy("factor", F.year("date").alias("year")).agg(F.avg("excess").alias("y"))
    years = years.groupBy("factor").agg(F.count_if(F.col("y") > 0).alias("top_win_years"), F.count(F.lit(1)).alias("top_years"))
    return excess.groupBy("factor").agg(F.avg("excess").alias("top_excess")).join(years, "factor")


def turnover(values: DataFrame, quantiles: int = 5) -> DataFrame:
    """(factor, turnover): one minus the mean share of the top bucket that stood in it the session before; the first session is all new."""
    ranked = quantile_rank(values).withColumn("top", F.coalesce(F.col("mask") & (F.col("q") > 1 - 1 / quantiles), F.lit(False)))
    stayed = F.col("top") & F.coalesce(F.lag("top").over(Window.partitionBy("factor", "code").orderBy("date")), F.lit(False))
    day = ranked.withColumn("stayed", stayed).groupBy("factor", "date").agg(F.sum(F.col("stayed").cast("int")).alias("s"), F.sum(F.col("top").cast("int")).alias("t"))
    return day.where("t > 0").groupBy("factor").agg((1 - F.avg(F.col("s") / F.col("t"))).alias("turnover"))


#: Horizons that an evaluation reports, in sessions.
HORIZONS = (1, 5, 10, 20, 60)


def average_ranks(x: pa.ChunkedArray) -> np.ndarray:
    """``rank.average_rank`` of one cross section inside a task: ranks from 1 among known values, NaN where there is none.

    As in SQL, a value that is NaN ranks last and ties with its like.
    """
    at = np.flatnonzero(x.is_valid().to_numpy())
    v = x.to_numpy()[at]
    order = np.argsort(v)
    v = v[order]
    first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))) if len(v) else at
    size = np.diff(np.append(first, len(v)))
    out = np.full(len(x), np.nan)
    out[at[order]] = np.repeat(first + (size + 1) / 2, size)
    return out


def centred(ranks: np.ndarray) -> np.ndarray:
    """Ranks less their mean, zero where there is none."""
    return np.nan_to_num(ranks - (np.count_nonzero(~np.isnan(ranks)) + 1) / 2)


#: Factors whose marks share one long.
MARKS = 62


def ranked_days(panel: DataFrame, names: list[str], horizons: tuple[int, ...], main: int, quantiles: int, least: int) -> DataFrame:
    """One row per (factor, date): n, ic_h of each horizon, mean returns l_0.. of the layers, excess, top and stayed.

    Tradable rows go to their date once, with all factors side by side: a task ranks each return and each factor of a date once and
    adds up what the day gives. Back come a row a factor and, for ``stayed``, the place in its code's line of each row that stands in
    a top bucket, with one mark a factor.
    """
    ship(panel.sparkSession)
    longs = [f"top_{j}" for j in range(-(-len(names) // MARKS))]
    measures = ["excess", *[f"l_{i}" for i in range(quantiles)], *[f"ic_{h}" for h in horizons]]
    wide = panel.select("code", "date", F.row_number().over(own()).alias("at"), tradable().alias("mask"), *[forward_return(h).alias(f"r_{h}") for h in horizons], *[(REGISTRY[n].build() * REGISTRY[n].direction).alias(f"f_{k}") for k, n in enumerate(names)])
    schema = pa.schema([("date", pa.date32()), ("factor", pa.string()), ("n", pa.int64()), ("top", pa.int64()), *[(m, pa.float64()) for m in measures], ("code", pa.string()), ("at", pa.int32()), *[(c, pa.int64()) for c in longs]])

    def run(t: pa.Table) -> pa.Table:
        back = {h: centred(average_ranks(t[f"r_{h}"])) for h in horizons}
        under = {h: x @ x for h, x in back.items()}
        known, r = t[f"r_{main}"].is_valid().to_numpy(), t[f"r_{main}"].to_numpy()
        mean = lambda rows: r[rows].mean() if rows.any() else None
        marks, days = np.zeros((len(longs), len(r)), np.int64), []
        for k, name in enumerate(names):
            ranks = average_ranks(t[f"f_{k}"])
            n = np.count_nonzero(~np.isnan(ranks))
            q = ranks / max(n, 1)
            layer = np.clip(np.ceil(q * quantiles - 1e-12), 1, quantiles) - 1
            top = q > 1 - 1 / quantiles
            marks[k // MARKS] |= top.astype(np.int64) << k % MARKS
            best, x = mean(top & known), centred(ranks)
            spans = {h: np.sqrt((x @ x) * under[h]) for h in horizons}
            day = {"factor": name, "n": n, "top": np.count_nonzero(top), "excess": None if best is None else best - mean(known)}
            day |= {f"l_{i}": mean((layer == i) & known) for i in range(quantiles)}
            day |= {f"ic_{h}": (x @ back[h]) / s if n >= least and s else None for h, s in spans.items()}
            days.append(day | {"date": t["date"][0].as_py()})
        held = np.flatnonzero(marks.any(axis=0))
        lines = t.select(["date", "code", "at"]).take(held)
        for c, m in zip(longs, marks):
            lines = lines.append_column(c, pa.array(m[held]))
        return pa.concat_tables([pa.Table.from_pylist(days, schema), lines], promote_options="default").select(schema.names).cast(schema)

    kinds = {pa.date32(): "date", pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.float64(): "double"}
    both = durable(wide.where("mask").drop("mask").groupBy("date").applyInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)), "ranked")
    line = Window.partitionBy("code").orderBy("at")
    again = [F.when(F.lag("at").over(line) == F.col("at") - 1, F.col(c).bitwiseAND(F.lag(c).over(line))).alias(c) for c in longs]
    bit = lambda k: F.coalesce(F.sum(F.shiftrightunsigned(longs[k // MARKS], k % MARKS).bitwiseAND(F.lit(1))), F.lit(0))
    stayed = both.where("factor IS NULL").select("date", *again).groupBy("date").agg(F.array(*[F.struct(F.lit(n).alias("factor"), bit(k).alias("stayed")) for k, n in enumerate(names)]).alias("s"))
    stayed = stayed.select("date", F.explode("s").alias("s")).select("s.factor", "date", "s.stayed")
    return both.where("factor IS NOT NULL").join(stayed, ["factor", "date"], "left").select("factor", "date", "n", "top", F.coalesce("stayed", F.lit(0)).alias("stayed"), *measures)


def evaluate_all(panel: DataFrame, names: list[str] | None = None, main: int = 20, quantiles: int = 5, horizons: tuple[int, ...] = HORIZONS, least: int = 30, least_days: int = 30) -> DataFrame:
    """One row a factor, best top excess first: name, IC with its ratio and t value at the main horizon, IC at every horizon, spread
    of the layers, monotonic, top excess, winning years, excess by year, turnover, and an error where it could not be measured.
    """
    names = names or list(REGISTRY)
    horizons = tuple(sorted({*horizons, main}))
    days = durable(ranked_days(panel, names, horizons, main, quantiles, least), "days")  # a row a factor and date, read twice
    ic = F.col(f"ic_{main}")
    layer = [F.avg(f"l_{i}").alias(f"l_{i}") for i in range(quantiles)]
    decay = [F.when(F.count(f"ic_{h}") >= least_days, F.avg(f"ic_{h}")).alias(f"ic_{h}") for h in horizons]
    sums = days.groupBy("factor").agg(
        *decay, *layer, F.stddev_samp(ic).alias("std"), F.avg(F.when(ic.isNotNull(), (ic > 0).cast("double"))).alias("pos_ratio"), F.count(ic).alias("ic_days"),
        F.avg("excess").alias("top_excess"), (1 - F.avg(F.when(F.col("top") > 0, F.col("stayed") / F.col("top")))).alias("turnover"),
    )
    years = days.where("excess IS NOT NULL").groupBy("factor", F.year("date").alias("year")).agg(F.avg("excess").alias("y"))
    years = years.groupBy("factor").agg(F.count_if(F.col("y") > 0).alias("top_win_years"), F.count(F.lit(1)).alias("top_years"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "y")))).alias("excess_by_year"))
    rises = sum((F.coalesce((F.col(f"l_{i + 1}") > F.col(f"l_{i}")).cast("double"), F.lit(0.0)) for i in range(quantiles - 1)), F.lit(0.0))
    known = F.col("ic_days") >= least_days
    ir = F.when(known, F.when(F.col("std") > 0, F.col(f"ic_{main}") / F.col("std")).otherwise(F.lit(0.0)))
    asked = panel.sparkSession.createDataFrame([(n,) for n in names], "factor string")
    out = asked.join(F.broadcast(sums), "factor", "left").join(F.broadcast(years), "factor", "left")  # a row a factor
    error = F.when(F.coalesce("ic_days", F.lit(0)) < least_days, F.concat(F.lit("fewer than "), F.lit(least_days), F.lit(" sessions with "), F.lit(least), F.lit(" values")))
    return out.select(
        "factor", F.col(f"ic_{main}").alias("ic"), ir.alias("ir"), (ir * F.sqrt("ic_days")).alias("t"), F.when(known, F.col("pos_ratio")).alias("pos_ratio"), *[f"ic_{h}" for h in horizons],
        (F.col(f"l_{quantiles - 1}") - F.col("l_0")).alias("spread"), (rises / max(quantiles - 1, 1)).alias("monotonic"), "top_excess", "top_win_years", "top_years", "excess_by_year", "turnover", error.alias("error"),
    ).orderBy(F.col("top_excess").desc_nulls_last(), "factor")


def gram(vectors: DataFrame, width: int) -> DataFrame:
    """(date, pos, s): sums of products of each pair of components over a date's vectors (date, z array<struct<i, v>>).

    Tasks add up whole batches of outer products, packed as upper triangles; only a triangle a date leaves a task. ``pos``
    counts the pairs i <= j row by row; absent components count as zero.
    """
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            z = np.zeros((len(lists), width))
            z[rows, flat.field("i").to_numpy()] = flat.field("v").to_numpy()
            days, of = np.unique(b.column(0).cast(pa.int32()).to_numpy(), return_inverse=True)
            order = np.argsort(of, kind="stable")
            first = np.searchsorted(of[order], np.arange(len(days)))
            sums = np.add.reduceat(z[order][:, i] * z[order][:, j], first, axis=0) if len(days) else np.zeros((0, len(i)))
            yield pa.RecordBatch.from_arrays([pa.array(days, pa.int32()).cast(pa.date32()), pa.array(list(sums), pa.list_(pa.float64()))], ["date", "t"])

    triangles = vectors.select("date", "z").mapInArrow(run, "date date, t array<double>")
    return triangles.select("date", F.posexplode("t").alias("pos", "s")).groupBy("date", "pos").agg(F.sum("s").alias("s"))


def correlation(panel: DataFrame, names: list[str] | None = None, joined: bool = False) -> DataFrame:
    """(a, b, corr): mean over days of the rank correlation of each pair of factors (None: all), a before b in the list or equal.

    Tradable rows go to their date once, with all factors side by side; the task ranks each factor and hands on one packed triangle
    of sums of products. Rows that share code and date stand for themselves. ``joined`` adds up products of each of them with
    each, as a join by code and date does.
    """
    names = names or list(REGISTRY)
    ship(panel.sparkSession)
    wide = panel.select("code", "date", tradable().alias("mask"), *[(REGISTRY[n].build() * REGISTRY[n].direction).alias(f"f_{k}") for k, n in enumerate(names)])
    i, j = np.triu_indices(len(names))

    def run(t: pa.Table) -> pa.Table:
        z = np.stack([centred(average_ranks(t[f"f_{k}"])) for k in range(len(names))], axis=1)
        norms = (z * z).sum(axis=0)
        if joined:
            of = t["code"].combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.argsort(of)
            z = np.add.reduceat(z[order], np.flatnonzero(np.append(True, np.diff(of[order]) != 0)), axis=0)
        return pa.table({"g": pa.array([(z.T @ z)[i, j]], pa.list_(pa.float64())), "own": pa.array([norms], pa.list_(pa.float64()))})

    day = wide.where("mask").drop("mask").groupBy("date").applyInArrow(run, "g array<double>, own array<double>")
    asked = F.array(*[F.struct(F.lit(names[a]).alias("a"), F.lit(names[b]).alias("b"), F.lit(p).alias("p"), F.lit(int(a)).alias("x"), F.lit(int(b)).alias("y")) for p, (a, b) in enumerate(zip(i, j))])
    each = day.select("g", "own", F.explode(asked).alias("q"))
    corr = F.col("g")[F.col("q.p")] / F.nullif(F.sqrt(F.col("own")[F.col("q.x")] * F.col("own")[F.col("q.y")]), F.lit(0.0))
    return each.select("q.a", "q.b", corr.alias("corr")).groupBy("a", "b").agg(F.avg("corr").alias("corr"))
