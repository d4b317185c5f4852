"""DuckDB twins of the registered queries, over the same test tables."""

from __future__ import annotations

from math import sqrt

YEAR = sqrt(252)

MARKET = """
m_px AS (SELECT l_suppkey // 2 AS n, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 100 + l_extendedprice / 10000 AS px, l_quantity AS q, l_extendedprice AS e,
  row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem),
m_b AS (SELECT n, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume, sum(e) AS amount FROM m_px GROUP BY n, date),
m_c AS (SELECT (CASE n % 4 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' ELSE '688' END) || lpad(CAST(n // 4 AS VARCHAR), 3, '0') AS code, * FROM m_b),
bars AS (SELECT *, 100 * (close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1) AS pct_chg FROM m_c),
idx0 AS (SELECT 'IDX000300' AS code, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume FROM m_px GROUP BY date),
idx AS (SELECT *, 100 * (close / lag(close) OVER (ORDER BY date) - 1) AS pct_chg FROM idx0),
daily AS (SELECT code, n, date, open, high, low, close, volume, amount, pct_chg FROM bars UNION ALL SELECT code, NULL, date, open, high, low, close, volume, NULL, pct_chg FROM idx),
inst AS (SELECT s.code, CASE WHEN s.n % 10 = 3 THEN 'ST' ELSE 'N' END || s.code AS name,
  CASE left(s.code, 3) WHEN '600' THEN 'sh_main' WHEN '000' THEN 'sz_main' WHEN '300' THEN 'chinext' WHEN '688' THEN 'star' END AS board,
  CAST(s.n % 10 = 3 AS INT) AS is_st, CAST(s.d0 - to_days(CAST(s.n % 3 * 200 AS INT)) AS DATE) AS listed_date, CASE WHEN s.n % 17 = 5 THEN CAST(s.d1 + INTERVAL 7 DAY AS DATE) END AS delisted_date, v.n_name AS industry, s.n
  FROM (SELECT code, n, min(date) AS d0, max(date) AS d1 FROM bars GROUP BY code, n) s LEFT JOIN supplier u ON u.s_suppkey = 2 * s.n LEFT JOIN nation v ON v.n_nationkey = u.s_nationkey),
f_q AS (SELECT l_suppkey // 2 AS n, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (0.05 - l_discount)) AS profit, avg(l_tax) AS tax, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
f_b AS (SELECT s_suppkey // 2 AS n, min(s_acctbal) / 100 AS bps FROM supplier GROUP BY 1),
f_p AS (SELECT *, strftime(last_day(q + INTERVAL 2 MONTH), '%Y%m%d') AS period FROM f_q JOIN f_b USING (n)),
fund AS (SELECT (CASE n % 4 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' ELSE '688' END) || lpad(CAST(n // 4 AS VARCHAR), 3, '0') AS code, period,
  CASE quarter(q) WHEN 1 THEN make_date(year(q), 4, 30) WHEN 2 THEN make_date(year(q), 8, 31) WHEN 3 THEN make_date(year(q), 10, 31) ELSE make_date(year(q) + 1, 4, 30) END AS avail_date,
  profit / 1e6 AS eps, bps, 100 * (profit / 1e6) / nullif(bps, 0) AS roe, CASE WHEN quarter(q) <> n % 4 + 1 THEN 100 * (1 - discount) END AS gross_margin, profit / 1e6 * (1 - tax) AS ocfps,
  revenue, 100 * (revenue / nullif(lag(revenue, 4) OVER w, 0) - 1) AS revenue_yoy, profit, 100 * (profit / nullif(lag(profit, 4) OVER w, 0) - 1) AS profit_yoy
  FROM f_p WINDOW w AS (PARTITION BY n ORDER BY q))
"""


def win(n: int, by: str = "code") -> str:
    return f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


EVER = "(PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
OWN = "(PARTITION BY code ORDER BY date)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {win(n)} = {n} THEN {agg}({x}) OVER {win(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {OWN}"


def mom(n: int, x: str = "close") -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def r(x: str, name: str) -> str:
    """Six digits; the shift keeps decimals that end in a 5 from falling either way."""
    return f"round({x} + 3e-10, 6) AS {name}"


def ewm(cte: str, source: str, x: str, alpha: float, least: int, out: str) -> str:
    """CTEs that add the recursion's column ``out`` to ``source``, row by row along each code's line."""
    return f"""
{cte}_k AS MATERIALIZED (SELECT *, {x} AS x_, count({x}) OVER {EVER} AS k_, row_number() OVER {OWN} AS t_ FROM {source}),
{cte}_w AS (SELECT code, t_, x_ AS y_ FROM {cte}_k WHERE k_ = 1 AND x_ IS NOT NULL UNION ALL
  SELECT s.code, s.t_, {1 - alpha!r} * w.y_ + {alpha!r} * s.x_ FROM {cte}_w w JOIN {cte}_k s ON s.code = w.code AND s.t_ = w.t_ + 1),
{cte} AS (SELECT v.* EXCLUDE (x_, k_, t_), CASE WHEN v.x_ IS NOT NULL AND v.k_ >= {least} THEN w.y_ END AS {out} FROM {cte}_k v LEFT JOIN {cte}_w w ON w.code = v.code AND w.t_ = v.t_)"""


def rsi(cte: str, source: str, n: int = 14, out: str = "rsi14") -> str:
    return f"""
{cte}_d AS (SELECT *, close - {lag('close')} AS d_ FROM {source}),
{ewm(cte + '_u', cte + '_d', 'greatest(d_, CASE WHEN d_ IS NOT NULL THEN 0.0 END)', 1 / n, n, 'g_')},
{ewm(cte + '_v', cte + '_u', 'CASE WHEN d_ IS NOT NULL THEN greatest(-d_, 0.0) END', 1 / n, n, 'l_')},
{cte} AS (SELECT * EXCLUDE (d_, g_, l_), coalesce(100 - 100 / (1 + g_ / nullif(l_, 0)), CASE WHEN g_ > 0 THEN 100.0 ELSE 0.0 END) AS {out} FROM {cte}_v)"""


def atr(cte: str, source: str) -> str:
    pc = lag("close")
    return f"""
{cte}_t AS (SELECT *, greatest(high - low, abs(high - {pc}), abs(low - {pc})) AS tr_ FROM {source}),
{ewm(cte, cte + '_t', 'tr_', 1 / 14, 14, 'atr14')}"""


def macd(cte: str, source: str) -> str:
    return f"""
{ewm(cte + '_f', source, 'close', 2 / 13, 12, 'f_')},
{ewm(cte + '_g', cte + '_f', 'close', 2 / 27, 26, 'g_')},
{cte}_h AS (SELECT *, f_ - g_ AS dif FROM {cte}_g),
{ewm(cte, cte + '_h', 'dif', 2 / 10, 9, 'dea')}"""


VOL20 = f"({full('stddev_pop', 'ret', 20)}) * {YEAR!r}"
RET = f"ret AS (SELECT *, {mom(1)} AS ret FROM bars)"

# ---- factors on the dense grid ----

GRID0 = "g0 AS (SELECT c.code, t.date, b.open, b.high, b.low, b.close, b.volume, b.amount, b.pct_chg FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN (SELECT DISTINCT date FROM bars) t LEFT JOIN bars b ON b.code = c.code AND b.date = t.date)"
GRID = f"{GRID0}, g1 AS (SELECT *, last_value(close IGNORE NULLS) OVER {EVER} AS held FROM g0), grid AS (SELECT *, held / nullif({lag('held')}, 0) - 1 AS ret FROM g1)"
LIMIT = "(CASE WHEN left(code, 3) IN ('300', '301', '688', '689') THEN 0.20 ELSE 0.10 END)"
TRADABLE = f"coalesce(close IS NOT NULL AND lead(open) OVER {OWN} < close * (1 + {LIMIT}) - 1e-6, false)"


def fwd(h: int) -> str:
    return f"lead(open, {1 + h}) OVER {OWN} / nullif(lead(open, 1) OVER {OWN}, 0) - 1"


MOM140 = f"({lag('close', 20)} / nullif({lag('close', 140)}, 0) - 1)"
SVOL = f"({full('stddev_samp', 'ret', 20)}) * {YEAR!r}"
FACTORS = {
    "mom_20": mom(20), "mom_60": mom(60), "mom_120_20": MOM140, "reversal_5": mom(5), "vol_20": SVOL, "max_ret_20": full("max", "pct_chg", 20),
    "amihud": f"({full('avg', '(abs(ret) / nullif(amount, 0))', 20)}) * 1e9", "turnover_20": f"ln(nullif({full('avg', 'amount', 20)}, 0))", "ma60_dist": f"close / nullif({full('avg', 'close', 60)}, 0) - 1",
    "vol_ratio": f"volume / nullif({full('avg', 'volume', 20)}, 0)", "mom_vol": f"{MOM140} / nullif({SVOL}, 0)",
}
DIRECTIONS = {"mom_20": 1, "reversal_5": -1, "ma60_dist": 1}


def pit(rows: str, fields: dict[str, str], out: str = "pit") -> str:
    """CTEs: rows (code, date) with the latest known value of each field."""
    parts, joins, cols = [], [], []
    for i, (f, name) in enumerate(fields.items()):
        parts.append(f"{out}_{i} AS (SELECT *, lead(vf) OVER (PARTITION BY code ORDER BY vf) AS vt FROM (SELECT code, avail_date AS vf, arg_max({f}, period) AS v FROM fund WHERE {f} IS NOT NULL GROUP BY code, avail_date))")
        joins.append(f"LEFT JOIN {out}_{i} p{i} ON p{i}.code = b.code AND b.date >= p{i}.vf AND (p{i}.vt IS NULL OR b.date < p{i}.vt)")
        cols.append(f"p{i}.v AS {name}")
    return ", ".join(parts) + f", {out} AS (SELECT b.*, {', '.join(cols)} FROM {rows} b {' '.join(joins)})"


ALL_REPORTS = {"roe": "f_roe", "gross_margin": "f_gm", "profit_yoy": "f_pyoy", "revenue_yoy": "f_ryoy", "bps": "f_bps", "eps": "f_eps", "ocfps": "f_ocfps"}


def avg_rank(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def values(horizons: tuple[int, ...]) -> str:
    rs = ", ".join(f"{fwd(h)} AS r_{h}" for h in horizons)
    wide = f"wide AS (SELECT code, date, {TRADABLE} AS mask, {rs}, " + ", ".join(f"({FACTORS[f]}) * {s} AS {f}" for f, s in DIRECTIONS.items()) + " FROM grid)"
    stacked = " UNION ALL ".join(f"SELECT '{f}' AS factor, code, date, {f} AS f, mask, {', '.join(f'r_{h}' for h in horizons)} FROM wide" for f in DIRECTIONS)
    return f"{GRID}, {wide}, vals AS ({stacked})"


def ic_of(h: int) -> str:
    by = "factor, date"
    return f"""i{h}_a AS (SELECT factor, date, CASE WHEN mask THEN f END AS f, CASE WHEN mask THEN r_{h} END AS r FROM vals),
i{h}_b AS (SELECT factor, date, {avg_rank('f', by)} AS f, {avg_rank('r', by)} AS r FROM i{h}_a),
i{h}_c AS (SELECT factor, date, f - avg(f) OVER (PARTITION BY {by}) AS f, r - avg(r) OVER (PARTITION BY {by}) AS r FROM i{h}_b),
i{h} AS (SELECT factor, date, {h} AS horizon, count(f) AS n, sum(f * r) / nullif(sqrt(sum(f * f) * sum(r * r)), 0) AS ic FROM i{h}_c GROUP BY factor, date HAVING count(f) >= 30)"""


QRANK = f"qr AS (SELECT *, ({avg_rank('y', 'factor, date')}) / count(y) OVER (PARTITION BY factor, date) AS q FROM (SELECT *, CASE WHEN mask THEN f END AS y FROM vals))"
LAYERS = f"{values((5,))}, {QRANK}, lay AS (SELECT factor, layer, avg(ret) AS ret FROM (SELECT factor, date, CAST(least(greatest(ceil(q * 5 - 1e-12), 1), 5) AS INT) - 1 AS layer, avg(r_5) AS ret FROM qr WHERE mask AND q IS NOT NULL GROUP BY ALL) WHERE ret IS NOT NULL GROUP BY factor, layer)"

# ---- strategies ----

ABOVE = lambda a, b: f"coalesce({a} > {b} AND {lag(a)} <= {lag(b)}, false)"
BELOW = lambda a, b: f"coalesce({a} < {b} AND {lag(a)} >= {lag(b)}, false)"


def strategy(steps: str, source: str, columns: str, entry: str, exit_: str, score: str) -> str:
    return f"{steps + ', ' if steps else ''}st AS (SELECT *, {columns} FROM {source}) SELECT code, date, coalesce({entry}, false) AS entry, coalesce({exit_}, false) AS exit, {r(score, 'score')} FROM st"


MOM60 = f"{mom(60)} AS mom60"
BASE_SCORE = "coalesce(mom60, -9.9)"
sma = lambda n, x="close": full("avg", x, n)

CURVE = "curve AS (SELECT 'curve' AS run_id, date, 200000.0 * close / (SELECT arg_min(close, date) FROM idx) AS equity, 0.3 * (200000.0 * close / (SELECT arg_min(close, date) FROM idx)) AS cash, 3 AS positions, close AS benchmark FROM idx)"
PEAK = "max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"
UNDER = f"{CURVE}, u0 AS (SELECT date, equity < {PEAK} AS under FROM curve), u1 AS (SELECT *, sum(CAST(NOT under AS INT)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM u0), uw AS (SELECT coalesce(max(n), 0) AS longest FROM (SELECT island, count(*) AS n FROM u1 WHERE under GROUP BY island))"
TRADES = "trades AS (SELECT 'years' AS run_id, 100 * (z - a) AS pnl, z / a - 1 AS pnl_pct, hold_days FROM (SELECT code, year(date) AS y, arg_min(close, date) AS a, arg_max(close, date) AS z, count(*) AS hold_days FROM bars GROUP BY ALL))"
EDGES = [-1.0, -0.30, -0.20, -0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 10.0]
THINNED = "thin AS (SELECT * FROM bars WHERE NOT (n % 9 = 4 AND date > DATE '2001-01-01'))"
DAMAGED = "dmg AS (SELECT * REPLACE (CASE WHEN n % 7 = 3 AND date < DATE '1996-01-01' THEN -1.0 ELSE low END AS low) FROM bars)"
UNIVERSE = """days AS (SELECT DISTINCT date FROM bars WHERE date <= DATE '1999-01-04' ORDER BY date DESC LIMIT 20),
liq AS (SELECT code, avg(amount) AS avg_amount, arg_max(close, date) AS last_close, count(*) AS bars FROM bars WHERE date IN (SELECT date FROM days) GROUP BY code),
uni AS (SELECT i.code, name, board, industry, avg_amount, last_close, bars FROM inst i JOIN liq USING (code)
  WHERE (delisted_date IS NULL OR delisted_date > DATE '1999-01-04') AND is_st = 0 AND date_diff('day', listed_date, DATE '1999-01-04') >= 250 AND avg_amount >= 150000 AND last_close BETWEEN 2 AND 1e9 AND bars >= 15)"""
FLAGS = f"fl AS (SELECT date, coalesce(close > CASE WHEN count(close) OVER w = 40 THEN avg(close) OVER w END, false) AS above FROM idx WINDOW w AS (ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))"
POSITIONS = """sp AS (SELECT code, n, arg_max(close, date) AS price, arg_min(close, date) AS cost FROM bars GROUP BY code, n),
pos AS (SELECT code, n % 5 * 100 + 100 AS shares, cost, CASE WHEN n % 3 <> 1 THEN price END AS price, CASE n % 3 WHEN 0 THEN 'live' WHEN 2 THEN 'cache' ELSE 'none' END AS price_source FROM sp)"""


def _bodies() -> dict[str, str]:
    """Query -> what follows the market CTEs (further CTEs start with a comma)."""
    q: dict[str, str] = {}
    ohlc = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))
    q["bars_ohlcv"] = f" SELECT code, date, {ohlc}, {r('amount', 'amount')}, {r('pct_chg', 'pct_chg')} FROM bars"
    q["index_ohlcv"] = f" SELECT code, date, {ohlc}, {r('pct_chg', 'pct_chg')} FROM idx"
    q["instruments"] = " SELECT * EXCLUDE (n, is_st), CAST(is_st AS BIGINT) AS is_st FROM inst"
    q["fundamentals"] = " SELECT code, period, avail_date, " + ", ".join(r(c, c) for c in ("eps", "bps", "roe", "gross_margin", "ocfps", "revenue", "revenue_yoy", "profit", "profit_yoy")) + " FROM fund"
    q["calendar_sessions"] = " SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM (SELECT DISTINCT date FROM bars)"
    q["load_daily"] = f" SELECT code, date, {ohlc}, {r('amount', 'amount')}, {r('pct_chg', 'pct_chg')} FROM bars WHERE code IN ('600000', '000000', '300000') AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
    q["dense_grid"] = f", {GRID0} SELECT code, date, {r('close', 'close')} FROM g0"
    q["usable_history"] = f", {DAMAGED}, bad AS (SELECT code, max(date) AS d FROM dmg WHERE close <= 0 OR low <= 0 OR open <= 0 GROUP BY code) SELECT code, count(*) AS bars, min(date) AS first_date FROM dmg LEFT JOIN bad USING (code) WHERE d IS NULL OR date > d GROUP BY code"
    q["store_load_daily"] = q["load_daily"]
    q["store_meta"] = " SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'set' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation"
    q["store_saves"] = " SELECT c_name AS user_name, CAST(CAST(CASE WHEN c_acctbal > 0 THEN -c_acctbal ELSE c_acctbal END AS DECIMAL(18, 2)) AS VARCHAR) AS payload, CASE WHEN c_acctbal > 0 THEN DATE '1999-01-05' ELSE DATE '1999-01-04' END AS day FROM customer"
    q["universe_asof"] = f", {UNIVERSE} SELECT code, name, board, industry, {r('avg_amount', 'avg_amount')}, {r('last_close', 'last_close')}, bars FROM uni"
    q["universe_by_board"] = f", {UNIVERSE} SELECT board, count(*) AS n FROM uni GROUP BY board"
    q["price_limits"] = f" SELECT code, board, CASE WHEN board IN ('star', 'chinext') THEN 0.2 WHEN is_st = 1 THEN 0.05 ELSE 0.1 END::DOUBLE AS price_limit, {LIMIT}::DOUBLE AS prefix_limit FROM inst"
    q["trade_costs"] = " SELECT o_orderkey, round(greatest(o_totalprice * 0.00025, 5) + o_totalprice * 0.00001 + 3e-10, 6) AS buy_cost, round(greatest(o_totalprice / 100 * 0.00025, 5) + o_totalprice / 100 * 0.0005 + o_totalprice / 100 * 0.00001 + 3e-10, 6) AS sell_cost FROM orders"
    q["last_complete_day"] = ", c AS (SELECT date, count(*) AS n FROM bars GROUP BY date ORDER BY date DESC LIMIT 30) SELECT max(date) AS date FROM c WHERE n >= 0.5 * (SELECT list_sort(list(n))[len(list(n)) // 2 + 1] FROM c)"
    q["instruments_search"] = " SELECT code, name FROM inst WHERE code LIKE '%00%' OR name LIKE '%00%' ORDER BY code LIMIT 20"

    q["last_dates"] = " SELECT code, max(date) AS last_date FROM daily GROUP BY code"
    q["coverage"] = " SELECT count(*) FILTER (code NOT LIKE 'IDX%') AS stock_rows, count(DISTINCT code) FILTER (code NOT LIKE 'IDX%') AS stock_codes, min(date) FILTER (code NOT LIKE 'IDX%') AS first_date, max(date) FILTER (code NOT LIKE 'IDX%') AS last_date, count(*) FILTER (code LIKE 'IDX%') AS index_rows, count(DISTINCT code) FILTER (code LIKE 'IDX%') AS index_codes FROM daily"
    q["fundamentals_coverage"] = " SELECT count(*) AS rows, count(DISTINCT code) AS codes, count(DISTINCT period) AS periods, min(period) AS first_period, max(period) AS last_period FROM fund"
    q["boards"] = " SELECT board, count(*) AS n FROM inst GROUP BY board"
    q["listings_by_year"] = " SELECT year(listed_date) AS year, count(*) AS n FROM inst GROUP BY 1 ORDER BY 1 DESC LIMIT 8"
    q["bars_by_year"] = " SELECT year(date) AS year, count(DISTINCT date) AS sessions, count(DISTINCT code) AS codes, count(*) AS bars FROM bars GROUP BY 1"
    near = "(CASE WHEN left(code, 3) IN ('300', '301', '688', '689') THEN 19.5 ELSE 9.8 END)"
    q["limit_counts_by_year"] = f" SELECT year(date) AS year, count(*) FILTER (pct_chg >= {near}) AS limit_up, count(*) FILTER (pct_chg <= -{near}) AS limit_down FROM bars GROUP BY 1"
    q["index_yearly"] = f" SELECT code, year(date) AS year, {r('arg_max(close, date) / arg_min(close, date) - 1', 'ret')} FROM idx GROUP BY ALL"
    q["yearly_return_dist"] = f""", e AS (SELECT year(date) AS year, code, arg_max(close, date) / arg_min(close, date) - 1 AS r FROM bars GROUP BY ALL HAVING count(*) >= 40)
SELECT year, count(*) AS codes, {r('avg(r)', 'mean')}, {r('quantile_cont(r, 0.5)', 'median')}, {r('quantile_cont(r, 0.1)', 'p10')}, {r('quantile_cont(r, 0.9)', 'p90')}, count(*) FILTER (r > 0) AS up, count(*) FILTER (r <= 0) AS down, count(*) FILTER (r > 1) AS doubled, count(*) FILTER (r < -0.5) AS halved, {r('max(r)', 'best')} FROM e GROUP BY year"""
    p = f", pr AS (SELECT code, avg(amount) AS amount, stddev_samp(pct_chg) * {YEAR!r} / 100 AS volatility, arg_max(close, date) AS price FROM bars WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 90) GROUP BY code)"
    q["liquidity_quantiles"] = p + " " + " UNION ALL ".join(f"SELECT '{c}' AS measure, {x} AS quantile, {r(f'quantile_cont({c}, {x})', 'value')} FROM pr" for c in ("amount", "volatility", "price") for x in ("0.1::DOUBLE", "0.25::DOUBLE", "0.5::DOUBLE", "0.75::DOUBLE", "0.9::DOUBLE"))
    long = lambda part, key, source, *names: " UNION ALL ".join(f"SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS key, '{m}' AS measure, {r(f'CAST({m} AS DOUBLE)', 'value')} FROM {source}" for m in names)
    near_ = "(CASE WHEN left(code, 3) IN ('300', '301', '688', '689') THEN 19.5 ELSE 9.8 END)"
    q["market_report"] = f"""{p}, rb AS (SELECT board, count(*) AS n FROM inst GROUP BY board), rl AS (SELECT year(listed_date) AS year, count(*) AS n FROM inst GROUP BY 1 ORDER BY 1 DESC LIMIT 8),
ry AS (SELECT year(date) AS year, count(DISTINCT date) AS sessions, count(DISTINCT code) AS codes, count(*) AS bars, count(*) FILTER (pct_chg >= {near_}) AS limit_up, count(*) FILTER (pct_chg <= -{near_}) AS limit_down FROM bars GROUP BY 1),
ri AS (SELECT code || ' ' || year(date) AS k, arg_max(close, date) / arg_min(close, date) - 1 AS ret FROM idx GROUP BY code, year(date)),
re AS (SELECT year(date) AS year, code, arg_max(close, date) / arg_min(close, date) - 1 AS r FROM bars GROUP BY ALL HAVING count(*) >= 40),
rr AS (SELECT year, count(*) AS codes, avg(r) AS mean, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.1) AS p10, quantile_cont(r, 0.9) AS p90, count(*) FILTER (r > 0) AS up, count(*) FILTER (r <= 0) AS down, count(*) FILTER (r > 1) AS doubled, count(*) FILTER (r < -0.5) AS halved, max(r) AS best FROM re GROUP BY year),
rspan AS (SELECT count(DISTINCT date) AS s, min(date) AS d0, max(date) AS d1 FROM bars), rg AS (SELECT 1 - count(*) / (SELECT s FROM rspan) AS r FROM bars GROUP BY code HAVING min(date) = (SELECT d0 FROM rspan) AND max(date) = (SELECT d1 FROM rspan)),
rs AS (SELECT count(*) AS codes, avg(r) AS mean, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.9) AS p90, count(*) FILTER (r > 0.1) AS over_10pct FROM rg),
rt AS (SELECT code, date_diff('day', max(date), (SELECT d1 FROM rspan)) AS days_behind FROM bars GROUP BY code HAVING max(date) < (SELECT min(date) FROM (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 20)))
{long('boards', 'board', 'rb', 'n')} UNION ALL {long('listings', 'year', 'rl', 'n')} UNION ALL {long('years', 'year', 'ry', 'sessions', 'codes', 'bars', 'limit_up', 'limit_down')} UNION ALL {long('index', 'k', 'ri', 'ret')}
UNION ALL {long('returns', 'year', 'rr', 'codes', 'mean', 'median', 'p10', 'p90', 'up', 'down', 'doubled', 'halved', 'best')} UNION ALL {long('suspension', "''", 'rs', 'codes', 'mean', 'median', 'p90', 'over_10pct')} UNION ALL {long('stale', 'code', 'rt', 'days_behind')}
UNION ALL """ + " UNION ALL ".join(f"SELECT 'recent', '{c}', 'p{x:02d}', {r(f'quantile_cont({c}, {x / 100})', 'value')} FROM pr" for c in ("amount", "volatility", "price") for x in (10, 25, 50, 75, 90))
    q["suspension"] = f", sp AS (SELECT count(DISTINCT date) AS s, min(date) AS d0, max(date) AS d1 FROM bars), g AS (SELECT 1 - count(*) / (SELECT s FROM sp) AS r FROM bars GROUP BY code HAVING min(date) = (SELECT d0 FROM sp) AND max(date) = (SELECT d1 FROM sp)) SELECT count(*) AS codes, {r('avg(r)', 'mean')}, {r('quantile_cont(r, 0.5)', 'median')}, {r('quantile_cont(r, 0.9)', 'p90')}, count(*) FILTER (r > 0.1) AS over_10pct FROM g"
    q["stale_codes"] = f", {THINNED} SELECT code, max(date) AS last_date FROM thin GROUP BY code HAVING max(date) < (SELECT min(date) FROM (SELECT DISTINCT date FROM thin ORDER BY date DESC LIMIT 5))"
    q["find_gaps"] = f", {THINNED}, kn AS (SELECT * FROM thin WHERE n % 11 <> 7), ld AS (SELECT code, max(date) AS last_date FROM kn GROUP BY code) SELECT code, 'lagging' AS kind, last_date, date_diff('day', last_date, (SELECT max(date) FROM kn))::DOUBLE AS days_behind FROM ld WHERE date_diff('day', last_date, (SELECT max(date) FROM kn)) > 3 UNION ALL SELECT code, 'no_data', NULL, NULL FROM inst WHERE code NOT IN (SELECT code FROM kn)"
    q["no_data_anti"] = " SELECT code, name FROM inst WHERE code NOT IN (SELECT code FROM bars WHERE n % 11 <> 7)"
    q["dup_keys"] = " SELECT CAST(l_orderkey AS VARCHAR) AS code, CAST(l_linenumber AS BIGINT) AS date, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"
    q["ohlc_sanity"] = f", {DAMAGED} SELECT count(*) FILTER (low > high) AS low_over_high, count(*) FILTER (low > open) AS low_over_open, count(*) FILTER (low > close) AS low_over_close, count(*) FILTER (high < open) AS high_under_open, count(*) FILTER (high < close) AS high_under_close, count(*) FILTER (close <= 0 OR open <= 0 OR low <= 0) AS non_positive FROM dmg"
    q["amount_missing_by_month"] = f" SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS bars, count(*) FILTER (n % 5 = 2 OR amount <= 0) AS missing, {r('count(*) FILTER (n % 5 = 2 OR amount <= 0) / count(*)', 'share')} FROM bars GROUP BY 1"
    q["unit_ratio"] = f" SELECT {r('avg(amount / nullif(volume * close, 0))', 'ratio')}, count(*) AS bars FROM bars WHERE date > (SELECT max(date) FROM bars) - INTERVAL 60 DAY"
    q["source_compatibility"] = f", s AS (SELECT code, date, close AS a, round(close, 1) AS b FROM bars), t AS (SELECT code, a / b AS ratio, abs(a / lag(a) OVER {OWN} - b / lag(b) OVER {OWN}) AS d FROM s) SELECT code, {r('max(ratio) - min(ratio)', 'ratio_range')}, {r('max(d)', 'return_diff')}, count(*) AS sessions FROM t GROUP BY code"

    def ind(steps: str, source: str, **cols: str) -> str:
        return (f", {steps}" if steps else "") + f" SELECT code, date, {', '.join(r(x, c) for c, x in cols.items())} FROM {source}"

    boll = {"boll_low": f"({sma(20)}) - 2 * ({full('stddev_pop', 'close', 20)})", "boll_mid": sma(20), "boll_up": f"({sma(20)}) + 2 * ({full('stddev_pop', 'close', 20)})"}
    mac = {"dif": "dif", "dea": "dea", "macd_hist": "2 * (dif - dea)"}
    dd = f"close / max(close) OVER {EVER} - 1"
    q["ind_sma"] = ind("", "bars", sma5=sma(5), sma10=sma(10), sma30=sma(30))
    q["ind_ema"] = ind(ewm("e", "bars", "close", 2 / 13, 12, "ema12"), "e", ema12="ema12")
    q["ind_rsi"] = ind(rsi("e", "bars"), "e", rsi14="rsi14")
    q["ind_macd"] = ind(macd("e", "bars"), "e", **mac)
    q["ind_atr"] = ind(atr("e", "bars"), "e", atr14="atr14")
    q["ind_bollinger"] = ind("", "bars", **boll)
    q["ind_channel"] = ind("", "bars", high20=full("max", "high", 20), low10=full("min", "low", 10))
    q["ind_drawdown"] = ind("", "bars", dd=dd)
    q["ind_momentum"] = ind("", "bars", **{f"mom{n}": mom(n) for n in (20, 60, 120)})
    q["ind_volatility"] = ind(RET, "ret", vol20=VOL20)
    q["ind_slope"] = ind(f"i AS (SELECT *, CAST(row_number() OVER {OWN} AS DOUBLE) AS i_ FROM bars)", "i", slope20=f"CASE WHEN count(close) OVER {win(20)} = 20 THEN covar_pop(i_, close) OVER {win(20)} / var_pop(i_) OVER {win(20)} / greatest(avg(close) OVER {win(20)}, 1e-9) END")
    common = {f"ma{n}": sma(n) for n in (5, 10, 20, 60, 120)} | {"vol_ma20": sma(20, "volume"), "vol_ratio": f"volume / nullif({sma(20, 'volume')}, 0)", "rsi14": "rsi14", "atr14": "atr14", "atr_pct": "atr14 / nullif(close, 0)", "high20": full("max", "high", 20), "low20": full("min", "low", 20), "dd": dd} | {f"mom{n}": mom(n) for n in (20, 60, 120)} | {"vol20": VOL20}
    q["ind_common"] = ind(f"{RET}, {rsi('e', 'ret')}, {atr('f', 'e')}", "f", **common)
    q["ind_extended"] = ind(macd("e", "bars"), "e", **{"ma250": sma(250), "vol_ma5": sma(5, "volume"), "high60": full("max", "high", 60)}, **mac, **boll)
    q["cross_above_below"] = f", ab AS (SELECT code, date, {sma(10)} AS a, {sma(30)} AS b FROM bars), x AS (SELECT code, date, {ABOVE('a', 'b')} AS up, {BELOW('a', 'b')} AS down FROM ab) SELECT * FROM x WHERE up OR down"
    q["regime_index_ma"] = f", {FLAGS} SELECT date, above FROM fl WHERE date IN (SELECT date FROM bars)"
    hyst = f"h1 AS (SELECT *, CAST(above <> coalesce(lag(above) OVER (ORDER BY date), NOT above) AS INT) AS nw FROM fl), h2 AS (SELECT *, sum(nw) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM h1), h3 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY date) AS ln FROM h2)"
    held = lambda c: f"coalesce(last_value(CASE WHEN ln >= {c} THEN above END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(above) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING))"
    q["regime_hysteresis"] = f", {FLAGS}, {hyst} SELECT date, {held(3)} AS regime FROM h3"

    q["fundamentals_pit"] = f", {pit('(SELECT code, date FROM bars)', ALL_REPORTS)} SELECT code, date, {', '.join(r(c, c) for c in ALL_REPORTS.values())} FROM pit"
    q["fundamentals_pit_buckets"] = q["fundamentals_pit"]
    q["avail_dates"] = " SELECT period, avail_date, count(*) AS reports FROM fund WHERE period >= '1995' AND avail_date <= DATE '1999-09-01' GROUP BY ALL"
    q["source_pick"] = f", s AS (SELECT code, date, CASE WHEN n % 3 = 0 THEN 'first' WHEN n % 2 = 0 THEN 'second' ELSE 'third' END AS source, close + CASE WHEN n % 3 = 0 THEN 0 WHEN n % 2 = 0 THEN 1 ELSE 2 END AS c FROM bars) SELECT code, source, count(*) AS bars, {r('sum(c)', 'total')} FROM s GROUP BY ALL"
    q["upsert_latest"] = f" SELECT code, date, {r('CASE WHEN n % 4 = 1 THEN 2 * close ELSE close END', 'close')} FROM bars WHERE n % 3 <> 2 OR n % 4 = 1"
    q["adjust_factor"] = f", a0 AS (SELECT *, CASE WHEN month(date) IN (3, 9) THEN 1 + (year(date) - 1990) / 10 END AS f FROM bars), a1 AS (SELECT *, coalesce(last_value(f IGNORE NULLS) OVER {EVER}, first_value(f IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ff FROM a0), a2 AS (SELECT *, ff / last_value(ff) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rr FROM a1) SELECT code, date, {', '.join(r(f'{c} * rr', c) for c in ('open', 'high', 'low', 'close'))} FROM a2"
    q["stitched_spans"] = f" SELECT code, date, {r('close', 'close')}, {r('pct_chg', 'pct_chg')}, {r('volume * 100 * close', 'amount')} FROM bars"
    q["sync_plan"] = f", {THINNED}, l AS (SELECT code, max(date) AS d FROM thin WHERE n % 11 <> 7 GROUP BY code) SELECT i.code, coalesce(CAST(d - INTERVAL 7 DAY AS DATE), DATE '1995-01-01') AS start FROM inst i LEFT JOIN l USING (code)"
    q["spot_prices"] = f" SELECT code, {r('arg_max(close, date)', 'price')} FROM bars GROUP BY code"
    q["stream_dedup_latest"] = f" SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type, {r('arg_max(value, row(ts, event_id))', 'value')} FROM events GROUP BY ALL"
    q["complete_sessions"] = ", c AS (SELECT date, count(*) AS n FROM bars WHERE NOT (date > DATE '2001-06-01' AND n % 3 <> 0) GROUP BY date) SELECT date, n, coalesce(n >= 0.5 * quantile_cont(n, 0.5) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), true) AS complete FROM c"
    q["stream_sessions"] = ", c AS (SELECT date, count(*) FILTER (NOT (date > DATE '2001-06-01' AND n % 3 <> 0)) AS n FROM bars GROUP BY date HAVING date < (SELECT max(date) FROM bars)) SELECT date, n, coalesce(n >= 0.5 * quantile_cont(n, 0.5) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), true) AS complete FROM c"

    y = "CASE WHEN volume > 20 THEN {} END"
    cnt = "count(y) OVER (PARTITION BY date)"
    q["cross_rank_ordinal"] = f", t AS (SELECT code, date, {y.format('volume')} AS y FROM bars) SELECT code, date, round(CASE WHEN y IS NULL THEN 0.0 WHEN {cnt} <= 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY date ORDER BY y NULLS LAST, code) - 1) / ({cnt} - 1) END + 3e-10, 6) AS r FROM t"
    crank = lambda: f"CASE WHEN y IS NULL THEN 0.0 WHEN {cnt} <= 1 THEN 0.0 ELSE (({avg_rank('y', 'date')}) - 1) / ({cnt} - 1) END"
    q["cross_rank_average"] = f", t AS (SELECT code, date, {y.format('volume')} AS y FROM bars) SELECT code, date, {r(crank(), 'r')} FROM t"
    q["cross_rank_ranged"] = q["cross_rank_average"]
    q["price_rank_ranged"] = f" SELECT l_returnflag, l_orderkey, l_linenumber, {r('l_extendedprice', 'l_extendedprice')}, {avg_rank('l_extendedprice', 'l_returnflag')} AS rank, count(l_extendedprice) OVER (PARTITION BY l_returnflag) AS total FROM lineitem"
    q["score_blend"] = f", t AS (SELECT code, date, {y.format('volume')} AS y, volume, close FROM bars), u AS (SELECT code, date, volume, {crank()} AS a, {y.format('close')} AS y FROM t), v AS (SELECT *, {crank()} AS b FROM u) SELECT code, date, {r('CASE WHEN volume > 20 THEN (2 * a + b) / 3 ELSE -9.9 END', 'score')} FROM v"

    q["store_daily"] = f" SELECT code, date, {r('CASE WHEN n % 4 = 1 AND year(date) = 1997 THEN 2 * close ELSE close END', 'close')}, {r('volume', 'volume')} FROM bars"
    q["store_positions"] = " SELECT CAST(code AS BIGINT) AS id, code, name, CAST(code AS BIGINT) % 1000 * 100 AS shares, 10.5::DOUBLE AS cost, listed_date AS open_date FROM inst WHERE code <> '300000'"
    q["store_signal_log"] = f" SELECT date, 'jump' AS strategy, code, 'BUY' AS action, {r("CASE WHEN code < '3' THEN 1.0 ELSE close END", 'price')} FROM bars WHERE pct_chg > 9"
    q["store_sync_errors"] = " SELECT code, DATE '1999-01-04' AS date, 'timeout' AS reason, CASE WHEN code LIKE '6%' THEN 2 ELSE 1 END AS attempt FROM inst WHERE code NOT IN ('000000', '300000')"
    q["parsed_numbers"] = f" SELECT o_orderkey, {r('CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END', 'value')} FROM orders"
    q["parsed_instruments"] = " SELECT lpad(CAST(n AS VARCHAR), 6, '0') AS code, CASE WHEN n % 2 = 0 THEN '*ST' ELSE 'B' END || n AS name, 'sz_main' AS board, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS is_st, CASE WHEN n % 2 = 0 THEN DATE '1998-01-05' ELSE DATE '1999-02-03' END AS listed_date FROM (SELECT DISTINCT n FROM bars)"
    q["parsed_bars"] = f" SELECT code, date, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))}, {r(f'100 * (close / lag(close) OVER {OWN} - 1)', 'pct_chg')}, {r('volume * 100 * close', 'amount')} FROM bars"
    q["parsed_reports"] = f" SELECT code, period, avail_date, {r('eps', 'eps')}, {r('revenue', 'revenue')}, {r('gross_margin', 'gross_margin')} FROM fund"
    q["reports_since"] = f" SELECT code, period, avail_date, {r('eps', 'eps')}, {r('roe', 'roe')} FROM fund WHERE code IN ('600000', '000000', '300000') AND avail_date >= DATE '1996-01-01'"
    q["delisted_missing"] = " SELECT code, name, delisted_date, 1 AS is_st FROM inst WHERE delisted_date IS NOT NULL AND code NOT IN (SELECT code FROM bars WHERE n % 3 = 0)"
    q["universe_members"] = f""", ss AS (SELECT date, row_number() OVER (ORDER BY date) AS s FROM (SELECT DISTINCT date FROM bars)), mw AS (SELECT code, date, avg(amount) OVER w AS a, last_value(close) OVER w AS c, count(*) OVER w AS b FROM bars JOIN ss USING (date) WINDOW w AS (PARTITION BY code ORDER BY s RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)),
mg AS (SELECT mw.*, row_number() OVER (PARTITION BY date ORDER BY a DESC, code) AS k FROM mw JOIN inst USING (code) WHERE is_st = 0 AND (delisted_date IS NULL OR delisted_date > date) AND date_diff('day', listed_date, date) >= 250 AND a >= 150000 AND c BETWEEN 2 AND 1e9 AND b >= 15) SELECT date, code FROM mg WHERE k <= 30"""
    q["fwd_return"] = f", {GRID0} SELECT code, date, {r(fwd(5), 'r5')}, {r(fwd(20), 'r20')} FROM g0"
    q["tradable_mask"] = f", {GRID0} SELECT code, date, {TRADABLE} AS tradable FROM g0"
    for name, x in FACTORS.items():
        q[f"factor_{name}"] = f", {GRID} SELECT code, date, {r(x, 'value')} FROM grid"
    reports = {"roe": "v0", "gross_margin": "v0", "profit_yoy": "v0", "revenue_yoy": "v0"}
    for name in reports:
        q[f"factor_{name}"] = f", {GRID0}, {pit('(SELECT code, date FROM g0)', {name: 'v0'})} SELECT code, date, {r('v0', 'value')} FROM pit"
    for name, fields, x in (("pb", {"bps": "v0"}, "close / CASE WHEN v0 > 0 THEN v0 END"), ("ep", {"eps": "v0"}, "v0 / nullif(close, 0)"), ("ocf_quality", {"ocfps": "v0", "eps": "v1"}, "v0 / CASE WHEN abs(v1) > 1e-6 THEN v1 END")):
        q[f"factor_{name}"] = f", {GRID0}, {pit('(SELECT code, date, close FROM g0)', fields)} SELECT code, date, {r(x, 'value')} FROM pit"
    q["factor_ic"] = f", {values((5,))}, {ic_of(5)} SELECT factor, date, n, {r('ic', 'ic')} FROM i5 WHERE ic IS NOT NULL"
    q["factor_ic_decay"] = f", {values((1, 5, 20))}, {ic_of(1)}, {ic_of(5)}, {ic_of(20)}, al AS (SELECT * FROM i1 UNION ALL SELECT * FROM i5 UNION ALL SELECT * FROM i20), ag AS (SELECT factor, CAST(horizon AS BIGINT) AS horizon, avg(ic) AS mean, stddev_samp(ic) AS std, avg(CAST(ic > 0 AS DOUBLE)) AS pos, count(*) AS n FROM al WHERE ic IS NOT NULL GROUP BY factor, horizon HAVING count(*) >= 30) SELECT factor, horizon, {r('mean', 'mean')}, {r('std', 'std')}, {r('mean / std', 'ir')}, {r('mean / std * sqrt(n)', 't')}, {r('pos', 'pos_ratio')}, n FROM ag"
    q["factor_layers"] = f", {LAYERS} SELECT factor, CAST(layer AS BIGINT) AS layer, {r('ret', 'ret')} FROM lay"
    q["factor_spread"] = f", {LAYERS}, up AS (SELECT *, CAST(ret > lag(ret) OVER (PARTITION BY factor ORDER BY layer) AS DOUBLE) AS up FROM lay) SELECT factor, {r('arg_max(ret, layer) - arg_min(ret, layer)', 'spread')}, {r('coalesce(sum(up), 0.0) / 4', 'monotonic')} FROM up GROUP BY factor"
    q["factor_top_excess"] = f", {values((5,))}, {QRANK}, ex AS (SELECT factor, date, avg(CASE WHEN q > 0.8 THEN r_5 END) - avg(r_5) AS x FROM qr WHERE mask GROUP BY ALL), yr AS (SELECT factor, year(date) AS y, avg(x) AS x FROM ex WHERE x IS NOT NULL GROUP BY ALL), yy AS (SELECT factor, count(*) FILTER (x > 0) AS top_win_years, count(*) AS top_years FROM yr GROUP BY factor) SELECT factor, {r('avg(x)', 'top_excess')}, any_value(top_win_years) AS top_win_years, any_value(top_years) AS top_years FROM ex JOIN yy USING (factor) GROUP BY factor"
    q["factor_turnover"] = f", {values((5,))}, {QRANK}, tp AS (SELECT factor, code, date, coalesce(mask AND q > 0.8, false) AS top FROM qr), tq AS (SELECT *, top AND coalesce(lag(top) OVER (PARTITION BY factor, code ORDER BY date), false) AS stayed FROM tp), td AS (SELECT factor, date, count(*) FILTER (stayed) AS s, count(*) FILTER (top) AS t FROM tq GROUP BY ALL) SELECT factor, {r('1 - avg(s / t)', 'turnover')} FROM td WHERE t > 0 GROUP BY factor"
    year_excess = "ex AS (SELECT factor, date, avg(CASE WHEN q > 0.8 THEN r_5 END) - avg(r_5) AS x FROM qr WHERE mask GROUP BY ALL), yr AS (SELECT factor, year(date) AS year, avg(x) AS x FROM ex WHERE x IS NOT NULL GROUP BY ALL)"
    q["factor_excess_by_year"] = f", {values((5,))}, {QRANK}, {year_excess} SELECT factor, year, {r('x', 'excess')} FROM yr"
    three, means = (1, 5, 20), ", ".join(f"avg(ic) FILTER (h = {h}) AS ic_{h}" for h in (1, 5, 20))
    q["factor_evaluate_some"] = (
        f", {values(three)}, {', '.join(ic_of(h) for h in three)}, {QRANK}, {year_excess}, al AS (SELECT factor, horizon AS h, ic FROM i1 UNION ALL SELECT factor, horizon, ic FROM i5 UNION ALL SELECT factor, horizon, ic FROM i20),"
        f" e1 AS (SELECT factor, {means}, stddev_samp(ic) FILTER (h = 5) AS sd, avg(CAST(ic > 0 AS DOUBLE)) FILTER (h = 5 AND ic IS NOT NULL) AS pos, count(ic) FILTER (h = 5) AS days FROM al GROUP BY factor),"
        " ld AS (SELECT factor, date, CAST(least(greatest(ceil(q * 5 - 1e-12), 1), 5) AS INT) - 1 AS layer, avg(r_5) AS ret FROM qr WHERE mask AND q IS NOT NULL GROUP BY ALL), ly AS (SELECT factor, layer, avg(ret) AS ret FROM ld WHERE ret IS NOT NULL GROUP BY ALL),"
        " lu AS (SELECT *, CAST(ret > lag(ret) OVER (PARTITION BY factor ORDER BY layer) AS DOUBLE) AS up FROM ly), e2 AS (SELECT factor, arg_max(ret, layer) - arg_min(ret, layer) AS spread, coalesce(sum(up), 0.0) / 4 AS mono FROM lu GROUP BY factor),"
        " e3 AS (SELECT factor, avg(x) AS te FROM ex GROUP BY factor), e4 AS (SELECT factor, count(*) FILTER (x > 0) AS w, count(*) AS n FROM yr GROUP BY factor),"
        " tp AS (SELECT factor, code, date, coalesce(mask AND q > 0.8, false) AS top FROM qr), tq AS (SELECT *, top AND coalesce(lag(top) OVER (PARTITION BY factor, code ORDER BY date), false) AS stayed FROM tp), td AS (SELECT factor, date, count(*) FILTER (stayed) AS s, count(*) FILTER (top) AS t FROM tq GROUP BY ALL), e5 AS (SELECT factor, 1 - avg(s / t) AS turn FROM td WHERE t > 0 GROUP BY factor)"
        f" SELECT factor, {r('ic_5', 'ic')}, {r('ic_5 / sd', 'ir')}, {r('ic_5 / sd * sqrt(days)', 't')}, {r('pos', 'pos_ratio')}, {r('ic_1', 'ic_1')}, {r('ic_5', 'ic_5')}, {r('ic_20', 'ic_20')}, {r('spread', 'spread')}, {r('mono', 'monotonic')}, {r('te', 'top_excess')}, w AS top_win_years, n AS top_years, {r('turn', 'turnover')}, CASE WHEN coalesce(days, 0) < 30 THEN 'fewer than 30 sessions with 30 values' END AS error"
        " FROM (SELECT DISTINCT factor FROM vals) LEFT JOIN e1 USING (factor) LEFT JOIN e2 USING (factor) LEFT JOIN e3 USING (factor) LEFT JOIN e4 USING (factor) LEFT JOIN e5 USING (factor)"
    )
    # The averages decay over sessions without a bar; a change next to one is unknown.
    q["factor_rsi_14"] = f""", {GRID0}, ch AS (SELECT code, date, row_number() OVER {OWN} AS t, close - lag(close) OVER {OWN} AS d FROM g0),
wr AS (SELECT code, date, t, NULL::DOUBLE AS u, NULL::DOUBLE AS l, 1.0::DOUBLE AS w, 0 AS n FROM ch WHERE t = 1 UNION ALL
  SELECT ch.code, ch.date, ch.t, CASE WHEN d IS NULL THEN u WHEN n = 0 THEN greatest(d, 0) ELSE (u * w * 13 / 14.0 + greatest(d, 0) / 14.0) / (w * 13 / 14.0 + 1 / 14.0) END,
    CASE WHEN d IS NULL THEN l WHEN n = 0 THEN greatest(-d, 0) ELSE (l * w * 13 / 14.0 + greatest(-d, 0) / 14.0) / (w * 13 / 14.0 + 1 / 14.0) END,
    CASE WHEN d IS NOT NULL OR n = 0 THEN 1.0 ELSE w * 13 / 14.0 END, n + CASE WHEN d IS NULL THEN 0 ELSE 1 END FROM wr JOIN ch ON ch.code = wr.code AND ch.t = wr.t + 1)
SELECT code, date, {r('CASE WHEN n >= 14 THEN 100 - 100 / (1 + u / nullif(l, 0)) END', 'value')} FROM wr"""
    signs = dict.fromkeys(FACTORS, 1) | {f: -1 for f in ("reversal_5", "vol_20", "max_ret_20", "amihud", "turnover_20")}
    stacked = " UNION ALL ".join(f"SELECT {k} AS i, code, date, {f} AS f FROM wide WHERE mask AND {f} IS NOT NULL" for k, f in enumerate(signs))
    q["factor_correlation_price"] = f""", {GRID}, wide AS (SELECT code, date, {TRADABLE} AS mask, {', '.join(f'({FACTORS[f]}) * {x} AS {f}' for f, x in signs.items())} FROM grid), k0 AS ({stacked}),
k1 AS (SELECT i, code, date, ({avg_rank('f', 'i, date')}) - (count(*) OVER (PARTITION BY i, date) + 1) / 2.0 AS v FROM k0), k2 AS (SELECT i, date, sum(v * v) AS vv FROM k1 GROUP BY ALL),
k3 AS (SELECT a.date, a.i, b.i AS j, sum(a.v * b.v) AS ab FROM k1 a JOIN k1 b ON b.date = a.date AND b.code = a.code AND b.i >= a.i GROUP BY ALL),
k4 AS (SELECT x.i, x.j, x.date, y.vv AS ii, z.vv AS jj, coalesce(ab, 0) AS ab FROM (SELECT p.i, q.i AS j, p.date FROM k2 p JOIN k2 q ON q.date = p.date AND q.i >= p.i) x JOIN k2 y ON y.date = x.date AND y.i = x.i JOIN k2 z ON z.date = x.date AND z.i = x.j LEFT JOIN k3 ON k3.date = x.date AND k3.i = x.i AND k3.j = x.j)
SELECT {list(signs)!r}[i + 1] AS a, {list(signs)!r}[j + 1] AS b, {r('avg(ab / nullif(sqrt(ii * jj), 0))', 'corr')} FROM k4 GROUP BY i, j"""
    q["universe_panel"] = f""", {UNIVERSE}, top20 AS (SELECT code FROM uni ORDER BY avg_amount DESC, code LIMIT 20), pb AS (SELECT code, date, close FROM bars WHERE code IN (SELECT code FROM top20) AND date BETWEEN DATE '1999-01-04' AND DATE '2001-06-25'),
pg AS (SELECT c.code, t.date, pb.close FROM top20 c CROSS JOIN (SELECT DISTINCT date FROM pb) t LEFT JOIN pb ON pb.code = c.code AND pb.date = t.date), ph AS (SELECT *, last_value(close IGNORE NULLS) OVER {EVER} AS held FROM pg)
SELECT code, date, {r('close', 'close')}, {r(f"held / nullif({lag('held')}, 0) - 1", 'ret')} FROM ph"""
    names = list(DIRECTIONS)
    ranks = ", ".join(f"{avg_rank(n, 'date')} AS {n}" for n in names)
    masked = ", ".join(f"CASE WHEN mask THEN {n} END AS {n}" for n in names)
    centred = ", ".join(f"{n} - avg({n}) OVER (PARTITION BY date) AS {n}" for n in names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    day = ", ".join(f"sum({a} * {b}) / nullif(sqrt(sum({a} * {a}) * sum({b} * {b})), 0) AS {a}__{b}" for a, b in pairs)
    q["factor_correlation"] = f", {values((5,))}, k0 AS (SELECT date, {masked} FROM wide), k1 AS (SELECT date, {ranks} FROM k0), k2 AS (SELECT date, {centred} FROM k1), k3 AS (SELECT date, {day} FROM k2 GROUP BY date) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'avg({a}__{b})', 'corr')} FROM k3" for a, b in pairs)

    q["strategy_ma_trend"] = ", " + strategy(f"p0 AS (SELECT *, {sma(5)} AS f, {sma(20)} AS m, {sma(60)} AS s, {full('max', 'high', 20)} AS h, volume / nullif({sma(20, 'volume')}, 0) AS vr FROM bars)", "p0", MOM60, f"f > m AND m > s AND s > sl5 AND close > hl AND vr >= 1.2", "xb", BASE_SCORE).replace("st AS (SELECT *, ", f"st AS (SELECT *, {lag('s', 5)} AS sl5, {lag('h')} AS hl, {BELOW('close', 'm')} AS xb, ")
    q["strategy_ma_cross"] = ", " + strategy(f"p0 AS (SELECT *, {sma(10)} AS f, {sma(30)} AS s FROM bars)", "p0", f"{MOM60}, {ABOVE('f', 's')} AS up, {BELOW('f', 's')} AS dn", "up", "dn", BASE_SCORE)
    q["strategy_rsi_reversal"] = ", " + strategy(f"{rsi('e', 'bars')}", "e", f"{sma(120)} AS tr, {sma(60)} AS sp, {dd} AS dd, {mom(120)} AS mom120, coalesce(rsi14 > 68.0 AND {lag('rsi14')} <= 68.0, false) AS ob", "close > tr AND rsi14 < 32 AND close > open AND dd > -0.30", "ob OR coalesce(close < sp, false)", "coalesce(100 - rsi14, 0.0) + coalesce(mom120, 0.0) * 20")
    q["strategy_momentum_rotation"] = ", " + strategy(f"{RET}, p0 AS (SELECT *, {sma(60)} AS ma, {mom(60)} AS mom, {VOL20} AS vol20 FROM ret)", "p0", f"{lag('ma', 10)} AS ma10", "close > ma AND ma > ma10 AND mom > 0", "coalesce(close < ma, false) OR coalesce(mom < 0, false)", "coalesce(mom / nullif(vol20, 0), -9.9)")
    q["strategy_regime_momentum"] = ", " + strategy(f"{RET}, p0 AS (SELECT *, {sma(60)} AS ma, {lag('close', 20)} / nullif({lag('close', 140)}, 0) - 1 AS mom, {VOL20} AS vol20 FROM ret)", "p0", f"{lag('ma', 20)} AS ma20", "close > ma AND ma > ma20 AND mom > 0 AND mom <= 1 AND vol20 <= 0.6", "close < ma", "coalesce(mom / nullif(vol20, 0), -9.9)")
    q["strategy_defensive"] = ", " + strategy(RET, "ret", f"{sma(60)} AS ma60, {mom(20)} AS mom20, {VOL20} AS vol20, {full('max', 'pct_chg', 20)} AS mx", "vol20 <= 0.6 AND mx <= 9 AND ma60 IS NOT NULL", "coalesce(vol20 > 0.9, false) OR coalesce(mx > 15, false)", "coalesce(-vol20 / 0.40 - mx / 6.0 - mom20 / 0.15, -9.9)")
    gv = pit("(SELECT code, date, close FROM bars)", {"revenue_yoy": "g", "bps": "b"})
    q["strategy_growth_value"] = ", " + strategy(gv, "pit", "b / nullif(close, 0) AS bp", "g IS NOT NULL AND bp IS NOT NULL AND b > 0 AND bp >= 0.1", "false", "0.0::DOUBLE")
    q["strategy_turtle_breakout"] = ", " + strategy(f"p0 AS (SELECT *, {full('max', 'high', 20)} AS hi, {full('min', 'low', 10)} AS lo FROM bars)", "p0", f"{MOM60}, {lag('hi')} AS up, {lag('lo')} AS dn", "close > up", "close < dn", BASE_SCORE)
    q["strategy_score_fields"] = f", {gv}, e AS (SELECT code, date, g, b / nullif(close, 0) AS y FROM pit WHERE g IS NOT NULL AND b / nullif(close, 0) IS NOT NULL AND b > 0), e2 AS (SELECT code, date, {crank()} AS bp, g AS y FROM e) SELECT code, date, {r(f'({crank()} + bp) / 2', 'score')} FROM e2"
    lastd = "(SELECT max(date) FROM bars)"
    q["signals_today"] = f""", el AS (SELECT code FROM bars GROUP BY code HAVING count(*) >= 135 AND max(date) = {lastd}), p0 AS (SELECT *, {sma(3)} AS f, {sma(8)} AS s, {mom(60)} AS mom60 FROM bars WHERE code IN (SELECT code FROM el)),
p1 AS (SELECT *, {ABOVE('f', 's')} AS up, {BELOW('f', 's')} AS dn FROM p0), now AS (SELECT p1.*, is_st = 1 AS held, coalesce(mom60, -9.9) AS sc FROM p1 JOIN inst USING (code) WHERE date = {lastd}),
buys AS (SELECT * FROM now WHERE up AND NOT held ORDER BY sc DESC, code LIMIT 10)
SELECT date, 'ma_cross' AS strategy, code, 'BUY' AS action, {r('close', 'price')}, {r('sc', 'score')}, CAST(floor(40000 / round(close, 2) / 100) * 100 AS DOUBLE) AS shares FROM buys
UNION ALL SELECT date, 'ma_cross', code, 'SELL', round(close + 3e-10, 6), round(sc + 3e-10, 6), NULL FROM now WHERE held AND dn"""
    day_list = "(SELECT unnest([DATE '1999-06-28', DATE '2000-06-26', DATE '2001-03-26']) AS date)"
    q["signals_gated"] = f""", {RET}, p0 AS (SELECT *, {sma(60)} AS ma, {lag('close', 20)} / nullif({lag('close', 140)}, 0) - 1 AS mom, {VOL20} AS vol20, row_number() OVER {OWN} AS seen FROM ret), p1 AS (SELECT *, {lag('ma', 20)} AS ma20 FROM p0),
ix AS (SELECT date, coalesce(close > CASE WHEN count(close) OVER w = 40 THEN avg(close) OVER w END, false) AS above FROM idx WHERE date < DATE '2001-03-26' WINDOW w AS (ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
gate AS (SELECT t.date, (SELECT arg_max(above, ix.date) FROM ix WHERE ix.date <= t.date) AS regime, (SELECT max(date) FROM ix) AS index_last FROM {day_list} t),
now AS (SELECT p1.*, is_st = 1 AS held, coalesce(mom / nullif(vol20, 0), -9.9) AS sc, regime, index_last FROM p1 JOIN inst USING (code) JOIN gate USING (date) WHERE seen >= 216),
buys AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY sc DESC, code) AS place FROM now WHERE close > ma AND ma > ma20 AND mom > 0 AND mom <= 1 AND vol20 <= 0.6 AND NOT held AND regime)
SELECT date, 'regime_momentum' AS strategy, code, 'BUY' AS action, {r('close', 'price')}, {r('sc', 'score')}, printf('skipped momentum %.1f%%, volatility %.2f', mom * 100, vol20) AS reason, regime, index_last, index_last < date AS stale FROM buys WHERE place <= 10
UNION ALL SELECT date, 'regime_momentum', code, 'SELL', round(close + 3e-10, 6), round(sc + 3e-10, 6), printf('close %.2f fell below its average %.2f', close, ma), regime, index_last, index_last < date FROM now WHERE held AND close < ma"""
    q["index_four"] = f""", f0 AS (SELECT ['IDX000300', 'IDX000905', 'IDX000001', 'IDX399006', 'IDX000852'][l_orderkey % 5 + 1] AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 100 + l_extendedprice / 10000 AS px, l_quantity AS q, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem),
f1 AS (SELECT code, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume FROM f0 GROUP BY ALL), f2 AS (SELECT *, 100 * (close / {lag('close')} - 1) AS pct_chg FROM f1) SELECT code, date, {ohlc}, {r('pct_chg', 'pct_chg')} FROM f2 WHERE date >= DATE '1996-01-01'"""
    zipped = """, tl AS (SELECT code AS run_id, date AS open_date, close AS price, n % 7 * 100 AS shares, n FROM bars WHERE year(date) < 1998),
tr AS (SELECT run_id, open_date, CASE WHEN n % 5 = 1 AND year(open_date) = 1997 THEN price + 0.01 ELSE price END AS price, CASE WHEN n % 11 = 3 AND month(open_date) = 7 THEN 1 ELSE shares END AS shares FROM tl WHERE NOT (n % 7 = 2 AND open_date BETWEEN DATE '1996-03-01' AND DATE '1996-06-01') AND n % 23 <> 4
  UNION ALL SELECT run_id, CAST(max(open_date) + INTERVAL 7 DAY AS DATE), 1.0, 100 FROM tl WHERE n % 13 = 6 GROUP BY run_id),
ta AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY open_date, price, shares) AS k FROM tl), tb AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY open_date, price, shares) AS k FROM tr),
z0 AS (SELECT coalesce(ta.run_id, tb.run_id) AS run_id, coalesce(ta.k, tb.k) AS k, ta.open_date AS left_open_date, ta.price AS left_price, ta.shares AS left_shares, tb.open_date AS right_open_date, tb.price AS right_price, tb.shares AS right_shares, ta.run_id IS NULL AS no_left, tb.run_id IS NULL AS no_right FROM ta FULL JOIN tb ON tb.run_id = ta.run_id AND tb.k = ta.k),
z1 AS (SELECT *, CASE WHEN left_open_date <> right_open_date THEN 'open_date' WHEN abs(left_price - right_price) > 1e-9 * greatest(left_price, right_price, 1) THEN 'price' WHEN left_shares <> right_shares THEN 'shares' END AS f FROM z0),
z AS (SELECT *, CASE WHEN no_right THEN 'left_only' WHEN no_left THEN 'right_only' WHEN f IS NOT NULL THEN 'different' ELSE 'same' END AS status FROM z1)"""
    q["reconcile_rows"] = f"{zipped} SELECT run_id, k, status, f AS field, left_open_date, {r('left_price', 'left_price')}, left_shares, right_open_date, {r('right_price', 'right_price')}, right_shares FROM z WHERE status <> 'same'"
    q["reconcile_trades"] = f"""{zipped} SELECT run_id, count(*) FILTER (status <> 'right_only') AS n_left, count(*) FILTER (status <> 'left_only') AS n_right, count(*) FILTER (status = 'same') AS same, count(*) FILTER (status = 'different') AS different,
  count(*) FILTER (status = 'left_only') AS left_only, count(*) FILTER (status = 'right_only') AS right_only, min(k) FILTER (status <> 'same') AS first_k, arg_min(status, k) FILTER (status <> 'same') AS first_status, arg_min(f, k) FILTER (status <> 'same' AND k = k0) AS first_field, min(k) FILTER (status <> 'same') IS NULL AS equal
  FROM (SELECT *, min(CASE WHEN status <> 'same' THEN k END) OVER (PARTITION BY run_id) AS k0 FROM z) GROUP BY run_id"""
    q["signal_sizing"] = f", s AS (SELECT code, arg_max(close, date) AS price FROM bars GROUP BY code) SELECT code, {r('price', 'price')}, 12000.0::DOUBLE AS budget, CAST(floor(12000 / round(price, 2) / 100) * 100 AS BIGINT) AS shares, floor(12000 / round(price, 2) / 100) > 0 AS affordable, round(round(price, 2) * 100, 2) AS min_amount FROM s"
    q["position_pnl"] = f", {POSITIONS} SELECT code, shares, {r('cost', 'cost')}, {r('price', 'price')}, price_source, {r('shares * cost', 'paid')}, {r('shares * price', 'value')}, {r('shares * price - shares * cost', 'pnl')}, {r('(shares * price - shares * cost) / (shares * cost)', 'pnl_pct')} FROM pos"
    q["position_totals"] = f", {POSITIONS} SELECT {r('sum(shares * cost)', 'paid')}, {r('sum(shares * price)', 'value')}, {r('sum(shares * (price - cost))', 'pnl')}, {r('sum(shares * (price - cost)) / sum(shares * cost)', 'pnl_pct')} FROM pos WHERE price IS NOT NULL"

    q["underwater"] = f", {UNDER} SELECT 'curve' AS run_id, longest AS longest_underwater FROM uw"
    q["drawdown_curve"] = f", {CURVE} SELECT run_id, date, round(equity / {PEAK} - 1, 5) AS drawdown FROM curve"
    q["exposure_curve"] = f", {CURVE} SELECT run_id, date, round(least(greatest((equity - cash) / equity, 0), 1), 4) AS exposure, CAST(positions AS BIGINT) AS positions FROM curve"
    q["metrics_equity"] = f""", {UNDER}, s AS (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS rt, equity / {PEAK} - 1 AS dd FROM curve),
a AS (SELECT arg_max(equity, date) AS fin, count(*) AS days, avg(rt) AS m, stddev_pop(rt) * {YEAR!r} AS vol, stddev_pop(CASE WHEN rt < 0 THEN rt END) * {YEAR!r} AS down, min(dd) AS mdd FROM s)
SELECT 'curve' AS run_id, round(fin / 200000 - 1, 4) AS total_return, round(pow(fin / 200000, 252.0 / days) - 1, 4) AS cagr, round(vol, 4) AS volatility, round(m * 252 / vol, 3) AS sharpe, round(m * 252 / down, 3) AS sortino, round(mdd, 4) AS max_drawdown, (SELECT longest FROM uw) AS longest_underwater, round((pow(fin / 200000, 252.0 / days) - 1) / -mdd, 3) AS calmar, round(fin, 2) AS final_equity, days FROM a"""
    q["metrics_trades"] = f", {TRADES} SELECT run_id, count(*) AS trades, round(avg(CAST(pnl > 0 AS DOUBLE)), 4) AS win_rate, round(avg(pnl_pct), 4) AS avg_return, round(avg(pnl_pct) FILTER (pnl > 0), 4) AS avg_win, round(avg(pnl_pct) FILTER (pnl <= 0), 4) AS avg_loss, round(sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)), 2) AS profit_factor, round(avg(hold_days), 1) AS avg_hold_days, round(max(pnl_pct), 4) AS best, round(min(pnl_pct), 4) AS worst FROM trades GROUP BY run_id"
    q["metrics_benchmark"] = f", {CURVE}, s AS (SELECT *, benchmark / max(benchmark) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM curve) SELECT 'curve' AS run_id, round(arg_max(benchmark, date) / arg_min(benchmark, date) - 1, 4) AS benchmark_return, round(min(dd), 4) AS benchmark_drawdown, round(arg_max(equity, date) / 200000 - 1 - (arg_max(benchmark, date) / arg_min(benchmark, date) - 1), 4) AS excess FROM s"
    q["monthly_returns"] = f", {CURVE}, m AS (SELECT date_trunc('month', date) AS d, arg_max(equity, date) AS e FROM curve GROUP BY 1) SELECT 'curve' AS run_id, year(d) AS year, month(d) AS month, round(e / coalesce(lag(e) OVER (ORDER BY d), 200000) - 1, 4) AS ret FROM m"
    q["yearly_vs_benchmark"] = f", {CURVE}, y AS (SELECT year(date) AS year, arg_max(equity, date) AS e, arg_max(benchmark, date) AS b FROM curve GROUP BY 1) SELECT 'curve' AS run_id, year, round(e / coalesce(lag(e) OVER (ORDER BY year), 200000) - 1, 4) AS ret, round(b / coalesce(lag(b) OVER (ORDER BY year), (SELECT arg_min(benchmark, date) FROM curve)) - 1, 4) AS bench FROM y"
    q["trade_histogram"] = f", {TRADES} " + " UNION ALL ".join(f"SELECT 'years' AS run_id, {i}::BIGINT AS bucket, {a}::DOUBLE AS low, {b}::DOUBLE AS high, count(*) FILTER (pnl_pct >= {a} AND pnl_pct {'<=' if i == 12 else '<'} {b}) AS count FROM trades" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
    return q


def sql() -> dict[str, str]:
    return {name: f"WITH RECURSIVE {MARKET.strip()}{body}" for name, body in _bodies().items()}


