"""The forward account: append-only, one session after the other, idempotent.

The state of an account (cash, open lots, last session) is one JSON row. ``advance`` folds all sessions after the last one in
order and writes state, trades and equity of the batch as one version each, the state last, so a crash never half-applies a
session: what was written after the last state is ignored and made again. Advancing to a session that is not newer changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions.portfolio import ORDER, Config, Position, State, dump, fold, fold_runs, load
from ..operators.backtest import calendar, prepare
from ..operators.strategies import get_strategy

ADVANCED = "account string, kind string, date date, payload string"
MIN_BARS = 130


class ForwardAccount:
    def __init__(self, spark: SparkSession, root: str, account: str = "paper") -> None:
        self.spark, self.root, self.account = spark, f"{root.rstrip('/')}/{account}", account

    def _log(self) -> DataFrame:
        schema = "seq long, " + ADVANCED
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _state(self) -> dict | None:
        """The newest committed state; log rows of a later sequence number than its own were never committed."""
        row = self._log().where("kind = 'state'").orderBy(F.desc("seq")).first()
        return None if row is None else {"seq": row["seq"], "date": row["date"], **json.loads(row["payload"])}

    def reset(self, strategy: str, params: dict, start, cash: float = 200_000.0, max_positions: int = 5, max_hold_days: int = 0) -> None:
        """Validate and begin anew; ``start`` is the last session that counts as past."""
        get_strategy(strategy, **params)
        if cash <= 0 or max_positions < 1:
            raise ValueError("cash must be positive and max_positions 1 or more")
        old = self._state()
        cfg = {"strategy": strategy, "params": params, "cash": cash, "max_positions": max_positions, "max_hold_days": max_hold_days}
        row = (old["seq"] + 1 if old else 0, self.account, "state", start, json.dumps({"config": cfg, "state": dump(State(cash)), "since": old["seq"] + 1 if old else 0}))
        self.spark.createDataFrame([row], "seq long, " + ADVANCED).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def advance(self, daily: DataFrame, index: DataFrame, as_of, codes: DataFrame, facts: DataFrame | None = None, names: DataFrame | None = None, members: DataFrame | None = None) -> int:
        """Apply every session after the last one up to as_of, in order; returns how many there were.

        ``members`` (date, code), as ``bars.members`` gives it, names the universe of each session: only its codes are entered.
        """
        now = self._state()
        if now is None:
            raise ValueError("reset the account first")
        if as_of <= now["date"]:
            return 0
        days = calendar(daily, now["date"], as_of)
        dates = [r["date"] for r in days.orderBy("session").collect()]
        if not dates or dates[0] != now["date"]:
            dates = [now["date"], *dates]
            days = self.spark.createDataFrame([(d, i) for i, d in enumerate(dates)], "date date, session int")
        if len(dates) < 2:
            return 0
        c = now["config"]
        strategy = get_strategy(c["strategy"], **c["params"])
        cfg = Config(c["cash"], c["max_positions"], max_hold_days=c["max_hold_days"], sizing="account")
        gate = strategy.market_regime(days, index)
        open_days = {} if gate is None else {r["date"]: r["regime"] for r in gate.collect()}
        rows = prepare(strategy, daily, days, self.account, dates[0], as_of, facts, codes, names, min_bars=MIN_BARS)
        if members is not None:
            allowed = members.join(F.broadcast(days), "date").select("session", "code").distinct().withColumn("_member", F.lit(True))
            rows = rows.join(allowed, ["session", "code"], "left").withColumn("entry", F.col("entry") & F.coalesce("_member", F.lit(False))).drop("_member")
        ship(self.spark)
        state_text, account, config, since, seq = now["state"], self.account, c, now["since"], now["seq"] + 1
        last = dates[-1]
        bench = index.where(F.col("date").isin(dates)).select("date", "close").collect()  # a row a session

        def result(equity: list, trades: list, state: State) -> pd.DataFrame:
            close = {r["date"]: r["close"] for r in bench}
            out = [(account, "equity", d, json.dumps({"equity": round(e, 2), "cash": round(cash, 2), "positions": n, "benchmark": close.get(d), "idle": not open_days.get(before, True)})) for before, (d, e, cash, n) in zip(dates, equity)]
            out += [(account, "trade", t[2], json.dumps({"code": t[0], "opened": str(t[1]), "shares": t[3], "open_price": t[4], "close_price": t[5], "pnl": t[6], "pnl_pct": t[7], "hold_days": t[8], "reason": t[9]})) for t in trades]
            out.append((account, "state", last, json.dumps({"config": config, "state": dump(state), "since": since})))
            return pd.DataFrame(out, columns=["account", "kind", "date", "payload"])

        def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, *found in fold_runs(frames, dates, {account: open_days}, {account: cfg}, load(state_text)):
                yield result(*found)

        if rows.isEmpty():  # no code has enough bars: the sessions count all the same
            done = self.spark.createDataFrame(result(*fold(rows.limit(0).toPandas(), dates, open_days, cfg, load(state_text))).values.tolist(), ADVANCED).coalesce(1)
        else:  # one task folds and writes one file: all of it or nothing
            done = rows.repartition(1).sortWithinPartitions(*ORDER).mapInPandas(go, ADVANCED)
        done = done.select(F.lit(seq).cast("long").alias("seq"), "*")
        done.write.mode("append").parquet(f"{self.root}/log")
        return len(dates) - 1

    def _rows(self, kind: str) -> DataFrame:
        now = self._state()
        return self._log().where(F.col("kind") == kind).where(F.col("seq").between(now["since"], now["seq"]))

    def equity(self) -> DataFrame:
        return self._rows("equity").select(F.lit(self.account).alias("run_id"), "date", F.from_json("payload", "equity double, cash double, positions int, benchmark double, idle boolean").alias("x")).select("run_id", "date", "x.*")

    def trades(self) -> DataFrame:
        return self._rows("trade").select(F.lit(self.account).alias("run_id"), F.col("date").alias("close_date"), F.from_json("payload", "code string, opened date, shares long, open_price double, close_price double, pnl double, pnl_pct double, hold_days int, reason string").alias("x")).select("run_id", "close_date", "x.*")

    def status(self) -> dict:
        now = self._state()
        if now is None:
            raise ValueError("reset the account first")
        c, rows = now["config"], self.equity()
        peak = F.max("equity").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # a row a session
        e = rows.withColumn("fall", F.col("equity") / peak - 1).agg(
            F.max_by("equity", "date").alias("last"), F.max_by("fall", "date").alias("from_peak"), F.min("fall").alias("drawdown"), F.count(F.lit(1)).alias("days"), F.count_if("idle").alias("idle"),
            F.count("benchmark").alias("marks"), (F.max_by("benchmark", F.when(F.col("benchmark").isNotNull(), F.col("date"))) / F.min_by("benchmark", F.when(F.col("benchmark").isNotNull(), F.col("date"))) - 1).alias("benchmark"),
        ).first()
        t = self.trades().agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win"), F.sum("pnl").alias("pnl")).first()
        state = load(now["state"])
        value = e["last"] if e["last"] is not None else c["cash"]
        return {
            "account": self.account, "strategy": c["strategy"], "params": c["params"], "max_positions": c["max_positions"], "max_hold_days": c["max_hold_days"], "initial_cash": c["cash"], "cash": state.cash, "last_date": now["date"],
            "equity": value, "return": value / c["cash"] - 1, "from_peak": e["from_peak"] or 0.0, "max_drawdown": e["drawdown"], "benchmark_return": e["benchmark"] if e["marks"] > 1 else None, "sessions": e["days"], "idle_days": e["idle"],
            "trades": t["n"], "win_rate": t["win"], "realised_pnl": t["pnl"] or 0.0, "open_positions": len(state.positions), "holdings": [{"code": k, "shares": p.shares, "cost": p.cost, "opened": str(p.opened), "held": p.held} for k, p in state.positions.items()],
        }
