"""One session of a portfolio after the other: sell, buy, mark. Plain Python, as it runs inside a grouped fold."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd

# Fees and the size of a round lot.
COMMISSION, COMMISSION_MIN, STAMP, TRANSFER, LOT = 0.00025, 5.0, 0.0005, 0.00001, 100


@dataclass(frozen=True)
class Config:
    initial_cash: float = 200_000.0
    max_positions: int = 5
    position_pct: float = 0.0  # 0: an equal share
    stop_loss: float = 0.0
    take_profit: float = 0.0
    trail_stop_atr: float = 0.0
    min_hold_days: int = 1
    max_hold_days: int = 0
    sizing: str = "close"  # or prev_close; suspended positions count as nothing, or with "account" at cost


@dataclass
class Position:
    shares: int
    cost: float
    opened: object
    peak: float
    held: int = 0


@dataclass
class State:
    cash: float
    positions: dict[str, Position] = field(default_factory=dict)
    blocked: dict[str, int] = field(default_factory=lambda: {"suspended": 0, "limit_up": 0, "limit_down": 0, "insufficient": 0})


FIELDS = ["open", "close", "atr14", "entry", "exit", "score", "limit"]


class Session:
    """The codes of one session; values stay in columns and are read on demand."""

    def __init__(self, columns: dict[str, np.ndarray], places: dict[str, int]) -> None:
        self.columns, self.places = columns, places

    def __contains__(self, code: str) -> bool:
        return code in self.places

    def __getitem__(self, code: str) -> dict:
        i = self.places[code]
        return {f: c[i] for f, c in self.columns.items()}

    def entries(self) -> list[str]:
        entry = self.columns["entry"]
        return [c for c, i in self.places.items() if entry[i]]


def buy_fee(amount: float) -> float:
    return max(amount * COMMISSION, COMMISSION_MIN) + amount * TRANSFER


def sell_fee(amount: float) -> float:
    return max(amount * COMMISSION, COMMISSION_MIN) + amount * STAMP + amount * TRANSFER


def why_leave(p: Position, prev: dict, cfg: Config) -> str | None:
    """The first rule that tells to sell, on the previous session's values."""
    close, atr = prev["close"], prev["atr14"]
    rules = [
        ("exit signal", prev["exit"]),
        ("stop loss", cfg.stop_loss > 0 and close <= p.cost * (1 - cfg.stop_loss)),
        ("take profit", cfg.take_profit > 0 and close >= p.cost * (1 + cfg.take_profit)),
        ("held long enough", cfg.max_hold_days > 0 and p.held >= cfg.max_hold_days),
        ("trailing stop", cfg.trail_stop_atr > 0 and atr is not None and atr == atr and p.peak - cfg.trail_stop_atr * atr >= close),
    ]
    return next((name for name, hit in rules if hit), None) if p.held >= cfg.min_hold_days else None


def sell(state: State, day: object, prev: Session, now: Session, cfg: Config) -> list[tuple]:
    trades = []
    for code, p in list(state.positions.items()):
        p.held += 1
        if code not in now or code not in prev:
            state.blocked["suspended"] += 1
            continue
        reason = why_leave(p, prev[code], cfg)
        if reason is None:
            continue
        price = now[code]["open"]
        if price <= 0:
            state.blocked["suspended"] += 1
        elif price <= prev[code]["close"] * (1 - now[code]["limit"]) + 1e-6:
            state.blocked["limit_down"] += 1
        else:
            gross = p.shares * price
            got = gross - sell_fee(gross)
            state.cash += got
            pnl = got - p.shares * p.cost
            trades.append((code, p.opened, day, p.shares, p.cost, price, pnl, pnl / (p.shares * p.cost), p.held, reason))
            del state.positions[code]
    return trades


def buy(state: State, day: object, prev: Session, now: Session, cfg: Config) -> None:
    free = cfg.max_positions - len(state.positions)
    wanted = [c for c in prev.entries() if c in now and c not in state.positions]
    wanted.sort(key=lambda c: (-prev[c]["score"] if prev[c]["score"] == prev[c]["score"] and prev[c]["score"] is not None else np.inf, c))

    def worth(code: str, p: Position) -> float:
        frame = prev if cfg.sizing == "prev_close" else now
        return p.shares * (frame[code]["close"] if code in frame else p.cost if cfg.sizing == "account" else 0.0)

    budget = (state.cash + sum(worth(c, p) for c, p in state.positions.items())) * (cfg.position_pct or 1 / cfg.max_positions)
    for code in wanted:
        if free <= 0:
            return
        price = now[code]["open"]
        if price <= 0:
            continue
        if price >= prev[code]["close"] * (1 + now[code]["limit"]) - 1e-6:
            state.blocked["limit_up"] += 1
            continue
        shares = int(budget / price / LOT) * LOT
        while shares > 0 and shares * price + buy_fee(shares * price) > state.cash:
            shares -= LOT
        if shares <= 0:
            state.blocked["insufficient"] += 1
            continue
        spent = shares * price + buy_fee(shares * price)
        state.cash -= spent
        state.positions[code] = Position(shares, spent / shares, day, spent / shares)
        free -= 1


def mark(state: State, now: Session) -> float:
    total = state.cash
    for code, p in state.positions.items():
        if code in now:
            p.peak = max(p.peak, now[code]["close"])
            total += p.shares * now[code]["close"]
        else:
            total += p.shares * p.cost
    return total


NOTHING = Session({f: np.zeros(0) for f in FIELDS}, {})
#: The order in which ``fold_runs`` gets its rows; of several rows of a code in a session the last one counts.
ORDER = ["run_id", "session", "code", "open", "close"]


def sessions_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Session]]:
    """(run, session, its codes) of rows that come in ``ORDER``, piece by piece; one session is held at a time."""

    def session(parts: list[pd.DataFrame]) -> Session:
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        return Session({f: rows[f].to_numpy() for f in FIELDS}, {c: i for i, c in enumerate(rows["code"].to_numpy())})

    at, parts = None, []
    for frame in frames:
        for here, part in frame.groupby(["run_id", "session"], sort=False):
            if parts and here != at:
                yield at[0], int(at[1]), session(parts)
                parts = []
            at = here
            parts.append(part)
    if parts:
        yield at[0], int(at[1]), session(parts)


def fold_runs(frames: Iterator[pd.DataFrame], days: list, gates: dict[str, dict], configs: dict[str, Config], state: State | None = None) -> Iterator[tuple[str, list, list, State]]:
    """(run, equity, trades, state) of the runs whose rows (run_id and those of ``fold``) come in ``ORDER``.

    Two sessions are held at a time, whatever the number of sessions; equity and trades are what a run gives.
    """
    for run_id, found in groupby(sessions_of(frames), lambda x: x[0]):
        yield run_id, *_fold(((j, s) for _, j, s in found), days, gates.get(run_id, {}), configs[run_id], state)


def fold(rows: pd.DataFrame, days: list, gate: dict, cfg: Config, state: State | None = None) -> tuple[list, list, State]:
    """Equity rows and trades from the second session on. rows: session (index into days), code, open, close, atr14, entry, exit, score, limit."""
    ordered = rows.assign(run_id="").sort_values("session", kind="stable")
    return _fold(((j, s) for _, j, s in sessions_of(iter([ordered]))), days, gate, cfg, state)


def _fold(found: Iterator[tuple[int, Session]], days: list, gate: dict, cfg: Config, state: State | None) -> tuple[list, list, State]:
    state = state or State(cfg.initial_cash)
    ahead = next(found, None)

    def at(j: int) -> Session:
        nonlocal ahead
        while ahead is not None and ahead[0] < j:
            ahead = next(found, None)
        return ahead[1] if ahead is not None and ahead[0] == j else NOTHING

    equity, trades, now = [], [], at(0)
    for j in range(1, len(days)):
        prev, now = now, at(j)
        trades += sell(state, days[j], prev, now, cfg)
        if gate.get(days[j - 1], True):
            buy(state, days[j], prev, now, cfg)
        total = mark(state, now)
        equity.append((days[j], total, state.cash, len(state.positions)))
    return equity, trades, state


def dump(state: State) -> str:
    return json.dumps({"cash": state.cash, "positions": {c: asdict(p) | {"opened": str(p.opened)} for c, p in state.positions.items()}, "blocked": state.blocked})


def load(text: str) -> State:
    raw = json.loads(text)
    opened = lambda p: p | {"opened": pd.Timestamp(p["opened"]).date()}
    return State(raw["cash"], {c: Position(**opened(p)) for c, p in raw["positions"].items()}, raw["blocked"])
