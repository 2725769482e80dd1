"""Ordered replay of strategies: orders of a bar fill at the next open, positions are marked at each close.

One run is sequential by nature, so a run is one group of a pandas function;
many runs (strategies, universes, parameter sets) go side by side. A session
goes in this order: entitlements and payments that fall due, ex-dates, forced
exits, fills of pending orders, marks, the strategy, record dates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Costs:
    """Basis points of commission and slippage on each trade, of stamp duty on sales, and the lot that orders are cut to.

    `margin` is the part of a position's value that must be held, and
    `multiplier` what a contract counts; shares have 1 and 1.
    """

    commission_bps: float = 2.5
    stamp_bps: float = 5.0
    slippage_bps: float = 1.0
    lot: int = 100
    margin: float = 1.0
    multiplier: float = 1.0


def fill(cash: float, shares: int, target: int, price: float, costs: Costs, limit_up: bool = False, limit_down: bool = False) -> tuple[float, int, int]:
    """(cash, shares, traded) after trading towards `target` at `price`: limits block their side, cash and lots bound purchases."""
    want = target - shares
    if want > 0:
        if limit_up or price <= 0:
            return cash, shares, 0
        cost = price * (1 + costs.slippage_bps / 1e4) * (1 + costs.commission_bps / 1e4)
        n = min(want, int(cash / cost)) // costs.lot * costs.lot
        return cash - n * cost, shares + n, n
    if want < 0:
        if limit_down or price <= 0:
            return cash, shares, 0
        n = -want if target == 0 else -want // costs.lot * costs.lot
        got = price * (1 - costs.slippage_bps / 1e4) * (1 - (costs.commission_bps + costs.stamp_bps) / 1e4)
        return cash + n * got, shares - n, -n
    return cash, shares, 0


def distribute(shares: int, stock_rate: float, cash_rate: float) -> tuple[int, float]:
    """(shares after a distribution, cash to come), by what the record date's holder has; part shares are dropped."""
    return shares + int(shares * stock_rate + 1e-9), shares * cash_rate


@dataclass
class Account:
    """Cash, shares held and not yet listed, cash to come, marks and average costs by symbol."""

    cash: float
    held: dict[str, int] = field(default_factory=dict)
    locked: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    receivable: list[tuple[int, float]] = field(default_factory=list)
    marks: dict[str, float] = field(default_factory=dict)
    cost: dict[str, float] = field(default_factory=dict)

    def shares(self, symbol: str) -> int:
        return self.held.get(symbol, 0) + sum(n for _, n in self.locked.get(symbol, ()))

    def equity(self) -> float:
        return self.cash + sum(a for _, a in self.receivable) + sum(self.shares(s) * self.marks.get(s, 0.0) for s in {*self.held, *self.locked})

    def settle(self, day: int) -> None:
        """Pays what is due and lists shares whose date has come."""
        self.cash += sum(a for d, a in self.receivable if d <= day)
        self.receivable = [(d, a) for d, a in self.receivable if d > day]
        for symbol, rows in list(self.locked.items()):
            self.held[symbol] = self.held.get(symbol, 0) + sum(n for d, n in rows if d <= day)
            self.locked[symbol] = [(d, n) for d, n in rows if d > day]

    def go_ex(self, symbol: str, entitled: int, stock_rate: float, cash_rate: float, pay: int, listing: int) -> None:
        """New shares are locked until they are listed, cash is to come; the mark falls so that the value stays."""
        after, cash = distribute(entitled, stock_rate, cash_rate)
        if after > entitled:
            self.locked.setdefault(symbol, []).append((listing, after - entitled))
        if cash:
            self.receivable.append((pay, cash))
        if symbol in self.marks:
            self.marks[symbol] = (self.marks[symbol] - cash_rate) / (1 + stock_rate)

    def trade(self, symbol: str, target: int, price: float, costs: Costs, limit_up: bool = False, limit_down: bool = False) -> tuple[int, float]:
        """(traded, realised gain) towards a target; locked shares can't be sold."""
        locked = self.shares(symbol) - self.held.get(symbol, 0)
        before = self.held.get(symbol, 0)
        self.cash, now, n = fill(self.cash, before, max(0, target - locked), price, costs, limit_up, limit_down)
        gain = 0.0
        if n > 0:
            total = self.shares(symbol)
            self.cost[symbol] = (self.cost.get(symbol, 0.0) * total + n * price) / (total + n)
        elif n < 0:
            gain = -n * (price - self.cost.get(symbol, price))
        self.held[symbol] = now
        return n, gain


def trade_contracts(cash: float, held: int, mark: float, target: int, price: float, costs: Costs) -> tuple[float, int, float]:
    """(cash, contracts, gain) of futures: what is closed comes before what is opened, and openings are bound by the margin that cash allows.

    Gains since the last mark are settled in cash; a target below zero is short.
    """
    gain = held * (price - mark) * costs.multiplier
    cash += gain
    fee = lambda n: abs(n) * price * costs.multiplier * (costs.commission_bps + costs.slippage_bps) / 1e4
    kept = 0 if held * target <= 0 else (min if held > 0 else max)(held, target)
    cash -= fee(held - kept)
    per = price * costs.multiplier * (costs.margin + (costs.commission_bps + costs.slippage_bps) / 1e4)
    free = cash - abs(kept) * price * costs.multiplier * costs.margin
    opened = max(0, min(abs(target - kept), int(free / per) if per > 0 else 0)) // costs.lot * costs.lot
    opened = opened if target >= kept else -opened
    return cash - fee(opened), kept + opened, gain


#: A strategy sees a session's rows by symbol, the closes so far by symbol, and the account; it answers targets in shares by symbol.
Strategy = Callable[[dict, dict, Account], dict[str, int]]


def moving_average(window: int) -> Strategy:
    """All of the equity, shared alike, in symbols whose close is above its mean of `window` sessions."""

    def decide(rows: dict, closes: dict, account: Account) -> dict[str, int]:
        above = [s for s, c in closes.items() if len(c) >= window and s in rows and c[-1] > sum(c[-window:]) / window]
        share = account.equity() / max(1, len(rows))
        return {s: int(share / closes[s][-1]) if s in above else 0 for s in closes if s in rows}

    return decide


def top_scores(n: int) -> Strategy:
    """The `n` symbols of highest score in equal parts; ties to the smaller symbol; what has no score is sold."""

    def decide(rows: dict, closes: dict, account: Account) -> dict[str, int]:
        scored = sorted((-r["score"], s) for s, r in rows.items() if r.get("score") == r.get("score") and r.get("score") is not None)
        chosen = {s for _, s in scored[:n]}
        share = account.equity() / n
        return {s: int(share / rows[s]["close"]) if s in chosen else 0 for s in {*chosen, *(s for s in account.held if account.held[s])} if s in rows}

    return decide


def run_strategy(sessions: pd.DataFrame, strategy: Strategy, cash: float = 1_000_000.0, costs: Costs = Costs()) -> tuple[list[tuple], list[tuple]]:
    """(daily, trades) of one run over rows trade_date, symbol, open, close and, where there are any, score, limits, distributions and delistings.

    limit_up and limit_down block their side at the open. stock_rate, cash_rate,
    ex_date, pay_date and listing_date stand on the record date's row. A
    delisted symbol is sold at that session's close, whatever is locked.
    """
    account, pending, closes, due, daily, trades = Account(cash), {}, {}, [], [], []
    for day, part in sessions.sort_values(["trade_date", "symbol"], kind="stable").groupby("trade_date", sort=True):
        rows = {r["symbol"]: r for r in part.to_dict("records")}
        account.settle(day)
        for event in [e for e in due if e[0] <= day]:
            account.go_ex(*event[1:])
        due = [e for e in due if e[0] > day]
        # sales first, so that their cash is there to buy with
        for symbol, target in sorted(pending.items(), key=lambda p: (p[1] >= account.shares(p[0]), p[0])):
            row = rows.get(symbol)
            if row is None or not row["open"] == row["open"]:
                continue
            n, gain = account.trade(symbol, target, row["open"], costs, bool(row.get("limit_up")), bool(row.get("limit_down")))
            if n:
                trades.append((day, symbol, n, row["open"], gain, "order"))
        pending = {}
        for symbol, row in rows.items():
            if row["close"] == row["close"]:
                account.marks[symbol] = row["close"]
                closes.setdefault(symbol, []).append(row["close"])
            if row.get("delisted") is True and account.shares(symbol):
                account.held[symbol] = account.shares(symbol)
                account.locked.pop(symbol, None)
                n, gain = account.trade(symbol, 0, account.marks.get(symbol, 0.0), costs)
                trades.append((day, symbol, n, account.marks.get(symbol, 0.0), gain, "delisting"))
        gone = {s for s, r in rows.items() if r.get("delisted") is True}
        for symbol in gone:
            closes.pop(symbol, None)
        pending = {s: t for s, t in strategy({s: r for s, r in rows.items() if s not in gone}, closes, account).items() if t != account.shares(s)}
        for symbol, row in rows.items():
            stock, money = row.get("stock_rate") or 0.0, row.get("cash_rate") or 0.0
            if (stock > 0 or money > 0) and account.shares(symbol):
                due.append((int(row["ex_date"]), symbol, account.shares(symbol), stock, money, int(row["pay_date"]), int(row["listing_date"])))
        daily.append((day, account.cash, account.equity(), sum(1 for s in account.held if account.shares(s))))
    return daily, trades


def replay(sessions: DataFrame, run: str, strategy: Strategy, cash: float = 1_000_000.0, costs: Costs = Costs(), what: str = "daily") -> DataFrame:
    """All runs of a table: by run and date cash, equity and number of holdings, or (`what` = "trades") each trade with its gain and cause."""
    kind, day = sessions.schema[run].dataType.simpleString(), sessions.schema["trade_date"].dataType.simpleString()
    columns, types = (["trade_date", "cash", "equity", "holdings"], f"trade_date {day}, cash double, equity double, holdings int") if what == "daily" else (["trade_date", "symbol", "shares", "price", "gain", "cause"], f"trade_date {day}, symbol string, shares long, price double, gain double, cause string")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[run].iloc[0]
        found = run_strategy(pdf, strategy, cash, costs)[what != "daily"]
        out = pd.DataFrame(found, columns=columns)
        out.insert(0, run, name)
        return out

    return sessions.groupBy(run).applyInPandas(one, f"{run} {kind}, {types}")


def holding_days(trades: DataFrame, ordinals: DataFrame, run: str) -> DataFrame:
    """By run and symbol: shares sold and their mean sessions held, first bought first sold."""
    kind = trades.schema[run].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lots, sold, time = [], 0, 0
        for n, at in pdf.sort_values("ordinal", kind="stable")[["shares", "ordinal"]].itertuples(index=False):
            if n > 0:
                lots.append([n, at])
            while n < 0 and lots:
                part = min(-n, lots[0][0])
                sold, time, n = sold + part, time + part * (at - lots[0][1]), n + part
                lots[0][0] -= part
                if not lots[0][0]:
                    lots.pop(0)
        return pd.DataFrame([(pdf[run].iloc[0], pdf["symbol"].iloc[0], sold, time / sold if sold else None)], columns=[run, "symbol", "sold", "sessions"])

    return trades.join(ordinals, "trade_date").groupBy(run, "symbol").applyInPandas(one, f"{run} {kind}, symbol string, sold long, sessions double")


def moving_average_runs(bars: DataFrame, run: str, order: str, open_: str, close: str, window: int, cash: float = 1_000_000.0, costs: Costs = Costs()) -> DataFrame:
    """Long all of the cash while the close is above its mean of `window` bars, flat below: (run, order, shares, cash, equity, traded)."""
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        money, shares, target, out, closes = cash, 0, None, [], []
        for day, o, c in pdf.sort_values(order)[[order, open_, close]].itertuples(index=False):
            traded = 0
            if target is not None and o == o:
                money, shares, traded = fill(money, shares, target, o, costs)
                target = None
            if c == c:
                closes.append(c)
                mean = sum(closes[-window:]) / min(window, len(closes))
                if len(closes) >= window:
                    target = int(money / c) + shares if c > mean else 0
            last = closes[-1] if closes else 0.0
            out.append((pdf[run].iloc[0], day, shares, money, money + shares * last, traded))
        return pd.DataFrame(out, columns=[run, order, "shares", "cash", "equity", "traded"])

    return bars.groupBy(run).applyInPandas(one, f"{run} {kinds[run]}, {order} {kinds[order]}, shares long, cash double, equity double, traded long")
