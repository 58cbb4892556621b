"""The portfolio ledger: many scenarios at once, each a deterministic cash account.

Cash is shared by a scenario's symbols, so a scenario is the unit of work; all
else is set-based. Bars become a table of what an account needs of each bar
(prices, stop distance, average volumes) in one window pass, signals are
computed once for each set of parameters, and scenarios are dealt to tasks in
small groups that share their signals. A task sees days x symbols arrays.

Rules of an account: signals after the close, fills at a later open; a stop may
fire on the bar of entry and fills at the open if that is below it; size is the
lesser of risk budget and position cap, shrunk once to what cash affords; costs
move prices against the order; money is integer micro-dollars; what is left at
the end is sold at the last close."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind

MICRO = 1_000_000


@dataclass(frozen=True)
class Costs:
    commission_per_share: float = 0.005
    min_commission: float = 1.0
    half_spread_bps: float = 2.5
    impact_coeff: float = 0.1
    pessimism_multiplier: float = 1.5

    def scaled(self, stress: float) -> "Friction":
        return Friction(self, self.pessimism_multiplier * stress)


@dataclass(frozen=True)
class Friction:
    costs: Costs
    scale: float

    def commission(self, qty: int) -> float:
        return max(self.costs.min_commission, self.costs.commission_per_share * qty) * self.scale if qty > 0 else 0.0

    def slip(self, qty: int, adv: float) -> float:
        return (self.costs.half_spread_bps / 1e4 + self.costs.impact_coeff * (qty / adv if adv > 0 else 0.0)) * self.scale


@dataclass(frozen=True)
class Sizing:
    risk_per_trade_pct: float = 0.5
    atr_period: int = 14
    atr_stop_mult: float = 3.0
    max_position_pct: float = 10.0


@dataclass(frozen=True)
class Account:
    initial_capital: float = 100_000.0
    costs: Costs = field(default_factory=Costs)
    sizing: Sizing = field(default_factory=Sizing)


@dataclass
class _Holding:
    qty: int
    price: float
    since: int
    stop: float
    fee: float
    slip: float
    lowest: float
    highest: float
    context: str
    bars: int = 0


@dataclass
class _Order:
    made: int
    wait: int
    buy: bool
    stop_distance: float
    adv: float
    context: str


def _micro(x: float) -> int:
    return int(round(x * MICRO))


@dataclass
class Tape:
    """Days x symbols; NaN and False where a symbol has no bar."""

    has: np.ndarray
    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    stop: np.ndarray  # stop distance of an order made after this bar
    adv: np.ndarray  # of the last bars, this one included
    adv_before: np.ndarray
    state: np.ndarray  # 1 long, 0 flat, -1 nothing
    context: np.ndarray


class Book:
    """One account's run over a tape."""

    def __init__(self, tape: Tape, symbols: list[str], account: Account, stress: float, delay: int):
        self.tape, self.symbols, self.account, self.friction, self.delay = tape, symbols, account, account.costs.scaled(stress), delay
        self.cash = self.worth = _micro(account.initial_capital)
        self.held: dict[int, _Holding] = {}
        self.orders: dict[int, _Order] = {}
        self.mark: dict[int, float] = {}
        self.trades: list[dict] = []
        self.signals = 0

    def sell(self, s: int, day: int, reference: float, reason: str) -> None:
        h = self.held.pop(s)
        adv = self.tape.adv_before[day, s]
        price = reference * (1.0 - self.friction.slip(h.qty, adv))
        fee = self.friction.commission(h.qty)
        self.cash += _micro(price) * h.qty - _micro(fee)
        self.trades.append({
            "symbol": self.symbols[s], "entry_idx": h.since, "entry_px": h.price, "exit_idx": day, "exit_px": price, "qty": h.qty,
            "fees": round(h.fee + fee, 6), "slippage": round(h.slip + (reference - price) * h.qty, 6), "pnl": round((price - h.price) * h.qty - h.fee - fee, 6),
            "mae": round(min(0.0, h.lowest / h.price - 1.0), 6), "mfe": round(max(0.0, h.highest / h.price - 1.0), 6), "holding_bars": h.bars, "exit_reason": reason, "context_json": h.context,
        })

    def buy(self, s: int, day: int, order: _Order) -> None:
        if not (np.isfinite(order.stop_distance) and order.stop_distance > 0):
            return
        worth, opened, sizing = self.worth / MICRO, float(self.tape.open[day, s]), self.account.sizing
        qty = max(0, min(int(worth * sizing.risk_per_trade_pct / 100.0 / order.stop_distance), int(worth * sizing.max_position_pct / 100.0 / opened)))
        for shrunk in (False, True):
            if not qty:
                return
            price, fee = opened * (1.0 + self.friction.slip(qty, order.adv)), self.friction.commission(qty)
            cost = _micro(price) * qty + _micro(fee)
            if cost <= self.cash:
                break
            if shrunk:
                return
            qty = max(0, min(qty, int((self.cash - _micro(fee)) / max(_micro(price), 1))))
        self.cash -= cost
        self.held[s] = _Holding(qty, price, day, price - order.stop_distance, fee, (price - opened) * qty, price, price, order.context)

    def open_of_day(self, day: int) -> None:
        for s, order in list(self.orders.items()):
            if day <= order.made + order.wait or not self.tape.has[day, s]:
                continue
            del self.orders[s]
            if order.buy:
                self.buy(s, day, order)
            elif s in self.held:
                self.sell(s, day, float(self.tape.open[day, s]), "signal")

    def stops(self, day: int) -> None:
        t = self.tape
        for s, h in list(self.held.items()):
            if t.has[day, s] and t.low[day, s] <= h.stop:
                self.sell(s, day, min(float(t.open[day, s]), h.stop), "stop")

    def close_of_day(self, day: int) -> float:
        """Marks what is held; gives what is invested as a share."""
        t, invested = self.tape, 0
        for s, h in self.held.items():
            if t.has[day, s]:
                h.lowest, h.highest, h.bars = min(h.lowest, float(t.low[day, s])), max(h.highest, float(t.high[day, s])), h.bars + 1
                self.mark[s] = float(t.close[day, s])
            invested += _micro(self.mark.get(s, h.price)) * h.qty
        self.worth = self.cash + invested
        return invested / self.worth if self.worth > 0 else 0.0

    def decide(self, day: int) -> None:
        t = self.tape
        for s in np.flatnonzero(t.state[day] >= 0):
            s = int(s)
            if s in self.orders:
                continue
            self.signals += 1
            if t.state[day, s] == 1 and s not in self.held:
                if np.isfinite(t.stop[day, s]) and t.stop[day, s] > 0:
                    self.orders[s] = _Order(day, self.delay, True, float(t.stop[day, s]), float(t.adv[day, s]), t.context[day, s])
            elif t.state[day, s] == 0 and s in self.held:
                self.orders[s] = _Order(day, 0, False, 0.0, 0.0, t.context[day, s])

    def run(self, first: int, last: int, decide_at_last: bool = False) -> list[tuple]:
        """(day, equity, cash, exposure) of days first..last. Before the first there are no orders, so nothing happens.

        decide_at_last: the window goes on after its last day with bars, so what is said on that day counts, though
        nothing is filled any more."""
        rows = []
        for day in range(first, last + 1):
            self.open_of_day(day)
            self.stops(day)
            share = self.close_of_day(day)
            rows.append((day, self.worth / MICRO, self.cash / MICRO, round(share, 6)))
            if day < last or decide_at_last:
                self.decide(day)
        if rows:
            for s in list(self.held):
                self.sell(s, last, self.mark.get(s, self.held[s].price), "end_of_data")
            rows[-1] = (last, self.cash / MICRO, self.cash / MICRO, 0.0)
        return rows


EQUITY = "array<struct<date:date,equity:double,cash:double,exposure:double>>"
TRADES = "array<struct<symbol:string,entry_ts:date,entry_px:double,exit_ts:date,exit_px:double,qty:bigint,fees:double,slippage:double,pnl:double,mae:double,mfe:double,holding_bars:int,exit_reason:string,context_json:string>>"
RESULT = f"scenario_id string, n_signals bigint, equity {EQUITY}, trades {TRADES}"
SCENARIO = "scenario_id string, params_key string, first date, last date, cost_mult double, delay int"


def tape_rows(bars: DataFrame, sizing: Sizing) -> DataFrame:
    """bars with stop_distance, adv_in, adv_ex: one window pass for each symbol."""
    ranged = bars.withColumn("tr", ind.true_range())
    return ranged.select(
        "symbol", "date", "open", "high", "low", "close",
        (ind.tail_atr("tr", sizing.atr_period) * sizing.atr_stop_mult).alias("stop_distance"), ind.adv().alias("adv_in"),
        ind.adv(including=False).alias("adv_ex")
    )


def scenarios(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """rows: scenario_id, params_key and, if other than the defaults, first, last (None: all days), cost_mult, delay."""
    return spark.createDataFrame(
        [(r["scenario_id"], r["params_key"], r.get("first"), r.get("last"), float(r.get("cost_mult", 1.0)), int(r.get("delay", 0))) for r in rows],
        SCENARIO
    )


PER_TASK = 6
_TAPE = ("symbol", "date", "open", "high", "low", "close", "stop_distance", "adv_in", "adv_ex")


def run(bars: DataFrame, signals: DataFrame, wanted: DataFrame, universe: list[str], account: Account) -> DataFrame:
    """A row of RESULT for each scenario of `wanted` (see SCENARIO).

    The calendar is that of all bars; the universe's symbols trade, in that order. Scenarios that share their signals
    and have neighbouring windows go to a task together, which gets the bars of these windows only."""
    universe = [s.upper() for s in universe]
    days = bars.groupBy("date").agg(F.lit(None).cast("string").alias("symbol"))
    rows = tape_rows(bars.filter(F.upper("symbol").isin(universe)), account.sizing).withColumn("symbol", F.upper("symbol"))
    tape = rows.unionByName(days, allowMissingColumns=True).select(*_TAPE)
    place = F.row_number().over(Window.partitionBy("params_key").orderBy("first", "last", "scenario_id"))
    grouped = wanted.withColumn("slot", F.floor((place - 1) / PER_TASK).cast("int"))
    # a slot's windows in months, so that bars are dealt to slots by an equi-join
    open_start, open_end = F.max(F.col("first").isNull().cast("int")) == 1, F.max(F.col("last").isNull().cast("int")) == 1
    span = days.agg(F.min("date").alias("from"), F.max("date").alias("until"))
    slots = grouped.groupBy("params_key", "slot").agg(
        F.when(~open_start, F.min("first")).alias("lo"), F.when(~open_end, F.max("last")).alias("hi")
    )
    slots = slots.join(F.broadcast(span)).select("params_key", "slot", F.coalesce("lo", "from").alias("lo"), F.coalesce("hi", "until").alias("hi"))
    month = lambda c: F.trunc(c, "month")
    each = F.explode(F.when(F.col("lo") <= F.col("hi"), F.sequence(month("lo"), month("hi"), F.expr("interval 1 month"))))
    months = slots.select("*", each.alias("month"))
    said = signals.select("params_key", F.upper("symbol").alias("symbol"), "date", "desired_state", "context")
    dealt = tape.withColumn("month", month("date")).join(months, "month").filter(F.col("date").between(F.col("lo"), F.col("hi")))
    dealt = dealt.select("params_key", "slot", *_TAPE).join(said, ["params_key", "symbol", "date"], "left")
    jobs = grouped.join(F.broadcast(span.select("until")))

    def work(jobs: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        return _run_group(jobs, frame, universe, account)

    keys = ["params_key", "slot"]
    dealt = dealt.toDF(*dealt.columns)  # names of their own: both sides come from `wanted`
    return jobs.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(work, RESULT)


def _run_group(jobs: pd.DataFrame, frame: pd.DataFrame, universe: list[str], account: Account) -> pd.DataFrame:
    days = np.sort(frame["date"].unique()) if len(frame) else np.zeros(0, object)
    where = {d: i for i, d in enumerate(days)}
    bars = frame[frame["symbol"].notna()]
    d, s = bars["date"].map(where).to_numpy(int), bars["symbol"].map({u: i for i, u in enumerate(universe)}).to_numpy(int)
    shape = (len(days), len(universe))

    def grid(name: str) -> np.ndarray:
        out = np.full(shape, np.nan)
        out[d, s] = bars[name].astype(float).to_numpy()
        return out

    has, state, context = np.zeros(shape, bool), np.full(shape, -1), np.full(shape, "{}", object)
    has[d, s] = True
    state[d, s] = bars["desired_state"].map({"long": 1, "flat": 0}).fillna(-1).astype(int).to_numpy()
    context[d, s] = bars["context"].fillna("{}").to_numpy()
    before = grid("adv_ex")
    # on a day without a bar the volume average is that of the bars before it
    filled = pd.DataFrame(np.where(has, grid("adv_in"), np.nan)).ffill().fillna(0.0).to_numpy()
    before = np.where(has, before, filled)
    tape = Tape(has, grid("open"), grid("high"), grid("low"), grid("close"), grid("stop_distance"), grid("adv_in"), before, state, context)
    out = []
    for job in jobs.sort_values("scenario_id").itertuples():
        first = int(np.searchsorted(days, job.first)) if job.first is not None else 0
        last = int(np.searchsorted(days, job.last, "right")) - 1 if job.last is not None else len(days) - 1
        book = Book(tape, universe, account, job.cost_mult, job.delay)
        # a window that ends on a day without bars, while later days have some
        goes_on = job.last is not None and last >= 0 and days[last] != job.last and days[last] < job.until
        equity = [{"date": days[k], "equity": e, "cash": c, "exposure": x} for k, e, c, x in book.run(first, last, goes_on)]
        trades = [{"entry_ts": days[t.pop("entry_idx")], "exit_ts": days[t.pop("exit_idx")], **t} for t in book.trades]
        out.append((job.scenario_id, book.signals, equity, trades))
    return pd.DataFrame(out, columns=["scenario_id", "n_signals", "equity", "trades"])


def equity_of(results: DataFrame) -> DataFrame:
    """scenario_id, date, equity, cash, exposure."""
    return results.select("scenario_id", F.inline("equity"))


def trades_of(results: DataFrame) -> DataFrame:
    return results.select("scenario_id", F.inline("trades"))
