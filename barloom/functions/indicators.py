"""Indicators over bars: columns of window expressions, all of whose frames end at the current row.

What is undefined (warm-up, division by zero) is NULL. Recurrences without end
(EMA, Wilder's averages) have no window form; they are computed for each symbol
by recursive(), which gives all of them in one pass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def last(n: int):
    """The current bar and the n - 1 before it."""
    if n < 1:
        raise ValueError("period must be >= 1")
    return by_symbol().rowsBetween(-(n - 1), 0)


def _full(value: Column, of: Column | str, n: int) -> Column:
    return F.when(F.count(of).over(last(n)) == n, value)


def sma(x: str, n: int) -> Column:
    return _full(F.avg(x).over(last(n)), x, n)


def log_return(close: str = "close") -> Column:
    return F.ln(F.col(close)) - F.ln(F.lag(close).over(by_symbol()))


def realized_vol(returns: str, n: int = 20, annualise: bool = True) -> Column:
    """Of a column of log returns."""
    return _full(F.stddev_samp(returns).over(last(n)), returns, n) * (YEAR**0.5 if annualise else 1.0)


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def adv(n: int = 20, including: bool = True) -> Column:
    """Mean volume of up to n bars, with or without the current one; 0 where there is none."""
    frame = last(n) if including else by_symbol().rowsBetween(-n, -1)
    return F.coalesce(F.avg("volume").over(frame), F.lit(0.0))


def tail_atr(tr: str, n: int) -> Column:
    """Wilder's average over the last n true ranges only, seeded at the oldest of them: what orders are sized with."""
    ranges = F.collect_list(tr).over(last(n))
    folded = F.aggregate(F.slice(ranges, 2, n), F.element_at(ranges, 1), lambda a, x: a + (x - a) / n)
    return F.when(F.size(ranges) == n, folded)


def momentum(lookback: int, skip: int) -> Column:
    w = by_symbol()
    return F.try_divide(F.lag("close", skip).over(w), F.lag("close", skip + lookback).over(w)) - 1


def bar_number() -> Column:
    return F.row_number().over(by_symbol())


def _wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def _rsi(close: pd.Series, n: int) -> pd.Series:
    step = close.diff()
    up, down = _wilder(step.clip(lower=0), n), _wilder((-step).clip(lower=0), n)
    both = up + down
    # 100 up / (up + down) is the usual form without its division by an average loss of zero
    return (100 * up / both.where(both > 0)).where(~((both == 0) & up.notna()), 50.0)


def recursive(bars: DataFrame, ema: tuple[int, ...] = (), rsi: tuple[int, ...] = (), atr: tuple[int, ...] = ()) -> DataFrame:
    """bars with ema_<n> of closes, rsi_<n> and atr_<n>.

    A symbol's history is one group: some thousand daily bars, however many symbols there are."""
    if any(n < 1 for n in (*ema, *rsi, *atr)):
        raise ValueError("period must be >= 1")
    names = [f"{k}_{n}" for k, ns in (("ema", ema), ("rsi", rsi), ("atr", atr)) for n in ns]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", kind="stable")
        close = frame["close"]
        for n in ema:
            frame[f"ema_{n}"] = close.ewm(span=n, adjust=False, min_periods=n).mean()
        for n in rsi:
            frame[f"rsi_{n}"] = _rsi(close, n)
        if atr:
            before = close.shift()
            tr = pd.concat([frame["high"] - frame["low"], (frame["high"] - before).abs(), (frame["low"] - before).abs()], axis=1).max(axis=1).where(before.notna())
            for n in atr:
                frame[f"atr_{n}"] = _wilder(tr, n)
        return frame.astype({n: "Float64" for n in names})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", {n} double" for n in names)
    return bars.groupBy("symbol").applyInPandas(work, schema)
