"""Known values, and no sight of the future."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.operators.strategies import DipBuyer, RsiMeanReversion, SmaCross, TimeSeriesMomentum
from barloom.sources import bars as src
from barloom.sources.synthetic import regime_walk, synthetic_bars


def bars(spark, close):
    d = pd.bdate_range("2020-01-01", periods=len(close))
    return spark.createDataFrame([("S", a.date(), float(c), float(c) * 1.01, float(c) * 0.99, float(c), 1000 + i) for i, (a, c) in enumerate(zip(d, close))], src.BARS)


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_sma(spark):
    assert column(bars(spark, [1, 2, 3, 4, 5]).withColumn("x", ind.sma("close", 3)), "x") == [None, None, 2, 3, 4]
    with pytest.raises(ValueError):
        ind.sma("close", 0)


@pytest.mark.parametrize(("close", "want"), [(np.arange(1, 40), 100.0), (np.arange(40, 1, -1), 0.0), (np.full(40, 7.0), 50.0)])
def test_rsi_edges(spark, close, want):
    got = column(ind.recursive(bars(spark, close), rsi=(14,)), "rsi_14")
    assert got[:14] == [None] * 14 and got[14:] == pytest.approx([want] * len(got[14:]))


def test_recursions_match_a_loop(spark):
    close = 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 120)))
    got = ind.recursive(bars(spark, close), ema=(5,), atr=(14,)).orderBy("date").toPandas()
    e, want = close[0], [close[0]]
    for c in close[1:]:
        e += (c - e) / 3
        want.append(e)
    assert got["ema_5"].astype(float)[4:].to_numpy() == pytest.approx(want[4:]) and got["ema_5"][:4].isna().all()
    assert got["atr_14"][:14].isna().all() and got["atr_14"][14:].notna().all()


def test_adv_excludes_the_current_bar(spark):
    got = bars(spark, [1.0] * 30).withColumn("a", ind.adv()).withColumn("b", ind.adv(including=False)).orderBy("date").collect()
    assert got[0]["b"] == 0 and got[0]["a"] == 1000 and got[29]["a"] == pytest.approx(np.mean(range(1010, 1030))) and got[29]["b"] == pytest.approx(np.mean(range(1009, 1029)))


@pytest.mark.parametrize("cut", [230, 300, 350])
def test_the_past_does_not_change_with_the_future(spark, cut):
    base = 100 * np.exp(np.cumsum(np.random.default_rng(4).normal(0, 0.02, 400)))
    other = base.copy()
    other[cut:] *= np.exp(np.random.default_rng(cut).normal(0, 0.3, 400 - cut))
    both = []
    for close in (base, other):
        b = bars(spark, close)
        day = b.orderBy("date").collect()[cut]["date"]
        wide = ind.recursive(b.withColumn("tr", ind.true_range()).withColumn("r", ind.log_return()), ema=(10,), rsi=(14,), atr=(14,))
        wide = wide.select(
            "date", "ema_10", "rsi_14", "atr_14", ind.sma("close", 20).alias("sma"), ind.tail_atr("tr", 14).alias("tail"),
            ind.realized_vol("r").alias("vol"), ind.momentum(63, 21).alias("m"), ind.adv().alias("adv")
        )
        said = [s.signals(b, [s.grid()[0]]).filter(F.col("date") < day).orderBy("date").collect() for s in (SmaCross, RsiMeanReversion, TimeSeriesMomentum, DipBuyer)]
        both.append((wide.filter(F.col("date") < day).orderBy("date").collect(), said))
    assert both[0] == both[1]


def test_momentum_turns_long_in_a_trend(spark):
    close = np.concatenate([np.full(300, 100.0), 100 * 1.002 ** np.arange(1, 401)])
    rows = TimeSeriesMomentum.signals(bars(spark, close), [{"lookback": 63, "skip": 0}]).orderBy("date").collect()
    assert rows[0]["desired_state"] == "flat" and rows[-1]["desired_state"] == "long"


def test_vendor_payloads(spark):
    rows = [
        {
            "date": f"2024-01-0{2 + i}T00:00:00.000Z", "open": 1, "close": 1, "adjOpen": 100 + i, "adjHigh": 101 + i, "adjLow": 99 + i,
            "adjClose": 100.5 + i, "adjVolume": 1_000_000 + i
        }
        for i in range(5)
    ]
    got = src.tiingo_bars(spark, "aapl", rows).orderBy("date").collect()
    assert len(got) == 5 and got[0]["symbol"] == "AAPL" and got[0]["close"] == 100.5 and str(got[0]["date"]) == "2024-01-02" and got[4]["volume"] == 1_000_004
    for bad in ([], [{k: v for k, v in rows[0].items() if k != "adjClose"}]):
        with pytest.raises(ValueError):
            src.tiingo_bars(spark, "aapl", bad)
    with pytest.raises(ValueError):
        src.stooq_bars(spark, "aapl", "<html>No data</html>")
    text = "Date, Open,High,Low,Close,Volume\n2024-01-03,1,2,0.5,1.5,10\n2024-01-02,1,2,0.5,1.25,20\n2024-01-02,9,9,9,9,9\n"
    got = src.stooq_bars(spark, "aapl", text).orderBy("date").collect()
    assert [(r["close"], r["volume"]) for r in got] == [(1.25, 20), (1.5, 10)]
    with pytest.raises(Exception, match="a bar without"):
        src.csv_text(spark, "date,open,high,low,close,volume\n2024-01-03,,2,0.5,1.5,10\n", "x").collect()
    with pytest.raises(ValueError, match="bars lack"):
        src.csv_text(spark, "date,open\n2024-01-03,1\n", "x")


def test_synthetic_bars(spark):
    a = synthetic_bars(spark, ["one", "two"], 300).orderBy("symbol", "date").collect()
    assert len(a) == 600 and a == synthetic_bars(spark, ["one", "two"], 300).orderBy("symbol", "date").collect()
    f = regime_walk(500, 42)
    assert (f.low <= f[["open", "close"]].min(axis=1)).all() and (f.high >= f[["open", "close"]].max(axis=1)).all()
