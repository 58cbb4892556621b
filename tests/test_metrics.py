import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, regimes, validation
from barloom.operators.strategies import Strategy, SmaCross, create, get_class, params_key, register

TRADE = "scenario_id string, symbol string, entry_ts date, exit_ts date, pnl double, fees double, slippage double, holding_bars int"


def curve(spark, values):
    d = pd.bdate_range("2020-01-01", periods=len(values))
    return spark.createDataFrame([("x", a.date(), float(b)) for a, b in zip(d, values)], "scenario_id string, date date, equity double")


def trades(spark, pnls):
    d = pd.bdate_range("2020-01-01", periods=len(pnls) + 1)
    return spark.createDataFrame([("x", "S", d[0].date(), d[i + 1].date(), float(p), 0.0, 0.0, 2) for i, p in enumerate(pnls)], TRADE)


def test_drawdown(spark):
    r = metrics.underwater(curve(spark, [100, 110, 99, 121])).first()
    assert r["max_drawdown"] == pytest.approx(-0.10) and r["longest_underwater_bars"] == 1


def test_cagr_of_a_year(spark):
    r = metrics.curve_metrics(curve(spark, np.linspace(100, 200, 252))).first()
    assert r["cagr"] == pytest.approx(1.0) and r["total_return"] == pytest.approx(1.0) and r["n_bars"] == 252


def test_undefined_is_null(spark):
    r = metrics.curve_metrics(curve(spark, [100.0])).first()
    assert r["sharpe"] is None and r["total_return"] is None and r["cagr"] is None
    r = metrics.curve_metrics(curve(spark, [100.0] * 50)).first()
    assert r["sharpe"] is None and r["sortino"] is None and r["max_drawdown"] == 0


def test_trade_stats(spark):
    r = metrics.trade_stats(trades(spark, [10, 20, -5]), 1000.0).first()
    assert r["win_rate"] == pytest.approx(2 / 3) and r["profit_factor"] == pytest.approx(6) and r["expectancy_usd"] == pytest.approx(25 / 3) and r["longest_losing_streak"] == 1
    keys = spark.createDataFrame([("x",), ("y",)], "scenario_id string")
    empty = metrics.trade_stats(trades(spark, [1]), 1000.0, keys).filter("scenario_id = 'y'").first()
    assert empty["n_trades"] == 0 and empty["win_rate"] is None and empty["total_fees_usd"] == 0


def test_losing_streak(spark):
    assert metrics.losing_streaks(trades(spark, [5, -1, -1, -1, 5])).first()["longest_losing_streak"] == 3


def test_losing_streaks_are_folded_in_ranges(spark):
    rng = np.random.default_rng(4)
    day = pd.Timestamp("2020-01-01").date()
    rows = [(k, f"{i:05d}", day, day, float(p), 0.0, 0.0, 2) for k, m in ((None, 40), ("a", 3000), ("b", 1), ("c", 2000)) for i, p in enumerate(rng.choice([-1, -1, -1, 0, 1], m))]  # all end on one day
    rows += [("d", f"{i:05d}", day, day, -1.0, 0.0, 0.0, 2) for i in range(3000)] + [("e", "x", day, day, None, 0.0, 0.0, 2)]
    want, runs = {}, {}
    for k, *_, pnl, _, _, _ in rows:
        runs[k] = runs.get(k, 0) + 1 if pnl is not None and pnl < 0 else 0
        want[k] = max(want.get(k, 0), runs[k])
    some = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], TRADE)
    df = metrics.losing_streaks(some)
    assert {r["scenario_id"]: r["longest_losing_streak"] for r in df.collect()} == want and want["d"] == 3000
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()  # which would sort each scenario in one task
    for n, size in (("1", "10000"), ("13", "7")):  # stretches that go over ranges and batches
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r["scenario_id"]: r["longest_losing_streak"] for r in metrics.losing_streaks(some).collect()}
        for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want
    assert metrics.losing_streaks(some.limit(0)).count() == 0


def test_losing_streak_of_rows_that_stand_for_many(spark):
    some = trades(spark, [5, -1, -1, 2, -1]).withColumn("n", F.when(F.col("pnl") == 2, 9).otherwise(F.col("pnl") + 3))
    assert metrics.losing_streaks(some, often="n").first()["longest_losing_streak"] == 4


def test_against_itself(spark):
    rng = np.random.default_rng(9)
    d = pd.bdate_range("2020-01-01", periods=300)
    own = spark.createDataFrame([("x", a.date(), float(b)) for a, b in zip(d, rng.normal(0.0005, 0.01, 300))], "scenario_id string, date date, r double")
    r = metrics.compare(own, own.select("date", F.col("r").alias("b"))).first()
    assert r["beta"] == pytest.approx(1) and r["alpha_ann"] == pytest.approx(0, abs=1e-9) and r["correlation"] == pytest.approx(1) and r["information_ratio"] is None
    assert metrics.compare(own.limit(10), own.select("date", F.col("r").alias("b"))).first()["beta"] is None


def test_folds(spark):
    d = pd.bdate_range("2010-01-01", periods=1000)
    days = spark.createDataFrame([(a.date(), i) for i, a in enumerate(d)], "date date, idx int")
    got = validation.folds(days, 300, 100, 50).orderBy("fold").collect()
    at = {a.date(): i for i, a in enumerate(d)}
    assert [(at[r["train_start"]], at[r["train_end"]], at[r["test_start"]], at[r["test_end"]]) for r in got] == [(k, k + 299, k + 350, k + 449) for k in range(0, 551, 100)]
    assert validation.folds(days, 900, 100, 50).count() == 0


def test_bootstraps(spark):
    rng = np.random.default_rng(123)
    pnls = rng.normal(20, 100, 80).tolist()
    a, b = (validation.trade_bootstrap(spark, pnls, 100_000.0, 200, 7, 15.0) for _ in range(2))
    assert a == b and a["dd_p99"] <= a["dd_p95"] <= a["dd_p50"] <= 0 and a != validation.trade_bootstrap(spark, pnls, 100_000.0, 200, 8, 15.0)
    assert validation.trade_bootstrap(spark, [], 1.0, 100, 7, 15.0) == {"error": "no trades"}
    blocks = validation.block_bootstrap(spark, rng.normal(0.0004, 0.012, 400).tolist(), 200, 7, 15.0)
    assert blocks["block_len"] == 20 and blocks["dd_p99"] <= blocks["dd_p50"]
    assert "error" in validation.block_bootstrap(spark, [0.01] * 10, 100, 7, 15.0)


def test_bootstrap_of_repeated_amounts_and_in_parts(spark, monkeypatch):
    pnls, often = [-300.0, 50.0, 125.0], [20, 70, 35]
    whole = validation.trade_bootstrap(spark, np.repeat(pnls, often).tolist(), 100_000.0, 200, 7, 15.0)
    assert validation.trade_bootstrap(spark, pnls, 100_000.0, 200, 7, 15.0, often) == whole
    monkeypatch.setattr(validation, "DRAWS", 32)
    one = np.random.default_rng(validation.derive_seed(7, "path", "0"))
    drawn = np.concatenate([one.integers(0, 125, min(32, 125 - at)) for at in range(0, 125, 32)])
    path = np.concatenate(([100_000.0], 100_000.0 + np.cumsum(np.repeat(pnls, often)[drawn])))
    got = validation.trade_bootstrap(spark, pnls, 100_000.0, 1, 7, 15.0, often)
    assert got["final_equity_p50"] == pytest.approx(path[-1]) and got["dd_p50"] == pytest.approx((path / np.maximum.accumulate(path) - 1).min())


def test_drawn_trades_are_found_in_a_table(monkeypatch):
    rng = np.random.default_rng(3)
    for cells in (1, 2, 8, 64, 1 << 25):
        monkeypatch.setattr(validation, "CELLS", cells)
        for often in ([1], [5], [1] * 100, [70, 1, 1, 1, 90, 2], rng.integers(1, 50, 300)):
            ends = np.cumsum(often)
            drawn = rng.permutation(np.arange(ends[-1]))
            assert (validation._finder(ends)(drawn) == np.searchsorted(ends, drawn, "right")).all()


def test_bootstrap_of_more_trades_than_cells(spark, monkeypatch):
    pnls, often = [-300.0, 50.0, 125.0], [20, 70, 35]
    whole = validation.trade_bootstrap(spark, np.repeat(pnls, often).tolist(), 100_000.0, 20, 7, 15.0)
    monkeypatch.setattr(validation, "CELLS", 16)
    assert validation.trade_bootstrap(spark, pnls, 100_000.0, 20, 7, 15.0, often) == whole


def test_deflated_sharpe(spark):
    x = np.random.default_rng(5).standard_t(5, 500) * 0.01 + 0.0008
    r = spark.createDataFrame([(float(v),) for v in x], "r double")
    m, s = validation.moments(r).first(), pd.Series(x)
    assert m["skew"] == pytest.approx(s.skew()) and m["kurt"] == pytest.approx(s.kurtosis())
    one, many = validation.deflated_sharpe(r, 1, [1.0, 0.2, -0.5]), validation.deflated_sharpe(r, 100, [1.0, 0.2, -0.5])
    assert 0 <= many < one <= 1
    assert validation.deflated_sharpe(r.limit(20), 1, []) is None


def test_gates():
    good = validation.Evidence(50, 10.0, 1.0, 0.8, 0.99, 3.0, (0.1,), (50.0, 60.0, 40.0), 0.9, -0.05, 2)
    found = validation.gates(good)
    assert len(found) == 10 and validation.verdict(found) == ("pass", [])
    assert validation.weaknesses(found, good)[0].startswith("Nothing failed")
    verdict, reasons = validation.verdict(validation.gates(validation.Evidence()))
    assert verdict == "fail" and len(reasons) >= 8
    assert len(validation.gates(good, validation.GateLimits(require_delay_survival=False))) == 9


def test_regimes(spark):
    up = [(("B"), d.date(), float(c)) for d, c in zip(pd.bdate_range("2020-01-01", periods=300), 100 + np.cumsum(np.random.default_rng(1).normal(0, 1, 300)))]
    bars = spark.createDataFrame(up, "symbol string, date date, close double")
    got = {r["label"]: r["count"] for r in regimes.label(bars).groupBy("label").count().collect()}
    assert set(got) == {"down", "flat", "up"} and abs(got["down"] - got["up"]) <= 2
    assert {r["label"] for r in regimes.label(bars.limit(80)).collect()} == {"flat"}


def test_strategies():
    assert len(SmaCross.grid()) == 9 and len(get_class("rsi_meanrev").grid()) == 27 and len(get_class("tsmom").grid()) == 6
    for bad in ({"fast": 20}, {"fast": 20, "slow": 100, "x": 1}, {"fast": 11, "slow": 100}):
        with pytest.raises(ValueError):
            create("sma_cross", 1, bad)
    with pytest.raises(KeyError):
        get_class("nothing", 1)
    with pytest.raises(ValueError):

        @register
        class Other(Strategy):
            name = "sma_cross"

    assert validation.neighbours(SmaCross.grid(), {"fast": 20, "slow": 100}) == [
        {"fast": 10, "slow": 100}, {"fast": 20, "slow": 50}, {"fast": 20, "slow": 200}, {"fast": 30, "slow": 100}
    ]
    assert params_key({"b": 1, "a": 2}) == '{"a":2,"b":1}'
