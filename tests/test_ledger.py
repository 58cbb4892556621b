"""Hand-computed accounts: what is filled when, at what price and size."""

import pandas as pd
import pytest

from barloom.operators import ledger
from barloom.operators.strategies import scripted

BASE, HELD = (100.0, 101.0, 99.5, 100.0), (105.0, 106.0, 104.5, 105.0)
FREE = ledger.Costs(0.0, 0.0, 0.0, 0.0, 1.0)


def account(cap=10.0, costs=FREE):
    return ledger.Account(100_000.0, costs, ledger.Sizing(0.5, 2, 3.0, cap))


def days(n):
    return [d.date() for d in pd.bdate_range("2020-01-06", periods=n)]


def run(spark, specs, long_at=5, flat_at=None, delay=0, acc=None):
    d = days(len(specs))
    bars = spark.createDataFrame(
        [("SYM", x, *map(float, s), 1_000_000) for x, s in zip(d, specs)],
        "symbol string, date date, open double, high double, low double, close double, volume bigint"
    )
    script = [(d[long_at], "SYM", "long")] + ([(d[flat_at], "SYM", "flat")] if flat_at else [])
    got = ledger.run(bars, scripted(spark, script), ledger.scenarios(spark, [{"scenario_id": "x", "params_key": "script", "delay": delay}]), ["SYM"], acc or account()).collect()
    assert len(got) == 1
    return got[0], d


def test_fills_at_the_next_open_and_the_cap_binds(spark):
    r, d = run(spark, [BASE] * 6 + [HELD] * 9, flat_at=10)
    (t,) = r["trades"]
    assert (t["entry_ts"], t["exit_ts"], t["qty"], t["exit_reason"], t["holding_bars"]) == (d[6], d[11], 95, "signal", 5)
    assert t["entry_px"] == t["exit_px"] == 105.0 and t["pnl"] == 0.0 and r["n_signals"] == 2
    assert r["equity"][-1]["equity"] == 100_000.0


def test_risk_budget_binds(spark):
    r, _ = run(spark, [BASE] * 6 + [HELD] * 9, flat_at=10, acc=account(25.0))
    assert r["trades"][0]["qty"] == 111


@pytest.mark.parametrize(("bar", "price", "pnl"), [((105.0, 106.0, 100.0, 102.0), 100.5, -427.5), ((99.0, 105.0, 98.0, 100.0), 99.0, -570.0)])
def test_stops_fill_at_the_stop_or_a_lower_open(spark, bar, price, pnl):
    r, d = run(spark, [BASE] * 6 + [HELD] * 2 + [bar] + [HELD] * 6)
    (t,) = r["trades"]
    assert (t["exit_reason"], t["exit_ts"], t["exit_px"], t["pnl"]) == ("stop", d[8], price, pnl)
    assert r["equity"][-1]["equity"] == pytest.approx(100_000 + pnl)


def test_what_is_left_is_sold_at_the_end(spark):
    r, d = run(spark, [BASE] * 6 + [HELD] * 9)
    (t,) = r["trades"]
    assert (t["exit_reason"], t["exit_px"], t["exit_ts"]) == ("end_of_data", 105.0, d[-1])
    assert r["equity"][-1]["equity"] == r["equity"][-1]["cash"] and r["equity"][-1]["exposure"] == 0


def test_costs_reconcile(spark):
    r, _ = run(spark, [BASE] * 6 + [HELD] * 9, flat_at=10, acc=account(costs=ledger.Costs(0.01, 1.0, 10.0, 0.0, 2.0)))
    (t,) = r["trades"]
    assert t["fees"] > 0 and t["slippage"] > 0 and t["exit_px"] < 105 < t["entry_px"]
    assert t["pnl"] == pytest.approx((t["exit_px"] - t["entry_px"]) * t["qty"] - t["fees"])
    assert all(e["cash"] >= 0 for e in r["equity"])


def test_delay(spark):
    r, d = run(spark, [BASE] * 6 + [HELD] * 9, flat_at=12, delay=2)
    assert r["trades"][0]["entry_ts"] == d[8]


def test_equal_at_any_number_of_partitions(spark):
    got = []
    for n in ("1", "4", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(run(spark, [BASE] * 6 + [HELD] * 2 + [(105.0, 106.0, 100.0, 102.0)] + [HELD] * 6)[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]


def test_orders_are_shrunk_once_to_the_cash(spark):
    r, _ = run(spark, [BASE] * 6 + [HELD] * 9, flat_at=10, acc=ledger.Account(100_000.0, FREE, ledger.Sizing(50.0, 2, 3.0, 200.0)))
    (t,) = r["trades"]
    assert t["qty"] == 952 and min(e["cash"] for e in r["equity"]) == 100_000.0 - 952 * 105.0


def test_windows_cut_to_slots_change_nothing(spark, monkeypatch):
    """A scenario's result doesn't depend on who shares its task, nor on bars outside its window."""
    from barloom.operators.strategies import SmaCross, params_key
    from barloom.sources.synthetic import synthetic_bars

    bars = synthetic_bars(spark, ["SYN1", "SYN2"], 400, 5).persist()
    grid = [{"fast": 10, "slow": 50}, {"fast": 20, "slow": 50}]
    signals = SmaCross.signals(bars, grid)
    dates = [r["date"] for r in bars.select("date").distinct().orderBy("date").collect()]
    spans = [(None, None), (dates[60], dates[200]), (dates[61], None), (None, dates[300]), (dates[150], dates[399]), (dates[100], dates[90])]
    gap = next(a for a, b in zip(dates, dates[1:]) if (b - a).days > 1 and a > dates[120])
    spans.append((dates[80], gap.replace(day=gap.day) + __import__("datetime").timedelta(days=1)))  # ends on a day without bars
    wanted = [{"scenario_id": f"{i}/{k}", "params_key": params_key(c), "first": a, "last": z, "delay": i % 2} for i, (a, z) in enumerate(spans) for k, c in enumerate(grid)]
    got = []
    for size in (1, 6, 100):
        monkeypatch.setattr(ledger, "PER_TASK", size)
        rows = ledger.run(bars, signals, ledger.scenarios(spark, wanted), ["SYN1", "SYN2"], account()).collect()
        got.append({r["scenario_id"]: (r["n_signals"], r["equity"], r["trades"]) for r in rows})
    assert got[0] == got[1] == got[2] and len(got[0]) == len(wanted)
    assert got[0]["5/0"] == (0, [], []) and got[0]["1/0"][1][0]["date"] == dates[60] and got[0]["1/0"][1][-1]["date"] == dates[200]
    bars.unpersist()


def test_metrics_of_scenarios_equal_those_of_their_curves(spark):
    from barloom.operators import metrics
    from barloom.operators.strategies import SmaCross, params_key
    from barloom.sources.synthetic import synthetic_bars

    bars = synthetic_bars(spark, ["SYN1", "SYN2"], 400, 5)
    c = {"fast": 10, "slow": 50}
    wanted = ledger.scenarios(spark, [{"scenario_id": "a", "params_key": params_key(c)}, {"scenario_id": "b", "params_key": "nothing"}])
    got = ledger.run(bars, SmaCross.signals(bars, [c]), wanted, ["SYN1", "SYN2"], account(25.0)).persist()
    one = {r["scenario_id"]: r.asDict() for r in metrics.scenario_metrics(got, 1e5).collect()}
    two = {r["scenario_id"]: r.asDict() for r in metrics.curve_metrics(ledger.equity_of(got)).join(metrics.trade_stats(ledger.trades_of(got), 1e5, got), "scenario_id").collect()}
    assert one.keys() == two.keys() == {"a", "b"} and one["a"]["n_trades"] > 3 and one["b"]["n_trades"] == 0
    for s, values in one.items():
        assert values.keys() == two[s].keys()
        for k, v in values.items():
            assert v == (pytest.approx(two[s][k], rel=1e-9) if isinstance(v, float) else two[s][k]), (s, k)
    got.unpersist()
