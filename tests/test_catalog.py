"""The catalogue, the store, the command line and both control experiments."""

import numpy as np
import pandas as pd
import pytest

from barloom import cli
from barloom.plans import experiment, report, store
from barloom.plans.catalog import Catalog, SimilarFailures
from barloom.plans.config import DEFAULTS, Workspace, load
from barloom.operators import quality
from barloom.sources.bars import BARS
from barloom.sources.synthetic import synthetic_bars

SMALL = {
    "global.yaml": "timezone: UTC\nroot_seed: 777\n",
    "data.yaml": "frequency: daily\nbenchmark_symbol: BENCH\nuniverse: [SYN1, SYN2]\nvalidation: {max_consecutive_gap_days: 5, spike_zscore: 8.0, min_avg_volume: 10000, min_bars: 300}\n",
    "validation.yaml": DEFAULTS["validation.yaml"].replace("756", "350").replace("126", "150").replace("2000", "200").replace("[1.0, 1.5, 2.0, 3.0]", "[1.0, 1.5, 2.0]").replace("perturbation_samples: 8", "perturbation_samples: 4"),
    "strategies/random_walk@1.yaml": "name: random_walk\nversion: 1\nuniverse: [SYN1, SYN2]\nparams: {p: 1}\n",
    "strategies/dip_buyer@1.yaml": "name: dip_buyer\nversion: 1\nuniverse: [OU1, OU2, OU3, OU4]\nparams: {sma_n: 20, entry_k: 4}\n",
}
TEXTS = ("momentum persists in equities", "slow information diffusion", "s", "f")


@pytest.fixture
def catalog(spark, tmp_path):
    at = Workspace(tmp_path)
    (tmp_path / "configs/strategies").mkdir(parents=True)
    for name, text in SMALL.items():
        (at.configs / name).write_text(text)
    c = Catalog(spark, at.create())
    c.audit("system", "workspace.init", {})
    return c


def snapshot_row(c, key="snap0001"):
    c.append("snapshots", [{"snapshot_id": key, "created_at": "now", "description": "test", "frequency": "daily", "manifest_json": "{}"}])


def test_config(catalog):
    a = load(catalog.at.configs, "sma_cross", 1)
    assert a.digest() == load(catalog.at.configs, "sma_cross", 1).digest() and len(a.digest()) == 64
    for name, old, new in [
        ("backtest.yaml", "pessimism_multiplier: 1.5", "pessimism_multiplier: 0.8"),
        ("backtest.yaml", "allow_short: false", "allow_short: true"),
        ("backtest.yaml", "risk_per_trade_pct: 0.5", "risk_per_trade_pct: 5.0"), ("global.yaml", "timezone: UTC", "timezone: UTC\nx: 1"),
        ("validation.yaml", "[1.0, 1.5, 2.0]", "[0.5]")
    ]:
        f = catalog.at.configs / name
        text = f.read_text()
        assert old in text
        f.write_text(text.replace(old, new))
        with pytest.raises(ValueError):
            load(catalog.at.configs, "sma_cross", 1)
        f.write_text(text)
    with pytest.raises(FileNotFoundError):
        load(catalog.at.configs, "nothing", 1)


def test_hypotheses_experiments_and_similar_failures(catalog):
    c = catalog
    snapshot_row(c)
    with pytest.raises(ValueError):
        c.register_hypothesis("trend", " ", *TEXTS[1:])
    with pytest.raises(ValueError):
        c.add_journal("me", "  ")
    with pytest.raises(KeyError):
        c.register_experiment(1, "sma_cross", 1, "snap0001", "SPY")
    h = c.register_hypothesis("trend", *TEXTS)
    e, similar = c.register_experiment(h, "sma_cross", 1, "snap0001", "SPY")
    assert (e, similar) == (1, [])
    c.mark_running(e)
    c.finalize(e, "fail", "failed OOS")
    with pytest.raises(PermissionError):
        c.finalize(e, "pass", "on second thought")
    with pytest.raises(KeyError):
        c.mark_running(2)
    with pytest.raises(ValueError):
        c.append("experiment_events", [{"experiment_id": 1, "seq": 9, "status": "done"}])
    with pytest.raises(SimilarFailures) as why:
        c.register_experiment(h, "sma_cross", 1, "snap0001", "SPY")
    assert why.value.similar[0]["reason"].startswith("of the same family") and "1 of hypothesis" in str(why.value)
    other = c.register_hypothesis("other-family", "equities momentum strategies persist", "information diffusion is slow", "s", "f")
    with pytest.raises(SimilarFailures) as why:
        c.register_experiment(other, "tsmom", 1, "snap0001", "SPY")
    assert why.value.similar[0]["reason"].startswith("with a similar text")
    with pytest.raises(KeyError):
        c.register_experiment(other, "tsmom", 1, "snap0001", "SPY", 99)
    note = c.add_journal("me", "read and understood")
    e2, similar = c.register_experiment(other, "tsmom", 1, "snap0001", "SPY", note)
    assert e2 == 2 and len(similar) == 1
    unlike = c.register_hypothesis("third", "volatility clusters", "inventory", "s", "f")
    assert c.register_experiment(unlike, "tsmom", 1, "snap0001", "SPY")[1] == []
    assert {r["experiment_id"]: r["status"] for r in c.experiments().collect()} == {1: "complete", 2: "registered", 3: "registered"}


def test_family_totals(catalog):
    c = catalog
    snapshot_row(c)
    h = c.register_hypothesis("trend", *TEXTS)
    e, _ = c.register_experiment(h, "sma_cross", 1, "snap0001", "SPY")
    rid = c.record_run(e, "walkforward", "h", "sha", True, 0, "1", "now", None)
    c.record_metrics(rid, {"n_trials": 36.0, "sharpe": float("nan")}, "oos")
    assert c.family_total("trend", "n_trials") == 36 and c.family_total("trend", "n_trials", exclude=e) == 0 and c.family_total("none", "n_trials") == 0
    assert {r["metric"]: r["value"] for r in c.table("run_metrics").collect()} == {"n_trials": 36.0, "sharpe": None}
    assert c.table("runs").first()["promotable"] is False
    with pytest.raises(ValueError):
        c.record_run(e, "guess", "h", "sha", True, 0, "1", "now", None)


def test_audit_chain(catalog):
    c = catalog
    for k in range(3):
        c.audit("human", "x", {"k": k})
    assert c.verify()[0]
    rows = c.table("audit_log").orderBy("seq").collect()
    forged = [r.asDict() | ({"payload_json": "{}"} if r["seq"] == 2 else {}) for r in rows]
    import shutil

    shutil.rmtree(c.at.catalog / "audit_log")
    c.append("audit_log", forged)
    assert c.verify() == (False, "entry 2 of the log was changed")
    shutil.rmtree(c.at.catalog / "audit_log")
    c.append("audit_log", [r.asDict() for r in rows if r["seq"] != 2])
    assert c.verify() == (False, "entry 3 of the log doesn't follow the one before it")


def test_versions(catalog, monkeypatch):
    from barloom.plans import catalog as module

    catalog.migrate()
    catalog.migrate()
    assert catalog.table("schema_migrations").count() == 1
    monkeypatch.setitem(module.TABLES, "journal_entries", module.TABLES["journal_entries"] + ", more string")
    with pytest.raises(RuntimeError, match="has changed"):
        catalog.migrate()
    monkeypatch.setattr(module, "VERSION", 2)
    catalog.migrate()
    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="is of version 2"):
        catalog.migrate()


def test_store_and_snapshots(catalog, spark):
    c = catalog
    bars = synthetic_bars(spark, ["SYN1", "SYN2", "BENCH"], 400, 777)
    assert all(store.admit(c, bars, quality.Limits(), "synthetic", "BENCH").values())
    assert not any(store.admit(c, synthetic_bars(spark, ["TINY"], 100, 777), quality.Limits(), "synthetic", "BENCH").values())
    with pytest.raises(FileNotFoundError):
        store.load_curated(c, ["TINY"])
    assert store.load_curated(c, ["syn1"]).count() == 400
    a = store.create_snapshot(c, ["syn1", "bench"], "first")
    assert a == store.create_snapshot(c, ["BENCH", "SYN1"], "again") and c.table("snapshots").count() == 1
    assert store.load_snapshot(c, a).count() == 800
    with pytest.raises(KeyError):
        store.load_snapshot(c, "nothing")
    kept = {r["symbol"]: r["is_benchmark"] for r in c.instruments().collect()}
    assert kept == {"SYN1": False, "SYN2": False, "BENCH": True}
    store.write_curated(c, synthetic_bars(spark, ["SYN2"], 350, 1))
    assert store.load_curated(c, ["SYN1", "SYN2"]).groupBy("symbol").count().collect().__len__() == 2 and store.load_snapshot(c, a).count() == 800
    import shutil

    shutil.rmtree(c.at.snapshots / a / "symbol=SYN1")
    with pytest.raises(RuntimeError, match="other hashes"):
        store.load_snapshot(c, a)


def frame_of(spark, frames):
    rows = [f.assign(symbol=s) for s, f in frames.items()]
    both = pd.concat(rows)
    both["date"] = both["date"].dt.date
    return spark.createDataFrame(both[["symbol", "date", "open", "high", "low", "close", "volume"]], BARS)


def reverting(n, seed, theta=0.07, sigma=0.02):
    rng = np.random.default_rng(seed)
    level = 4.6 + 0.0002 * np.arange(1, n + 1)
    x, shocks = [level[0]], sigma * rng.standard_normal(n - 1)
    for mean, shock in zip(level[1:], shocks):
        x.append(x[-1] + theta * (mean - x[-1]) + shock)
    close = np.exp(x)
    opened = np.concatenate([close[:1], close[:-1] * (1 + sigma * 0.3 * rng.standard_normal(n - 1))])
    span = np.abs(sigma * rng.standard_normal(n)) * close / 2
    f = pd.DataFrame(
        {"date": pd.bdate_range("2005-01-03", periods=n), "open": opened, "high": np.maximum(opened, close) + span, "low": np.minimum(opened, close) - span, "close": close}
    )
    return f.round(4).assign(volume=rng.integers(1_000_000, 3_000_000, n))


def test_positive_control_passes(catalog, spark):
    """A real, regime-independent edge is accepted."""
    n, rng = 2600, np.random.default_rng(200)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.01, n)))
    bench = pd.DataFrame(
        {"date": pd.bdate_range("2005-01-03", periods=n), "open": close, "high": close * 1.003, "low": close * 0.997, "close": close}
    ).round(4).assign(volume=rng.integers(1_000_000, 3_000_000, n))
    frames = {f"OU{i}": reverting(n, 100 + i) for i in range(1, 5)} | {"BENCH": bench}
    store.write_curated(catalog, frame_of(spark, frames))
    key = store.create_snapshot(catalog, list(frames), "positive control")
    h = catalog.register_hypothesis("positive-control", "buying dips on reverting series pays", "engineered reversion", "passes", "fails")
    got = experiment.run(catalog, h, "dip_buyer", 1, key)
    assert got["verdict"] == "pass", got["reasons"]


def test_negative_control_fails_and_is_reported(catalog, spark, capsys):
    """Noise is rejected; the whole way by the command line."""
    root = ["--root", str(catalog.at.root)]
    run = lambda *a: cli.main([*root, *a], spark)
    assert run("data", "synth", "-s", "SYN1", "-s", "SYN2", "-s", "BENCH", "--bars", "1200", "--trend", "0.0") == 0
    assert run("data", "validate", "-s", "SYN1") == 0
    assert run("data", "snapshot", "-s", "SYN1", "-s", "SYN2", "-s", "BENCH", "-m", "noise") == 0
    key = catalog.table("snapshots").first()["snapshot_id"]
    assert run("hypothesis", "new", "--family", "noise", "--statement", "coin flips predict", "--mechanism", "none", "--success", "pass", "--falsification", "fail") == 0
    assert run("experiment", "run", "--hypothesis", "1", "--strategy", "random_walk", "--snapshot", key) == 0
    assert "FAIL" in capsys.readouterr().out
    assert run("experiment", "run", "--hypothesis", "1", "--strategy", "random_walk", "--snapshot", key) == 2
    assert run("journal", "add", "seen") == 0 and run("journal", "list") == 0
    assert run("report", "build", "1") == 0
    page = (catalog.at.artifacts / "E1" / "report.html").read_text()
    assert "SYNTHETIC DATA" in page and "<svg" in page and "min_oos_trades" in page and "n/a" in page
    assert run("vault", "experiments") == 0 and run("vault", "hypotheses") == 0 and run("vault", "show", "1") == 0 and run("vault", "show", "9") == 1
    assert run("data", "snapshots") == 0 and run("audit", "verify") == 0
    assert catalog.table("mc_simulations").count() == 5
    with pytest.raises(KeyError):
        report.build(catalog, 5)


def test_commands_need_a_workspace(spark, tmp_path):
    assert cli.main(["--root", str(tmp_path), "journal", "list"], spark) == 1
    assert cli.main(["--root", str(tmp_path), "init"], spark) == 0
    assert (tmp_path / "configs/strategies/tsmom@1.yaml").exists()
    f = tmp_path / "x.csv"
    f.write_text("date,open,high,low,close,volume\n2024-01-02,1,1,1,1,1\n")
    assert cli.main(["--root", str(tmp_path), "data", "import-csv", str(f), "--symbol", "abc"], spark) == 0
    assert (tmp_path / "datastore/raw/csv/ABC.csv").exists()
