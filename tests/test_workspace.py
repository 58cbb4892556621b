"""Settings, secrets, logs, sealed tables, steps between versions, and what was known on a day."""

import logging
import os
import stat
import subprocess
from datetime import date

import pytest

from barloom.operators import history, metrics, search
from barloom.operators.strategies import SmaCross
from barloom.plans import catalog as module
from barloom.plans import config, store
from barloom.plans.catalog import Catalog
from barloom.plans.config import RULES, Workspace, judged, load, load_secrets, logger, section


@pytest.fixture
def at(tmp_path):
    return Workspace(tmp_path).create()


def test_shipped_settings(at):
    s = load(at.configs, "sma_cross", 1)
    assert s.general.timezone == "UTC" and s.validation.walkforward.embargo_bars == "auto" and s.strategy.params.plain() == {"fast": 20, "slow": 100}
    assert config.account(s.backtest).sizing.max_position_pct == 10.0 and set(s) == set(RULES)
    with pytest.raises(TypeError):
        s.general.timezone = "CET"
    with pytest.raises(AttributeError):
        s.general.nothing


def test_every_rule_refuses():
    good = {"initial_capital": 1.0, "fill_policy": "next_bar_open", "cash_account": True, "allow_short": False,
            "costs": {"commission_per_share": 0, "min_commission": 0, "half_spread_bps": 0, "impact_coeff": 0, "pessimism_multiplier": 1},
            "sizing": {"risk_per_trade_pct": 2, "atr_period": 2, "atr_stop_mult": 1, "max_position_pct": 25}}
    assert judged("backtest", good).sizing.risk_per_trade_pct == 2.0
    for table, name, bad in (("costs", "pessimism_multiplier", 0.99), ("costs", "impact_coeff", -1), ("sizing", "risk_per_trade_pct", 2.01), ("sizing", "risk_per_trade_pct", 0), ("sizing", "atr_period", 2.5),
                             ("sizing", "atr_period", True), ("sizing", "max_position_pct", "10"), ("costs", "more", 1), ("sizing", "atr_stop_mult", float("nan"))):
        with pytest.raises(ValueError, match=name):
            judged("backtest", good | {table: good[table] | {name: bad}})
    with pytest.raises(ValueError) as told:  # all that is wrong at once
        judged("backtest", {k: v for k, v in good.items() if k != "initial_capital"} | {"allow_short": True, "cash_account": None})
    assert all(x in str(told.value) for x in ("initial_capital is missing", "allow_short", "cash_account"))
    with pytest.raises(ValueError):
        judged("general", ["no table"])


def test_multipliers_rise_and_never_understate(at):
    text = (at.configs / "validation.yaml").read_text()
    (at.configs / "validation.yaml").write_text(text.replace("[1.0, 1.5, 2.0, 3.0]", "[3, 1.0, 2]"))
    assert section(at.configs, "validation").montecarlo.cost_stress_multipliers == [1.0, 2.0, 3.0]
    (at.configs / "validation.yaml").write_text(text.replace("[1.0, 1.5, 2.0, 3.0]", "[0.5, 2.0]"))
    with pytest.raises(ValueError, match="cost_stress_multipliers"):
        section(at.configs, "validation")


def test_secrets(tmp_path, monkeypatch):
    monkeypatch.setenv("HAD_BEFORE", "stays")
    for name in ("A_TOKEN", "QUOTED"):
        monkeypatch.delenv(name, raising=False)
    assert load_secrets(tmp_path) == []
    (tmp_path / ".env").write_text("# a note\nA_TOKEN=abc # what it is\nexport QUOTED='x # y'\nHAD_BEFORE=goes\nno line\n")
    assert load_secrets(tmp_path) == ["A_TOKEN", "QUOTED"]
    assert (os.environ["A_TOKEN"], os.environ["QUOTED"], os.environ["HAD_BEFORE"]) == ("abc", "x # y", "stays")
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    load_secrets(tmp_path)
    subprocess.run(["git", "add", "-f", ".env"], cwd=tmp_path, check=True)
    with pytest.raises(RuntimeError, match="version control"):
        load_secrets(tmp_path)
    for name in ("A_TOKEN", "QUOTED"):
        os.environ.pop(name)


def test_logger_is_set_up_once(capsys):
    a, b = logger("x", "warning"), logger("y")
    own = logging.getLogger(config.LOGGER)
    assert sum(getattr(h, "barloom", False) for h in own.handlers) == 1 and a.name == "barloom.x" and b.getEffectiveLevel() == logging.WARNING
    logger(level="info")
    assert b.getEffectiveLevel() == logging.INFO


def test_tables_are_sealed(spark, at):
    c = Catalog(spark, at)
    c.audit("system", "a", {})
    c.audit("system", "b", {})
    files = [f for f in (at.catalog / "audit_log").rglob("*.parquet")]
    assert len(files) == 2 and not any(f.stat().st_mode & (stat.S_IWUSR | stat.S_IWGRP | stat.S_IWOTH) for f in files) and c.verify()[0]


def test_steps_between_versions(spark, at, monkeypatch):
    c = Catalog(spark, at)
    c.migrate()
    c.add_journal("me", "before")
    ran = []
    monkeypatch.setattr(module, "VERSION", 3)
    monkeypatch.setitem(module.TABLES, "journal_entries", module.TABLES["journal_entries"] + ", mood string")
    monkeypatch.setitem(module.STEPS, 2, lambda c: ran.append(2))
    monkeypatch.setitem(module.STEPS, 3, lambda c: ran.append(3))
    c.migrate()
    c.migrate()
    assert ran == [2, 3] and sorted(r["version"] for r in c.table("schema_migrations").collect()) == [1, 2, 3]
    assert c.table("journal_entries").first()["mood"] is None


def test_hashes_see_every_bit(spark):
    bars = lambda x: spark.createDataFrame([("A", date(2020, 1, 1), 1.0, 2.0, 0.5, x, 7)], store.BARS)
    one, two, again = (store.row_hashes(bars(x)).first()["sha256"] for x in (1.1, 1.1000000000000003, 1.1))
    assert one == again != two


def test_what_was_known(spark, tmp_path):
    rows = [("A", date(2020, 1, k), 1.0, 1.0, 1.0, float(k), 1) for k in range(1, 11)] + [("B", date(2020, 1, 9), 1.0, 1.0, 1.0, 5.0, 1)]
    spark.createDataFrame(rows, store.BARS).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    assert [r["close"] for r in history.tail(bars, "2020-01-05", 3).orderBy("date").collect()] == [3.0, 4.0, 5.0]
    assert {(r["symbol"], r["last_close"]) for r in history.last_close(bars, date(2020, 1, 9)).collect()} == {("A", 9.0), ("B", 5.0)}
    assert history.known(bars, "2019-12-31").count() == 0
    plan = history.last_close(bars, "2020-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(date,2020-01-05)" in plan and "ReadSchema: struct<symbol:string,date:date,close:double>" in plan
    with pytest.raises(ValueError):
        history.tail(bars, "2020-01-05", 0)


def test_growth_keeps_signs_and_zeros(spark):
    returns = [0.5, -0.5, -1.5, 0.1, -3.0, -1.0, 0.2]
    df = spark.createDataFrame([("c", date(2020, 1, k + 1), r) for k, r in enumerate(returns)], "curve string, date date, r double")
    from pyspark.sql import functions as F

    got = [r["g"] for r in df.select("date", metrics.growth(F.col("r"), ["curve"]).alias("g")).orderBy("date").collect()]
    want, x = [], 1.0
    for r in returns:
        x *= 1 + r
        want.append(x)
    assert got == pytest.approx(want)


def test_parameters_outside_the_space_are_told_apart():
    SmaCross({"fast": 20, "slow": 100})
    for params, said in (({"fast": 20}, "slow isn't given"), ({"fast": 20, "slow": 100, "x": 1}, "x isn't a parameter"), ({"fast": 21, "slow": 100}, "fast is one of")):
        with pytest.raises(ValueError, match=said):
            SmaCross(params)


def test_queries_of_text(spark):
    text = "The slow slow diffusion of Information in two markets"
    got = spark.createDataFrame([(text,)], "t string").select(search.fts_query("t").alias("q")).first()["q"]
    assert got == " OR ".join(search.query_terms(text)) == "diffusion OR information OR markets OR slow"
