"""An experiment: from a registered hypothesis to a final verdict.

Backtest, benchmark, walk-forward, resampling, stress reruns, regimes, deflated
Sharpe ratio, gates. All reruns are scenarios of the ledger; signals are computed
once for each set of parameters. Every part is recorded as a run."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import functions as F

from barloom import __version__
from barloom.operators import ledger, metrics, regimes, validation
from barloom.operators.strategies import get_class, params_key
from barloom.plans import store
from barloom.plans.catalog import Catalog, now
from barloom.plans.config import account as account_of, git_state, load
from barloom.sources.bars import missing_from
from barloom.sources.synthetic import derive_seed

BENCHMARK_METRICS = ("total_return", "cagr", "sharpe", "max_drawdown")


def _row(df, *drop: str) -> dict[str, Any]:
    got = df.collect()
    return {k: v for k, v in got[0].asDict().items() if k not in drop} if got else {}


def run(catalog: Catalog, hypothesis_id: int, strategy_name: str, version: int, snapshot_id: str, ack_journal: int | None = None) -> dict[str, Any]:
    spark, config = catalog.spark, load(catalog.at.configs, strategy_name, version)
    digest, (sha, dirty) = config.digest(), git_state(catalog.at.root)
    strategy, params = get_class(strategy_name, version), dict(config.strategy.params)
    strategy(params)  # refuses what is outside the declared space
    benchmark = config.data.benchmark_symbol.upper()
    key, _ = catalog.register_experiment(hypothesis_id, strategy_name, version, snapshot_id, benchmark, ack_journal)
    catalog.mark_running(key)
    folder = catalog.at.artifacts / f"E{key}"
    folder.mkdir(parents=True, exist_ok=True)
    bars = store.load_snapshot(catalog, snapshot_id)
    lacking = missing_from(bars, [*config.strategy.universe, benchmark])
    if lacking:
        raise KeyError(f"the strategy trades what snapshot {snapshot_id} has no bars of: {', '.join(lacking)}")
    bars = bars.persist()
    account, universe, mc = account_of(config.backtest), config.strategy.universe, config.validation.montecarlo
    root_seed = config.general.root_seed

    def record(kind: str, started: str, seed: int = 0) -> str:
        return catalog.record_run(key, kind, digest, sha, dirty, seed, __version__, started, str(folder.relative_to(catalog.at.root)))

    # the whole sample
    started = now()
    signals = strategy.signals(bars, [params])
    full = ledger.run(bars, signals, ledger.scenarios(spark, [{"scenario_id": "full", "params_key": params_key(params)}]), universe, account).persist()
    full_metrics = _row(metrics.scenario_metrics(full, account.initial_capital), "scenario_id")
    rid = record("backtest", started)
    catalog.record_metrics(rid, full_metrics, "full")
    equity, trades = ledger.equity_of(full), ledger.trades_of(full)
    catalog.append("trades", trades.withColumn("run_id", F.lit(rid)).drop("scenario_id").select(*[c.strip().split(" ")[0] for c in _columns("trades")]))
    equity.coalesce(1).write.mode("overwrite").parquet(str(folder / "equity_full"))
    trades.drop("scenario_id").coalesce(1).write.mode("overwrite").option("header", True).csv(str(folder / "trades_full"))

    # buy and hold
    started = now()
    span = equity.agg(F.min("date").alias("a"), F.max("date").alias("z")).first()
    held = metrics.buy_and_hold(bars.filter(F.col("symbol") == benchmark), account.initial_capital, account.costs, span["a"], span["z"]).persist()
    bench = _row(metrics.curve_metrics(held, "symbol"), "symbol")
    if not bench:
        raise ValueError(f"benchmark {benchmark}: not enough bars in window, or capital too small to buy one share")
    bench = {k: bench[k] for k in BENCHMARK_METRICS}
    rid_bench = record("benchmark", started)
    catalog.record_metrics(rid_bench, bench, "full")
    held.coalesce(1).write.mode("overwrite").parquet(str(folder / "equity_benchmark"))
    against = metrics.returns(held, "symbol").select("date", F.col("r").alias("b"))
    compared = _row(metrics.compare(metrics.returns(equity), against), "scenario_id") or dict.fromkeys(
        ("alpha_ann", "beta", "correlation", "information_ratio", "active_return_ann")
    )
    catalog.record_metrics(rid, compared, "full")

    # out of sample
    started = now()
    wf_cfg = config.validation.walkforward
    wf = validation.walk_forward(bars, strategy, params, universe, account, wf_cfg.train_bars, wf_cfg.test_bars, None if wf_cfg.embargo_bars == "auto" else wf_cfg.embargo_bars)
    oos = out_of_sample(wf, account.initial_capital)
    rid_wf = record("walkforward", started)
    catalog.record_metrics(rid_wf, oos, "oos")
    catalog.append(
        "walkforward_folds",
        wf.folds.select(
            F.lit(rid_wf).alias("run_id"), F.col("fold").alias("fold_n"), "train_start", "train_end", "test_start", "test_end",
            "embargo_bars", F.col("params_key").alias("chosen_params_json"), "train_sharpe", "test_sharpe", "test_return", "test_trades"
        ).coalesce(1)
    )
    catalog.append("trades", wf.oos_trades.withColumn("run_id", F.lit(rid_wf)).select(*[c.strip().split(" ")[0] for c in _columns("trades")]))
    wf.oos_returns.coalesce(1).write.mode("overwrite").parquet(str(folder / "oos_returns"))

    # resampling and reruns
    started = now()
    rid_mc = record("montecarlo", started, root_seed)
    pnls = [r["pnl"] for r in wf.oos_trades.orderBy("entry_ts", "symbol", "exit_ts").select("pnl").collect()]
    rets = [r["r"] for r in wf.oos_returns.orderBy("date").collect()]
    seeds = {k: derive_seed(root_seed, f"mc.{k}", str(key)) for k in ("trade", "block", "perturb")}
    by_trades = validation.trade_bootstrap(spark, pnls, account.initial_capital, mc.n_paths, seeds["trade"], mc.ruin_drawdown_pct)
    by_blocks = validation.block_bootstrap(spark, rets, mc.n_paths, seeds["block"], mc.ruin_drawdown_pct, None if mc.block_len == "auto" else mc.block_len)
    s = validation.stress(bars, strategy, params, universe, account, mc.cost_stress_multipliers, [0, *mc.delay_stress_bars], mc.perturbation_samples, seeds["perturb"])
    summaries = [
        ("trade_bootstrap", mc.n_paths, seeds["trade"], by_trades), ("block_bootstrap", mc.n_paths, seeds["block"], by_blocks),
        (
            "cost_stress", len(s.cost_table), 0, {"table": s.cost_table, "max_profitable_multiplier": s.max_profitable_multiplier}
        ), ("delay_stress", len(s.delay_table), 0, {"table": s.delay_table}),
        ("param_perturbation", len(s.neighbour.get("neighbor_sharpes", [])), seeds["perturb"], s.neighbour),
    ]
    catalog.append(
        "mc_simulations",
        [
            {"run_id": rid_mc, "method": m, "n_paths": n, "seed": seed, "summary_json": json.dumps(v, sort_keys=True, default=str), "created_at": now()}
            for m, n, seed, v in summaries
        ]
    )

    # regimes, deflated Sharpe ratio, gates
    labels = regimes.label(bars.filter(F.col("symbol") == benchmark)).select("date", "label")
    by_regime = {x: {"pnl": 0.0, "n_trades": 0.0} for x in regimes.LABELS} | {
        r["label"]: {"pnl": r["pnl"], "n_trades": float(r["n_trades"])}
        for r in regimes.pnl(wf.oos_trades.withColumn("scenario_id", F.lit("oos")), labels).collect()
    }
    family = catalog.table("hypotheses").filter(F.col("hypothesis_id") == hypothesis_id).first()["family"]
    tried = wf.n_configs + catalog.family_total(family, "n_configs", key)
    dsr = validation.deflated_sharpe(wf.oos_returns, tried, [r["sharpe"] or 0.0 for r in wf.trials.select("sharpe").collect()])
    evidence = validation.Evidence(
        oos["n_trades"] or 0, oos["expectancy_usd"], wf.oos_sharpe, wf.efficiency, dsr, s.max_profitable_multiplier, tuple(
            r["total_return"]
            for r in s.delay_table if r["extra_delay_bars"] > 0
        ),
        tuple(r["pnl"] for r in by_regime.values()), s.neighbour.get("neighbor_sharpe_ratio", 0.0), oos["max_drawdown"], oos["longest_losing_streak"] or 0,
    )
    found = validation.gates(evidence, validation.GateLimits(**config.validation.gates))
    verdict, reasons = validation.verdict(found)
    catalog.finalize(key, verdict, "; ".join(reasons) or "all gates passed")
    payload = {
        "experiment_id": key, "pessimism_multiplier": account.costs.pessimism_multiplier, "verdict": verdict, "reasons": reasons, "weaknesses": validation.weaknesses(found, evidence),
        "dsr": dsr, "dsr_n_configs": tried, "prior_family_trials": tried - wf.n_configs, "regimes": by_regime, "gates": found,
    }
    (folder / "gates.json").write_text(json.dumps(payload, indent=2, default=str), "utf-8")
    catalog.audit("system", "experiment.complete", {"experiment_id": key, "verdict": verdict})
    wf.release()
    for held_table in (full, held, bars):
        held_table.unpersist()
    return payload | {
        "config_hash": digest, "git_sha": sha, "dirty_tree": dirty, "full_metrics": full_metrics, "oos_metrics": oos,
        "benchmark_metrics": bench, "artifact_dir": str(folder)
    }


def _columns(table: str) -> list[str]:
    from barloom.plans.catalog import TABLES

    return TABLES[table].split(",")


def out_of_sample(wf: validation.WalkForward, capital: float) -> dict[str, Any]:
    """Metrics of the stitched test segments: equity is compounded from the capital, without a row for the start."""
    curve = wf.oos_returns.withColumn("scenario_id", F.lit("oos"))
    curve = curve.withColumn("equity", capital * metrics.growth(F.col("r"), ["scenario_id"])).persist()
    ends = _row(curve.agg(F.max_by("equity", "date").alias("last"), metrics.sortino().alias("sortino")))
    under = _row(metrics.underwater(curve), "scenario_id") or {"max_drawdown": None, "longest_underwater_bars": 0}
    keys = curve.sparkSession.createDataFrame([("oos",)], "scenario_id string")
    curve.unpersist()
    trades = _row(metrics.trade_stats(wf.oos_trades.withColumn("scenario_id", F.lit("oos")), capital, keys), "scenario_id")
    return {
        "sharpe": wf.oos_sharpe, "sortino": ends["sortino"], "total_return": ends["last"] / capital - 1 if ends["last"] is not None else None, **under,
        "wf_efficiency": wf.efficiency, "is_sharpe_mean": wf.is_sharpe_mean, "param_stability": wf.stability, "n_trials": float(wf.n_trials), "n_configs": float(wf.n_configs), "n_folds": float(wf.folds.count()), **trades,
    }
