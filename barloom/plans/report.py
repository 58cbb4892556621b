"""The tear sheet: one HTML page of a complete experiment, from the catalogue and its artifacts alone.

Only small aggregates and daily curves come to the driver; charts are inline SVG."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import metrics
from barloom.plans.catalog import Catalog

NA = "n/a"


def pct(x) -> str:
    return NA if x is None or x != x else f"{x:.2%}"


def f2(x) -> str:
    return NA if x is None or x != x else f"{x:.2f}"


def usd(x) -> str:
    return NA if x is None or x != x else f"${x:,.2f}"


def whole(x) -> str:
    return NA if x is None or x != x else f"{int(x)}"


#: Rows of the metric table: label, metric, format. Fixed values.
ROWS = [
    ("Total return", "total_return", pct), ("CAGR", "cagr", pct), ("Annualized volatility", "ann_vol", pct), ("Sharpe", "sharpe", f2), ("Sortino", "sortino", f2), ("Max drawdown", "max_drawdown", pct),
    (
        "Longest underwater (bars)", "longest_underwater_bars", whole
    ), ("Average exposure", "avg_exposure", pct), ("Trades", "n_trades", whole), ("Win rate", "win_rate", pct), ("Profit factor", "profit_factor", f2),
    ("Expectancy per trade", "expectancy_usd", usd), ("Longest losing streak", "longest_losing_streak", whole), ("Total fees", "total_fees_usd", usd), ("Total slippage", "total_slippage_usd", usd), ("Cost share of gross", "cost_share_of_gross", pct),
]


def pivoted(values: DataFrame, names: list[str] | None = None) -> DataFrame:
    """run_id, and a column for each metric (of `names`, or of all there are)."""
    return values.groupBy("run_id").pivot("metric", names).agg(F.first("value"))


def latest(runs: DataFrame) -> DataFrame:
    """The last run of each experiment and type; of runs that started together, the one with the greatest id."""
    newest = F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id"))
    return runs.groupBy("experiment_id", "run_type").agg(newest.alias("run")).select("run.*")


def latest_runs(catalog: Catalog, experiment_id: int) -> dict[str, dict]:
    runs = catalog.table("runs").filter(F.col("experiment_id") == experiment_id)
    return {r["run_type"]: r.asDict() for r in latest(runs).collect()}


def _svg(series: dict[str, list[float]], log: bool = False, width: int = 760, height: int = 220) -> str:
    values = {k: [math.log(v) if log and v > 0 else v for v in vs] for k, vs in series.items() if vs}
    flat = [v for vs in values.values() for v in vs]
    if not flat:
        return f"<p>{NA}</p>"
    lo, hi = min(flat), max(flat)
    lines = []
    for k, (name, vs) in enumerate(values.items()):
        points = " ".join(f"{i * width / max(len(vs) - 1, 1):.1f},{height - (v - lo) / ((hi - lo) or 1) * height:.1f}" for i, v in enumerate(vs))
        lines.append(f'<polyline fill="none" stroke="{("#1f5fa8", "#b0642c")[k % 2]}" stroke-width="1.2" points="{points}"><title>{html.escape(name)}</title></polyline>')
    legend = " &middot; ".join(html.escape(n) for n in values)
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" role="img">{"".join(lines)}</svg><p class="legend">{legend}</p>'


def _table(head: list[str], rows: list[list[str]]) -> str:
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    return f"<table>{line(head, 'th')}{''.join(line(r, 'td') for r in rows)}</table>"


def drawdown_curve(equity: DataFrame) -> DataFrame:
    """date, drawdown of one curve: a row for each day."""
    return metrics.drawdowns(equity.withColumn("curve", F.lit(0)), "curve").select("date", "drawdown")


def cumulative(returns: DataFrame) -> DataFrame:
    """date, growth less 1 of one curve: a row for each day."""
    return returns.withColumn("curve", F.lit(0)).select("date", (metrics.growth(F.col("r"), ["curve"]) - 1).alias("growth"))


def _column(df: DataFrame, name: str) -> list[float]:
    return [r[name] for r in df.orderBy("date").select(name).collect()]


def build(catalog: Catalog, experiment_id: int) -> Path:
    known = catalog.experiments().filter(F.col("experiment_id") == experiment_id).collect()
    if not known:
        raise KeyError(f"experiment {experiment_id} not found")
    e = known[0]
    if e["status"] != "complete":
        raise ValueError(f"experiment {experiment_id} is {e['status']}, not complete")
    spark, folder, runs = catalog.spark, catalog.at.artifacts / f"E{experiment_id}", latest_runs(catalog, experiment_id)
    h = catalog.table("hypotheses").filter(F.col("hypothesis_id") == e["hypothesis_id"]).first()
    gates = json.loads((folder / "gates.json").read_text("utf-8"))
    by_run = {r["run_id"]: r.asDict() for r in pivoted(catalog.table("run_metrics").filter(F.col("run_id").isin([r["run_id"] for r in runs.values()]))).collect()}
    of = {k: by_run.get(r["run_id"], {}) for k, r in runs.items()}
    full, oos, bench = of.get("backtest", {}), of.get("walkforward", {}), of.get("benchmark", {})
    equity = spark.read.parquet(str(folder / "equity_full"))
    held = spark.read.parquet(str(folder / "equity_benchmark"))
    oos_at = folder / "oos_returns"
    growth = _column(cumulative(spark.read.parquet(str(oos_at))), "growth") if oos_at.exists() else []
    parts = []
    if not catalog.instruments().filter("source = 'synthetic'").isEmpty():
        parts.append('<p class="banner">SYNTHETIC DATA - development only, not research</p>')
    parts += [
        f"<h1>Experiment E{experiment_id}: {html.escape(e['strategy_name'])}@{e['strategy_version']}</h1>",
        f'<p class="verdict {e["verdict"]}">{e["verdict"].upper()}</p><p>{html.escape(e["verdict_reason"] or "")}</p>',
        f"<h2>Hypothesis</h2><p><b>{html.escape(h['family'])}</b>: {html.escape(h['statement'])}</p><p>Mechanism: {html.escape(h['mechanism'])}</p><p>Success: {html.escape(h['success_criteria'])}</p><p>Falsification: {html.escape(h['falsification_criteria'])}</p>",
        "<h2>Gates</h2>" + _table(
            ["gate", "passed", "measured", "threshold", "meaning"],
            [[g["name"], "yes" if g["passed"] else "NO", f2(g["measured"]), f2(g["threshold"]), html.escape(g["detail"])] for g in gates["gates"]]
        ),
        "<h2>Weaknesses</h2><ul>" + "".join(f"<li>{html.escape(w)}</li>" for w in gates["weaknesses"]) + "</ul>",
        "<h2>Metrics</h2>" + _table(["", "out of sample", "full sample", "benchmark"], [[name, f(oos.get(k)), f(full.get(k)), f(bench.get(k))] for name, k, f in ROWS]),
        _table(
            ["", "against buy and hold"],
            [
                ["Alpha (annual)", pct(full.get("alpha_ann"))], ["Beta", f2(full.get("beta"))],
                ["Correlation", f2(full.get("correlation"))], ["Information ratio", f2(full.get("information_ratio"))],
                ["Active return (annual)", pct(full.get("active_return_ann"))]
            ]
        ),
        "<h2>Equity, log scale</h2>" + _svg({"strategy": _column(equity, "equity"), "benchmark": _column(held, "equity")}, log=True),
        "<h2>Drawdown</h2>" + _svg({"drawdown": _column(drawdown_curve(equity), "drawdown")}),
        "<h2>Out-of-sample growth</h2>" + _svg({"cumulative return": growth}),
    ]
    if "walkforward" in runs:
        folds = catalog.table("walkforward_folds").filter(F.col("run_id") == runs["walkforward"]["run_id"]).orderBy("fold_n").collect()
        parts.append(
            "<h2>Walk-forward folds</h2>" + _table(
                ["fold", "train", "test", "params", "train Sharpe", "test Sharpe", "test return", "trades"],
                [
                    [
                        str(r["fold_n"]), f"{r['train_start']} - {r['train_end']}", f"{r['test_start']} - {r['test_end']}",
                        html.escape(r["chosen_params_json"]), f2(r["train_sharpe"]), f2(r["test_sharpe"]), pct(r["test_return"]),
                        whole(r["test_trades"])
                    ]
                    for r in folds
                ]
            )
        )
    if "montecarlo" in runs:
        for r in catalog.table("mc_simulations").filter(F.col("run_id") == runs["montecarlo"]["run_id"]).orderBy("method").collect():
            stats = json.loads(r["summary_json"])
            rows = stats.get("table")
            body = _table(list(rows[0]), [[f2(v) for v in x.values()] for x in rows]) if rows else _table(
                ["", ""], [[html.escape(k), html.escape(str(v) if not isinstance(v, float) else f"{v:.4g}")] for k, v in stats.items()]
            )
            parts.append(f"<h2>{r['method']} ({r['n_paths']} paths, seed {r['seed']})</h2>{body}")
    parts.append("<h2>Regimes</h2>" + _table(["regime", "P&amp;L", "trades"], [[k, usd(v["pnl"]), whole(v["n_trades"])] for k, v in gates["regimes"].items()]))
    one = next(iter(runs.values()), {})
    parts.append(
        f"<footer>snapshot {e['snapshot_id']} &middot; config {str(one.get('config_hash'))[:12]} &middot; commit {str(one.get('git_sha'))[:12]}{' (dirty)' if one.get('dirty_tree') else ''} &middot; engine {one.get('engine_version')} &middot; costs x{gates['pessimism_multiplier']} &middot; risk-free rate 0, 252 days a year</footer>"
    )
    style = "body{font:14px/1.45 sans-serif;max-width:820px;margin:2em auto}table{border-collapse:collapse;margin:.6em 0}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}.banner{background:#b00;color:#fff;padding:.5em}.verdict{font-size:1.4em;font-weight:bold}.pass{color:#060}.fail{color:#b00}"
    out = folder / "report.html"
    out.write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>E{experiment_id}</title><style>{style}</style></head><body>{''.join(parts)}</body></html>", "utf-8")
    return out
