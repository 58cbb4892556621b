"""The research catalogue: append-only tables, as Parquet folders in the workspace.

Nothing is ever updated: a table grows by files, and what changes (an experiment's
status) is a table of events whose latest row counts. Guards refuse what the
rules forbid: a second verdict, an experiment without a hypothesis, repeats of
failed ideas that nobody acknowledged. Every action is an entry of a hash-chained
audit log. Rows are few and written from the driver; reading is set-based."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import search
from barloom.plans.config import Workspace, canonical

#: Columns of the catalogue's tables.
TABLES = {
    "instruments": "symbol string, name string, asset_class string, currency string, source string, first_bar date, last_bar date, is_benchmark boolean, seq long, created_at string",
    "data_quality_log": "symbol string, range_start date, range_end date, check_name string, severity string, detail string, created_at string",
    "snapshots": "snapshot_id string, created_at string, description string, frequency string, manifest_json string, coverage_start date, coverage_end date",
    "journal_entries": "journal_id long, ts string, author string, body string, tags string, linked_json string",
    "audit_log": "seq long, ts string, actor string, event_type string, payload_json string, prev_hash string, this_hash string",
    "hypotheses": "hypothesis_id long, family string, statement string, mechanism string, success_criteria string, falsification_criteria string, author string, created_at string",
    "experiments": "experiment_id long, hypothesis_id long, strategy_name string, strategy_version int, snapshot_id string, benchmark_symbol string, similar_failures_json string, ack_journal_id long, created_at string",
    "experiment_events": "experiment_id long, seq long, status string, verdict string, verdict_reason string, ts string",
    "runs": "run_id string, experiment_id long, run_type string, config_hash string, git_sha string, dirty_tree boolean, seed long, engine_version string, started_at string, finished_at string, artifact_dir string, promotable boolean",
    "run_metrics": "run_id string, metric string, period string, value double",
    "trades": "run_id string, symbol string, entry_ts date, entry_px double, exit_ts date, exit_px double, qty long, fees double, slippage double, pnl double, mae double, mfe double, holding_bars int, exit_reason string, context_json string",
    "walkforward_folds": "run_id string, fold_n int, train_start date, train_end date, test_start date, test_end date, embargo_bars int, chosen_params_json string, train_sharpe double, test_sharpe double, test_return double, test_trades int",
    "mc_simulations": "run_id string, method string, n_paths int, seed long, summary_json string, created_at string",
    "schema_migrations": "version int, applied_at string, checksum string",
}
#: Raised with every change of TABLES; a catalogue keeps the checksums of the versions it has seen.
VERSION = 1
#: What brings a catalogue from the version before to this one, where new columns being null isn't enough.
STEPS: dict[int, Callable[["Catalog"], None]] = {}
#: Values that columns may take.
ALLOWED = {
    ("experiment_events", "status"): ("registered", "running", "complete"), ("experiment_events", "verdict"): (None, "pass", "fail", "inconclusive"),
    ("runs", "run_type"): (
        "backtest", "walkforward", "montecarlo", "benchmark", "stress"
    ), ("data_quality_log", "severity"): ("info", "warn", "fail"), ("audit_log", "actor"): ("human", "system"),
    ("mc_simulations", "method"): (
        "trade_bootstrap", "block_bootstrap", "cost_stress", "delay_stress", "param_perturbation"
    ), ("trades", "exit_reason"): ("signal", "stop", "end_of_data"),
}
GENESIS = search.GENESIS


def seal(folder: Path) -> None:
    """Take the right to write from the files of a table: it grows by new ones."""
    for file in folder.rglob("*"):
        if file.is_file() and file.stat().st_mode & 0o222:
            file.chmod(file.stat().st_mode & ~0o222)


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class SimilarFailures(Exception):
    """Failed experiments that resemble a new one; `similar` holds them."""

    def __init__(self, similar: list[dict[str, Any]]):
        self.similar = similar
        told = "; ".join(f"{s['experiment_id']} of hypothesis {s['hypothesis_id']} in {s['family']} ({s['reason']})" for s in similar)
        super().__init__(f"{len(similar)} failed experiment(s) resemble this one: {told}. Write down in the journal why this is different, and give that entry's number.")


def current(experiments: DataFrame, events: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Experiments with status, verdict and reason by the last of their events, and their hypothesis' family."""
    latest = events.groupBy("experiment_id").agg(F.max_by(F.struct("status", "verdict", "verdict_reason", "ts"), "seq").alias("now"))
    known = experiments.join(latest, "experiment_id").join(hypotheses.select("hypothesis_id", "family"), "hypothesis_id")
    return known.select("*", "now.status", "now.verdict", "now.verdict_reason").drop("now")


def resembling(failed: DataFrame, hypotheses: DataFrame, family: str, terms: list[str], exclude_hypothesis: int | None = None) -> DataFrame:
    """experiment_id, hypothesis_id, family, verdict_reason, rank of failed experiments: 0 those of the family, 1 the ten whose
    hypothesis matches the terms best. One that is both has rank 0."""
    columns = ("experiment_id", "hypothesis_id", "family", "verdict_reason")
    texts = hypotheses.select("hypothesis_id", F.concat_ws(" ", "statement", "mechanism").alias("text"))
    ranked = search.bm25(texts, terms, "hypothesis_id").withColumn("score", F.round("score", 9))  # ties don't hang on the order of sums
    own = failed.filter(F.col("family") == family.strip()).select(*columns, F.lit(0).alias("rank"))
    near = failed.join(ranked, "hypothesis_id").orderBy(F.desc("score"), "experiment_id").limit(10).select(*columns, F.lit(1).alias("rank"))
    if exclude_hypothesis is not None:
        near = near.filter(F.col("hypothesis_id") != exclude_hypothesis)
    best = own.unionByName(near).groupBy("experiment_id").agg(F.min_by(F.struct(*columns[1:], "rank"), "rank").alias("x"))
    return best.select("experiment_id", "x.*")


def family_totals(values: DataFrame, runs: DataFrame, experiments: DataFrame, hypotheses: DataFrame, metric: str, exclude: int | None = None) -> DataFrame:
    """family, total, runs: a metric of walk-forward runs, summed over each family's experiments but `exclude`."""
    if exclude is not None:
        experiments = experiments.filter(F.col("experiment_id") != exclude)
    owned = experiments.select("experiment_id", "hypothesis_id").join(hypotheses.select("hypothesis_id", "family"), "hypothesis_id")
    of_runs = runs.filter("run_type = 'walkforward'").select("run_id", "experiment_id").join(owned, "experiment_id")
    joined = values.filter(F.col("metric") == metric).join(of_runs, "run_id")
    return joined.groupBy("family").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("*").alias("runs"))


class Catalog:
    def __init__(self, spark: SparkSession, at: Workspace):
        self.spark, self.at = spark, at

    def migrate(self) -> None:
        """Bring the catalogue to this version, step by step, and record each; refuse one that knows it with other columns, or a later one."""
        checksum = hashlib.sha256(canonical({k: v for k, v in TABLES.items() if k != "schema_migrations"}).encode()).hexdigest()
        known = {r["version"]: r["checksum"] for r in self.table("schema_migrations").collect()}
        if known.get(VERSION, checksum) != checksum:
            raise RuntimeError(f"version {VERSION} of the catalogue's tables has changed since it was applied; tables change with a new version only")
        if max(known, default=0) > VERSION:
            raise RuntimeError(f"the catalogue is of version {max(known)}, this code of version {VERSION}")
        for version in range(max(known, default=VERSION - 1) + 1, VERSION + 1):
            if known and version in STEPS:
                STEPS[version](self)
            self.append("schema_migrations", [{"version": version, "applied_at": now(), "checksum": checksum if version == VERSION else "passed through"}])

    def exists(self) -> bool:
        return (self.at.catalog / "audit_log").exists()

    def table(self, name: str) -> DataFrame:
        folder = self.at.catalog / name
        if not folder.exists():
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(folder))

    def append(self, name: str, rows: list[dict[str, Any]] | DataFrame) -> None:
        if isinstance(rows, list):
            for r in rows:
                for (table, column), allowed in ALLOWED.items():
                    if table == name and r.get(column) not in allowed:
                        raise ValueError(f"{name}.{column}: {r.get(column)!r} is none of {allowed}")
            if not rows:
                return
            columns = [c.strip().split(" ")[0] for c in TABLES[name].split(",")]
            rows = self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], TABLES[name]).coalesce(1)
        folder = self.at.catalog / name
        rows.write.mode("append").parquet(str(folder))
        seal(folder)

    def _next(self, name: str, key: str) -> int:
        return (self.table(name).agg(F.max(key)).first()[0] or 0) + 1

    # audit log

    def audit(self, actor: str, event: str, payload: dict[str, Any]) -> int:
        last = self.table("audit_log").orderBy(F.desc("seq")).limit(1).collect()
        seq, before = (last[0]["seq"] + 1, last[0]["this_hash"]) if last else (1, GENESIS)
        parts = [before, now(), actor, event, canonical(payload)]
        digest = hashlib.sha256("".join(p + "\0" for p in parts).encode()).hexdigest()
        self.append("audit_log", [{"seq": seq, "ts": parts[1], "actor": actor, "event_type": event, "payload_json": parts[4], "prev_hash": before, "this_hash": digest}])
        return seq

    def verify(self) -> tuple[bool, str]:
        """Whether the audit log is as it was written; else its first broken entry."""
        bad = search.chain_state(self.table("audit_log")).filter("not prev_ok or not hash_ok").orderBy("seq").limit(1).collect()
        if not bad:
            return True, "every entry of the log is as it was written"
        return False, f"entry {bad[0]['seq']} of the log " + ("was changed" if bad[0]["prev_ok"] else "doesn't follow the one before it")

    # journal and hypotheses

    def add_journal(self, author: str, body: str, tags: str | None = None, linked: list[str] | None = None) -> int:
        if not body.strip():
            raise ValueError("an entry of the journal needs a text")
        key = self._next("journal_entries", "journal_id")
        self.append("journal_entries", [{"journal_id": key, "ts": now(), "author": author, "body": body.strip(), "tags": tags, "linked_json": json.dumps(linked or [])}])
        self.audit("human", "journal.add", {"journal_id": key})
        return key

    def journal(self, last: int = 20) -> DataFrame:
        return self.table("journal_entries").orderBy(F.desc("journal_id")).limit(last)

    def register_hypothesis(self, family: str, statement: str, mechanism: str, success_criteria: str, falsification_criteria: str, author: str = "human") -> int:
        texts = {"statement": statement, "mechanism": mechanism, "success_criteria": success_criteria, "falsification_criteria": falsification_criteria}
        for name, text in texts.items():
            if not text.strip():
                raise ValueError(f"a hypothesis states its {name.replace('_', ' ')} before anything is run")
        key = self._next("hypotheses", "hypothesis_id")
        self.append("hypotheses", [{"hypothesis_id": key, "family": family.strip(), "author": author, "created_at": now()} | {k: v.strip() for k, v in texts.items()}])
        self.audit("human", "hypothesis.register", {"hypothesis_id": key, "family": family})
        return key

    # experiments

    def experiments(self) -> DataFrame:
        """Experiments with their current status and verdict, and their family."""
        return current(self.table("experiments"), self.table("experiment_events"), self.table("hypotheses"))

    def similar_failures(self, family: str, statement: str, mechanism: str, exclude_hypothesis: int | None = None) -> list[dict[str, Any]]:
        """Failed experiments of the family, and of the ten best text matches among hypotheses; the family's reason wins."""
        failed = self.experiments().filter("verdict = 'fail'")
        best = resembling(failed, self.table("hypotheses"), family, search.query_terms(f"{statement} {mechanism}"), exclude_hypothesis).orderBy("experiment_id")
        said = {0: "of the same family", 1: "with a similar text"}
        return [
            {"experiment_id": r["experiment_id"], "hypothesis_id": r["hypothesis_id"], "family": r["family"], "reason": f"{said[r['rank']]}, failed by {r['verdict_reason']}"}
            for r in best.collect()
        ]

    def register_experiment(
        self, hypothesis_id: int, strategy: str, version: int, snapshot_id: str, benchmark: str, ack_journal: int | None = None
    ) -> tuple[int, list[dict[str, Any]]]:
        h = self.table("hypotheses").filter(F.col("hypothesis_id") == hypothesis_id).collect()
        if not h:
            raise KeyError(f"there is no hypothesis {hypothesis_id} to test")
        if self.table("snapshots").filter(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise KeyError(f"there is no snapshot {snapshot_id}")
        similar = self.similar_failures(h[0]["family"], h[0]["statement"], h[0]["mechanism"], hypothesis_id)
        if similar and ack_journal is None:
            raise SimilarFailures(similar)
        if ack_journal is not None and self.table("journal_entries").filter(F.col("journal_id") == ack_journal).isEmpty():
            raise KeyError(f"the journal has no entry {ack_journal} to refer to")
        key = self._next("experiments", "experiment_id")
        self.append(
            "experiments",
            [{"experiment_id": key, "hypothesis_id": hypothesis_id, "strategy_name": strategy, "strategy_version": version, "snapshot_id": snapshot_id, "benchmark_symbol": benchmark, "similar_failures_json": json.dumps(similar), "ack_journal_id": ack_journal, "created_at": now()}]
        )
        self._event(key, "registered")
        self.audit(
            "system", "experiment.register",
            {
                "experiment_id": key, "hypothesis_id": hypothesis_id, "strategy": f"{strategy}@{version}", "snapshot": snapshot_id,
                "similar_failures": [s["experiment_id"] for s in similar]
            }
        )
        return key, similar

    def _event(self, experiment_id: int, status: str, verdict: str | None = None, reason: str | None = None) -> None:
        past = self.table("experiment_events").filter(F.col("experiment_id") == experiment_id)
        known = past.agg(F.max("seq").alias("seq"), F.max((F.col("status") == "complete").cast("int")).alias("done")).first()
        if known["done"]:
            raise PermissionError(f"experiment {experiment_id} has its verdict, which stands")
        if known["seq"] is None and status != "registered":
            raise KeyError(f"there is no experiment {experiment_id}")
        self.append(
            "experiment_events",
            [{"experiment_id": experiment_id, "seq": (known["seq"] or 0) + 1, "status": status, "verdict": verdict, "verdict_reason": reason, "ts": now()}]
        )

    def mark_running(self, experiment_id: int) -> None:
        self._event(experiment_id, "running")

    def finalize(self, experiment_id: int, verdict: str, reason: str) -> None:
        self._event(experiment_id, "complete", verdict, reason)
        self.audit("system", "experiment.verdict", {"experiment_id": experiment_id, "verdict": verdict, "reason": reason})

    # runs

    def record_run(self, experiment_id: int, run_type: str, config_hash: str, git_sha: str, dirty: bool, seed: int, engine: str, started: str, artifacts: str | None) -> str:
        digest = hashlib.sha256(f"{experiment_id}|{run_type}|{config_hash}|{started}".encode()).hexdigest()
        key = f"R{experiment_id}-{run_type}-{digest[:8]}"
        self.append(
            "runs",
            [{"run_id": key, "experiment_id": experiment_id, "run_type": run_type, "config_hash": config_hash, "git_sha": git_sha, "dirty_tree": dirty, "seed": seed, "engine_version": engine, "started_at": started, "finished_at": now(), "artifact_dir": artifacts, "promotable": not dirty}]
        )
        return key

    def record_metrics(self, run_id: str, values: dict[str, Any], period: str) -> None:
        """An undefined value is NULL."""
        self.append("run_metrics", [{"run_id": run_id, "metric": k, "period": period, "value": None if v is None or v != v else float(v)} for k, v in values.items()])

    def family_total(self, family: str, metric: str = "n_configs", exclude: int | None = None) -> int:
        """The sum of a walk-forward metric over a family's experiments: n_configs for multiple testing, n_trials for the record."""
        sums = family_totals(self.table("run_metrics"), self.table("runs"), self.table("experiments"), self.table("hypotheses"), metric, exclude)
        found = sums.filter(F.col("family") == family.strip()).first()
        return int(found["total"]) if found else 0

    # instruments

    def upsert_instrument(self, symbol: str, source: str, first_bar, last_bar, is_benchmark: bool = False) -> None:
        """A later row replaces source and coverage; whether a symbol is the benchmark stays as first said."""
        known = self.instruments().filter(F.col("symbol") == symbol.upper()).collect()
        self.append(
            "instruments",
            [{"symbol": symbol.upper(), "asset_class": "equity", "source": source, "first_bar": first_bar, "last_bar": last_bar, "is_benchmark": known[0]["is_benchmark"] if known else is_benchmark, "seq": self._next("instruments", "seq"), "created_at": known[0]["created_at"] if known else now()}]
        )

    def instruments(self) -> DataFrame:
        rows = self.table("instruments")
        return rows.groupBy("symbol").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "symbol")), "seq").alias("x")).select("symbol", "x.*")
