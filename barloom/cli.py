"""Command line: python -m barloom.cli --root DIR command ..."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barloom.operators import quality
from barloom.plans import experiment, report, store
from barloom.plans.catalog import Catalog, SimilarFailures
from barloom.plans.config import Workspace, load_secrets, logger, section
from barloom.sources import bars as src
from barloom.sources.synthetic import synthetic_bars


def session() -> SparkSession:
    return SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="barloom")
    top.add_argument("--root", help="workspace folder (default: BARLOOM_HOME or the current folder)")
    groups = top.add_subparsers(dest="group", required=True)
    groups.add_parser("init")

    def group(name: str):
        return groups.add_parser(name).add_subparsers(dest="command", required=True)

    def command(of, name: str, *options: tuple):
        p = of.add_parser(name)
        for flags, more in options:
            p.add_argument(*flags, **more)
        return p

    symbols = (("--symbol", "-s"), {"action": "append", "dest": "symbols"})
    needed = (symbols[0], symbols[1] | {"required": True})
    data = group("data")
    command(data, "fetch", symbols, (("--source",), {"default": "tiingo", "choices": ("tiingo", "stooq")}))
    command(data, "import-csv", (("file",), {}), (("--symbol",), {"required": True}))
    command(data, "synth", needed, (("--bars",), {"type": int, "default": 2400}), (("--trend",), {"type": float, "default": 0.05}))
    command(data, "validate", needed)
    command(data, "snapshot", needed, (("--message", "-m"), {"required": True}))
    command(data, "snapshots")
    journal = group("journal")
    command(journal, "add", (("body",), {}), (("--tags",), {}), (("--author",), {"default": "human"}))
    command(journal, "list", (("--last",), {"type": int, "default": 20}))
    command(group("hypothesis"), "new", *(((f"--{k}",), {"required": True}) for k in ("family", "statement", "mechanism", "success", "falsification")))
    command(
        group("experiment"), "run", (("--hypothesis",), {"type": int, "required": True}), (("--strategy",), {"required": True}),
        (("--version",), {"type": int, "default": 1}), (("--snapshot",), {"required": True}), (("--ack-journal",), {"type": int})
    )
    command(group("report"), "build", (("experiment_id",), {"type": int}))
    vault = group("vault")
    command(vault, "experiments")
    command(vault, "hypotheses")
    command(vault, "show", (("experiment_id",), {"type": int}))
    command(group("audit"), "verify")
    return top


def _data(args, catalog: Catalog) -> int:
    config, spark = section(catalog.at.configs, "data"), catalog.spark
    limits, bad = quality.Limits(**config.validation), 0

    def admit(bars, source: str) -> None:
        nonlocal bad
        for symbol, ok in sorted(store.admit(catalog, bars, limits, source, config.benchmark_symbol).items()):
            print(f"  {symbol}: {'curated' if ok else 'refused; see its findings'}")
            bad += not ok

    if args.command == "fetch":
        token = os.environ.get("TIINGO_API_KEY", "")
        if args.source == "tiingo" and not token:
            print("TIINGO_API_KEY is not set (or use --source stooq)", file=sys.stderr)
            return 1
        for symbol in args.symbols or config.universe:
            try:  # one symbol's failure doesn't keep the others
                bars, raw = src.fetch_tiingo(spark, symbol, token) if args.source == "tiingo" else src.fetch_stooq(spark, symbol)
                store.archive_raw(catalog, args.source, symbol, raw, "json" if args.source == "tiingo" else "csv")
            except Exception as error:  # noqa: BLE001
                print(f"  {symbol}: fetch failed: {error}", file=sys.stderr)
                continue
            admit(bars, args.source)
        return 0
    if args.command == "import-csv":
        text = Path(args.file).read_text("utf-8")
        store.archive_raw(catalog, "csv", args.symbol, text)
        admit(src.csv_text(spark, text, args.symbol), "csv")
        return 0
    if args.command == "synth":
        print("WARNING: synthetic data is for development only - results are not research.")
        seed = section(catalog.at.configs, "general").root_seed
        admit(synthetic_bars(spark, args.symbols, args.bars, seed, args.trend), "synthetic")
        return 0
    if args.command == "validate":
        bars = store.load_curated(catalog, args.symbols)
        found = store.check(catalog, bars, limits)
        for r in found.orderBy("symbol", "check_name").collect():
            print(f"  {r['symbol']} [{r['severity']}] {r['check_name']}: {r['detail']}")
        return int(not quality.passing(bars, found).filter("not passes").isEmpty())
    if args.command == "snapshot":
        key = store.create_snapshot(catalog, args.symbols, args.message)
        catalog.audit("system", "snapshot.create", {"snapshot_id": key, "symbols": sorted(s.upper() for s in args.symbols)})
        print(f"snapshot {key} created")
        return 0
    for r in catalog.table("snapshots").orderBy("created_at").collect():
        print(f"{r['snapshot_id']}  {r['created_at']}  {r['coverage_start']}..{r['coverage_end']}  {r['description']}")
    return 0


def _experiment(args, catalog: Catalog) -> int:
    try:
        got = experiment.run(catalog, args.hypothesis, args.strategy, args.version, args.snapshot, args.ack_journal)
    except SimilarFailures as similar:
        print(similar, file=sys.stderr)
        return 2
    print(f"Experiment E{got['experiment_id']}: {got['verdict'].upper()}", *(f"  - {r}" for r in got["reasons"]), sep="\n")
    oos = got["oos_metrics"]
    print(f"OOS: sharpe={report.f2(oos['sharpe'])} trades={report.whole(oos['n_trades'])} maxDD={report.pct(oos['max_drawdown'])} wf_eff={report.f2(oos['wf_efficiency'])}")
    if got["dirty_tree"]:
        print("note: git tree was dirty - this run is recorded as non-promotable")
    print(f"artifacts: {got['artifact_dir']}")
    return 0


def _vault(args, catalog: Catalog) -> int:
    if args.command == "hypotheses":
        for r in catalog.table("hypotheses").orderBy("hypothesis_id").collect():
            print(f"H{r['hypothesis_id']} [{r['family']}] {r['statement']}")
        return 0
    rows = catalog.experiments().orderBy("experiment_id")
    if args.command == "show":
        rows = rows.filter(F.col("experiment_id") == args.experiment_id)
    found = rows.collect()
    for r in found:
        print(
            f"E{r['experiment_id']}  H{r['hypothesis_id']} [{r['family']}] {r['strategy_name']}@{r['strategy_version']}  snap={r['snapshot_id'][:8]}  {r['status']}  verdict={r['verdict'] or '-'}"
        )
        if args.command == "show":
            print(f"reason: {r['verdict_reason']}")
            runs = catalog.table("runs").filter(F.col("experiment_id") == args.experiment_id).join(catalog.table("run_metrics"), "run_id", "left").orderBy("started_at", "run_id", "metric")
            for m in runs.select("run_id", "run_type", "period", "metric", "value").collect():
                print(f"  {m['run_id']} {m['run_type']} {m['period'] or '-'} {m['metric'] or '-'} = {report.NA if m['value'] is None else f'{m["value"]:.6g}'}")
    if args.command == "show" and not found:
        print(f"experiment {args.experiment_id} not found", file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    at = Workspace(args.root)
    names = load_secrets(at.root)
    catalog = Catalog(spark or session(), at)
    if args.group == "init":
        at.create()
        catalog.migrate()
        catalog.audit("system", "workspace.init", {"root": str(at.root)})
        print(f"Workspace ready at {at.root}")
        return 0
    if not catalog.exists():
        print("No catalogue found - run init first.", file=sys.stderr)
        return 1
    catalog.migrate()
    logger("cli", section(at.configs, "general").log_level).debug("workspace %s, from its .env: %s", at.root, ", ".join(names) or "nothing")
    if args.group == "data":
        return _data(args, catalog)
    if args.group == "journal":
        if args.command == "add":
            print(f"journal entry {catalog.add_journal(args.author, args.body, args.tags)} recorded")
        else:
            for r in catalog.journal(args.last).collect():
                print(f"[{r['journal_id']}] {r['ts']} {r['author']}: {r['body'][:100]}")
        return 0
    if args.group == "hypothesis":
        print(f"hypothesis {catalog.register_hypothesis(args.family, args.statement, args.mechanism, args.success, args.falsification)} registered (family: {args.family})")
        return 0
    if args.group == "experiment":
        return _experiment(args, catalog)
    if args.group == "report":
        out = report.build(catalog, args.experiment_id)
        catalog.audit("system", "report.build", {"experiment_id": args.experiment_id, "path": str(out)})
        print(f"report written: {out}")
        return 0
    if args.group == "vault":
        return _vault(args, catalog)
    ok, message = catalog.verify()
    print(message)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
