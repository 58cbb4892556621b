"""The curated bar store and its snapshots.

Curated bars are partitioned by symbol; writing a symbol replaces its partition.
Only bars that pass the quality rules get there. A snapshot is a copy of chosen
symbols, named by the hash of its manifest; the manifest holds a hash of each
symbol's rows (not of file bytes, which Spark doesn't keep stable), and loading
a snapshot checks them."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import quality
from barloom.plans.catalog import Catalog, now, seal
from barloom.plans.config import canonical
from barloom.sources.bars import BARS, COLUMNS, PRICES


def archive_raw(catalog: Catalog, source: str, symbol: str, text: str, extension: str = "csv") -> Path:
    """The vendor's answer as it came."""
    target = catalog.at.raw / source / f"{symbol.upper()}.{extension}"
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, "utf-8")
    return target


def row_hashes(bars: DataFrame) -> DataFrame:
    """symbol, sha256, first, last: of each symbol's rows in the order of dates.

    Doubles are written in hexadecimal, every bit of them, so that no change goes unseen."""
    exact = lambda c: F.format_string("%a", c) if bars.schema[c].dataType.typeName() == "double" else F.col(c).cast("string")
    line = F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), *(exact(c) for c in (*PRICES, "volume")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", line.alias("line")))), lambda x: x["line"]), "\n")
    return bars.groupBy("symbol").agg(F.sha2(lines, 256).alias("sha256"), F.min("date").alias("first"), F.max("date").alias("last"))


def coverage(bars: DataFrame) -> DataFrame:
    """symbol, bars, first_bar, last_bar."""
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("date").alias("first_bar"), F.max("date").alias("last_bar"))


def write_curated(catalog: Catalog, bars: DataFrame) -> None:
    bars.select(*COLUMNS).repartition("symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(str(catalog.at.curated / "daily"))


def load_curated(catalog: Catalog, symbols: list[str]) -> DataFrame:
    """Bars of the symbols; others' partitions aren't read."""
    folder = catalog.at.curated / "daily"
    wanted = sorted({s.upper() for s in symbols})
    missing = [s for s in wanted if not (folder / f"symbol={s}").exists()]
    if missing:
        raise FileNotFoundError(f"the store has no bars of {', '.join(missing)}")
    return catalog.spark.read.schema(BARS).parquet(str(folder)).filter(F.col("symbol").isin(wanted)).select(*COLUMNS)


def check(catalog: Catalog, bars: DataFrame, limits: quality.Limits) -> DataFrame:
    """Findings, which also go to the log."""
    found = catalog.spark.createDataFrame(
        quality.issues(bars, limits).collect() or [],
        "symbol string, check_name string, severity string, detail string, range_start date, range_end date"
    )
    catalog.append("data_quality_log", found.select("symbol", "range_start", "range_end", "check_name", "severity", "detail", F.lit(now()).alias("created_at")).coalesce(1))
    return found


def admit(catalog: Catalog, bars: DataFrame, limits: quality.Limits, source: str, benchmark: str) -> dict[str, bool]:
    """Check bars; write those symbols that pass. Gives whether each did."""
    bars = bars.persist()
    found = check(catalog, bars, limits)
    passed = {r["symbol"]: r["passes"] for r in quality.passing(bars, found).collect()}
    good = [s for s, ok in passed.items() if ok]
    if good:
        some = bars.filter(F.col("symbol").isin(good))
        write_curated(catalog, some)
        for r in coverage(some).orderBy("symbol").collect():
            catalog.upsert_instrument(r["symbol"], source, r["first_bar"], r["last_bar"], r["symbol"] == benchmark.upper())
            catalog.audit("system", "data.curated", {"symbol": r["symbol"], "source": source, "bars": r["bars"]})
    bars.unpersist()
    return passed


def create_snapshot(catalog: Catalog, symbols: list[str], description: str) -> str:
    """The id; bars that were snapshotted before keep theirs."""
    bars = load_curated(catalog, symbols)
    rows = row_hashes(bars).orderBy("symbol").collect()
    manifest = {"frequency": "daily", "symbols": [{"symbol": r["symbol"], "sha256": r["sha256"]} for r in rows]}
    text = canonical(manifest)
    key = hashlib.sha256(text.encode()).hexdigest()[:16]
    target = catalog.at.snapshots / key
    if not target.exists():
        bars.repartition("symbol").write.mode("errorifexists").partitionBy("symbol").parquet(str(target))
        seal(target)
        catalog.append(
            "snapshots",
            [{"snapshot_id": key, "created_at": now(), "description": description, "frequency": "daily", "manifest_json": text, "coverage_start": min(r["first"] for r in rows), "coverage_end": max(r["last"] for r in rows)}]
        )
    return key


def load_snapshot(catalog: Catalog, snapshot_id: str) -> DataFrame:
    """Its bars, if their rows still have the manifest's hashes."""
    known = catalog.table("snapshots").filter(F.col("snapshot_id") == snapshot_id).collect()
    if not known:
        raise KeyError(f"there is no snapshot {snapshot_id}")
    bars = catalog.spark.read.schema(BARS).parquet(str(catalog.at.snapshots / snapshot_id)).select(*COLUMNS)
    want = catalog.spark.createDataFrame([(s["symbol"], s["sha256"]) for s in json.loads(known[0]["manifest_json"])["symbols"]], "symbol string, want string")
    bad = row_hashes(bars).join(want, "symbol", "full").filter("sha256 is null or want is null or sha256 <> want").collect()
    if bad:
        raise RuntimeError(f"snapshot {snapshot_id} isn't what was written: other hashes for {', '.join(sorted(r['symbol'] for r in bad))}")
    return bars
