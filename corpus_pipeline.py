"""From raw documents to packed training sequences.

Toxic documents go, then near copies, then repeated passages, then documents
that leak benchmark items; what is left is packed. Each stage is written as
Parquet to the shared folder and reread, so a lost executor or a restarted
driver repeats one stage at most. Nulls, ties, repeated rows, empty tables and
further columns are as the stages' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, minhash, packing, suffix_dedup, toxicity
from barloom.llm.shared import discard, materialise, scratch

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", minhash.stage),
    ("repeated_passages", suffix_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]
#: The stages are models, searches and a tokenizer: no SQL. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as keep:  # what a stage wrote on its way goes, and so does its input
            after = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(after)
        discard(docs)
        docs = after
    return docs
