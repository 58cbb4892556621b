"""Full-text similarity: an inverted index in DataFrame form, ranked by BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RANGE = 1 << 16
GENESIS = "0" * 64  # what the first entry of a log links to


def query_terms(text: str, most: int = 12) -> list[str]:
    """The words of at least four letters, sorted; the first `most` of them are asked for."""
    return sorted({t.lower() for t in re.findall(r"[a-zA-Z]{4,}", text)})[:most]


def fts_query(text: str, most: int = 12) -> Column:
    """As query_terms(), of a column: any of these words."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z]{4,})"), 1), F.lower)
    return F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, most), " OR ")


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([a-z0-9]+)"), 1)


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of documents that hold any of the terms. One scan; only matching words are exploded and counted."""
    spark = docs.sparkSession
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = docs.select(key, tokens(text).alias("words"))
    sizes = rows.agg(F.count("*").alias("docs"), F.avg(F.size("words")).alias("mean_size"))
    asked = F.array(*(F.lit(t) for t in terms))
    hits = rows.select(key, F.size("words").alias("size"), F.explode(F.filter("words", lambda w: F.array_contains(asked, w))).alias("term"))
    tf = hits.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(sizes).select("term", F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean_size")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    return tf.join(F.broadcast(idf), "term").groupBy(key).agg(F.sum(part).alias("score"))  # idf: a row for each term asked


def entry_hash(*parts: Column) -> Column:
    """The hash of a log's entry: of the hash before it and of its own parts, each ended by a zero byte."""
    return F.sha2(F.concat(*(x for c in parts for x in (c, F.lit("\0")))), 256)


def chain_state(log: DataFrame) -> DataFrame:
    """seq, prev_ok, hash_ok of a hash-chained log (seq, ts, actor, event_type, payload_json, prev_hash, this_hash)."""
    # ranges of seq, about RANGE rows each; each begins after the last entry of the range before it that has any
    span = log.agg(
        F.min("seq").cast("double").alias("__low"),
        F.greatest(F.lit(1.0), (F.max("seq").cast("double") - F.min("seq").cast("double") + 1) * RANGE / F.greatest(F.count("seq"), F.lit(1))).alias("__width")
    )
    rows = log.crossJoin(F.broadcast(span)).withColumn("__part", F.floor((F.col("seq").cast("double") - F.col("__low")) / F.col("__width")))  # span: one row
    order = F.struct("seq", "this_hash")
    ends = rows.groupBy("__part").agg(F.max_by(F.struct("this_hash"), order).alias("__end"))
    edges = ends.select(F.col("__part").alias("__of"), F.lag("__end").over(Window.orderBy("__part")).alias("__edge"))  # a row for each range
    within = F.lag(F.struct("this_hash")).over(Window.partitionBy("__part").orderBy("seq", "this_hash"))
    log = rows.withColumn("__last", within).join(F.broadcast(edges), F.col("__part").eqNullSafe(F.col("__of")), "left")
    before = F.coalesce(F.coalesce("__last", "__edge")["this_hash"], F.lit(GENESIS))
    own = entry_hash(*(F.col(c) for c in ("prev_hash", "ts", "actor", "event_type", "payload_json")))
    return log.select("seq", (F.col("prev_hash") == before).alias("prev_ok"), (own == F.col("this_hash")).alias("hash_ok"))
