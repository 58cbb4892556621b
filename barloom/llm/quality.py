"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed with each, in blocks of `BLOCK` bytes, so that a
dictionary counts as much at the end of a long text as in a short one. The
score is a logistic calibration of one number, the normalised difference of the
sizes, (bad - good) / (bad + good), fitted on rows that are not in the
dictionaries; nothing else about a text goes into it. A dictionary is
`DICTIONARY` bytes of labelled text, dealt evenly over its texts. Dictionaries
and calibration use at most `sample` labelled rows of each label, those whose
doc_id hashes lowest, one text for each doc_id (the least, where several rows
share it).

Null and empty texts have difference 0 and get the calibration's score for it.
Equal texts have equal scores, so repeated rows do; a row without doc_id is
scored and isn't held out. Texts are read whole, however long; an empty table
gives an empty one. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import pieces, utf8, with_documents_columns

BLOCK = 2048
LEVEL = 7
SAMPLE = 1500
DICTIONARY = 2 << 20
CUT = 0.3


def is_held_out(doc_id=None):
    """Rows from which no label is learnt."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


@dataclass
class CompressionModel:
    """The two dictionaries, and the calibration: log odds = offset + slope * difference."""

    good: bytes
    bad: bytes
    offset: float = 0.0
    slope: float = 0.0

    def tools(self) -> list[zstandard.ZstdCompressor]:
        held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.good, self.bad)]
        for d in held:
            d.precompute_compress(level=LEVEL)
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in held]

    def differences(self, data: np.ndarray, offsets: np.ndarray, tools=None) -> np.ndarray:
        """(bad - good) / (bad + good) of each text's compressed sizes."""
        good, bad = (tool.compress for tool in tools or self.tools())
        view, out = memoryview(np.ascontiguousarray(data)), np.zeros(len(offsets) - 1)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            parts = [view[at : min(b, at + BLOCK)] for at in range(a, b, BLOCK)]
            g, h = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
            out[i] = (h - g) / (h + g) if parts else 0.0
        return out

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * difference, -35, 35)))


def _dictionary(texts: list[bytes]) -> bytes:
    """`DICTIONARY` bytes: the first block of every text, then the second ones, and so on; first ones last, where they are cheapest to refer to."""
    out, size, at = [], 0, 0
    while size < DICTIONARY and any(len(t) > at for t in texts):
        for t in texts:
            part = t[at : at + min(BLOCK, DICTIONARY - size)]
            out.append(part)
            size += len(part)
        at += BLOCK
    return b"".join(out[::-1]) or b" " * 16


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[float, float]:
    """(offset, slope) by Newton's method, x scaled to unit spread."""
    spread = max(float(x.std()), 1e-9)
    x = np.column_stack([np.ones(len(x)), x / spread])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -4, 4)
    return float(w[0]), float(w[1] / spread)


def fit(rows: list[tuple[str, int]]) -> CompressionModel | None:
    """rows in a fixed order: every other one is in the dictionaries, the others calibrate."""
    by = {y: [t.encode() for t, q in rows if q == y] for y in (0, 1)}
    if min(len(v) for v in by.values()) < 4:
        return None
    model = CompressionModel(*(_dictionary(by[y][::2]) for y in (1, 0)))
    rest = [(t, y) for y in (0, 1) for t in by[y][1::2]]
    x = model.differences(*utf8(pa.array([t for t, _ in rest], pa.binary())))
    model.offset, model.slope = _logistic(x, np.array([v for _, v in rest], float))
    return model


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn=None) -> tuple[CompressionModel | None, float]:
    """The model, and the share of good rows among the labelled ones it may learn from (0.5 without any); the sample has another."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    marked = marked.filter("y in (0, 1)").dropna().groupBy("doc_id").agg(F.min("y").alias("y")).filter(~is_held_out() if learn is None else learn)
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    picked = None
    for y in (0, 1):
        some = marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.union(some)
    # a text for each id: however often a sampled row is repeated, 2 * sample texts come to the driver
    found = with_documents_columns(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = [(r["text"], r["y"]) for r in sorted(found.collect(), key=lambda r: r["doc_id"])]
    model = fit(rows)
    if model is not None:
        own = sum(y for _, y in rows) / len(rows)
        model.offset += float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return model, share


def score(docs: DataFrame, model: CompressionModel | None) -> DataFrame:
    """doc_id, score."""

    def work(batches):
        tools = model.tools() if model else None
        for batch in pieces(batches, 2 << 20):
            data, offsets = utf8(batch.column(1))
            s = model.score(model.differences(data, offsets, tools)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return with_documents_columns(docs).mapInArrow(work, "doc_id long, score double")


def op6_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, _ = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
