"""Toxicity by cumulative-link ordinal regression.

Grades: 0 not toxic; a document labelled toxic has grade 1 or 2, by whether it
holds fewer or more words that mark toxic documents than the median of those it
is fitted on. (Marking words are much commoner in the sample's toxic documents,
by the log-likelihood ratio.) The
model is P(grade > k) = sigmoid(w.x - theta_k): one weight vector for all
thresholds, which are kept in order. x: log(1 + count) of hashed words and of
the first bytes of longer words. Output: expected severity, 0 to 2, and P(grade > 0).

It is fitted on at most `sample` labelled rows, by the hash of their doc_id;
scoring covers all rows. Null and empty texts score by the thresholds alone.
Rows without label only are scored. Repeated rows are each scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import pieces, tidied, utf8, with_documents_columns
from barloom.llm.words import prefix_hash, span_hash, scramble

WIDTH_BITS = 42
SAMPLE = 3000
HEAD = 6
REJECT_FROM = 0.2
_LETTERS = np.zeros(256, bool)
_LETTERS[np.r_[65:91, 97:123, 128:256, 48:58]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed word, value), sorted by text and word. Words: runs of letters, digits and bytes above 127."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    word, edge = _LETTERS[data], np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:n] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    text = np.searchsorted(offsets, starts, "right") - 1
    prefix = prefix_hash(data)
    hashes = [span_hash(prefix, starts, ends)]
    heads = starts[ends - starts > HEAD]
    hashes.append(scramble(span_hash(prefix, heads, heads + HEAD)))  # scrambled once more: not the word of these bytes
    text = np.concatenate((text, text[ends - starts > HEAD]))
    slot = np.concatenate(hashes) >> np.uint64(64 - WIDTH_BITS)
    key, counts = np.unique((text.astype(np.uint64) << np.uint64(WIDTH_BITS)) | slot, return_counts=True)
    text, slot = (key >> np.uint64(WIDTH_BITS)).astype(np.int64), (key & np.uint64((1 << WIDTH_BITS) - 1)).astype(np.int64)
    return text, slot, np.log1p(counts)


def _in_parts(texts: list[str], rows: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of many texts, in memory for few."""
    got = []
    for at in range(0, len(texts), rows):
        text, slot, value = features(*utf8(pa.array(texts[at : at + rows], pa.string())))
        got.append((text + at, slot, value))
    return tuple(np.concatenate(c) for c in zip(*got))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class OrdinalModel:
    slots: np.ndarray  # ascending hashed words that have a weight
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def above(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k), a row for each text."""
        text, slot, value = features(data, offsets)
        z = np.zeros(len(offsets) - 1)
        if len(self.slots) and len(slot):
            k = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            z = np.bincount(text, np.where(self.slots[k] == slot, self.weights[k], 0) * value, len(z))
        return _sigmoid(z[:, None] - self.thresholds)


def fit(texts: list[str], toxic: list[int], evidence: float = 5.0, rounds: int = 1000, rate: float = 0.03, ridge: float = 1e-5) -> OrdinalModel:
    """Gradient ascent (Adam) on the ordinal likelihood."""
    y01 = np.array(toxic, int)
    if not len(y01) or y01.min() == y01.max():
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([4.0, 6.0]) * (1 if not y01.sum() else -1) if len(y01) else np.array([4.0, 6.0]))
    text, slot, value = _in_parts(texts)
    slots, column = np.unique(slot, return_inverse=True)
    in_bad = np.bincount(column, y01[text], len(slots))
    in_all = np.bincount(column, minlength=len(slots)).astype(float)
    bad, everyone = y01.sum(), len(y01)
    expected = in_all * bad / everyone
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (
            np.where(in_bad > 0, in_bad * np.log(in_bad / expected), 0) + np.where(
                in_all > in_bad, (in_all - in_bad) * np.log(np.maximum(in_all - in_bad, 1e-9) / np.maximum(in_all - expected, 1e-9)), 0
            )
        )
    marking = (ratio > evidence * 2.5) & (in_bad > expected)
    found = np.bincount(text, marking[column] * value, len(y01))
    has = (y01 == 1) & (found > 0)
    grade = y01 + (y01 == 1) * (found > (np.median(found[has]) if has.any() else 1))
    use = ratio > evidence
    new = np.cumsum(use) - 1
    keep = use[column]
    text, column, value, slots = text[keep], new[column[keep]], value[keep], slots[use]
    w, theta = np.zeros(len(slots)), np.array([2.0, 3.0])
    first, second = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for k1 in range(1, rounds + 1):
        z = np.bincount(text, w[column] * value, len(y01))
        above = _sigmoid(z[:, None] - theta)
        upper, lower = np.column_stack([np.ones(len(z)), above]), np.column_stack([above, np.zeros(len(z))])
        p = np.maximum(np.take_along_axis(upper - lower, grade[:, None], 1)[:, 0], 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        dz = (np.take_along_axis(du, grade[:, None], 1)[:, 0] - np.take_along_axis(dl, grade[:, None], 1)[:, 0]) / p
        dt = np.zeros(2)
        for k in range(2):  # theta_k bounds grade k from above and grade k + 1 from below
            dt[k] = ((grade == k) * du[:, k + 1] / p).sum() - ((grade == k + 1) * du[:, k + 1] / p).sum()
        g = np.bincount(column, dz[text] * value, len(w)) / len(z) - ridge * w
        dt /= len(z)
        step = np.concatenate((g, dt))
        first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step * step
        step = rate * (first / (1 - 0.9**k1)) / (np.sqrt(second / (1 - 0.99**k1)) + 1e-8)
        w += step[:-2]
        theta += step[-2:]
        theta[1] = max(theta[1], theta[0] + 1e-3)
    return OrdinalModel(slots, w, theta)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, where=None) -> list[tuple[str, int]]:
    """At most `most` labelled rows, those whose doc_id hashes lowest: (text, label). The same rows whatever the partitioning.

    Where rows share a doc_id, the least label and the least text count, so repeats of a sampled row don't come to the driver."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    if where is not None:
        marked = marked.filter(where)
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = with_documents_columns(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return [(r["text"], r["label"]) for r in sorted(found.collect(), key=lambda r: r["doc_id"])]


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, p_toxic (P(grade > 0)), severity (expected grade)."""

    def work(batches):
        for batch in pieces(batches, 1 << 20):
            above = model.above(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(1))], names=["doc_id", "p_toxic", "severity"])

    return with_documents_columns(docs).mapInArrow(work, "doc_id long, p_toxic double, severity double")


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    rows = labelled_sample(docs, labels, "toxic", sample)
    return fit([t for t, _ in rows], [y for _, y in rows])


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, p_toxic, severity, toxic (rejected by the pipeline)."""
    docs = _read(spark, sf_dir, "documents")
    return score(docs, trained(docs, _read(spark, sf_dir, "labels"))).withColumn("toxic", F.col("p_toxic") >= REJECT_FROM)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those found toxic; every other row stays, with all its columns."""
    model = trained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))

    def work(batches):
        for batch in pieces(batches, 1 << 20):
            above = model.above(*utf8(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(above[:, 0] < REJECT_FROM))

    return docs.mapInArrow(lambda batches: tidied(work(batches)), docs.schema)
