"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased words (runs of letters, digits and non-ASCII characters).
All of an item's n-grams are its seeds, however many documents hold them; an
item of fewer than n words is one seed of its own length, looked for among the
documents' runs of that length. A document that holds a seed is aligned with
the item around the seed by Smith-Waterman, match 2, mismatch and gap -1;
similarity is the number of matching words on the best alignment over the
item's words. Pairs of at least `least` are leaks, and so are those whose
alignment scores `ENOUGH`, some fifteen words in a row: a passage of a long
item. Not aligned are only pairs with too few words in common for either, as
those of a phrase that everybody uses.

Items of equal text are one, under their smallest item_id and with their
number, so copies of items don't multiply rows. The items are worked through in
slices of bounded size; each slice is judged on all documents and alone, so the
size of slices doesn't change what is found. Null or empty items and texts have
no leaks, nor has an empty table on either side; texts are read whole, however
long. Repeated documents, also of one doc_id, each give their own rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import pieces, tidied, utf8, with_documents_columns
from barloom.llm.words import chain, prefix_hash, span_hash

N = 3
LEAST = 0.5
ENOUGH = 30
SLICE_BYTES = 16 << 20
_WORD = np.zeros(256, bool)
_WORD[np.r_[48:58, 97:123, 128:256]] = True
_BITS = 22
_MATCH, _OTHER = (2 << 24) + 1, -(1 << 24)  # a cell holds the score and, below it, the matches on the way
_LEAK = "doc_id long, item_id long, similarity double, matches int, item_words int, score int, same_items long"


def words(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words of a column of texts."""
    data, offsets = utf8(pc.utf8_lower(column))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, edge = _WORD[data], np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:n] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(offsets, starts, "right") - 1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, matching words) of the best local alignment."""
    if not len(item) or not len(text):
        return 0, 0
    ramp = np.arange(1, len(text) + 1, dtype=np.int64) * -_OTHER
    row, best = np.zeros(len(text) + 1, np.int64), 0
    for w in item:
        step = np.maximum(row[:-1] + np.where(text == w, _MATCH, _OTHER), row[1:] + _OTHER)
        row[1:] = np.maximum(np.maximum.accumulate(np.maximum(step, 0) + ramp) - ramp, 0)
        best = max(best, int(row.max()))
    return best >> 24, best & ((1 << 24) - 1)


def runs(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of n words within a text."""
    k = len(h) - n + 1
    first = np.flatnonzero(text[:k] == text[n - 1 :]) if k > 0 else np.zeros(0, np.int64)
    return chain(*(h[first + i] for i in range(n))) if len(first) else np.zeros(0, np.uint64), first


class Items:
    """A slice of the benchmark: words of all items in a row, and their seeds in one ascending array."""

    def __init__(self, ids: list, texts: list, n: int = N, same: list | None = None):
        h, item = words(pa.array([t or "" for t in texts], pa.string()))
        self.ids, self.same = ids, same or [1] * len(ids)
        cuts = np.searchsorted(item, np.arange(len(ids) + 1))
        size = np.diff(cuts)
        #: Lengths of seeds that any item has: n, and those of shorter items.
        self.lengths = sorted({int(min(m, n)) for m in np.unique(size) if m})
        grams, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for m in self.lengths:
            g, at = runs(h, item, m)
            own = np.minimum(size[item[at]], n) == m
            grams.append(g[own])
            first.append(at[own])
        grams, first = np.concatenate(grams), np.concatenate(first)
        order = np.argsort(grams, kind="stable")
        self.hash, first = grams[order], first[order]
        self.item = item[first] if len(first) else first
        self.place = first - cuts[self.item]
        self.flat, self.cuts = h, cuts
        self.distinct, self.start = np.unique(self.hash, return_index=True)
        self.start = np.append(self.start, len(self.hash))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.distinct >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of grams are the items', and the number of each in distinct."""
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.distinct, grams[at]), max(0, len(self.distinct) - 1))
        ok = self.distinct[k] == grams[at] if len(self.distinct) else np.zeros(len(at), bool)
        return at[ok], k[ok]


def slices(benchmark: DataFrame, most: int = SLICE_BYTES):
    """(ids, texts, how many items each stands for) of parts of the benchmark of about `most` bytes of text, chosen by the hash of the text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = rows.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("same"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // most)
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows], [r["same"] for r in rows]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b share, repeats counted: no alignment matches more."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    return int(np.minimum(n, m[at])[y[at] == x].sum()) if len(x) and len(y) else 0


def _near(items: Items, of: np.ndarray, first: np.ndarray, at: np.ndarray, k: np.ndarray):
    """(row, items, where in them, shifts) for each text with seeds: the places of each of its items, ascending."""
    begin, often = items.start[k], items.start[k + 1] - items.start[k]
    for one in np.split(np.arange(len(at)), np.flatnonzero(np.diff(of[at])) + 1):
        n = often[one]
        e = np.repeat(begin[one] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, shift = items.item[e], np.repeat(first[at[one]], n) - items.place[e]
        order = np.lexsort((shift, item))
        item, shift = item[order], shift[order]
        own, where = np.unique(item, return_index=True)
        yield int(of[at[one[0]]]), own, np.append(where, len(item)), shift


def leaks_of(items: Items, batch, least: float = LEAST):
    """(row, item, similarity, matches, item's words, score) of each leak in the batch's texts."""
    h, text = words(batch.column(batch.schema.get_field_index("text")))
    found = [runs(h, text, m) for m in items.lengths]
    hits = [items.find(g) for g, _ in found]
    first = np.concatenate([np.zeros(0, np.int64), *(p[at] for (_, p), (at, _) in zip(found, hits))])
    if not len(first):
        return
    k = np.concatenate([k for _, k in hits])
    order = np.argsort(first, kind="stable")
    first, k = first[order], k[order]
    of, at = text[first], np.arange(len(first))
    begin = np.searchsorted(text, np.arange(batch.num_rows + 1))
    for row, found, where, shifts in _near(items, of, first, at, k):
        whole = h[begin[row] : begin[row + 1]]
        sizes = items.cuts[found + 1] - items.cuts[found]
        heads = np.cumsum(sizes) - sizes
        flat = items.flat[np.repeat(items.cuts[found] - heads, sizes) + np.arange(sizes.sum())]
        shared = np.add.reduceat(np.isin(flat, whole).astype(np.int64), heads)
        for j in np.flatnonzero((shared >= least * sizes) | (2 * shared >= ENOUGH)):
            item, places = int(found[j]), shifts[where[j] : where[j + 1]]
            own = items.flat[items.cuts[item] : items.cuts[item + 1]]
            m = len(own)
            slack = m // 4 + 4
            gaps = np.flatnonzero(np.diff(places) > m + slack)
            best = (0, 0)
            for lo, hi in zip(places[np.append(0, gaps + 1)], places[np.append(gaps, len(places) - 1)]):
                window = h[max(begin[row], lo - slack) : min(begin[row + 1], hi + m + slack)]
                some = _common(own, window)
                if some >= least * m or 2 * some >= ENOUGH:
                    best = max(best, align(own, window))
            if best[1] >= least * m or best[0] >= ENOUGH:
                yield row, item, best[1] / m, best[1], m, best[0]


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, similarity, matches, item_words, score, same_items: a row for each leaking pair of a document and an item's text."""
    spark, docs = docs.sparkSession, with_documents_columns(docs)
    out = spark.createDataFrame([], _LEAK)
    for ids, texts, same in slices(benchmark):
        held = spark.sparkContext.broadcast(Items(ids, texts, n, same))  # SLICE_BYTES of text at most

        def work(batches, held=held):
            items = held.value
            for batch in pieces(batches, 1 << 20):
                rows = [(batch.column(0)[r].as_py(), items.ids[i], *rest, items.same[i]) for r, i, *rest in leaks_of(items, batch, least)]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                        names=["doc_id", "item_id", "similarity", "matches", "item_words", "score", "same_items"]
                    )

        out = out.union(docs.mapInArrow(work, _LEAK))
    return out


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that leak an item; every other row stays, with all its columns."""
    for ids, texts, _ in slices(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        held = spark.sparkContext.broadcast(Items(ids, texts))  # SLICE_BYTES of text at most

        def work(batches, held=held):
            items = held.value
            for batch in pieces(batches, 1 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in leaks_of(items, batch)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lambda batches, work=work: tidied(work(batches)), docs.schema)
    return docs
