"""Near-duplicate documents by improved consistent weighted sampling (Ioffe 2010).

A document is the weighted set of its shingles of `N` words: weight = (1 + log
tf) * idf, with document frequencies counted over all documents (see blocks).
`BANDS * ROWS` samples are drawn; each picks the shingle with the least
log c - log y - r, where log y quantises the shingle's log weight at random, so
that two sets pick the same (shingle, level) with the probability of their
weighted Jaccard similarity. Rows of samples make bands; documents that share a
band are candidates and are verified by exact weighted Jaccard similarity.

Equal texts are one class before anything else, and only their representative
(smallest doc_id) goes on. Within a band's bucket nobody meets everybody: all
are compared with the bucket's first text (the one that shares most bands with
others: of copies, their original). Texts that are then in another component
than their bucket's first are joined exactly with all that share a band with
anyone, by a prefix filter on their rarest shingles. So no link between
candidates is lost. A text's comparisons are dealt out in groups of `GROUP`, so
that one with very many copies is the work of many tasks. Classes are connected
components of verified links.

Null and empty texts (no words) are copies of each other only if their bytes
are equal; they have no shingles and no other links. A text of fewer than N
words is one shingle. Rows without doc_id are classes of their own and kept.
Rows that share a doc_id are one document for classes, and all kept or dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import Block, Corpus, by_bucket
from barloom.llm.graph import components
from barloom.llm.shared import fan_out, get_counts, get_sorted, materialise, pieces, put_counts, put_sorted, tidied, with_documents_columns
from barloom.llm.words import chain, scramble, shingles, word_hashes

N = 5
BANDS, ROWS = 12, 4
LEAST = 0.8
GROUP = 256
_TABLE = 1 << 14
_rng = np.random.default_rng(31)
#: Draws of Gamma(2, 1), its logarithm, and of Uniform(0, 1); a shingle's bits pick among them.
_GAMMA = _rng.gamma(2, 1, _TABLE).astype(np.float32)
_UNIFORM = _rng.random(_TABLE).astype(np.float32)
_ODD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _weighted(block: Block):
    """(document, shingle hash, times) of the block, distinct and sorted by document then shingle."""
    h, text = word_hashes(block.data, block.offsets)
    grams, of, _ = shingles(h, text, N)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])))) if len(grams) else np.zeros(0, np.int64)
    return of[first], grams[first], np.diff(np.append(first, len(grams)))


def weights(times: np.ndarray, in_docs: np.ndarray, docs: int) -> np.ndarray:
    """(1 + log tf) * log(1 + docs / df): above zero also for what every document has."""
    return (1 + np.log(times)) * np.log1p(docs / np.maximum(in_docs, 1))


def sample(grams: np.ndarray, w: np.ndarray) -> np.ndarray:
    """BANDS * ROWS consistent samples of one weighted set, as hashes of (shingle, level)."""
    best, out = None, None
    logw = np.log(w).astype(np.float32)
    for at in range(0, len(grams), 512):  # what fits into a core's cache
        g, lw = grams[at : at + 512, None], logw[at : at + 512, None]
        x = g * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(29)
        r = _GAMMA[(x & np.uint64(_TABLE - 1)).astype(np.intp)]
        beta = _UNIFORM[((x >> np.uint64(14)) & np.uint64(_TABLE - 1)).astype(np.intp)]
        # c ~ Gamma(2, 1) from two uniforms: one of 23 bits, whose small values decide, and one of the table
        u = ((x >> np.uint64(41)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)
        v = _UNIFORM[((x >> np.uint64(26)) & np.uint64(_TABLE - 1)).astype(np.intp)]
        c = -np.log1p(-u) - np.log(np.maximum(v, np.float32(1e-7)))
        level = np.floor(lw / r + beta)
        a = np.log(c) - r * (level - beta) - r
        k = a.argmin(0)
        col = np.arange(len(_ODD))
        value, picked = a[k, col], scramble(g[k, 0] + level[k, col].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + _ODD)
        if best is None:
            best, out = value, picked
        else:
            less = value < best
            best, out = np.where(less, value, best), np.where(less, picked, out)
    return out


_SIGNED = "doc_id long, text_key string, bands array<long>, in_docs binary"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("bands", pa.list_(pa.int64())), ("in_docs", pa.binary())])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, bands, in_docs (document frequency of each of its shingles, in order), for every row."""
    corpus = Corpus(docs)
    bits, total = corpus.bits, corpus.rows

    def request(block: Block) -> dict[int, bytes]:
        _, grams, _ = _weighted(block)
        distinct, often = np.unique(grams, return_counts=True)
        out = {}
        for b, i, j in by_bucket(distinct, bits):
            head = put_sorted(distinct[i:j])
            out[b] = len(head).to_bytes(4, "little") + head + put_counts(often[i:j])
        return out

    def reply(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
        cut = [int.from_bytes(b[:4], "little") + 4 for b in bodies]
        hashes = [get_sorted(b[4:c]) for b, c in zip(bodies, cut)]
        distinct, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(number.ravel(), np.concatenate([get_counts(b[c:]) for b, c in zip(bodies, cut)]), len(distinct)).astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])
        return [put_counts(total[number.ravel()[e - len(h) : e]]) for e, h in zip(ends, hashes)], b""

    corpus.ask(request, reply)

    def sign(block: Block):
        of, grams, times = _weighted(block)
        distinct, number = np.unique(grams, return_inverse=True)
        got = block.answers.get(0, {})
        in_docs = np.concatenate([np.zeros(0, np.int64), *(get_counts(got[b]) for b in sorted(got))])[number.ravel()] if len(grams) else np.zeros(0, np.int64)
        w = weights(times, in_docs, total)
        cuts = np.searchsorted(of, np.arange(len(block.ids) + 1))
        rows, seen = [], {}
        raw = block.data.tobytes()
        for i, doc_id in enumerate(block.ids):
            key = hashlib.md5(raw[block.offsets[i] : block.offsets[i + 1]]).hexdigest()
            if key not in seen:
                a, b = cuts[i], cuts[i + 1]
                bands = []
                if b > a:
                    picked = sample(grams[a:b], w[a:b]).reshape(BANDS, ROWS)
                    bands = chain(np.arange(BANDS, dtype=np.uint64), *picked.T).astype(np.int64).tolist()
                seen[key] = bands, put_counts(in_docs[a:b])
            rows.append((doc_id, key, *seen[key]))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SIGNED_ARROW.types)], schema=_SIGNED_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SIGNED_ARROW.types)], schema=_SIGNED_ARROW)

    return materialise(corpus.map(sign, _SIGNED), "signatures")


def jaccard(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of (ascending shingles, weights, ...)."""
    k = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][k] == b[0]
    least = np.minimum(a[1][k[both]], b[1][both]).sum()
    return float(least / max(a[1].sum() + b[1].sum() - least, 1e-300))


def _vectors(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, body for the wanted representatives (rep, rep_key, in_docs)."""
    rows = docs.join(wanted, (docs["doc_id"] == wanted["rep"]) & (F.md5(docs["text"].cast("binary")) == wanted["rep_key"])).dropDuplicates(["rep"]).select("rep", "text", "in_docs")

    def work(batches):
        for batch in pieces(batches, 1 << 20):
            out = []
            for rep, text, in_docs in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                block = Block(0, [rep], np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                _, grams, times = _weighted(block)
                parts = put_sorted(grams), put_counts(times)
                out.append((rep, b"".join(len(x).to_bytes(4, "little") + x for x in parts) + in_docs))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["rep", "body"])

    return materialise(rows.mapInArrow(lambda batches: tidied(work(batches)), "rep long, body binary"), "vectors")


def _opened(body: bytes, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, weights, document frequencies."""
    a = 4 + int.from_bytes(body[:4], "little")
    b = a + 4 + int.from_bytes(body[a : a + 4], "little")
    in_docs = get_counts(body[b:])
    return get_sorted(body[4:a]), weights(get_counts(body[a + 4 : b]), in_docs, total), in_docs


def _compared(pairs: DataFrame, vectors: DataFrame, total: int) -> DataFrame:
    """The pairs (head, rep) with their similarity. A head with many partners is copied to groups of them."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("head").agg(F.count("*").alias("n"))
    groups = sizes.select("head", F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(groups, "head").select("head", "rep", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int").alias("part"))
    partners = dealt.join(vectors, "rep").select("head", "part", F.lit(1).alias("side"), "rep", "body")
    heads = groups.select(
        "head", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")
    ).join(vectors.withColumnRenamed("rep", "head"), "head").select("head", "part", F.lit(0).alias("side"), F.col("head").alias("rep"), "body")
    both = heads.unionByName(partners).repartition(fan_out(spark), "head", "part").sortWithinPartitions("head", "part", "side")

    def work(batches):
        own = None
        for batch in batches:
            out = []
            names = [batch.column(c).to_pylist() for c in ("head", "side", "rep")]
            bodies = batch.column("body")
            for k, (head, side, rep) in enumerate(zip(*names)):
                other = _opened(bodies[k].as_py(), total)
                if side == 0:
                    own = other
                else:
                    out.append((head, rep, jaccard(own, other)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["head", "rep", "similarity"])

    return both.mapInArrow(lambda batches: tidied(work(batches)), "head long, rep long, similarity double")


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), kept."""
    docs = with_documents_columns(docs)
    total = docs.count()
    signed = signatures(docs)
    exact = signed.filter("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("rep"))
    # a row for each representative; of several texts with its doc_id, that with the least key
    chosen = exact.groupBy("rep").agg(F.min("text_key").alias("rep_key"))
    reps = materialise(
        signed.join(chosen, (signed["doc_id"] == chosen["rep"]) & (signed["text_key"] == chosen["rep_key"])).select("rep", "rep_key", "bands", "in_docs").dropDuplicates(["rep"]),
        "reps"
    )
    banded = materialise(reps.select("rep", F.explode("bands").alias("band")), "banded")
    shared = materialise(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    joint = banded.join(shared, "band")
    # whom most texts share bands with comes first: the text that copies were made from, rather than one of the copies
    rank = joint.groupBy("rep").agg((-F.sum("n")).alias("n")).select("rep", F.struct("n", "rep").alias("rank"))
    joint = materialise(joint.select("band", "rep").join(rank, "rep"), "joint")
    inside = materialise(joint.join(joint.groupBy("band").agg(F.min("rank").alias("first")), "band").select("band", "rep", "rank", F.col("first.rep").alias("head")), "inside")
    wanted = reps.select("rep", "rep_key", "in_docs").join(inside.select("rep").distinct(), "rep", "left_semi")
    vectors = _vectors(docs, wanted)
    compared = materialise(_compared(inside.filter("rep <> head").select("head", "rep").distinct(), vectors, total), "compared")
    part = components(_links(compared, least))
    now = inside.join(part, F.col("rep") == F.col("node"), "left").select("band", "rep", "head", F.coalesce("component", "rep").alias("of"))
    own = now.filter("rep = head").select("band", F.col("of").alias("of_head"))
    every = now.select("rep", "of").distinct()
    apart = materialise(now.join(own, "band").filter("of <> of_head").select("rep", "of").distinct(), "apart")
    if apart.limit(1).count():
        further = _links(_compared(_joined(every, apart, vectors, total, least), vectors, total), least)
        part = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(further))
    # written, so that the join with all rows may split a text that very many documents have
    classes = materialise(exact.join(part, F.col("rep") == F.col("node"), "left").select("text_key", F.coalesce("component", "rep").alias("class_id")), "classes")
    out = signed.select("doc_id", "text_key").join(classes, "text_key", "left")
    found = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(found, F.col("class_id")).alias("class_id"), (~found | (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def _joined(every: DataFrame, apart: DataFrame, vectors: DataFrame, total: int, least: float) -> DataFrame:
    """Pairs (head, rep) of a text of `apart` and one of `every` in another component that may be similar enough.

    An exact filter. In the order of rising document frequency, two texts whose
    first common shingle is g overlap by no more than either weighs from g on;
    and they must overlap by least / (1 + least) of their joint weight. So g is
    within the first 1 - least of either text's weight, which is mostly what
    a text has for itself, and both must weigh enough from there on."""

    def prefixes(batches):
        def rows(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                names=["gram", "rep", "whole", "left"]
            )

        for batch in batches:
            out, bodies = [], batch.column("body")
            for k, rep in enumerate(batch.column("rep").to_pylist()):
                grams, w, in_docs = _opened(bodies[k].as_py(), total)
                order = np.lexsort((grams, in_docs))
                whole = w.sum()
                left = whole - (np.cumsum(w[order]) - w[order])
                n = int((left >= least * whole * (1 - 1e-9)).sum())
                out += zip(grams[order[:n]].astype(np.int64).tolist(), [rep] * n, [whole] * n, left[:n].tolist())
                if len(out) > 20_000:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    grams = materialise(vectors.mapInArrow(lambda batches: tidied(prefixes(batches)), "gram long, rep long, whole double, left double"), "prefixes")
    a = grams.join(apart, "rep").select("gram", *(F.col(c).alias(f"a_{c}") for c in ("rep", "whole", "left", "of")))
    b = grams.join(every, "rep").select("gram", *(F.col(c).alias(f"b_{c}") for c in ("rep", "whole", "left", "of")))
    enough = F.least("a_left", "b_left") >= least / (1 + least) * (F.col("a_whole") + F.col("b_whole")) * (1 - 1e-9)
    pairs = a.join(b, (a["gram"] == b["gram"]) & (F.col("a_of") != F.col("b_of")) & enough)
    return materialise(pairs.select(F.least("a_rep", "b_rep").alias("head"), F.greatest("a_rep", "b_rep").alias("rep")).distinct(), "pairs")


def _links(compared: DataFrame, least: float) -> DataFrame:
    return compared.filter(F.col("similarity") >= least).select(F.col("head").alias("a"), F.col("rep").alias("b"))


def op3_weighted_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each class (the smallest doc_id), all columns."""
    drop = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"))
    drop = materialise(drop.distinct(), "dropped")
    return docs.join(drop, docs["doc_id"].cast("long") == drop["dropped_id"], "left_anti")
