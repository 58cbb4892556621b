"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders up to `order`,
P(w | h) = sum over k of weight[bucket][k] * count(h_k w) / count(h_k), down to
the uniform 1 / (V + 1), in which one share stands for all unknown words. The
bucket is that of the longest context seen: its order and the logarithm of its
frequency. Weights are learned by expectation-maximisation on held-out counts:
every training text is held out in turn (deleted), its own n-grams taken from
the counts, so all of the training text is both counted and held out. What EM
needs is how often each (bucket, estimates) combination occurs; estimates are
put in steps of half an octave for that, not for scoring.

Counting: every block of texts sends its distinct n-grams, hashed, to buckets of
hashes (see blocks); frequent words are one entry for each block. Words are
those of the contract, A-Z in small letters, with an end token after each text.

Null text is an empty one: its only token is the end. Rows with null doc_id
train. Repeated rows count as often as they occur. Without any training text
nothing is known, and every token has 1 / (V + 1) = 1; base_score is then 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import Block, Corpus, by_bucket
from barloom.llm.shared import get_counts, get_sorted, materialise, put_counts, put_sorted, with_documents_columns
from barloom.llm.words import chain, word_hashes

ORDER = 3
END, START = np.uint64(0x51ED270B7F4A7C15), np.uint64(0xA24BAED4963EE407)
STEPS = 128  # of half an octave; the last is for zero


def is_held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


def grams(block: Block, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(hash of each token's n-gram for n = 1 .. order, text of each token)."""
    h, text = word_hashes(block.data, block.offsets)
    n = len(block.ids)
    words = np.bincount(text, minlength=n)
    first = np.concatenate(([0], np.cumsum(words + 1)))
    token, of = np.full(len(h) + n, END), np.repeat(np.arange(n), words + 1)
    token[np.arange(len(h)) + text] = h
    out = [chain(np.full(len(token), np.uint64(1)), token)]
    held = [token]
    place = np.arange(len(token)) - first[of]
    for k in range(2, order + 1):
        before = np.full(len(token), START)
        before[k - 1 :] = token[: len(token) - k + 1]
        before[place < k - 1] = START
        held.append(before)
        out.append(chain(np.full(len(token), np.uint64(k)), *held[::-1]))
    return out, of


def _distinct(block: Block, order: int):
    """For each order: distinct hashes, each token's number among them; and the text and training mark of tokens."""
    hashes, of = grams(block, order)
    found = [np.unique(h, return_inverse=True) for h in hashes]
    return [f[0] for f in found], [f[1].ravel() for f in found], of, ~is_held_out(block.ids)


def _answer(block: Block, k: int, order: int) -> np.ndarray:
    """Counts of the block's distinct n-grams of one order, as the buckets gave them."""
    got = block.answers.get(0, {})
    return np.concatenate([np.zeros(0, np.int64), *(_section(got[b], k) for b in sorted(got))])


def _section(body: bytes, k: int) -> np.ndarray:
    for _ in range(k):
        body = body[4 + int.from_bytes(body[:4], "little") :]
    size = int.from_bytes(body[:4], "little")
    return get_counts(body[4 : 4 + size]) if size else np.zeros(0, np.int64)


def _framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unframed(body: bytes) -> list[bytes]:
    out = []
    while body:
        size = int.from_bytes(body[:4], "little")
        out.append(body[4 : 4 + size])
        body = body[4 + size :]
    return out


def _count(corpus: Corpus, order: int) -> tuple[int, int]:
    """Ask for all counts; gives tokens and distinct tokens of the training part."""
    bits = corpus.bits

    def request(block: Block) -> dict[int, bytes]:
        hashes, number, of, train = _distinct(block, order)
        out: dict[int, list[bytes]] = {}
        for k in range(order):
            counts = np.bincount(number[k], train[of], len(hashes[k])).astype(np.int64)
            for b, i, j in by_bucket(hashes[k], bits):
                out.setdefault(b, [b""] * (2 * order))[2 * k : 2 * k + 2] = put_sorted(hashes[k][i:j]), put_counts(counts[i:j])
        return {b: _framed(*parts) for b, parts in out.items()}

    def reply(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
        split = [_unframed(b) for b in bodies]
        answers: list[list[bytes]] = [[] for _ in bodies]
        about = []
        for k in range(order):
            hashes = [get_sorted(s[2 * k]) if s[2 * k] else np.zeros(0, np.uint64) for s in split]
            counts = [get_counts(s[2 * k + 1]) if s[2 * k] else np.zeros(0, np.int64) for s in split]
            distinct, number = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(number.ravel(), np.concatenate(counts), len(distinct)).astype(np.int64)
            at = 0
            for i, h in enumerate(hashes):
                answers[i].append(put_counts(total[number[at : at + len(h)]]) if len(h) else b"")
                at += len(h)
            about += [int((total > 0).sum()), int(total.sum())]
        return [_framed(*a) for a in answers], np.array(about, "<i8").tobytes()

    about = corpus.ask(request, reply)

    def summed(batches):
        total = np.zeros(2 * order, np.int64)
        for batch in batches:
            for body in batch.column("body").to_pylist():
                total += np.frombuffer(body, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([int(total[1])]), pa.array([int(total[0])])], names=["tokens", "distinct"])

    row = about.mapInArrow(summed, "tokens long, distinct long").agg(F.sum("tokens"), F.sum("distinct")).first()
    return row[0] or 0, row[1] or 0


def _step(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-2 * np.log2(np.maximum(p, 1e-300))), STEPS - 2), STEPS - 1).astype(np.int64)


def _estimates(counts: list[np.ndarray], contexts: list[np.ndarray], tokens: float | np.ndarray):
    """(maximum-likelihood estimates of the orders, bucket). counts, contexts: of each order from 1, contexts of order 1: all tokens."""
    p, bucket = [], np.zeros(len(counts[0]), np.int64)
    for k, (c, n) in enumerate(zip(counts, contexts)):
        p.append(np.divide(c, n, out=np.zeros(len(c)), where=n > 0))
        if k:
            bucket = np.where(n > 0, 64 * k + np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), bucket)
    return p, bucket


def _contexts(counts: list[np.ndarray], of: np.ndarray, tokens, texts) -> list[np.ndarray]:
    """How often each token's context occurred: the count of the n-gram that ends before it; at a text's start, the number of texts."""
    start = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
    out = [np.broadcast_to(np.asarray(tokens, float), of.shape)]
    for c in counts[:-1]:
        before = np.concatenate(([0], c[:-1])) if len(c) else c
        out.append(np.where(start, texts, before))
    return out


_FEATURES = "doc_id long, held_out boolean, n_tokens long, body binary, cell long, n long"
_FEATURES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("body", pa.binary()), ("cell", pa.int64()), ("n", pa.int64())])


def score(docs: DataFrame, order: int = ORDER, rounds: int = 40) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = with_documents_columns(docs)
    corpus = Corpus(docs)
    tokens, distinct = _count(corpus, order)
    texts = docs.filter(F.col("doc_id").isNull() | (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2)).count()

    def features(block: Block):
        hashes, number, of, train = _distinct(block, order)
        n = len(block.ids)
        counts = [_answer(block, k, order)[number[k]] for k in range(order)]
        sizes = np.bincount(of, minlength=n)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        rows = []
        for i, doc_id in enumerate(block.ids):
            body = _framed(*(put_counts(c[cuts[i] : cuts[i + 1]]) for c in counts))
            rows.append((doc_id, not train[i], int(sizes[i]), body, None, None))
        # each training text held out in turn: its own n-grams are taken from the counts
        mine = []
        for k in range(order):
            key = of * np.int64(len(hashes[k]) + 1) + number[k]
            _, at, often = np.unique(key, return_inverse=True, return_counts=True)
            mine.append(often[at.ravel()])
        use = train[of]
        left = [np.maximum(c - m, 0)[use] for c, m in zip(counts, mine)]
        p, bucket = _estimates(left, _contexts(left, of[use], np.maximum(tokens - sizes[of[use]], 0), max(texts - 1, 0)), tokens)
        cell = bucket
        for q in p:
            cell = cell * STEPS + _step(q)
        cells, often = np.unique(cell, return_counts=True)
        rows += [(None, None, None, None, int(c), int(m)) for c, m in zip(cells, often)]
        for at in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2000]), _FEATURES_ARROW.types)], schema=_FEATURES_ARROW)

    table = materialise(corpus.map(features, _FEATURES), "features")
    cells = table.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # buckets times steps at most
    weights = learn_weights(np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], float), order, 1 / (distinct + 1), rounds)
    base = float(tokens + distinct + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def final(batches):
        for batch in batches:
            out = []
            for doc_id, held_out, n, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "n_tokens", "body"))):
                counts = [get_counts(x) for x in _unframed(body)]
                p, bucket = _estimates(counts, _contexts(counts, np.zeros(n, np.int64), tokens, texts), tokens)
                w = weights_of(weights, bucket, order)
                mixed = w[:, 0] / (distinct + 1) + sum(w[:, k + 1] * q for k, q in enumerate(p))
                out.append((doc_id, held_out, n, int((counts[0] > 0).sum()), tokens, float(np.log10((counts[0] + 1) / base).sum()), float(np.log10(mixed).sum())))
            if out:
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return table.filter("cell is null").select("doc_id", "held_out", "n_tokens", "body").mapInArrow(
        final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def learn_weights(cells: np.ndarray, n: np.ndarray, order: int, uniform: float, rounds: int) -> dict[int, np.ndarray]:
    """Weights of the uniform and of each order, for each bucket, by EM; buckets that held-out text never has are not in it."""
    steps = []
    for _ in range(order):
        steps.append(cells % STEPS)
        cells = cells // STEPS
    p = np.column_stack([np.full(len(cells), uniform), *(np.where(s < STEPS - 1, 2.0 ** (-s / 2), 0) for s in steps[::-1])]) if len(cells) else np.zeros((0, order + 1))
    out = {}
    for b in np.unique(cells):
        rows = cells == b
        w, q, m = np.full(order + 1, 1 / (order + 1)), p[rows], n[rows]
        for _ in range(rounds):
            share = q * w
            w = (share / share.sum(1, keepdims=True) * m[:, None]).sum(0) + 1e-3  # no weight falls to nothing
            w /= w.sum()
        out[int(b)] = w
    return out


def weights_of(weights: dict[int, np.ndarray], bucket: np.ndarray, order: int) -> np.ndarray:
    """A row of weights for each token; without a weight for its bucket, that of the nearest bucket of the same order, or of shorter contexts."""
    out = np.zeros((len(bucket), order + 1))
    known = np.array(sorted(weights), np.int64)
    for b in np.unique(bucket):
        same = known[known // 64 == b // 64] if len(known) else known
        if not len(same):
            w = np.zeros(order + 1)
            w[0] = 1.0
        else:
            w = weights[int(same[np.argmin(np.abs(same - b))])]
        out[bucket == b] = w
    # an order whose context was never seen has no estimate: its share goes to the others
    for k in range(1, order):
        missing = (bucket // 64 < k) & (out[:, k + 1] > 0)
        spare = out[missing, k + 1]
        out[missing, k + 1] = 0
        out[missing] /= (1 - spare)[:, None]
    return out


def op1_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
