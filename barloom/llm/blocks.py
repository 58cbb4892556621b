"""Asking the whole corpus about what a block of texts holds.

A block is a run of rows of one scan partition, some MB of text. Round by round
each block sends one small request to each bucket (a range of 64-bit hashes);
what all blocks sent to a bucket meets in one task, which answers each block in
the order of its request. So a hash is sent once for each block, however often
it occurs, and a very frequent one is no more than one entry for each block.
Answers return to a block's task together with its texts.

Blocks are named by partition and place in it. Scans of a table deal out the
same rows each time, also when a lost executor's work is done again; each
block's answer carries the number and a hash of its texts, and a block that
doesn't match ends the job rather than give wrong counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import fan_out, materialise, squeeze, tidied, unsqueeze, utf8

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20  # of text for each bucket, however much there is
_ASKED = "block long, bucket int, kind int, body binary"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
TEXTS = -1


class Block:
    """ids (None where null), the texts' bytes and offsets, and answers: round -> {bucket: bytes}."""

    def __init__(self, name: int, ids: list, data: np.ndarray, offsets: np.ndarray, answers: dict | None = None):
        self.name, self.ids, self.data, self.offsets, self.answers = name, ids, data, offsets, answers or {}

    def mark(self) -> int:
        return zlib.crc32(self.data.tobytes(), len(self.ids))


def _cut(batches, size: int) -> Iterator[Block]:
    place = TaskContext.get().partitionId() << 32
    held, ids, got, k = [], [], 0, 0

    def out():
        data = np.concatenate([d for d, _ in held]) if held else np.zeros(0, np.uint8)
        offsets, at = [np.zeros(1, np.int64)], 0
        for d, o in held:
            offsets.append(o[1:] + at)
            at += len(d)
        return Block(place + k, ids, data, np.concatenate(offsets))

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        names, at = batch.column(0), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max(1, size - got), "right")) - 1)
            held.append((data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]))
            ids += names.slice(at, end - at).to_pylist()
            got += int(offsets[end] - offsets[at])
            at = end
            if got >= size or len(ids) >= 50_000:
                yield out()
                held, ids, got, k = [], [], 0, k + 1
    if ids:
        yield out()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def _texts(block: Block) -> tuple:
    body = squeeze(np.diff(block.offsets).astype("<i8").tobytes() + block.data.tobytes())
    known = np.array([i is not None for i in block.ids], "u1").tobytes()
    values = np.array([i or 0 for i in block.ids], "<i8").tobytes()
    head = squeeze(known + values)
    return block.name, 0, TEXTS, len(block.ids).to_bytes(8, "little") + len(head).to_bytes(8, "little") + head + body


def _open(name: int, body: bytes, answers: dict) -> Block:
    n, m = int.from_bytes(body[:8], "little"), int.from_bytes(body[8:16], "little")
    head = unsqueeze(body[16 : 16 + m])
    known, values = np.frombuffer(head, "u1", n), np.frombuffer(head, "<i8", n, n)
    raw = unsqueeze(body[16 + m :])
    lengths = np.frombuffer(raw, "<i8", n)
    ids = [int(v) if k else None for k, v in zip(known, values)]
    return Block(name, ids, np.frombuffer(raw, np.uint8, -1, 8 * n), np.concatenate(([0], np.cumsum(lengths))), answers)


class Corpus:
    """docs: a DataFrame of doc_id and text; see with_documents_columns."""

    def __init__(self, docs: DataFrame, size: int = BLOCK_BYTES, bucket: int = BUCKET_BYTES):
        self.docs, self.size, self.spark = docs, size, docs.sparkSession
        self.parts = fan_out(self.spark)
        measured = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.rows, self.bytes = int(measured[0]), int(measured[1])
        #: Buckets are ranges of hashes, as many as there are shares of `bucket` bytes of text: what one
        #: task holds doesn't grow with the corpus.
        self.bits = max(6, int(np.ceil(np.log2(max(1, self.bytes / bucket)))))
        self.rounds: list[DataFrame] = []

    def _joined(self) -> DataFrame:
        size = self.size

        def texts(batches):
            for block in _cut(batches, size):
                yield _rows([_texts(block)])

        df = self.docs.mapInArrow(lambda batches: tidied(texts(batches)), _ASKED)
        for got in self.rounds:
            df = df.unionByName(got)
        return df.repartition(self.parts, "block").sortWithinPartitions("block", "kind", "bucket")

    def map(self, work: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """work on each block, with the answers of all rounds so far; without rounds straight from the scan."""
        size, rounds = self.size, len(self.rounds)
        if not rounds:

            def scan(batches):
                for block in _cut(batches, size):
                    yield from work(block)

            return self.docs.mapInArrow(lambda batches: tidied(scan(batches)), schema)

        def joined(batches):
            name, body, answers = None, None, {}

            def done():
                block = _open(name, body, {k: {b: x[4:] for b, x in v.items()} for k, v in answers.items()})
                mark = block.mark()
                if any(int.from_bytes(x[:4], "little") != mark for v in answers.values() for x in v.values()):
                    raise ValueError("a scan partition held other rows than before; give a table or a checkpointed DataFrame")
                return work(block)

            for batch in batches:
                for who, bucket, kind, what in zip(*(c.to_pylist() for c in batch.columns)):
                    if who != name:
                        if body is not None:
                            yield from done()
                        name, body, answers = who, None, {}
                    if kind == TEXTS:
                        body = what
                    else:
                        answers.setdefault(kind, {})[bucket] = what
            if body is not None:
                yield from done()

        return self._joined().mapInArrow(lambda batches: tidied(joined(batches)), schema)

    def ask(self, request: Callable[[Block], dict[int, bytes]], reply: Callable[[list[bytes]], tuple[list[bytes], bytes]]) -> DataFrame:
        """One round. request gives bytes for buckets; reply gets all that was sent to a bucket, and gives an answer to each, and bytes about the bucket itself, which are in the body of the returned DataFrame (a row for each bucket)."""
        k = len(self.rounds)

        def asked(block: Block):
            mark = block.mark().to_bytes(4, "little")
            rows = [(block.name, bucket, k, mark + body) for bucket, body in request(block).items()]
            if rows:
                yield _rows(rows)

        def answered(batches):
            now, names, bodies = None, [], []

            def done():
                replies, about = reply([b[4:] for b in bodies])
                rows = [(n, now, k, b[:4] + r) for n, b, r in zip(names, bodies, replies)]
                for i in range(0, len(rows), 500):
                    yield _rows(rows[i : i + 500])
                yield _rows([(None, now, k, about)])

            for batch in batches:
                for name, bucket, _, body in zip(*(c.to_pylist() for c in batch.columns)):
                    if bucket != now:
                        if names:
                            yield from done()
                        now, names, bodies = bucket, [], []
                    names.append(name)
                    bodies.append(body)
            if names:
                yield from done()

        sent = self.map(asked, _ASKED).repartition(self.parts, "bucket").sortWithinPartitions("bucket", "block")
        got = materialise(sent.mapInArrow(lambda batches: tidied(answered(batches)), _ASKED), f"round{k}")
        self.rounds.append(got.filter(F.col("block").isNotNull()))
        return got.filter(F.col("block").isNull()).select("bucket", "body")


def by_bucket(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending hashes, for buckets that have any."""
    if not len(hashes):
        return []
    edges = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.concatenate(([0], edges, [len(hashes)]))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]
