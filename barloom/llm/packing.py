"""Best-fit packing of token sequences by exact-complement hashing.

tokenise() cuts each document into pieces of at most `capacity` tokens.
plan_patterns() packs at the level of lengths: only how many pieces have each
length matters, at most `capacity` numbers however many documents there are. It
takes the longest length left, and looks up its gap among the single lengths,
the sums of pairs and the sums of triples that are still available; a
combination that fills the gap exactly is consumed as often as the counts
allow. Where none does, the longest piece that fits goes in (best fit), and the
smaller gap is looked up again. place() then deals pieces to the slots of these
patterns by their rank within their length.

Null text is an empty one; a document always has its end id, so no piece is
empty. Rows that share a doc_id, or have none, are each packed as they are. Long
texts are tokenised whole. Columns other than doc_id and text are not read, so
their names don't matter. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import CACHES, materialise, pieces, tidied, utf8, with_documents_columns

CAPACITY = 2048
CACHED_WORDS = 400_000
WINDOW = 2 << 20
_SPACE, _LETTER, _MARK, _DIGIT, _ODD = range(5)
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
_KEPT: dict = {}
CACHES["packing"] = [_KEPT]


def _classes(odd: bytes) -> np.ndarray:
    """What each byte of UTF-8 is; letters beyond ASCII are those that 0xC3 leads."""
    out = np.full(256, _ODD, np.uint8)
    for c in range(0x21, 0x7F):
        out[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[[0xC3, *range(0x80, 0xC0)]] = _LETTER
    out[list(odd)] = _ODD
    return out


class _Words:
    """Ids of the words met so far: word k has `counts[k]` of them, from `starts[k]` of `ids` on."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        # an apostrophe may take letters along, and the first byte of an added token may begin it
        self.classes = _classes(b"'" + bytes(t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.odd = bytes(np.flatnonzero(self.classes == _ODD).tolist())
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, "<u4") for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_plain(self, word: bytes) -> bool:
        return len(word.translate(None, self.odd)) == len(word) and b"\xc3\x97" not in word and b"\xc3\xb7" not in word

    def learn(self, new: list[bytes]) -> None:
        """Many words at a time, joined by spaces, and told apart by their last ids; odd ones by themselves."""
        plain, odd, ids, counts = [], [], [], []
        for word in new:
            (plain if word.isalpha() or self.is_plain(word) else odd).append(word)
        groups = [plain[i : i + 400] for i in range(0, len(plain), 400)]
        for group, got in zip(groups, self._encoded([b" ".join(g).decode() for g in groups])):
            last = np.flatnonzero(self.ends[got]) + 1
            if len(last) == len(group):
                ids.append(got)
                counts.append(np.diff(last, prepend=0))
            else:
                each = self._encoded([word.decode() for word in group])
                ids += each
                counts.append(np.array([len(e) for e in each], np.int64))
        each = self._encoded([word.decode() for word in odd])
        counts = np.concatenate([*counts, np.array([len(e) for e in each], np.int64)])
        first = len(self.ids) + np.cumsum(counts) - counts
        self.rows.update(zip(plain + odd, range(len(self.counts), len(self.counts) + len(counts))))
        self.ids, self.starts, self.counts = np.concatenate([self.ids, *ids, *each]), np.append(self.starts, first), np.append(self.counts, counts)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Rows of different words."""
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(self.rows) + len(new) > CACHED_WORDS:
            self.forget()
            new = np.arange(len(words))
        if len(new):
            self.learn([words[k] for k in new.tolist()])
            rows[new] = np.fromiter(map(self.rows.__getitem__, (words[k] for k in new.tolist())), np.int64, len(new))
        return rows

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in UTF-8, and how many there are before each text and after the last.

        The tokenizer never looks across white space, and splits runs of ASCII
        marks, digits one by one and runs of letters from one another; so these
        are the words that are looked up, in small letters. What white space
        parts and holds any other byte is one word, as it is.
        """
        if len(offsets) == 2 and len(data) > WINDOW:  # a long text: in parts that end in white space
            gaps = np.flatnonzero(self.classes[data] == _SPACE) + 1
            k = np.searchsorted(gaps, np.arange(WINDOW, len(data), WINDOW))
            cuts = np.unique(np.concatenate([[0], gaps[k[k < len(gaps)]], [len(data)]])).tolist()
            if len(cuts) > 2:
                parts = [self.encode(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])]
                return np.concatenate(parts), np.array([0, sum(map(len, parts))])
        kind = self.classes[data]
        lower = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
        beyond = np.flatnonzero(data[:-1] == 0xC3) + 1
        signs = beyond[(data[beyond] == 0x97) | (data[beyond] == 0xB7)]  # the signs of times and division
        kind[signs] = _ODD
        capitals = beyond[(data[beyond] >= 0x80) & (data[beyond] < 0x9F)]
        lower[capitals] = data[capitals] + 0x20
        edge = np.ones(len(data), bool)  # begins a word
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        text = np.zeros(len(data) + 1, bool)
        text[offsets] = True
        edge |= text[:-1]
        used = kind != _SPACE
        edge &= used
        if (kind == _ODD).any():
            begins = used.copy()  # what white space parts
            begins[1:] &= ~used[:-1] | text[1:-1]
            chunk = np.cumsum(begins, dtype=np.int32)
            odd = np.zeros(int(chunk[-1]) + 1, bool)
            odd[chunk[kind == _ODD]] = True
            within = odd[chunk] & used
            edge = np.where(within, begins, edge)
            lower = np.where(within, data, lower)
        at = np.flatnonzero(edge)
        packed = np.ascontiguousarray(lower[used])
        bounds = np.append(np.flatnonzero(edge[used]), len(packed))
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
        rows = self.look_up(words.dictionary.to_pylist())[words.indices.to_numpy()]
        counts = self.counts[rows]
        ends = np.append(0, np.cumsum(counts))
        ids = self.ids[np.repeat((self.starts[rows] - ends[:-1]).astype(np.int32), counts) + np.arange(ends[-1], dtype=np.int32)]
        return ids, ends[np.searchsorted(at, offsets)]


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document; (part, place) order pieces within their length."""

    def work(batches):
        if tokenizer_path not in _KEPT:
            _KEPT[tokenizer_path] = _Words(tokenizer_path)
        known = _KEPT[tokenizer_path]
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches, WINDOW):
            rows = []
            all_ids, bounds = known.encode(*utf8(batch.column(1)))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                raw = all_ids[a:b].tobytes() + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    n = len(ids) // 4
                    rows.append((doc_id, k, k * capacity, n, zlib.crc32(ids), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "place"), map(list, zip(*rows)))), schema=_PIECE_ARROW)

    return with_documents_columns(docs).mapInArrow(lambda batches: tidied(work(batches), "packing"), _PIECE)


_PIECE_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())]
)


class _Left:
    """How many pieces of each length are left, and an index of the sums that two and three of them make.

    pairs[g] and triples[g] count the combinations of lengths, available as often as they hold each length, that sum to
    g. They are kept up as lengths run out or come back: what a length adds depends on whether one, two or three of its
    pieces are left. So a gap that nothing fills costs one look; a filled one is taken apart only then."""

    def __init__(self, capacity: int):
        self.counts, self.level = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        self.pairs, self.triples = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)

    def _with(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """What length x adds to pairs and triples; self.pairs must not hold its pairs."""
        size, level = len(self.counts), int(self.level[x])
        pairs, triples = np.zeros(size, np.int64), np.zeros(size, np.int64)
        if level:
            others = (self.level > 0).astype(np.int64)
            others[x] = 0
            pairs[x:] = others[: size - x]
            triples[x:] = self.pairs[: size - x]
            if level > 1 and 2 * x < size:
                pairs[2 * x] += 1
                triples[2 * x :] += others[: size - 2 * x]
            if level > 2 and 3 * x < size:
                triples[3 * x] += 1
        return pairs, triples

    def add(self, x: int, n: int) -> None:
        self.counts[x] += n
        level = min(3, int(self.counts[x]))
        if level == self.level[x]:
            return
        self.pairs -= self._with(x)[0]
        self.triples -= self._with(x)[1]
        self.level[x] = level
        pairs, triples = self._with(x)
        self.pairs += pairs
        self.triples += triples

    def pair(self, gap: int, without: int = 0) -> tuple[int, int] | None:
        """(b, c) with b + c = gap, b as long as can be; one piece of length `without` is spoken for."""
        have = self.counts
        if without:
            have = have.copy()
            have[without] -= 1
        low = np.arange(1, gap // 2 + 1)
        ok = (have[low] > 0) & (have[gap - low] > 0)
        if gap % 2 == 0 and gap:
            ok[-1] &= have[gap // 2] > 1
        hit = np.flatnonzero(ok)
        return (gap - int(low[hit[0]]), int(low[hit[0]])) if len(hit) else None

    def triple(self, gap: int) -> tuple[int, int, int]:
        """(b, c, d) with b + c + d = gap, b as long as can be; there must be one."""
        for b in np.flatnonzero(self.counts[: gap - 1])[::-1].tolist():
            rest = self.pair(gap - b, b) if self.pairs[gap - b] else None
            if rest and rest[0] <= b:
                return (b, *rest)
        raise AssertionError(f"the index has a triple for {gap} that isn't there")

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap exactly: one, two or three of them."""
        if self.counts[gap]:
            return (gap,)
        if self.pairs[gap]:
            return self.pair(gap)
        return self.triple(gap) if self.triples[gap] else None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many sequences are filled so)]; uses every piece once."""
    index, out = _Left(capacity), []
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
        index.add(length, n)
    left = index.counts
    for a in range(capacity, 0, -1):
        while left[a]:
            held, gap, times = [a], capacity - a, int(left[a])
            index.add(a, -times)
            while gap:
                fill = index.complement(gap)
                if not fill:  # best fit: the longest that goes in
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    fill = (int(fits[-1]),)
                m = min([times, *(int(left[x]) // fill.count(x) for x in set(fill))])
                for x in held if times > m else ():  # the others of this length try another filling
                    index.add(x, times - m)
                times = m
                for x in fill:
                    index.add(x, -m)
                held += fill
                gap -= sum(fill)
            out.append((tuple(held), times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length: from which rank on, a run of its pieces goes to which sequences and offset."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), first, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        first += times
    return {x: dict(zip(("rank", "sequence", "offset"), np.array(r, np.int64).T)) for x, r in runs.items()}


def place(tokenised: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """tokenised pieces with sequence_id and offset."""
    spark = tokenised.sparkSession
    sizes = tokenised.groupBy("part", "length").agg(F.count("*").alias("n"))
    sums = tokenised.groupBy("length").agg(F.count("*").alias("n"))
    table = slots(plan_patterns({r["length"]: r["n"] for r in sums.collect()}, capacity))  # at most `capacity` rows
    # the rank of a partition's first piece of each length: a row for each partition and length
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = tokenised.join(starts, ["part", "length"])
    held = spark.sparkContext.broadcast(table)  # runs of lengths: bounded by the capacity, not by the data

    def work(batches):
        table = held.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("base").to_numpy() + batch.column("place").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                t = table[int(x)]
                k = np.searchsorted(t["rank"], rank[rows], "right") - 1
                sequence[rows] = t["sequence"][k] + rank[rows] - t["rank"][k]
                offset[rows] = t["offset"][k]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialise(tokenise(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs and their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
