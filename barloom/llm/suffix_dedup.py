"""Removal of repeated byte strings by suffix arrays, sorted through Lyndon groups.

suffix_array() is a grouping construction after Baier (2016). Suffixes are
grouped by the longest Lyndon word they begin with. First phase, groups in
descending order: when a group is final, the word of each of its suffixes is
appended to the word that ends just before it, which belongs to the previous
smaller suffix; suffixes that gained the same runs leave their group for one
right above it. Second phase, suffixes in ascending order: each emits those
whose word ends where it begins, into the next free place of their groups.
Neither phase renames or recurses.

Finding repeats of `LENGTH` bytes in a corpus: every window of that length has
an anchor, the 16 bytes in it with the least hash (the first of equals). Equal
windows have equal anchors at equal places, so a run of windows with one anchor
(a context: some 300 bytes) need only meet contexts with the same anchor
content. Anchor contents that occur once are left out, by a round over all
documents (see blocks); in a second round the contexts go to buckets of anchor
contents, equal contexts of a block as one with their number. A bucket cuts
its distinct contexts into symbols of 32 bytes, in step with their anchors, and
sorts the suffixes of their concatenation. A window holds at least 5 whole
symbols; runs of the suffix array that agree on 5 symbols have windows that
may be equal, and what is left of these windows, less than 32 bytes on either
side, is compared by hashes of whole windows, weighted with their numbers.

Null texts are empty; texts shorter than `LENGTH` bytes lose nothing. Equal
rows, also of one doc_id, are repeats of each other. Rows keep their doc_id,
null or not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import Block, Corpus, by_bucket
from barloom.llm.shared import get_counts, get_sorted, put_counts, put_sorted, squeeze, unsqueeze, with_documents_columns
from barloom.llm.words import parts, powers, prefix_hash, scramble, span_hash

LENGTH = 200
ANCHOR = 16
SYMBOL = 32
WHOLE = (LENGTH - SYMBOL + 1) // SYMBOL  # symbols that any window holds whole
_TABLE = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)
_OTHER = np.random.default_rng(78).integers(0, 2**64, 256, dtype=np.uint64)
HOT = 20_000
_BATCH = 120_000  # symbols sorted at a time, at least a whole anchor content's


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of integers whose last one occurs nowhere else and is the least."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # groups: members, length of their common word, neighbours in the order of groups
    group, members, length, below, above = [0] * n, [], [], [], []
    of: dict[int, int] = {}
    for k, symbol in enumerate(sorted(set(text))):
        of[symbol] = k
        members.append([])
        length.append(1)
        below.append(k - 1)
        above.append(k + 1)
    for i, symbol in enumerate(text):
        g = of[symbol]
        group[i] = g
        members[g].append(i)
    above[-1] = -1
    final = [False] * len(members)
    owner = [i - 1 for i in range(n + 1)]  # owner[e]: whose word ends before e, not counting finished ones inside it
    follows = [0] * n  # where the word of a suffix ends
    order = []
    now = len(members) - 1
    while now >= 0:
        final[now] = True
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        if own:
            order.append(now)
            size = length[now]
            gains: dict[int, list] = {}
            for i in own:
                follows[i] = i + size
                before = owner[i]
                if before >= 0 and group[before] != now and not final[group[before]]:
                    end, times = i + size, 1
                    while end < n and group[end] == now:
                        end += size
                        times += 1
                    owner[end] = before
                    gains.setdefault(group[before], []).append((times, before))
            for g, moved in gains.items():
                by_times: dict[int, list] = {}
                for times, i in moved:
                    by_times.setdefault(times, []).append(i)
                after = g
                for times in sorted(by_times):
                    new = len(members)
                    members.append(by_times[times])
                    length.append(length[g] + times * size)
                    final.append(False)
                    below.append(after)
                    above.append(above[after])
                    if above[after] >= 0:
                        below[above[after]] = new
                    above[after] = new
                    after = new
                    for i in by_times[times]:
                        group[i] = new
        # leave the order: only groups below matter from here on
        down = below[now]
        if down >= 0:
            above[down] = -1
        now = down
    order.reverse()
    front, at = [0] * len(members), 0
    for g in order:
        front[g] = at
        at += len(members[g])
    head, link = [-1] * (n + 1), [-1] * n
    for i in range(n):
        e = follows[i]
        link[i] = head[e]
        head[e] = i
    out = [0] * n
    out[front[group[n - 1]]] = n - 1
    for k in range(n):
        i = head[out[k]]
        while i >= 0:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            i = link[i]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts: (hash of the anchor, its place, first window, last window, hash of the context), in order of place."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, np.uint64)
    prefix = prefix_hash(data, _TABLE)
    at = np.arange(n - ANCHOR + 1)
    h = span_hash(prefix, at, at + ANCHOR)
    least = (h & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    span, width = LENGTH - ANCHOR + 1, 1
    whole = least
    while 2 * width <= span:
        whole = np.minimum(whole[:-width], whole[width:])
        width *= 2
    whole = np.minimum(whole[: len(whole) - (span - width)], whole[span - width :]) if span > width else whole
    anchor = (whole & np.uint64((1 << 24) - 1)).astype(np.int64)  # of the window that begins here
    ok = np.zeros(n - LENGTH + 2, bool)
    lengths = np.diff(offsets)
    for start, size in zip(offsets[:-1][lengths >= LENGTH].tolist(), lengths[lengths >= LENGTH].tolist()):
        ok[start : start + size - LENGTH + 1] = True
    ok = ok[:-1]
    new = ok & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~ok[:-1]))
    last = ok & np.concatenate(((anchor[1:] != anchor[:-1]) | ~ok[1:], [True]))
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    place = anchor[first]
    whole = span_hash(prefix, first, last + LENGTH) + scramble((place - first).astype(np.uint64))
    return scramble(h[place]), place, first, last, whole  # scrambled: anchors have small hashes, buckets are ranges


def contexts(block: Block) -> tuple[np.ndarray, ...]:
    """anchors() of a whole block, in memory for a part of it; equal for equal blocks."""
    got, offsets = [], block.offsets
    for i, j in parts(offsets):
        start = offsets[i]
        part = block.data[start : offsets[j]]
        step = (1 << 24) - LENGTH
        if len(part) <= step + LENGTH:
            h, place, first, last, whole = anchors(part, offsets[i : j + 1] - start)
            got.append((h, place + start, first + start, last + start, whole))
        else:  # one very long text: windows in parts
            for at in range(0, max(1, len(part) - LENGTH + 1), step):
                some = part[at : at + step + LENGTH - 1]
                h, place, first, last, whole = anchors(some, np.array([0, len(some)]))
                got.append((h, place + start + at, first + start + at, last + start + at, whole))
    return tuple(np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))


ONCE, AGAIN, OFTEN = 1, 2, 3  # what the first round says of an anchor content


def _told(block: Block):
    """(the block's contexts, what the first round says of their anchors)."""
    h, place, first, last, _ = contexts(block)
    _, number = np.unique(h, return_inverse=True)
    got = block.answers.get(0, {})
    told = np.concatenate([np.zeros(0, np.int64), *(get_counts(got[b]) for b in sorted(got))])
    return h, place, first, last, told[number.ravel()] if len(h) else np.zeros(0, np.int64)


def _windows(block: Block, first: np.ndarray, last: np.ndarray):
    """(places of all windows of these contexts, distinct 128-bit hashes in two halves, ascending, the number of each window among them)."""
    runs = last - first + 1
    begin = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    a, b = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.unique(np.append(np.searchsorted(begin, np.arange(0, len(block.data) + 1, 1 << 20)), len(begin))))):
        start = int(begin[lo])
        some, at = block.data[start : int(begin[hi - 1]) + LENGTH], begin[lo:hi] - start
        a[lo:hi] = span_hash(prefix_hash(some, _TABLE), at, at + LENGTH)
        b[lo:hi] = span_hash(prefix_hash(some, _OTHER), at, at + LENGTH)
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    number = np.zeros(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return begin, a[order[new]], b[order[new]], number


def _repeated(h, place, first, last, block: Block):
    """The distinct ones of these contexts: (order of hashes, number among the distinct, representative of each distinct)."""
    size = last - first + LENGTH
    # distinct contexts: anchor, place of the anchor in it, and two hashes of its bytes
    marks = np.zeros(len(h), np.uint64)
    again = np.zeros(len(h), np.uint64)
    for i, (a, s) in enumerate(zip(first.tolist(), size.tolist())):
        raw = hashlib.blake2b(block.data[a : a + s].tobytes(), digest_size=16).digest()
        marks[i], again[i] = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")
    order = np.lexsort((again, marks, place - first, h))
    same = np.ones(len(h), bool)
    if len(h):
        o = order
        same[1:] = (h[o[1:]] != h[o[:-1]]) | (marks[o[1:]] != marks[o[:-1]]) | (again[o[1:]] != again[o[:-1]]) | ((place - first)[o[1:]] != (place - first)[o[:-1]])
    number = np.cumsum(same) - 1
    return order, number, order[same] if len(h) else order


def find(hashes: np.ndarray, shift: np.ndarray, runs: np.ndarray, times: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows of distinct contexts occur more than once.

    shift: place of the anchor in the context; runs: number of windows; data, starts: their bytes.
    Gives a mark for each window, contexts one after another."""
    total = int(runs.sum())
    base = np.concatenate(([0], np.cumsum(runs)))
    sizes = runs + LENGTH - 1
    # symbols in step with the anchor
    lead = shift % SYMBOL
    count = (sizes - lead) // SYMBOL
    context = np.repeat(np.arange(len(runs)), count)
    within = np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    at = starts[context] + lead[context] + within * SYMBOL
    prefix = prefix_hash(data, _TABLE)
    words = _words8(data)
    _, rank = np.unique(span_hash(prefix, at, at + SYMBOL), return_inverse=True)
    rank = _verified(rank.ravel(), words, at[:, None] + np.arange(0, SYMBOL, 8))
    # each context ends with a number of its own, below all symbols; the last is the least
    n = len(runs)
    ends = np.cumsum(count + 1) - 1
    text = np.zeros(len(at) + n, np.int64)
    text[ends] = n - 1 - np.arange(n)
    slot = np.arange(len(at)) + context
    text[slot] = rank + n
    where, window = np.full(len(text), -1), np.full(len(text), -1)
    where[slot] = context
    window[slot] = lead[context] + within * SYMBOL  # the symbol's place in its context
    sa = np.array(suffix_array(text.tolist()), np.int64)
    # runs of the suffix array that agree on WHOLE symbols, by their number
    padded = np.concatenate((text, np.full(WHOLE, -1)))
    agree = np.ones(len(sa) - 1, bool)
    a, b = sa[:-1], sa[1:]
    for k in range(WHOLE):
        one = padded[np.minimum(a + k, len(text))]
        agree &= (one == padded[np.minimum(b + k, len(text))]) & (one >= n)
    run = np.cumsum(np.concatenate(([True], ~agree))) - 1
    shared = np.zeros(len(sa), bool)
    shared[:-1] |= agree
    shared[1:] |= agree
    enough = np.zeros(len(sa), bool)  # alone in its run, but its context occurs more than once
    enough[where[sa] >= 0] = times[where[sa[where[sa] >= 0]]] > 1
    use = (shared | enough) & (where[sa] >= 0)
    chosen, run = sa[use], run[use]
    # windows whose first whole symbol is this one: `lead` bytes before it, and what follows the run's symbols
    c, lead = where[chosen], np.arange(SYMBOL)
    begin = window[chosen][:, None] - lead
    ok = (begin >= 0) & (begin < runs[c][:, None])
    c, run, lead = (np.broadcast_to(x, begin.shape)[ok] for x in (c[:, None], run[:, None], lead[None, :]))
    begin = begin[ok]
    s = starts[c] + begin
    first, rest = s + lead, s + lead + WHOLE * SYMBOL
    mark = scramble(span_hash(prefix, s, first) + (run * SYMBOL + lead).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) ^ span_hash(prefix, rest, s + LENGTH)
    _, number = np.unique(mark, return_inverse=True)
    # equal marks: the same run and lead, and equal bytes on both sides; 8 bytes at a time from either end
    ends = np.column_stack([s, s + 8, s + 16, s + 24, s + LENGTH - 40, s + LENGTH - 32, s + LENGTH - 24, s + LENGTH - 16, s + LENGTH - 8])
    number = _verified(number.ravel(), words, ends, run * SYMBOL + lead)
    weight = np.bincount(number, times[c]) if len(mark) else np.zeros(0)
    out = np.zeros(total, bool)
    out[base[c] + begin] = weight[number] > 1
    return out


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; short at the end."""
    raw = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))


def _verified(number: np.ndarray, words: np.ndarray, at: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """number, which says what has equal hashes, split where the bytes at `at` (rows of places of 8 bytes) or the groups differ."""
    if not len(number):
        return number
    rep = np.zeros(int(number.max()) + 1, np.int64)
    rep[number[::-1]] = np.arange(len(number))[::-1]
    mine = rep[number]
    same = np.ones(len(number), bool) if group is None else group == group[mine]
    for k in range(at.shape[1]):
        same &= words[at[:, k]] == words[at[mine, k]]
    if same.all():
        return number
    # two contents with one hash: all are told apart by their bytes
    keys = [words[at[:, k]] for k in range(at.shape[1])] + ([] if group is None else [group])
    order = np.lexsort(keys)
    new = np.zeros(len(number), np.int64)
    new[order[1:]] = np.cumsum(np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0))
    return new


def _pack(h, place, first, last, rep, times, data) -> bytes:
    head = np.concatenate([place[rep] - first[rep], last[rep] - first[rep] + 1, times]).astype("<i4").tobytes()
    body = b"".join(data[a : b + LENGTH].tobytes() for a, b in zip(first[rep].tolist(), last[rep].tolist()))
    return len(rep).to_bytes(4, "little") + squeeze(h[rep].astype("<u8").tobytes() + head + body)


def _unpack(blob: bytes):
    n = int.from_bytes(blob[:4], "little")
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, np.uint8)
    raw = unsqueeze(blob[4:])
    h = np.frombuffer(raw, "<u8", n)
    shift, runs, times = np.frombuffer(raw, "<i4", 3 * n, 8 * n).reshape(3, n).astype(np.int64)
    return h, shift, runs, times, np.frombuffer(raw, np.uint8, -1, 20 * n)


def _framed(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(4, "little") + first + second


def _unframed(body: bytes) -> tuple[bytes, bytes]:
    size = 4 + int.from_bytes(body[:4], "little")
    return body[4:size], body[size:]


def _bits(marks: np.ndarray) -> bytes:
    return squeeze(np.packbits(marks).tobytes())


def _put_windows(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> bytes:
    return _framed(_framed(put_sorted(a), b.astype("<u8").tobytes()), put_counts(times)) if len(a) else b""


def _count_windows(bodies: list[bytes]) -> list[bytes]:
    """Answers for the windows of a bucket: packed marks of those that occur more than once."""
    split = []
    for body in bodies:
        hashes, times = _unframed(body) if body else (b"", b"")
        head, rest = _unframed(hashes) if body else (b"", b"")
        split.append(
            (
                get_sorted(head) if body else np.zeros(0, np.uint64), np.frombuffer(rest, "<u8") if body else np.zeros(0, np.uint64),
                get_counts(times) if body else np.zeros(0, np.int64)
            )
        )
    a, b, times = (np.concatenate([s[k] for s in split]) for k in range(3))
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    number = np.zeros(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    often = np.bincount(number, times)[number] > 1 if len(a) else np.zeros(0, bool)
    ends = np.cumsum([len(s[0]) for s in split])
    return [_bits(often[e - len(s[0]) : e]) if len(s[0]) else b"" for e, s in zip(ends, split)]


def _solve(bodies: list[bytes]) -> list[bytes]:
    """Answers for all contexts of a bucket: packed marks of windows, context by context."""
    if not any(bodies):
        return [b""] * len(bodies)
    bodies = [b or bytes(4) for b in bodies]
    split = [_unpack(b) for b in bodies]
    h = np.concatenate([s[0] for s in split])
    shift, runs, times = (np.concatenate([s[k] for s in split]) for k in (1, 2, 3))
    data = np.concatenate([s[4] for s in split])
    sizes = runs + LENGTH - 1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # equal contexts of several blocks are one
    keys = np.array([hashlib.blake2b(data[a : a + n].tobytes(), digest_size=16).digest() for a, n in zip(starts.tolist(), sizes.tolist())], "S16")
    number = np.zeros(len(h), np.int64)
    held: dict = {}
    for i, key in enumerate(zip(h.tolist(), shift.tolist(), keys.tolist(), sizes.tolist())):
        number[i] = held.setdefault(key, len(held))
    rep = np.zeros(len(held), np.int64)
    rep[number[::-1]] = np.arange(len(h))[::-1]
    total = np.bincount(number, times).astype(np.int64)
    # sorted by anchor content; whole contents go together, until there are enough symbols
    order = np.argsort(h[rep], kind="stable")
    marks: list = [None] * len(rep)
    i = 0
    while i < len(order):
        size, j = 0, i
        while j < len(order) and (size < _BATCH or h[rep[order[j]]] == h[rep[order[j - 1]]]):
            size += int(sizes[rep[order[j]]]) // SYMBOL + 1
            j += 1
        part = rep[order[i:j]]
        packed = np.concatenate([data[a : a + n] for a, n in zip(starts[part].tolist(), sizes[part].tolist())])
        at = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
        found = find(h[part], shift[part], runs[part], total[order[i:j]], packed, at)
        for k, piece in zip(order[i:j].tolist(), np.split(found, np.cumsum(runs[part])[:-1])):
            marks[k] = piece
        i = j
    out, at = [], 0
    for s in split:
        n = len(s[0])
        out.append(_bits(np.concatenate([np.zeros(0, bool), *(marks[k] for k in number[at : at + n])])) if n else b"")
        at += n
    return out


def _ranges(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Removed runs of the block's bytes: starts and ends, ascending, never across texts."""
    h, place, first, last, told = _told(block)
    windows = np.zeros(len(block.data) + 1, np.int8)
    got = {b: _unframed(x) for b, x in block.answers.get(1, {}).items()}
    opened = lambda packed, n: np.unpackbits(np.frombuffer(unsqueeze(packed), np.uint8))[:n].astype(bool)
    if (told == OFTEN).any():
        begin, a, _, number = _windows(block, first[told == OFTEN], last[told == OFTEN])
        often = np.concatenate([opened(got[b][1], j - i) for b, i, j in by_bucket(a, block.bits)])
        windows[begin] = often[number]
    keep = told == AGAIN
    h, place, first, last = h[keep], place[keep], first[keep], last[keep]
    order, number, rep = _repeated(h, place, first, last, block)
    runs = last[rep] - first[rep] + 1
    marks: list = []
    for b, i, j in by_bucket(h[rep], block.bits):
        marks += np.split(opened(got[b][0], int(runs[i:j].sum())), np.cumsum(runs[i:j])[:-1])
    for k, i in enumerate(order.tolist()):
        windows[first[i] : last[i] + 1] = marks[number[k]]
    begin = np.flatnonzero(windows[:-1])
    if not len(begin):
        return begin, begin
    cover = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(cover, begin, 1)
    np.add.at(cover, np.minimum(begin + LENGTH, len(block.data)), -1)
    covered = np.cumsum(cover)[:-1] > 0
    edge = np.zeros(len(block.data) + 1, bool)
    edge[block.offsets] = True
    starts = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate(([False], covered[:-1]))))
    ends = np.flatnonzero(covered & (edge[1:] | ~np.concatenate((covered[1:], [False])))) + 1
    return starts, ends


def _searched(docs: DataFrame, hot: int) -> Corpus:
    """The corpus after both rounds."""
    corpus = Corpus(docs)
    bits = corpus.bits

    def ask_anchors(block: Block) -> dict[int, bytes]:
        h, _, _, _, whole = contexts(block)
        distinct, often = np.unique(h, return_counts=True)
        order = np.lexsort((whole, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (whole[order[1:]] != whole[order[:-1]])
        different = np.unique(h[order[new]], return_counts=True)[1]
        return {b: _framed(_framed(put_sorted(distinct[i:j]), put_counts(often[i:j])), put_counts(different[i:j])) for b, i, j in by_bucket(distinct, bits)}

    def count_anchors(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
        outer = [_unframed(b) for b in bodies]
        inner = [_unframed(o) for o, _ in outer]
        hashes = [get_sorted(x) for x, _ in inner]
        distinct, number = np.unique(np.concatenate(hashes), return_inverse=True)
        number = number.ravel()
        often = np.bincount(number, np.concatenate([get_counts(x) for _, x in inner]), len(distinct))
        different = np.bincount(number, np.concatenate([get_counts(x) for _, x in outer]), len(distinct))
        told = np.where(often < 2, ONCE, np.where(different > hot, OFTEN, AGAIN))[number]
        ends = np.cumsum([len(x) for x in hashes])
        return [put_counts(told[e - len(x) : e]) for e, x in zip(ends, hashes)], b""

    def ask_contexts(block: Block) -> dict[int, bytes]:
        h, place, first, last, told = _told(block)
        out: dict[int, tuple[bytes, bytes]] = {}
        if (told == OFTEN).any():
            _, a, b, number = _windows(block, first[told == OFTEN], last[told == OFTEN])
            times = np.bincount(number, minlength=len(a))
            out = {k: (b"", _put_windows(a[i:j], b[i:j], times[i:j])) for k, i, j in by_bucket(a, bits)}
        keep = told == AGAIN
        h, place, first, last = h[keep], place[keep], first[keep], last[keep]
        _, number, rep = _repeated(h, place, first, last, block)
        times = np.bincount(number, minlength=len(rep))
        for k, i, j in by_bucket(h[rep], bits):
            out[k] = _pack(h, place, first, last, rep[i:j], times[i:j], block.data), out.get(k, (b"", b""))[1]
        return {k: _framed(*parts) for k, parts in out.items()}

    def answer(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
        split = [_unframed(b) for b in bodies]
        return [_framed(x, y) for x, y in zip(_solve([c for c, _ in split]), _count_windows([w for _, w in split]))], b""

    corpus.ask(ask_anchors, count_anchors)
    corpus.ask(ask_contexts, answer)
    return corpus


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    corpus = _searched(with_documents_columns(docs), hot)
    bits = corpus.bits
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def work(block: Block):
        block.bits = bits
        starts, ends = _ranges(block)
        first = np.searchsorted(starts, block.offsets)
        raw, rows, size = block.data.tobytes(), [], 0
        for i, doc_id in enumerate(block.ids):
            a, b = int(block.offsets[i]), int(block.offsets[i + 1])
            spans = list(zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist()))
            kept, at = [], a
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept = b"".join([*kept, raw[at:b]])
            rows.append((doc_id, b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            size += len(kept)
            if size > 1 << 21 or len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return corpus.map(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: Every window of every text hashed, texts as hexadecimal digits, cut into pieces of 400 windows.
OP7_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 p AS (SELECT r, x, len(x) // 2 AS n, unnest(range(0, len(x) // 2 - 199, 400)) AS o FROM d WHERE len(x) >= 400),
 q AS (SELECT r, o, substr(x, 2 * o + 1, 1198) AS y, least(400, n - 199 - o) AS k FROM p),
 w AS (SELECT r, unnest(range(o, o + k)) AS i, unnest(list_transform(range(k), lambda j: md5_number(substr(y, 2 * j + 1, 400)))) AS h FROM q),
 hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
 g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
 s AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS s FROM g),
 spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY r, s),
 gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT r, coalesce(max(b), 0), NULL FROM d LEFT JOIN spans USING (r) GROUP BY r),
 kept AS (SELECT r, string_agg(substr(x, 2 * a + 1, coalesce(2 * b, len(x)) - 2 * a), '' ORDER BY a) AS k FROM gaps JOIN d USING (r) GROUP BY r),
 c AS (SELECT r, sum(b - a) AS m, count(*) AS n FROM spans GROUP BY r)
 SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
 FROM d JOIN kept USING (r) LEFT JOIN c USING (r)"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without their repeated bytes, all columns; n_chars, if there is one, is that of the new text.

    A character that loses some of its bytes is lost whole. A text that is
    nothing but repeats stays as an empty one; a null text stays null."""
    corpus = _searched(with_documents_columns(docs), HOT)
    bits = corpus.bits

    def work(block: Block):
        block.bits = bits
        starts, ends = _ranges(block)
        first = np.searchsorted(starts, block.offsets)
        raw, ids, texts, size = block.data.tobytes(), [], [], 0
        marks = [hashlib.md5(raw[a:b]).hexdigest() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())]
        for i, doc_id in enumerate(block.ids):
            a, b = int(block.offsets[i]), int(block.offsets[i + 1])
            if first[i] == first[i + 1]:
                continue
            kept, at = [], a
            for s, e in zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist()):
                kept.append(raw[at:s])
                at = e
            ids.append((doc_id, marks[i]))
            texts.append(b"".join([*kept, raw[at:b]]).decode("utf-8", "ignore"))
            size += len(texts[-1])
            if size > 1 << 21 or len(ids) >= 2000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids]), pa.array(texts, pa.string())],
                    names=["cut_id", "cut_key", "cut_text"]
                )
                ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids]), pa.array(texts, pa.string())],
                names=["cut_id", "cut_key", "cut_text"]
            )

    # only texts that change come back; one row for each text and id (equal texts change alike)
    cut = corpus.map(work, "cut_id long, cut_key string, cut_text string").dropDuplicates(["cut_id", "cut_key"])
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    joined = docs.join(cut, docs["doc_id"].cast("long").eqNullSafe(cut["cut_id"]) & (F.md5(text.cast("binary")) == cut["cut_key"]), "left")
    new = F.when(cut["cut_key"].isNull(), docs["text"]).otherwise(cut["cut_text"])
    out = {"text": new}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut["cut_key"].isNull(), docs["n_chars"]).otherwise(F.length(cut["cut_text"]).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(out[c].alias(c) if c in out else docs[c] for c in docs.columns))
