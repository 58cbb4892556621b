"""Words of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: White space as the contracts have it.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A random number for each byte; capital A-Z hash as their small letters.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        out = []
        for base in (BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = tuple(out)
    return _powers[0][:n], _powers[1][:n]


def scramble(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """out[j] - out[i] belongs to data[i:j]; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], independent of where they stand."""
    inverse = powers(len(prefix))[1]
    return scramble((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the text it is in. Words never cross texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:n] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


PART = 1 << 20


def parts(offsets: np.ndarray, most: int = PART):
    """(first, end) of runs of whole texts of about `most` bytes: what is worked on at a time."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text of each word); A-Z as a-z."""
    hashes, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in parts(offsets):
        some = data[offsets[i] : offsets[j]]
        starts, ends, text = spans(some, offsets[i : j + 1] - offsets[i])
        if len(starts):
            hashes.append(span_hash(prefix_hash(some), starts, ends))
            texts.append(text + i)
    return np.concatenate(hashes), np.concatenate(texts)


def chain(*hashes: np.ndarray) -> np.ndarray:
    """One hash for each row of equally long columns; order matters."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = scramble(out * np.uint64(0x9FB21C651E98DF25) + h)
    return out


def shingles(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of each run of n words within a text; a shorter text with words is one shingle."""
    if not len(h):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    k = len(h) - n + 1
    first = np.flatnonzero(text[:k] == text[n - 1 :]) if k > 0 else np.zeros(0, np.int64)
    full = chain(*(h[first + i] for i in range(n))) if len(first) else np.zeros(0, np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    lengths = np.diff(np.append(heads, len(h)))
    few = heads[lengths < n]
    if len(few):
        small = np.array([int(chain(*(h[i + j : i + j + 1] for j in range(m)))[0]) for i, m in zip(few, lengths[lengths < n])], np.uint64)
        full, first = np.concatenate((full, small)), np.concatenate((first, few))
        order = np.argsort(first, kind="stable")
        full, first = full[order], first[order]
    return full, text[first], first
