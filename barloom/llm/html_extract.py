"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks (html_blocks). Each block is a vector:
learned embeddings of its hashed tag path (tags, class and id words, pairs of
parent and child), of its hashed words, and a few numbers (length, share of
links, place). A bidirectional LSTM in numpy reads the sequence, so every block
is classified in the context of the whole page, and a logistic unit labels it
as article or not. The text of a page is its article blocks, joined by line ends.

The labeller is trained here, on pages that html_synthetic writes: many kinds
of layout whose blocks are known to be article or boilerplate, with the same
invented words in both, so that layout decides. Training uses `PAGES` pages and
a fixed seed; it takes some seconds and is done once for each driver process.

Null or empty html, or a page without article blocks: text '' and n_chars 0.
Rows are independent, so repeated and extra rows and columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.html_blocks import Leaf, leaves
from barloom.llm.html_synthetic import page
from barloom.llm.shared import pieces

PATH_SLOTS, WORD_SLOTS, WIDTH, HIDDEN, NUMBERS = 2048, 1024, 24, 20, 6
PAGES, EPOCHS = 1300, 10
_slots: dict = {}


def _path_slots(path: tuple) -> list[int]:
    if path not in _slots:
        if len(_slots) > 50_000:
            _slots.clear()
        names = []
        for depth, (tag, tokens) in enumerate(path):
            own = [tag, *("." + t for t in tokens)]
            names += own
            if depth:
                names += [f"{path[depth - 1][0]}>{x}" for x in own]
        names += [f"leaf:{x}" for x in ([path[-1][0], *("." + t for t in path[-1][1])] if path else ["none"])]
        _slots[path] = sorted({zlib.crc32(n.encode()) % PATH_SLOTS for n in names})
    return _slots[path]


def inputs(blocks: list[Leaf]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, slot, weight) of the embeddings, and the numbers of each block."""
    row, slot, weight = [], [], []
    numbers = np.zeros((len(blocks), NUMBERS), np.float32)
    for i, b in enumerate(blocks):
        own = _path_slots(b.path)
        words = {PATH_SLOTS + zlib.crc32(w.encode()) % WORD_SLOTS for w in b.text.lower().split()}
        row += [i] * (len(own) + len(words))
        slot += own
        slot += words
        weight += [len(own) ** -0.5] * len(own) + [1 / len(words)] * len(words)
        numbers[i] = np.log1p(len(b.text)) / 8, b.linked, (i + 1) / len(blocks), np.log1p(i) / 5, b.text[-1] in ".!?", np.log1p(len(blocks)) / 5
    return np.array(row, np.int64), np.array(slot, np.int64), np.array(weight, np.float32), numbers


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """The network's arrays by name: embed, and for each direction (f, b) w, u, z; out, bias."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.p = arrays

    @staticmethod
    def fresh(rng) -> Labeller:
        d = WIDTH + NUMBERS
        p = {"embed": rng.normal(0, 0.3, (PATH_SLOTS + WORD_SLOTS, WIDTH))}
        for k in "fb":
            p["w" + k], p["u" + k] = rng.normal(0, d**-0.5, (d, 4 * HIDDEN)), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            p["z" + k] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["out"], p["bias"] = rng.normal(0, 0.2, 2 * HIDDEN + d), np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in p.items()})

    def vectors(self, pages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded block vectors of pages (from inputs()), how to turn sequences round, and the mask."""
        n = np.array([len(p[3]) for p in pages])
        x = np.zeros((len(pages), n.max(), WIDTH + NUMBERS), np.float32)
        for i, (row, slot, weight, numbers) in enumerate(pages):
            for_rows = np.zeros((n[i], WIDTH), np.float32)
            if len(row):
                heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                for_rows[row[heads]] = np.add.reduceat(self.p["embed"][slot] * weight[:, None], heads, axis=0)
            x[i, : n[i], :WIDTH], x[i, : n[i], WIDTH:] = for_rows, numbers
        place = np.arange(n.max())
        mask = place < n[:, None]
        return x, np.where(mask, n[:, None] - 1 - place, place), mask

    def _run(self, x: np.ndarray, k: str, keep: bool):
        """LSTM over time; keep: also what the way back needs."""
        pre = x @ self.p["w" + k] + self.p["z" + k]
        h = c = np.zeros((len(x), HIDDEN), np.float32)
        out, held = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        u = self.p["u" + k]
        for t in range(x.shape[1]):
            a = pre[:, t] + h @ u
            s, g = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            before, c = c, s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
            tc = np.tanh(c)
            if keep:
                held.append((h, before, s, g, tc))
            h = s[:, 2 * HIDDEN :] * tc
            out[:, t] = h
        return out, held

    def logits(self, pages: list, keep: bool = False):
        x, turn, mask = self.vectors(pages)
        rows = np.arange(len(x))[:, None]
        hf, kf = self._run(x, "f", keep)
        hb, kb = self._run(x[rows, turn], "b", keep)
        full = np.concatenate([hf, hb[rows, turn], x], 2)
        z = full @ self.p["out"] + self.p["bias"]
        return (z, mask, (x, turn, full, kf, kb)) if keep else (z, mask)

    def _back(self, x, k, held, dh_all, grads):
        u, w = self.p["u" + k], self.p["w" + k]
        dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((len(x), HIDDEN), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, before, s, g, tc = held[t]
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dpre[:, t] = d
            grads["u" + k] += h.T @ d
            dh, dc = d @ u.T, dc * f
        flat = dpre.reshape(-1, 4 * HIDDEN)
        grads["w" + k] += x.reshape(-1, x.shape[2]).T @ flat
        grads["z" + k] += flat.sum(0)
        return dpre @ w.T

    def gradients(self, pages: list, labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        z, mask, (x, turn, full, kf, kb) = self.logits(pages, True)
        y = np.zeros(z.shape, np.float32)
        for i, l in enumerate(labels):
            y[i, : len(l)] = l
        p = _sigmoid(z)
        loss = -(np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / mask.sum()
        dz = ((p - y) * mask / mask.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = np.tensordot(dz, full, ([0, 1], [0, 1])), dz.sum().reshape(1)
        dfull = dz[:, :, None] * self.p["out"]
        rows = np.arange(len(x))[:, None]
        dx = dfull[:, :, 2 * HIDDEN :] + self._back(x, "f", kf, dfull[:, :, :HIDDEN], g)
        turned = self._back(x[rows, turn], "b", kb, dfull[:, :, HIDDEN : 2 * HIDDEN][rows, turn], g)
        dx = dx + turned[rows, turn]
        for i, (row, slot, weight, _) in enumerate(pages):
            np.add.at(g["embed"], slot, dx[i, row, :WIDTH] * weight[:, None])
        return float(loss), g

    def labels(self, pages: list, most: int = 6000) -> list[np.ndarray]:
        """P(article) of each page's blocks; pages of like length are read together."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][3])), key=lambda i: len(pages[i][3]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]][3]) * (end + 1 - at) <= most:
                end += 1
            z, _ = self.logits([pages[i] for i in order[at:end]])
            for i, row in zip(order[at:end], z):
                out[i] = _sigmoid(row[: len(pages[i][3])])
            at = end
        return out


def _without_words(given: tuple, rng, share: float = 0.75) -> tuple:
    """inputs() in which a share of blocks has lost its words and its length: layout has to do."""
    row, slot, weight, numbers = given
    lost = rng.random(len(numbers)) < share
    numbers = numbers.copy()
    numbers[lost, 0] = rng.random(int(lost.sum()))
    return row, slot, np.where(lost[row] & (slot >= PATH_SLOTS), 0, weight).astype(np.float32), numbers


_trained: dict = {}


def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    if (pages, epochs, seed) not in _trained:
        rng = np.random.default_rng(seed)
        rows = []
        for _ in range(pages):
            text, article = page(rng)
            blocks = leaves(text)
            rows.append((inputs(blocks), np.array([b.text in article for b in blocks], np.float32)))
        rows = [r for r in rows if len(r[1])]
        net = Labeller.fresh(rng)
        first = {k: np.zeros_like(v) for k, v in net.p.items()}
        second = {k: np.zeros_like(v) for k, v in net.p.items()}
        step, size = 0, 24
        for epoch in range(epochs):
            # batches of pages of like length, in random order
            order = rng.permutation(len(rows))
            pools = [sorted(order[at : at + 8 * size], key=lambda i: len(rows[i][1])) for at in range(0, len(order), 8 * size)]
            batches = [pool[at : at + size] for pool in pools for at in range(0, len(pool), size)]
            for k in rng.permutation(len(batches)):
                part = [rows[i] for i in batches[k]]
                _, g = net.gradients([_without_words(r[0], rng) for r in part], [r[1] for r in part])
                step += 1
                rate = 0.012 * (1 - 0.8 * epoch / epochs)
                g["embed"][PATH_SLOTS:] += 1e-4 * net.p["embed"][PATH_SLOTS:]  # words may hint, not decide
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.995 * second[k] + 0.005 * v * v
                    net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-7) + rate * 1e-4 * net.p[k]).astype(np.float32)
        _trained[pages, epochs, seed] = net
    return _trained[pages, epochs, seed]


def main_texts(net: Labeller, pages: list[str]) -> list[str]:
    found = [leaves(p) for p in pages]
    chances = net.labels([inputs(b) for b in found])
    return ["\n".join(b.text for b, c in zip(blocks, chance) if c >= 0.5) for blocks, chance in zip(found, chances)]


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    net = net or trained()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text"))

    def work(batches):
        for batch in pieces(batches, 1 << 20):
            texts = main_texts(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op2_recurrent_labeller(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
