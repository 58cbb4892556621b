"""The training-data operators against brute force, on small tables with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import decontaminate, embedding_dedup, html_extract, minhash, ngram_lm, packing, quality, suffix_dedup, toxicity, warc
from barloom.llm.html_blocks import leaves
from barloom.llm.html_synthetic import page
from barloom.llm.shared import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "é", "st"]) for _ in range(rng.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    out = [say(rng.randint(30, 120)) for _ in range(60)]
    for i in range(0, 20):  # near copies of every degree
        w = out[i].split()
        for k in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) // 25))):
            w[k] = word()
        out.append(" ".join(w))
    out += out[:6] + [out[0]] * 5  # exact copies
    out += [None, "", None, "", "   \n", "one", "one two", "Ünï  code\tÉ", "a " * 3000, "x" * 5000, say(4000)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With a null id, a repeated row and a column of another table's name."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts] + [(None, "no id at all", None, None, None), (3, texts[3][1], "en", "s", 1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).repartition(5)
    return materialise(df.select("*", F.lit(1).alias("head"), F.lit("x").alias("rep"), F.lit(2).alias("block")), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return materialise(spark.createDataFrame([], DOCS), "none")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# packing


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path).collect()
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, x in [*texts, (None, "no id at all"), (3, texts[3][1])]:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_piece_once(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 8), 64]) for _ in range(rng.randint(0, 400)))
    used = collections.Counter()
    for lengths, times in packing.plan_patterns(counts, 64):
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts


def test_complements():
    assert packing.plan_patterns({60: 3, 4: 3}, 64) == [((60, 4), 3)]
    assert packing.plan_patterns({50: 1, 10: 1, 4: 1}, 64) == [((50, 10, 4), 1)]
    assert packing.plan_patterns({40: 1, 12: 1, 8: 1, 4: 1}, 64) == [((40, 12, 8, 4), 1)]
    with pytest.raises(ValueError):
        packing.plan_patterns({65: 1}, 64)


def test_packing_empty(empty):
    import public_tokenizers

    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# language model


def test_language_model(docs, texts):
    got = ngram_lm.score(docs).collect()
    rows = [*texts, (None, "no id at all"), (3, texts[3][1])]
    train = [tokens(t) + ["</>"] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    by = {i: tokens(t) + ["</>"] for i, t in rows}
    for r in got:
        w = by[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_mixtures_are_distributions():
    """Weights of every bucket, also of unknown ones, sum to one, and give nothing to orders whose context was never seen."""
    rng = np.random.default_rng(2)
    cells = np.array(
        [(b * ngram_lm.STEPS + rng.integers(0, 40)) * ngram_lm.STEPS + rng.choice([rng.integers(0, 20), ngram_lm.STEPS - 1]) for b in (0, 64, 65, 70) for _ in range(50)],
        np.int64
    )
    learnt = ngram_lm.learn_weights(cells, rng.random(len(cells)) + 0.1, 2, 1e-4, 40)
    for some in (learnt, {}, {0: learnt[0]}, {64: learnt[64]}):
        w = ngram_lm.weights_of(some, np.array([0, 64, 66, 80]), 2)
        assert w.sum(1) == pytest.approx(1) and (w >= 0).all() and w[0, 2] == 0
    # a context's estimates sum to one, so mixing them with the uniform share of each word and of one unknown does too
    counts, whole = np.array([3, 0, 5, 2]), np.array([7, 1, 9, 3])
    p, bucket = ngram_lm._estimates([whole, counts], [np.full(4, whole.sum()), np.full(4, counts.sum())], whole.sum())
    w = ngram_lm.weights_of(learnt, bucket, 2)
    assert (w[:, 0] / 5 + w[:, 1] * p[0] + w[:, 2] * p[1]).sum() + w[0, 0] / 5 == pytest.approx(1)


def test_language_model_without_training_text(spark, empty):
    assert ngram_lm.score(empty).count() == 0
    only = materialise(spark.createDataFrame([(next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2), "a b", "", "", 0)], DOCS), "lm")
    r = ngram_lm.score(only).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0, 0)


# near-duplicates


def brute_classes(rows, least=0.8, n=5):
    ids = sorted({i for i, _ in rows if i is not None})
    text = {i: t or "" for i, t in rows if i is not None}
    sets, df = {}, collections.Counter()
    for i, t in rows:
        w = tokens(t)
        s = collections.Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else collections.Counter()
        df.update(s.keys())
        if i is not None:
            sets[i] = s
    weight = {i: {g: (1 + math.log(m)) * math.log1p(len(rows) / df[g]) for g, m in s.items()} for i, s in sets.items()}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b:
                both = sum(min(v, weight[b].get(g, 0)) for g, v in weight[a].items())
                whole = sum(weight[a].values()) + sum(weight[b].values()) - both
                if text[a] == text[b] or (whole > 0 and both / whole >= least):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, texts):
    rows = [*texts, (None, "no id at all"), (3, texts[3][1])]
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    for r in got:
        assert r["class_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]), r
        assert r["kept"] == (r["doc_id"] is None or r["class_id"] == r["doc_id"])


def test_several_texts_of_one_id(spark, texts):
    """They are one document; which of them stands for it doesn't depend on the partitioning."""
    rows = [(1, texts[0][1]), (1, texts[1][1]), (2, texts[1][1]), (3, texts[0][1] + " more"), (4, texts[2][1])]
    got = []
    for n in (1, 3):
        df = materialise(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS).repartition(n), "ids")
        got.append(sorted((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(df).collect()))
    assert got[0] == got[1] and dict(got[0])[2] == 1 and dict(got[0])[4] == 4 and len(got[0]) == 5


def test_clashing_names(spark, docs):
    from pyspark.sql import functions as F

    odd = docs.select("*", *(F.lit(1).alias(c) for c in ("dropped_id", "cut_id", "cut_key", "cut_text", "text_key", "component")))
    for stage in (minhash.stage, suffix_dedup.stage):
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.count() > 0


def test_near_duplicate_stage(spark, docs, texts):
    got = minhash.stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in minhash.near_duplicates(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in got.collect()} == kept and None in kept


def test_large_group_of_near_copies(spark):
    """Copies that differ from their original a little, and from one another more."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base), "", "", 0)]
    for i in range(1, 300):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6])):
            w[k] = f"x{i}{k}"
        rows.append((i, " ".join(w), "", "", 0))
    df = materialise(spark.createDataFrame(rows, DOCS), "group")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    want = brute_classes([(i, t) for i, t, *_ in rows])
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_components_go_on_from_those_found(spark, docs, texts, monkeypatch):
    """The exact join's links are added to the components so far; neither these nor their nodes are written once more."""
    written, links = [], []
    table, joined = minhash.materialise, minhash.components
    monkeypatch.setattr(minhash, "materialise", lambda df, name: written.append(name) or table(df, name))
    monkeypatch.setattr(minhash, "components", lambda df: links.append({(r["a"], r["b"]) for r in df.collect()}) or joined(df))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert len(links) == 2 and not {"parts", "every"} & set(written)
    first = brute_components({x for pair in links[0] for x in pair}, links[0])
    assert {(a, b) for a, b in links[1] if first.get(a) == b} == set(first.items())
    want = brute_classes([*texts, (None, "no id at all"), (3, texts[3][1])])
    assert all(got[i] == want[i] for i in want)


def brute_components(nodes, links):
    of = {n: n for n in nodes}
    while changed := [(a, b) for a, b in links if of[a] != of[b]]:
        for a, b in changed:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_near_duplicates_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_consistent_sampling_meets_jaccard():
    rng = np.random.default_rng(0)
    hits = total = 0
    for _ in range(40):
        g = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = rng.random(60) + 0.1, rng.random(60) + 0.1
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        hits += (minhash.sample(g, a) == minhash.sample(g, b)).mean() - j
        total += 1
    assert abs(hits / total) < 0.03


# suffix arrays


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = random.Random(seed)
    x = [rng.randint(1, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(0, 80))] + [0]
    assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_repeats(rows, n=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
    out = []
    for (i, _), x in zip(rows, raw):
        cut = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                cut[k : k + n] = b"\x01" * n
        kept = bytes(b for b, c in zip(x, cut) if not c)
        out.append((i, len(x), sum(cut), sum(1 for k in range(len(x)) if cut[k] and not (k and cut[k - 1])), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3, 0])
def test_repeats(spark, docs, texts, hot):
    """By the suffix array, by windows (hot anchors), and by both."""
    rng = random.Random(5)
    shared = ["".join(rng.choice("abcdefgh é") for _ in range(k)) for k in (150, 199, 200, 201, 230, 600)]
    more = []
    for i in range(80):
        t = "".join(rng.choice("stuvwxyz ") for _ in range(rng.choice([0, 10, 300])))
        for _ in range(rng.choice([0, 1, 2])):
            t += rng.choice(shared)[rng.choice([0, 0, 17]) :] + "".join(rng.choice("qrs") for _ in range(rng.choice([0, 2, 250])))
        more.append((1000 + i, t))
    rows = [*texts, *more, (None, None), (1000, more[0][1]), (2000, "ab" * 300), (2001, "a" * 201)]
    df = materialise(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS).repartition(4), "rep")
    got = collections.Counter(tuple(r) for r in suffix_dedup.repeats(df, hot).drop("kept").collect())
    assert got == brute_repeats(rows)


def test_the_array_decides(monkeypatch):
    """Equal windows in contexts that differ are found where the array brings them together, and not without it."""
    rng = np.random.default_rng(2)
    common = rng.integers(97, 123, 250, dtype=np.uint8)
    parts = [np.concatenate([common, rng.integers(97, 123, 40, dtype=np.uint8)]) for _ in range(5)] + [rng.integers(97, 123, 290, dtype=np.uint8) for _ in range(5)]
    data, starts = np.concatenate(parts), np.arange(10) * 290
    shift, runs, times = np.full(10, 180), np.full(10, 91), np.ones(10, np.int64)
    want = np.concatenate([(np.arange(91) <= 50) & (k < 5) for k in range(10)])
    assert (suffix_dedup.find(None, shift, runs, times, data, starts) == want).all()
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: list(range(len(text))))
    assert not suffix_dedup.find(None, shift, runs, times, data, starts).any()


def test_equal_hashes_are_told_apart():
    data = np.frombuffer(b"aaaaaaaabbbbbbbbaaaaaaaacccccccc", np.uint8)
    words = suffix_dedup._words8(data)
    got = suffix_dedup._verified(np.array([0, 0, 0, 1]), words, np.array([[0], [8], [16], [24]]))
    assert got[0] == got[2] and len({int(got[0]), int(got[1]), int(got[3])}) == 3


def test_repeat_stage(spark, docs, texts):
    got = suffix_dedup.stage(spark, docs, "")
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (None, "no id at all") in rows and ("one two" in {t for _, t in rows})
    want = {(r["doc_id"], bytes(r["kept"]).decode("utf-8", "ignore")) for r in suffix_dedup.repeats(docs).collect()}
    assert {(i, t or "") for i, t in rows} == want


def test_repeats_empty(empty):
    assert suffix_dedup.repeats(empty).count() == 0


# decontamination


def brute_align(a, b):
    best = (0, 0)
    h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            s, m = h[i - 1][j - 1]
            h[i][j] = max((s + 2, m + 1) if x == y else (s - 1, m), (h[i - 1][j][0] - 1, h[i - 1][j][1]), (h[i][j - 1][0] - 1, h[i][j - 1][1]), (0, 0))
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("seed", range(10))
def test_alignment(seed):
    rng = random.Random(seed)
    a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 30))] for _ in range(2))
    assert decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64)) == brute_align(a, b)


def test_leaks(spark, docs, texts):
    rng = random.Random(11)
    item = lambda: " ".join("".join(rng.choice(["ba", "du", "fe", "go", "hy"]) for _ in range(3)) for _ in range(40))
    items = [(k, item()) for k in range(12)] + [(12, None), (13, ""), (0, "tiny")]
    filler = texts[10][1]
    rows = [(1, filler + " " + items[0][1].upper() + "!! " + filler), (2, items[1][1].replace(" ", ", ")), (3, filler), (4, None), (5, "")]
    w = items[2][1].split()
    rows.append((6, filler + " " + " ".join(x if k % 5 else "other" for k, x in enumerate(w)) + " " + filler))  # a fifth of its words are others
    rows.append((7, filler + " " + " ".join(w[:25] + ["put", "in"] + w[25:])))
    rows.append((8, " ".join(items[3][1].split()[:10]) + " " + filler))  # a quarter of an item is none
    rows.append((9, " ".join(items[4][1].split()[8:26]) + " " + filler))  # eighteen words in a row are one
    df = materialise(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS), "leaks")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 3) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(1, 0): 1.0, (2, 1): 1.0, (6, 2): 0.8, (7, 2): 1.0, (9, 4): 0.45}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [5, 100, 2000])
def test_leaks_however_many_documents_hold_them(spark, copies):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ba", "du", "fe", "go", "hy"]) for _ in range(3))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(3)]
    part, edited = " ".join(items[0][1].split()[8:26]), " ".join(x if k % 5 else "other" for k, x in enumerate(items[1][1].split()))
    phrase = " ".join(items[2][1].split()[4:9])  # five words of an item that everybody uses
    texts = [f"{a} {phrase} {b}" for _ in range(copies) for a, b in ((part, word()), (word(), edited), (word(), word()))]
    df = materialise(spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], DOCS), "many")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == {(3 * k + i, i) for k in range(copies) for i in (0, 1)}
    assert all(s >= (0.45, 0.8)[i] for (_, i), s in got.items())


def test_items_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.slices, "__defaults__", (40,))
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k}") for k in range(9)], "item_id long, text string")
    df = materialise(spark.createDataFrame([(k, f"so alpha{k} beta{k} gamma{k} delta{k} it is", "", "", 0) for k in range(9)], DOCS), "s")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(k, k) for k in range(9)}


# classifiers


def test_toxicity(spark, docs):
    rng = random.Random(2)
    plain, vile = [f"word{k}" for k in range(300)], ["vilea", "vileb", "vilec", "viled"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        for _ in range(rng.randint(1, 6) * bad):
            w[rng.randrange(len(w))] = rng.choice(vile)
        rows.append((i, " ".join(w), "", "", 0))
        labels.append((i, 1, int(bad)))
    df, lab = materialise(spark.createDataFrame(rows, DOCS), "tox"), spark.createDataFrame(labels[:450], "doc_id long, quality int, toxic int")
    model = toxicity.trained(df, lab)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    wrong = sum((got[i]["p_toxic"] >= toxicity.REJECT_FROM) != (i % 5 == 0) for i in range(450, 600))
    assert wrong <= 6
    many = [got[i]["severity"] for i in range(600) if i % 5 == 0 and sum(v in rows[i][1].split() for v in vile) >= 3]
    few = [got[i]["severity"] for i in range(600) if i % 5 == 0 and sum(v in rows[i][1].split() for v in vile) == 1]
    assert np.mean(many) > np.mean(few)
    awkward = toxicity.score(docs, model).collect()
    assert len(awkward) == docs.count() and all(0 <= r["p_toxic"] <= 1 and 0 <= r["severity"] <= 2 for r in awkward)
    same = toxicity.fit(["a b"], [0])
    assert toxicity.score(docs, same).filter(f"p_toxic >= {toxicity.REJECT_FROM}").count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "evening", "letter", "window", "garden", "silent"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["CLICK!!", "$$$", "BUY###", "%%%", "FREE&&"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "", "", 0) for i in range(600)]
    df = materialise(spark.createDataFrame(rows, DOCS), "q")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    model, _ = quality.trained(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all((got[i] >= quality.CUT) == (i % 3 > 0) for i in held)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect()) and quality.score(docs, model).count() == docs.count()
    none, _ = quality.trained(df, labels.limit(0))
    assert none is None and {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


# pages


def test_leaves():
    html = "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><p>one <b>two<br>three<p>four &amp; five&nbsp;six</p><ul><li>a<li><a href='x>y'>b</a></ul><!-- <p>no</p> --><div>tail"
    assert [b.text for b in leaves(html)] == ["one two three", "four & five six", "a", "b", "tail"]
    assert leaves(html)[3].linked == 1 and [t for t, _ in leaves(html)[2].path] == ["html", "body", "ul", "li"]
    for odd in ("", "   ", "<", "<p", "a < b", "<script>never ends", "</p></div>", "<p class=\"x>unbalanced", "<!-- open", "plain"):
        leaves(odd)


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    pages = [page(rng) for _ in range(3)]
    blocks = [leaves(t) for t, _ in pages]
    given = [html_extract.inputs(b) for b in blocks]
    labels = [np.array([x.text in a for x in b], np.float32) for b, (_, a) in zip(blocks, pages)]
    net = html_extract.Labeller.fresh(rng)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    _, g = net.gradients(given, labels)
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        net.p[k][at] += 1e-3
        up, _ = net.gradients(given, labels)
        net.p[k][at] -= 2e-3
        down, _ = net.gradients(given, labels)
        net.p[k][at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=1e-3, abs=1e-6)


def test_extraction(spark):
    net = html_extract.trained()
    rng = np.random.default_rng(12345)
    right = total = 0
    for _ in range(120):
        text, article = page(rng)
        blocks = leaves(text)
        if blocks:
            said = net.labels([html_extract.inputs(blocks)])[0] >= 0.5
            right, total = right + sum(bool(s) == (b.text in article) for s, b in zip(said, blocks)), total + len(blocks)
    assert right / total > 0.98
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = html_extract.extract(table, net).collect()
    assert len(got) == table.count()
    html = {r["page_id"]: r["html"] for r in table.collect()}
    exact = 0
    for r in got:
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        import html as h

        want = [" ".join(h.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        exact += r["text"] == "\n".join(x for x in want if x)
        assert r["n_chars"] == len(r["text"])
    assert exact >= 0.98 * len(got)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "v", "<nav><a>x</a></nav>")], "page_id long, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in html_extract.extract(odd, net).collect()][:2] == [("", 0), ("", 0)]


def expected_records(rows):
    out, best = {}, {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            d = hashlib.sha1(p).hexdigest()
            best[d] = max(best.get(d, i), i)
    for i, _, h in rows:
        p = (h or "").encode()
        d = hashlib.sha1(p).hexdigest()
        other = best.get(d) if len(p) >= 1000 and i is not None and best.get(d) != i else None
        out[i] = (len(p), d, "revisit" if other is not None else "response", other)
    return out


@pytest.mark.parametrize("split", ["3000", "20000", "134217728"])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_warc_round_trip(spark, tmp_path, monkeypatch, split, broadcast):
    """Payloads full of forged records, at any size of splits."""
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    rng = random.Random(1)
    rows = []
    for i in range(120):
        h = "x" * rng.choice([0, 5, 1200, 4000])
        for _ in range(rng.choice([0, 0, 1, 3])):
            h += f"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{rng.randrange(300)}>\r\nContent-Length: {rng.choice([0, 10, 500, 100000])}\r\n\r\n" + "é" * rng.choice([10, 3000])
        rows.append((i, f"http://a\n/{i}", h + "WARC/1.1\r\n" * rng.choice([0, 1, 2]) if i % 40 else None))
    rows.append((None, None, "short"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
        got = warc.read(spark, str(tmp_path / "w")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows)
    assert {r["page_id"]: (r["size"], r["digest"], r["type"], r["refers_to"]) for r in got} == expected_records(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["type"] == "response")


def test_warc_query_equals_its_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/pages.parquet')")
    want = c.execute(warc.OP4_SQL)
    names = [d[0] for d in want.description]
    got = warc.op4_warc(spark, at)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


# vectors


def test_multi_index(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base, base[:80] + rng.normal(0, 0.05, (80, 16)), np.repeat(base[:1], 60, 0) + rng.normal(0, 0.02, (60, 16)), base[5:9] * 3])
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    n = len(rows)
    odd = [
        (n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [1.0, None] + [1.0] * 14), (n + 4, [1.0] * 8),
        (n + 5, []), (None, rows[0][1]), (3, rows[3][1]), (n + 6, rows[7][1])
    ]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df, sample=300, probes=100)
    out = collections.defaultdict(list)
    for r in got.collect():
        out[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert sum(map(len, out.values())) == len(rows) + len(odd)
    for i in range(n, n + 6):
        assert out[i] == [(0, i, True)]
    assert out[None] == [(0, None, None)] and len(out[3]) == 2 and out[3][0] == out[3][1]
    v = np.array([r for _, r in rows] + [rows[7][1]])
    ids = [*range(n), n + 6]
    v = v / np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T >= 0.9
    np.fill_diagonal(s, False)
    found = sum(out[i][0][0] for i in ids)
    assert all(out[i][0][0] <= k for i, k in zip(ids, s.sum(1))) and found >= 0.9 * s.sum()
    for i, row in zip(ids, s):  # linked vectors that were found are in one component
        assert out[i][0][1] <= i
    assert spark.createDataFrame([], df.schema).transform(embedding_dedup.near_duplicates).count() == 0


def test_one_large_tight_group_hides_no_looser_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    hot = base[0] + rng.normal(0, 0.002, (700, 16))
    x = np.concatenate([hot, base[1:], base[1:] + rng.normal(0, 0.1, (699, 16))])  # cosine of about 0.92
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, sample=800, probes=200).collect()}
    v = x / np.linalg.norm(x, axis=1)[:, None]
    want = (v @ v.T >= 0.9).sum(1) - 1
    loose = [i for i in range(700, len(x)) if want[i]]
    assert len(loose) > 500 and all(got[i] <= want[i] for i in got)
    assert sum(got[i] for i in loose) >= 0.96 * sum(want[i] for i in loose)
    assert sum(got.values()) >= 0.96 * want.sum()


def test_cells_without_links_are_measured(spark):
    """Where no probe has a link, cells are chosen by pairs made at the bar."""
    x = np.random.default_rng(4).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = embedding_dedup.Grid(embedding_dedup.codebook(x[:, :16], 20), embedding_dedup.codebook(x[:, 16:], 20))
    reps = spark.createDataFrame([(int(i), r.tobytes()) for i, r in enumerate(x[:50])], "rep long, body binary")
    visits, recall, links = embedding_dedup.cells_to_visit(reps, grid, [(i, x[i].tobytes()) for i in range(50)], 0.9, 0.985, 20, 3000)
    made = embedding_dedup._at_the_bar(grid, x[:50], 0.9)
    assert links == 0 and recall >= 0.985 and (made < visits).mean() >= 0.985 and visits > 8


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    rng = np.random.default_rng(1)
    x = np.ones((150, 8)) + rng.normal(0, 0.05, (150, 8))
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df, sample=100, probes=50).collect()
    v = x / np.linalg.norm(x, axis=1)[:, None]
    want = (v @ v.T >= 0.9).sum(1) - 1
    assert sum(r["n_links"] for r in got) >= 0.9 * want.sum() and all(r["n_links"] <= want[r["vec_id"]] for r in got)
    assert {r["component_id"] for r in got} == {0}
