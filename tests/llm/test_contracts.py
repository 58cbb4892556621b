"""Whole results against brute force, the dealt methods deciding, and tables with nothing in them."""

import collections
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from barloom.llm import decontaminate, embedding_dedup, html_extract, minhash, ngram_lm, packing, quality, suffix_dedup, toxicity, warc
from barloom.llm.html_blocks import DEPTH, leaves
from barloom.llm.shared import materialise, utf8
from tests.llm.test_operators import DOCS, brute_align

SMALL = "/root/testdata/sf0.001"


def table(spark, rows, name="t", schema=DOCS):
    return materialise(spark.createDataFrame(rows, schema), name)


def documents(spark, texts, name="t"):
    return table(spark, [(i, t, "", "", 0) for i, t in texts], name)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [], "nothing")


# op1: the model counted and mixed with dictionaries


def brute_scores(rows, order, rounds=40):
    words = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"]
    texts = [(i, words(t)) for i, t in rows]
    train = [(i, w) for i, w in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    gram = lambda w, at, k: tuple(w[at - j] if at - j >= 0 else "<s>" for j in range(k - 1, -1, -1))
    counts = [collections.Counter(gram(w, at, k) for _, w in train for at in range(len(w))) for k in range(1, order + 1)]
    total, known = sum(len(w) for _, w in train), len(counts[0])

    def estimates(w, own, n_tokens, n_texts):
        left = lambda k, at: max(counts[k][gram(w, at, k + 1)] - own[k][gram(w, at, k + 1)], 0)
        for at in range(len(w)):
            p, bucket = [], 0
            for k in range(order):
                n = n_tokens if k == 0 else n_texts if at == 0 else left(k - 1, at - 1)
                p.append(left(k, at) / n if n > 0 else 0.0)
                if k and n > 0:
                    bucket = 64 * k + math.floor(math.log2(n))
            yield bucket, p

    nothing = [collections.Counter()] * order
    # held-out counts: each training text against all the others, in steps of half an octave
    cells = collections.Counter()
    for _, w in train:
        own = [collections.Counter(gram(w, at, k) for at in range(len(w))) for k in range(1, order + 1)]
        for bucket, p in estimates(w, own, total - len(w), len(train) - 1):
            cells[bucket, tuple(min(round(-2 * math.log2(q)), 126) if q > 0 else None for q in p)] += 1
    uniform, weights = 1 / (known + 1), {}
    for b in {b for b, _ in cells}:
        rows_ = [([uniform] + [2.0 ** (-s / 2) if s is not None else 0.0 for s in steps], n) for (x, steps), n in cells.items() if x == b]
        w = [1 / (order + 1)] * (order + 1)
        for _ in range(rounds):
            new = [1e-3] * (order + 1)
            for q, n in rows_:
                mixed = sum(a * c for a, c in zip(w, q))
                for k in range(order + 1):
                    new[k] += n * w[k] * q[k] / mixed
            w = [x / sum(new) for x in new]
        weights[b] = w
    out = []
    for i, w in texts:
        score = 0.0
        for bucket, p in estimates(w, nothing, total, len(train)):
            same = sorted((abs(b - bucket), b) for b in weights if b // 64 == bucket // 64)
            mix = list(weights[same[0][1]]) if same else [1.0] + [0.0] * order
            for k in range(1, order):
                if bucket // 64 < k and mix[k + 1] > 0:
                    spare, mix[k + 1] = mix[k + 1], 0.0
                    mix = [m / (1 - spare) for m in mix]
            score += math.log10(mix[0] * uniform + sum(a * q for a, q in zip(mix[1:], p)))
        out.append((i, score))
    return out


@pytest.mark.parametrize("order", [2, ngram_lm.ORDER])
def test_scores_by_brute_force(spark, order):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("the a cat dog sat ran on mat far Red red blue".split()) for _ in range(n))
    rows = [(k, say(rng.randint(1, 40))) for k in range(120)] + [(None, say(9)), (500, None), (501, ""), (502, "new words only"), (7, "the cat sat on the mat")]
    got = collections.Counter((r["doc_id"], round(r["score"], 6)) for r in ngram_lm.score(documents(spark, rows, "lm"), order).collect())
    assert got == collections.Counter((i, round(s, 6)) for i, s in brute_scores(rows, order))


# op2


def test_pages_are_read_in_linear_time():
    began = time.perf_counter()
    for page in (
        "<a " * 1_000_000, "<a \"'>" * 300_000, "<!--" * 300_000, "<!" * 500_000, "<script>" * 300_000,
        "<b>" * 100_000 + "<li></li>x" * 50_000, "<div>" * 100_000 + "</x>" * 50_000 + "</div>y" * 50_000
    ):
        leaves(page)
    assert time.perf_counter() - began < 30


def test_letters_that_change_length_in_small_letters():
    page = "İ" * 60 + "<SCRIPT>let a = '<p>no</p>'</script ><p>first</p><style>p {}</STYLE\n><p>second"
    assert [x.text for x in leaves(page)] == ["İ" * 60, "first", "second"]


def test_unclosed_and_foreign_elements():
    read = lambda page: [x.text for x in leaves(page)]
    assert read("<p>one <svg><path d='1'/><text>two</text></p><p>three</p>") == ["one two", "three"]
    assert read("<div>a <object>instead</object> <math><mi>x</mi><mo>+</mo></math></div>b") == ["a instead x+", "b"]
    assert read("<p>a <b>b<p>c</b> d") == ["a b", "c d"] and read("a < b <3 <b") == ["a < b <3 <b"] and read("") == []
    assert read("<p>x<script>never closed<p>y") == ["x"]
    assert read("<i>" * (3 * DEPTH) + "deep" + "</i>" * (3 * DEPTH) + "<p>out") == ["deep", "out"]


def test_extraction_of_no_pages_and_long_ones(spark):
    schema = "page_id long, url string, html string, text string"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    long = "<html><body><nav><ul><li><a>Home</a></li></ul></nav><article>" + "".join(
        f"<p>This is sentence number {k} of a very long article, which goes on.</p>"
        for k in range(3000)
    ) + "</article></body></html>"
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame([(1, "u", long, "clash"), (2, None, None, None), (2, None, "", "x")], schema)).collect()}
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[1]["text"].count("\n") > 2900 and got[1]["n_chars"] == len(got[1]["text"])


# op4


def sql_of(query, **tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame)
    got = c.execute(query)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def test_records_of_null_and_repeated_pages(spark, tmp_path):
    big = ["x" * 1500, "y" * 1000, "z" * 999]
    rows = [
        (None, "u", big[0]), (2, "u", big[0]), (1, "u", big[0]), (2, "u", big[0]), (None, "u", big[1]), (None, "v", big[1]),
        (3, "u", big[2]), (4, "u", big[2]), (5, None, None), (6, "u", "w" * 3_000_000)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op4_warc(spark, str(tmp_path)).collect()
    want = sql_of(warc.OP4_SQL, pages=pages.toPandas().assign(page_id=lambda f: f["page_id"].astype("Int64")))
    key = lambda r: tuple(str(r[c]) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"))
    assert sorted(map(key, (r.asDict() for r in got))) == sorted(map(key, want))
    assert collections.Counter((r["page_id"], r["record_type"]) for r in got if r["payload_bytes"] == 1500) == {(None, "revisit"): 1, (1, "revisit"): 1, (2, "response"): 2}
    assert {r["record_type"] for r in got if r["payload_bytes"] == 1000} == {"response"}


def test_only_what_is_reached_is_a_record(spark, tmp_path, monkeypatch):
    forged = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = spark.createDataFrame([(k, "u", f"text {k}{forged}") for k in range(5)], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "w"))
    assert sorted(r["page_id"] for r in warc.read(spark, str(tmp_path / "w")).collect()) == list(range(5))
    monkeypatch.setattr(warc, "entries", lambda spark, at: warc.scan(spark, at).select("file", "split").distinct().withColumn("entry", F.lit(None).cast("long")))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_pointer_jumping_reaches_the_chain():
    rng = random.Random(9)
    for _ in range(50):
        magic = np.array(sorted(rng.sample(range(500), 30)))
        after = np.array([rng.choice([-1, *magic[magic > m].tolist(), 900]) for m in magic])
        entry = int(rng.choice(magic))
        want, at = set(), entry
        while at in magic:
            want.add(at)
            at = int(after[np.flatnonzero(magic == at)[0]])
        assert set(magic[warc._reached(magic, after, entry)].tolist()) == want


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op4_warc(spark, str(tmp_path)).count() == 0


# op5


@pytest.mark.parametrize("seed", range(5))
def test_the_index_of_sums_is_exact(seed):
    rng = random.Random(seed)
    left = packing._Left(60)
    counts = {rng.randint(1, 60): rng.randint(1, 5) for _ in range(12)}
    for x, n in counts.items():
        left.add(x, n)
    for x in rng.sample(sorted(counts), 6):
        left.add(x, -rng.randint(1, counts[x]))
    pieces = [x for x in range(61) for _ in range(min(3, left.counts[x]))]
    for k, index in ((2, left.pairs), (3, left.triples)):
        sums = collections.Counter(sum(c) for c in set(itertools.combinations(pieces, k)))
        assert {g: int(n) for g, n in enumerate(index) if n} == {g: n for g, n in sums.items() if g <= 60}


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing._Words(path), Tokenizer.from_file(path)


def test_a_word_is_learned_once_whatever_its_capitals_and_marks():
    words, tokenizer = _tokenizer()
    forms = [f"{a}{w}{b}" for w in ("river", "RIVER", "River", "été", "ÉTÉ") for a in ("", "(", '"') for b in ("", ",", ".", "!!", "-7.")]
    ids, bounds = words.encode(*utf8(pa.array([" ".join(forms), "\n".join(forms)])))
    want = tokenizer.encode(" ".join(forms), add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and bounds.tolist() == [0, len(want), 2 * len(want)]
    assert sorted(k.decode() for k in words.rows) == sorted(["river", "été", "(", '"', ",", ".", "!!", "-", "7"])


@pytest.mark.parametrize("window", [1 << 21, 40])
def test_ids_are_the_tokenizers(monkeypatch, window):
    """Awkward characters beside one another, words that leave the cache, long texts in parts."""
    monkeypatch.setattr(packing, "WINDOW", window)
    monkeypatch.setattr(packing, "CACHED_WORDS", 300)
    words, tokenizer = _tokenizer()
    rng = random.Random(window)
    bits = [*"aZ'9.,<|>!`_ßÀÿ×÷µªº²½İıſKÅΣσςДд中あ한ᄒ\u0301\u0308\u030a\u0345\u00a0\u0085\u00ad\u200b\u200d\u2028\u3000\ufeff\x00\x1c\x1f\x7f😀"]
    bits += [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'RE", "It's", "words", "Été,", "l'eau", "</w>", "a-b", "3.14", "...", "fi", "Ǆ"] * 3
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "\u0301a", "e", ""]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for k in range(0, len(texts), 1 if window == 40 else 70):
        ids, bounds = words.encode(*utf8(pa.array(texts[k : k + (1 if window == 40 else 70)])))
        for j, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            assert ids[a:b].tolist() == want[k + j], repr(texts[k + j])
    assert words.encode(*utf8(pa.array([], pa.string())))[0].tolist() == []


# op6


def test_quality_is_the_difference_alone(spark):
    rng = random.Random(5)
    words = [["river", "stone", "evening", "letter", "window"], ["BUY!!", "$$$", "CLICK", "%%%", "free"]]
    rows = [(" ".join(rng.choice(words[k % 2]) for _ in range(rng.randint(1, 900))), 1 - k % 2) for k in range(60)]
    model = quality.fit(rows)
    tools = [
        zstandard.ZstdCompressor(
            level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False, write_dict_id=False
        )
        for d in (model.good, model.bad)
    ]
    texts = [t for t, _ in rows] + ["", "é" * 5000]
    got = [r["score"] for r in sorted(quality.score(documents(spark, list(enumerate(texts)), "q"), model).collect(), key=lambda r: r["doc_id"])]
    for t, s in zip(texts, got):
        raw = t.encode()
        good, bad = (sum(len(tool.compress(raw[a : a + quality.BLOCK])) for a in range(0, len(raw), quality.BLOCK)) for tool in tools)
        d = (bad - good) / (bad + good) if raw else 0.0
        assert s == pytest.approx(1 / (1 + math.exp(-(model.offset + model.slope * d))), abs=1e-9)
    assert model.slope > 0 and np.mean(got[0:60:2]) > 0.9 > 0.1 > np.mean(got[1:60:2])


def test_held_out_quality(spark):
    """Labels that the model has never seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model, share = quality.trained(docs, labels)
    assert 0.5 < share < 1
    held = quality.score(docs, model).join(labels.filter(quality.is_held_out() & F.col("quality").isNotNull()), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert len(bad) >= 5 and np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.9


def test_classifiers_without_documents_or_labels(spark, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    some = documents(spark, [(k, f"text {k}") for k in range(20)] + [(3, "again"), (None, None)], "some")
    for lab in (empty, labels):
        model, share = quality.trained(none, lab)
        assert model is None and quality.score(none, model).count() == 0 and 0 <= share <= 1
        assert toxicity.score(none, toxicity.trained(none, lab)).count() == 0
    assert {r["score"] for r in quality.score(some, quality.trained(some, empty)[0]).collect()} == {0.5}
    assert toxicity.score(some, toxicity.trained(some, empty)).count() == 22


def test_a_repeated_sampled_row_is_one_text(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    many = documents(spark, [(1, f"text {k % 3}") for k in range(300)] + [(2, "other")], "many")
    assert toxicity.labelled_sample(many, labels, "toxic", 10) == [("text 0", 1), ("other", 0)]


# op7


def test_repeats_equal_their_sql(spark):
    got = {tuple(r) for r in suffix_dedup.op7_suffix_array_dedup(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert got == set(c.execute(suffix_dedup.OP7_SQL).fetchall())


# op9: every document aligned with every item


def test_leaks_by_brute_force(spark):
    rng = random.Random(21)
    vocabulary = ["".join(p) for p in itertools.product("bdfgk", "aeiou", "lmn")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (1, 2, 2, 3, 4, 9, 20, 40, 40)] + [["ultrarareone", "ultrararetwo"], []]
    docs = [say(60) for _ in range(20)] + [["zz", "qq", "ultrarareone", "ultrararetwo", "vv"], ["ultrarareone"], [], say(4000)]
    for k in range(30):
        own = list(items[k % 9])
        for _ in range(rng.randint(0, max(1, len(own) // 4))):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        docs.append(say(rng.randint(0, 25)) + own + say(rng.randint(0, 25)))
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            n = min(decontaminate.N, len(item))
            if n and len(doc) < 1000 and runs(item, n) & runs(doc, n):
                score, matches = brute_align(item, doc)
                if matches >= decontaminate.LEAST * len(item) or score >= decontaminate.ENOUGH:
                    want[d, i] = (matches, score)
    df = documents(spark, [(k, " ".join(d)) for k, d in enumerate(docs)] + [(None, None)], "leaky").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(50, " ".join(items[7])), (51, None), (None, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matches"], r["score"]) for r in decontaminate.find_leaks(df, bench).collect() if r["doc_id"] != 23}
    assert got == want and (20, 9) in got and (21, 9) not in got
    stage_kept = {r["doc_id"] for r in df.collect()} - {d for d, _ in got}
    assert {k for k in stage_kept if k not in (None, 23)} == set(range(len(docs))) - {d for d, _ in want} - {23}
    assert {r["same_items"] for r in decontaminate.find_leaks(df, bench).filter("item_id = 7").collect()} <= {2}


@pytest.mark.parametrize("size", [30, 200, 1 << 24])
def test_slices_of_items_change_nothing(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(decontaminate.slices, "__defaults__", (size,))
    rows = [(k, f"alpha{k} beta{k} gamma{k % 3} delta common phrase here") for k in range(12)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = documents(spark, [(k, f"so alpha{k} beta{k} gamma{k % 3} delta it is" if k % 2 else f"common phrase here {k} and nothing else of it at all") for k in range(12)], "s")
    kept = {r["doc_id"] for r in decontaminate.stage(spark, df, str(tmp_path)).collect()}
    assert kept == {k for k in range(12) if k % 2 == 0}


def test_leaks_without_documents(spark, none):
    assert decontaminate.find_leaks(none, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


# op10


def brute_links(rows):
    """vec_id -> (links, smallest vec_id reachable); rows: (vec_id, numbers)."""
    ids = [i for i, _ in rows]
    near = {i: set() for i in ids}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.9:
            near[i].add(j)
            near[j].add(i)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            least = min([root[i], *(root[j] for j in near[i])])
            changed |= least < root[i]
            root[i] = least
    return {i: (len(near[i]), root[i]) for i in ids}


def test_links_and_components_of_every_width(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 64)  # so that widths of some hundred vectors have a grid
    rng = np.random.default_rng(6)
    rows, key = [], itertools.count()
    for width, groups in ((16, 60), (8, 40), (4, 3), (1, 1)):
        for _ in range(groups):
            base = rng.normal(size=width)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((next(key), (base + rng.normal(0, 0.06 * rng.integers(0, 4), width)).astype(np.float32).astype(float).tolist()))
    report: list = []
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), report=report).collect()
    want = brute_links(rows)
    assert {r["width"] for r in report} == {8, 16} and all(r["recall"] >= 0.985 for r in report)
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got) and found >= 0.985 * sum(n for n, _ in want.values())
    exact = [r for r in got if r["n_links"] == want[r["vec_id"]][0]]
    assert len(exact) >= 0.97 * len(got)
    if found == sum(n for n, _ in want.values()):
        assert {r["vec_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}
    small = {i for i, v in rows if len(v) in (1, 4)}  # without a grid: exact
    assert all((r["n_links"], r["component_id"]) == want[r["vec_id"]] for r in got if r["vec_id"] in small)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_too_few_cells_are_doubled(spark):
    """Recall on probes that had no part in the choice decides."""
    rows = np.array([[0, 0, 0, 1], [1, 0, 100, 1], [2, 1, 2, 1], [3, 1, 90, 1]])
    assert embedding_dedup._recall(rows, 1) == 0.0 and embedding_dedup._recall(rows, 101) == 1.0 and embedding_dedup._recall(rows, 10) == 0.5


def test_vectors_equal_their_sql(spark):
    names = ("vec_id", "n_links", "component_id", "kept")
    got = {tuple(r[n] for n in names) for r in embedding_dedup.op10_inverted_multi_index(spark, SMALL).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    assert got == set(c.execute(embedding_dedup.OP10_SQL).fetchall())


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")).count() == 2


# all of them


def test_empty_tables(spark, none):
    assert ngram_lm.score(none).count() == 0 and minhash.near_duplicates(none).count() == 0 and suffix_dedup.repeats(none).count() == 0
