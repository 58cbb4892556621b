"""The whole pipeline on the smallest tables, stage by stage."""

import importlib.util

from tests.conftest import SF


def test_stages(spark):
    import corpus_pipeline
    from barloom.llm import decontaminate, minhash, suffix_dedup, toxicity
    from barloom.llm.shared import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    model = toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).filter(f"p_toxic >= {toxicity.REJECT_FROM}").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    every = ids(docs)
    one = materialise(by["toxicity"](spark, docs, SF), "t1")
    assert one.columns == columns and ids(one) == every - toxic
    two = materialise(by["near_duplicates"](spark, one, SF), "t2")
    assert two.columns == columns and ids(two) == {r["doc_id"] for r in minhash.near_duplicates(one).filter("kept").collect()}
    three = materialise(by["repeated_passages"](spark, two, SF), "t3")
    assert three.columns == columns and ids(three) == ids(two)
    kept = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in suffix_dedup.repeats(two).collect()}
    assert {r["doc_id"]: r["text"] for r in three.collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())
    four = materialise(by["decontamination"](spark, three, SF), "t4")
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(three, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert four.columns == columns and ids(four) == ids(three) - leaks
    five = corpus_pipeline.run(spark, SF)
    assert ids(five) == ids(four) and five.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_entry_without_the_folder(tmp_path):
    """The other queries work when the operators' folders and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(importlib.util.find_spec("__spark_entry__").origin))
    shutil.copytree(f"{root}/barloom", tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"],
        cwd=tmp_path, env=env, capture_output=True, text=True, check=True
    )
    assert int(out.stdout.split()[0]) > 50 and out.stdout.split()[1] == "False"


def test_awkward_documents(spark, tmp_path):
    """Nulls in every column, empty, long and repeated texts, names that clash with the stages' own; and no rows at all."""
    import corpus_pipeline
    import os

    from barloom.llm.shared import shared_dir
    from pyspark.sql import functions as F

    rng = __import__("random").Random(8)
    say = lambda n: " ".join(rng.choice("river stone evening letter window garden silent cold north paper".split()) + str(rng.randrange(400)) for _ in range(n))
    text, long = say(80), say(20_000)
    rows = [(k, say(60), "en", "s", 1) for k in range(30)] + [(100, text, "en", "s", 1), (101, text, None, None, None), (101, text, "en", "s", 1)]
    rows += [
        (102, long, "en", "s", 1), (103, None, None, None, None), (104, "", "en", "s", 0), (None, None, None, None, None),
        (None, say(50), "en", "s", 1), (105, "one", "en", "s", 3)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("rep", "head", "cut_id", "cut_key", "cut_text", "item_id", "label", "part", "place", "dropped_id", "block", "key")
    docs = docs.select("*", *(F.lit("x").alias(n) for n in names))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(rows[3][1].split()[:30])), (2, None), (None, "")], "item_id long, text string")
    for folder, df in (("some", docs), ("none", docs.limit(0))):
        at = str(tmp_path / folder)
        df.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        one = df = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            one = corpus_pipeline.materialise(stage(spark, one, at), name)
            assert one.columns == df.columns
        kept = {r["doc_id"] for r in one.collect()}
        place = os.path.join(shared_dir(spark).removeprefix("file:"), "barloom")
        before = set(os.listdir(place))
        got = corpus_pipeline.run(spark, at).collect()
        left = set(os.listdir(place)) - before
        assert len(left) == 1 and left.pop().startswith("stage-packing")
        assert {r["doc_id"] for r in got} == kept
        if folder == "some":
            assert {102, 103, 105, None} <= kept and not {3, 101, 104} & kept and 100 in kept  # null and "" are copies
            used = {}
            for r in got:
                used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for runs in used.values():
                runs.sort()
                assert [a for a, _ in runs] == [sum(n for _, n in runs[:k]) for k in range(len(runs))] and sum(n for _, n in runs) <= 2048
        else:
            assert not got
