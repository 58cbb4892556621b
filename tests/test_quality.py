"""Planted defects are found, and clean histories pass."""

import numpy as np
import pytest

from barloom.operators import quality
from barloom.sources.synthetic import regime_walk

LIMITS = quality.Limits()


def clean(n=600):
    return regime_walk(n, 101)


def found(spark, frame, limits=LIMITS):
    frame = frame.copy()
    frame.insert(0, "symbol", "X")
    frame["date"] = frame["date"].dt.date
    bars = spark.createDataFrame(frame, "symbol string, date date, open double, high double, low double, close double, volume bigint")
    return {(r["check_name"], r["severity"]) for r in quality.issues(bars, limits).collect()}


def fails(issues):
    return {c for c, s in issues if s == "fail"}


def test_clean(spark):
    assert not fails(found(spark, clean()))


def test_gap(spark):
    assert fails(found(spark, clean().drop(index=range(200, 215)))) == {"gaps"}


def test_bad_print(spark):
    f = clean()
    f.loc[300, ["open", "high", "low", "close"]] *= 4
    f.loc[300, "volume"] = int(f.volume[280:300].median())
    assert "spikes" in fails(found(spark, f))


def test_lasting_move_is_a_warning(spark):
    f = clean()
    f.loc[300:, ["open", "high", "low", "close"]] *= 0.75
    got = found(spark, f)
    assert ("spikes", "warn") in got and "spikes" not in fails(got)


def test_crash_and_bounce_on_volume_is_a_warning(spark):
    f = clean()
    f.loc[300:, ["open", "high", "low", "close"]] *= 0.90
    f.loc[301:, ["open", "high", "low", "close"]] /= 0.92
    f.loc[[300, 301], "volume"] *= 5
    got = found(spark, f)
    assert "spikes" not in fails(got)


def test_split(spark):
    f = clean()
    f.loc[350:, ["open", "high", "low", "close"]] /= 2
    f.loc[350, "volume"] = int(f.volume[330:350].median() * 10)
    assert "split_echo" in fails(found(spark, f))


def test_short_and_negative(spark):
    assert found(spark, clean(100)) == {("length", "fail")}
    f = clean()
    f.loc[100, "low"] = -1.0
    assert "positivity" in fails(found(spark, f))


def test_thin_volume_and_weekend(spark):
    f = clean()
    f["volume"] = 5
    assert ("volume", "warn") in found(spark, f)


@pytest.mark.parametrize("seed", range(4))
def test_business_days(spark, seed):
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    rng = np.random.default_rng(seed)
    rows = [(date(2020, 1, 1) + timedelta(int(a)), date(2020, 1, 1) + timedelta(int(a + b))) for a, b in zip(rng.integers(0, 60, 20), rng.integers(0, 40, 20))]
    df = spark.createDataFrame(rows, "a date, b date").select("a", "b", quality._business_days(F.col("a"), F.col("b")).alias("n"))
    for r in df.collect():
        assert r["n"] == sum((r["a"] + timedelta(k)).weekday() < 5 for k in range((r["b"] - r["a"]).days + 1))
