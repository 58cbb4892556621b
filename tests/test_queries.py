"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from barloom import queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T", " ").removesuffix(" 00:00:00")
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4)
    return value


def rows(names, columns, got):
    order = [columns.index(n) for n in names]
    return sorted(([plain(r[k]) for k in order] for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    a, b = rows(df.columns, df.columns, df.collect()), rows(df.columns, columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=1e-6) if all(isinstance(v, (int, float)) for v in x) else all(
            p == pytest.approx(q, rel=1e-6, abs=1e-4) if isinstance(p, float) and isinstance(q, float) else p == q
            for p, q in zip(x, y)
        ), (x, y)


@pytest.mark.parametrize("name", ["bootstrap_blocks", "synthetic_bars"])
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["family_config_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" in plan and "o_totalprice" not in plan and "o_comment" not in plan and "c_name" not in plan
    plan = queries.QUERIES["ind_sma"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_discount" not in plan and "Python" not in plan


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["symbol", "date", "desired_state"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bars_daily", "sma_cross_signals", "gap_runs", "regime_pnl_asof"])
def test_equal_at_any_number_of_partitions(spark, name):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_bootstrap_draws_from_all_trades(spark, monkeypatch):
    at = SF.replace("0.001", "0.01")
    asked = []
    monkeypatch.setattr(queries.validation, "trade_bootstrap", lambda spark, pnls, *rest: asked.append((pnls, rest[-1])) or {"n": 0.0})
    queries.bootstrap_trades(spark, at)
    pnls, often = asked[0]
    n, total = duckdb.connect().execute(f"SELECT count(*), sum(round(l_extendedprice - 38000, 2)) FROM read_parquet('{at}/lineitem.parquet') WHERE l_returnflag = 'R'").fetchone()
    assert sum(often) == n > 500 and sum(p * k for p, k in zip(pnls, often)) == pytest.approx(total)


def test_losing_streak_of_nulls_equals_its_sql(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"""CREATE VIEW lineitem AS SELECT * REPLACE (CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice / 2 END AS l_extendedprice, CASE WHEN l_suppkey % 5 <> 0 THEN l_shipdate END AS l_shipdate,
      CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS l_returnflag) FROM read_parquet('{SF}/lineitem.parquet')""")
    c.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = queries.losing_streak(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(c.execute(queries.ORACLE["losing_streak"]).fetchall(), key=repr)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_takes_no_rows_to_the_driver(spark, monkeypatch):
    asked, rows = [], []
    monkeypatch.setattr(queries.validation, "trade_bootstrap", lambda spark, pnls, *rest: asked.append((pnls, rest[-1])) or {"n": 0.0})
    kind = type(spark.range(1))
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toArrow"):
            m.setattr(kind, name, lambda self, *a, f=getattr(kind, name): rows.append(out := f(self, *a)) or out)
        queries.bootstrap_trades(spark, SF)
    assert sum(map(len, rows)) < 100
    pnls, often = asked[0]
    want = duckdb.connect().execute(f"SELECT round(l_extendedprice - 38000, 2) AS x, count(*) FROM read_parquet('{SF}/lineitem.parquet') WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY 1").fetchall()
    assert len(want) > 1000 and pnls.tolist() == [x for x, _ in want] and often.tolist() == [n for _, n in want]
    assert pnls.nbytes + often.nbytes == 16 * len(want)


def test_chain_is_verified_by_ranges(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    monkeypatch.setattr(queries.search, "RANGE", 16)
    seqs = [k * k if k < 300 else 10**12 + k for k in range(500)]  # with gaps, so that ranges are empty
    log = spark.createDataFrame([(k, f"t{k}", "a", "e", "p") for k in seqs], "seq long, ts string, actor string, event_type string, payload_json string")
    link = F.sha2(F.col("seq").cast("string"), 256)
    log = log.withColumn("this_hash", link).withColumn("prev_hash", F.coalesce(F.lag(link).over(Window.orderBy("seq")), F.lit("0" * 64)))
    log = log.withColumn("prev_hash", F.when(F.col("ts").isin("t49", "t1000000000400"), "broken").otherwise(F.col("prev_hash")))
    for n in (500, 200):  # ranges that hold many rows, and ranges of a few
        some = log.filter(F.col("seq") <= seqs[n - 1])
        got = queries.search.chain_state(some).collect()
        assert len(got) == n and {r["seq"] for r in got if not r["prev_ok"]} == {49, 10**12 + 400} & set(seqs[:n])
    plan = queries.search.chain_state(
        spark.range(10).select(F.col("id").alias("seq"), *(F.lit("x").alias(c) for c in ("ts", "actor", "event_type", "payload_json", "prev_hash", "this_hash")))
    )._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("windowspecdefinition(__part" in line for line in windows)  # none is over the whole log
    assert queries.search.chain_state(log.limit(0)).count() == 0
