from pyspark.sql import functions as F

from barloom.streaming import bars
from tests.conftest import SF


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.select(*[c.split(" ")[0] for c in bars.EVENTS.split(", ")]).sort("ts").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "in"))
    bars.write_bars(bars.hourly_bars(bars.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["symbol"], r["hour"]): tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["symbol"], r["hour"]): tuple(r) for r in bars.hourly_bars(spark.read.parquet(str(tmp_path / "in"))).collect()}
    last = max(h for _, h in want)
    assert got and all(want[k] == v for k, v in got.items())
    # only hours that the watermark hasn't passed are still open
    assert all((last - h).total_seconds() <= 3 * 3600 for k, h in want if (k, h) not in got)
