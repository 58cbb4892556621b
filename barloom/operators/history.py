"""What was known at the close of a day: bars up to it, and nothing after it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def known(bars: DataFrame, day: date | str) -> DataFrame:
    """Bars up to `day`, itself included. The bound reaches the scan wherever dates do."""
    return bars.filter(F.col("date") <= F.lit(day).cast("date"))


def tail(bars: DataFrame, day: date | str, n: int) -> DataFrame:
    """Each symbol's last n bars as of `day`; fewer where there are fewer."""
    if n < 1:
        raise ValueError("a tail has at least one bar")
    latest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return known(bars, day).withColumn("__k", latest).filter(F.col("__k") <= n).drop("__k")


def last_close(bars: DataFrame, day: date | str) -> DataFrame:
    """symbol, last_close as of `day`; symbols without a bar by then have no row."""
    return known(bars, day).groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"))
