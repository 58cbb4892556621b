"""Market regimes, and trades by the regime they end in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("down", "flat", "up")


def label(closes: DataFrame, window: int = 63, key: str = "symbol") -> DataFrame:
    """key, date, label: terciles of the `window`-bar return over the whole history; flat where there is none, or fewer than 30."""
    w = Window.partitionBy(key).orderBy("date")
    rows = closes.select(key, "date", (F.try_divide("close", F.lag("close", window).over(w)) - 1).alias("roll"))
    cuts = rows.groupBy(key).agg(F.percentile("roll", 1 / 3).alias("lo"), F.percentile("roll", 2 / 3).alias("hi"), F.count("roll").alias("n"))
    ok = (F.col("n") >= 30) & F.col("roll").isNotNull()
    return rows.join(cuts, key).select(
        key, "date",
        F.when(ok & (F.col("roll") >= F.col("hi")), "up").when(ok & (F.col("roll") <= F.col("lo")), "down").otherwise("flat").alias("label")
    )


def as_of(left: DataFrame, right: DataFrame, time: str, right_time: str, values: list[str], by: list[str] = (), every: str = "month") -> DataFrame:
    """left with the values of the last right row at or before its time: one sorted pass, no range join.

    by: columns whose values must be equal. Time is cut into months (`every`), so that a
    pass is sorted in many tasks also without such columns; what holds at a month's
    start is carried into it from a table of one row for each month."""
    by = list(by)
    left = left.withColumn("__m", F.date_trunc(every, F.col(time)))
    facts = right.select(*by, F.date_trunc(every, F.col(right_time)).alias("__m"), F.col(right_time).alias("__t"), F.struct(*values).alias("__v"))
    ends = facts.groupBy(*by, "__m").agg(F.max_by("__v", "__t").alias("__v"))
    months = left.select(*by, "__m").distinct().join(ends, [*by, "__m"], "full")
    past = Window.partitionBy(*by).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(*by, "__m", F.last("__v", ignorenulls=True).over(past).alias("__v")).filter("__v is not null")
    known = facts.select(*by, "__m", "__t", F.lit(0).alias("__side"), "__v").unionByName(
        carried.select(*by, "__m", F.lit(None).cast(right.schema[right_time].dataType).alias("__t"), F.lit(0).alias("__side"), "__v")
    )
    both = left.withColumn("__t", F.col(time).cast(right.schema[right_time].dataType)).withColumn("__side", F.lit(1)).unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__m").orderBy(F.asc_nulls_first("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select(*(c for c in left.columns if c != "__m"), *(F.col(f"__v.{v}").alias(v) for v in values))


def pnl(trades: DataFrame, labels: DataFrame, key: str = "scenario_id") -> DataFrame:
    """key, label, pnl, n_trades for all three labels; labels: (date, label). Before the first label a trade is flat."""
    matched = as_of(trades.select(key, "exit_ts", "pnl"), labels, "exit_ts", "date", ["label"]).withColumn("label", F.coalesce("label", F.lit("flat")))
    sums = matched.groupBy(key, "label").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n_trades"))
    every = trades.select(key).distinct().select(key, F.explode(F.array(*(F.lit(x) for x in LABELS))).alias("label"))
    return every.join(sums, [key, "label"], "left").select(key, "label", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.coalesce("n_trades", F.lit(0)).alias("n_trades"))
