"""Data-quality rules over bars: one query for each rule, all symbols at once.

issues() gives symbol, check_name, severity, detail, range_start, range_end.
Symbols that are too short, or hold a date twice, get that finding alone. The
local window of the spike rule looks ten bars ahead: these rules judge data,
they never feed a signal."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    max_consecutive_gap_days: int = 5
    spike_zscore: float = 8.0
    min_avg_volume: float = 10_000
    min_bars: int = 300


def _w():
    return Window.partitionBy("symbol").orderBy("date")


def _issue(rows: DataFrame, check: str, severity: str, detail: Column, start: Column | None = None, end: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("date")
    return rows.select(
        "symbol", F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), detail.alias("detail"),
        (none if start is None else start).alias("range_start"), (none if end is None else end).alias("range_end")
    )


def lengths(bars: DataFrame, limits: Limits) -> DataFrame:
    some = bars.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") < limits.min_bars)
    return _issue(some, "length", "fail", F.concat(F.col("n").cast("string"), F.lit(f" bars, fewer than the {limits.min_bars} asked for")))


def doubled_dates(bars: DataFrame) -> DataFrame:
    some = bars.groupBy("symbol", "date").count().filter("count > 1").select("symbol").distinct()
    return _issue(some, "calendar", "fail", F.lit("a date occurs more than once"))


def positivity(bars: DataFrame) -> DataFrame:
    return bars.filter(F.least("open", "high", "low", "close") <= 0)


def bounds(bars: DataFrame) -> DataFrame:
    return bars.filter((F.col("low") > F.least("open", "close") + 1e-9) | (F.col("high") < F.greatest("open", "close") - 1e-9))


def weekends(bars: DataFrame) -> DataFrame:
    return bars.filter(F.weekday("date") >= 5)


def missing_days(bars: DataFrame) -> DataFrame:
    """symbol, date: business days between a symbol's first and last bar without a bar."""
    spans = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = spans.select("symbol", F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    return days.join(bars, ["symbol", "date"], "left_anti")


def _business_days(a: Column, b: Column) -> Column:
    """Business days from a to b, both counted: whole weeks have five; what is left is cut at the weekend."""
    days, first = F.datediff(b, a) + 1, F.weekday(a)
    rest = days % 7
    weekend = F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(
        F.lit(0), F.least(first + rest, F.lit(14)) - F.greatest(first, F.lit(12))
    )
    return F.floor(days / 7) * 5 + rest - weekend


def gap_runs(bars: DataFrame) -> DataFrame:
    """symbol, run_start, run_end, business_days: missing days at most three calendar days apart are one run."""
    w = _w()
    rows = missing_days(bars).withColumn("new", F.when(F.datediff("date", F.lag("date").over(w)) <= 3, 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("symbol", "run").agg(F.min("date").alias("run_start"), F.max("date").alias("run_end")).select(
        "symbol", "run_start", "run_end", _business_days(F.col("run_start"), F.col("run_end")).cast("bigint").alias("business_days")
    )


def gaps(bars: DataFrame, limits: Limits) -> DataFrame:
    long = F.col("business_days") > limits.max_consecutive_gap_days
    some = gap_runs(bars).groupBy("symbol").agg(
        F.count("*").alias("n"), F.count(F.when(long, 1)).alias("long"),
        F.min(F.when(long, F.struct("run_start", "run_end"))).alias("first")
    )
    failed = _issue(
        some.filter("long > 0"), "gaps", "fail",
        F.concat(F.col("long").cast("string"), F.lit(f" gap(s) of more than {limits.max_consecutive_gap_days} business days")),
        F.col("first.run_start"), F.col("first.run_end")
    )
    return failed.unionByName(_issue(some.filter("long = 0"), "gaps", "info", F.concat(F.col("n").cast("string"), F.lit(" gap(s), none of them too long"))))


def spike_rows(bars: DataFrame, limits: Limits) -> DataFrame:
    """symbol, date, bad_print of every return beyond the robust z-score."""
    w = _w()
    rows = bars.withColumn("r", F.ln("close") - F.ln(F.lag("close").over(w)))
    middle = rows.groupBy("symbol").agg(F.percentile("r", 0.5).alias("median"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n")).filter("n > 20")
    rows = rows.join(middle, "symbol")
    mad = rows.groupBy("symbol").agg(F.percentile(F.abs(F.col("r") - F.col("median")), 0.5).alias("mad"))
    scale = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9)
    w20 = w.rowsBetween(-19, 0)
    rows = rows.join(mad, "symbol").select(
        "symbol", "date", "r", (F.abs(F.col("r") - F.col("median")) / scale).alias("z"), F.coalesce(F.lead("r").over(w), F.lit(0.0)).alias("next"), "volume",
        F.when(F.count("volume").over(w20) >= 5, F.percentile("volume", 0.5).over(w20)).alias("usual"),
        F.concat(F.collect_list("r").over(w.rowsBetween(-10, -1)), F.collect_list("r").over(w.rowsBetween(1, 10))).alias("near"),
    ).filter(F.col("z") > limits.spike_zscore)

    def median(values: Column) -> Column:
        x, n = F.array_sort(values), F.size(values)
        return (F.element_at(x, F.floor((n + 1) / 2).cast("int")) + F.element_at(x, F.floor(n / 2).cast("int") + 1)) / 2

    rows = rows.withColumn("near_median", F.when(F.size("near") >= 5, median(F.col("near"))))
    rows = rows.withColumn("near_mad", F.when(F.size("near") >= 5, median(F.transform("near", lambda x: F.abs(x - F.col("near_median")))) * 1.4826))
    alone = F.when(F.col("near_mad") > 0, F.abs(F.col("r") - F.col("near_median")) / F.col("near_mad") > limits.spike_zscore).otherwise(True)
    back = (F.col("r") * F.col("next") < 0) & (F.abs(F.col("r") + F.col("next")) < 0.4 * F.abs("r"))
    surge = F.coalesce((F.col("usual") > 0) & (F.col("volume") > 1.5 * F.col("usual")), F.lit(False))
    return rows.select("symbol", "date", (back & ~surge & alone).alias("bad_print"))


def split_rows(bars: DataFrame) -> DataFrame:
    """symbol, date of closes at about 1/3, 1/2, 2 or 3 times the last one, on more than three times the usual volume."""
    w = _w()
    w20 = w.rowsBetween(-19, 0)
    ratio = F.try_divide("close", F.lag("close").over(w))
    usual = F.when(F.count("volume").over(w20) == 20, F.percentile("volume", 0.5).over(w20))
    rows = bars.select("symbol", "date", ratio.alias("ratio"), F.try_divide("volume", usual).alias("times"))
    near = reduce(lambda a, b: a | b, (F.abs(F.col("ratio") - x) <= 1e-8 + 0.02 * x for x in (0.5, 2.0, 1 / 3, 3.0)))
    return rows.filter(near & (F.col("times") > 3)).select("symbol", "date")


def thin_volume(bars: DataFrame, limits: Limits) -> DataFrame:
    w = _w()
    mean = F.when(F.count("volume").over(w.rowsBetween(-19, 0)) == 20, F.avg("volume").over(w.rowsBetween(-19, 0)))
    last = bars.select("symbol", "date", mean.alias("mean")).groupBy("symbol").agg(F.max_by("mean", "date").alias("mean")).filter(F.col("mean") < limits.min_avg_volume)
    return _issue(last, "volume", "warn", F.concat(F.lit("mean volume of the last 20 bars is "), F.format_number("mean", 0), F.lit(f", under {limits.min_avg_volume:,.0f}")))


def _counted(rows: DataFrame, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """One aggregate for all (check, severity, condition, text with {n}): an issue for each symbol and rule that rows meet."""
    held = []
    for k, (_, _, met, _) in enumerate(rules):
        held += [F.count(F.when(met, 1)).alias(f"n{k}"), F.min(F.when(met, F.col("date"))).alias(f"a{k}"), F.max(F.when(met, F.col("date"))).alias(f"z{k}")]
    said = []
    for k, (check, severity, _, text) in enumerate(rules):
        before, after = text.split("{n}")
        detail = F.concat(F.lit(before), F.col(f"n{k}").cast("string"), F.lit(after))
        dated = check != "weekend_bars"
        said.append(
            F.struct(
                F.col(f"n{k}").alias("n"), F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), detail.alias("detail"),
                *((F.col(f"{c}{k}") if dated else F.lit(None).cast("date")).alias(name) for c, name in (("a", "range_start"), ("z", "range_end")))
            )
        )
    return rows.groupBy("symbol").agg(*held).select("symbol", F.inline(F.array(*said))).filter("n > 0").drop("n")


def issues(bars: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Bars are shuffled once, by symbol; the rules' windows, aggregates and joins all keep to that."""
    bars = bars.select("symbol", "date", "open", "high", "low", "close", "volume").repartition("symbol")
    short, double = lengths(bars, limits), doubled_dates(bars)
    double = double.join(short, "symbol", "left_anti")
    z = f"{limits.spike_zscore:.0f}"
    plain = [
        ("positivity", "fail", F.least("open", "high", "low", "close") <= 0, "{n} bar(s) with a price of zero or less"),
        (
            "ohlc_bounds", "fail", (F.col("low") > F.least("open", "close") + 1e-9) | (F.col("high") < F.greatest("open", "close") - 1e-9),
            "{n} bar(s) whose low and high do not enclose open and close"
        ),
        ("weekend_bars", "warn", F.weekday("date") >= 5, "{n} bar(s) on a Saturday or Sunday"),
    ]
    spikes = [
        ("spikes", "fail", F.col("bad_print"), "{n} spike(s) taken back on the next bar, as bad prints are"),
        ("spikes", "warn", ~F.col("bad_print"), "{n} move(s) beyond " + z + " robust deviations that lasted"),
    ]
    splits = [("split_echo", "fail", F.lit(True), "{n} bar(s) that look like splits nobody adjusted for")]
    # rules judge each symbol for itself, so symbols with the first two findings are left out of the few findings, not of the bars
    found = reduce(
        DataFrame.unionByName,
        [_counted(bars, plain), gaps(bars, limits), _counted(spike_rows(bars, limits), spikes), _counted(split_rows(bars), splits), thin_volume(bars, limits)]
    )
    first = short.unionByName(double)
    return found.join(first.select("symbol"), "symbol", "left_anti").unionByName(first)


def passing(bars: DataFrame, found: DataFrame) -> DataFrame:
    """symbol, passes."""
    failed = found.filter("severity = 'fail'").select("symbol").distinct().withColumn("failed", F.lit(True))
    return bars.select("symbol").distinct().join(failed, "symbol", "left").select("symbol", F.col("failed").isNull().alias("passes"))
