"""Metrics of equity curves and trades, as aggregates for any number of scenarios.

252 trading days a year, no risk-free rate. What is undefined is NULL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
_ROOT = YEAR**0.5


def _by(key: str):
    return Window.partitionBy(key).orderBy("date")


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.when(b != 0, b))


def returns(equity: DataFrame, key: str = "scenario_id", value: str = "equity") -> DataFrame:
    """key, date, r: relative changes from bar to bar; the first bar has none."""
    before = F.lag(value).over(_by(key))
    return equity.select(key, "date", _ratio(F.col(value), before).alias("q")).filter("q is not null").select(key, "date", (F.col("q") - 1).alias("r"))


def growth(r: Column, by: list[str], order: str = "date") -> Column:
    """The product of 1 + r up to each row: a sum of logarithms, with signs and zeros kept apart."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.exp(F.sum(F.when(r != -1, F.ln(F.abs(1 + r))).otherwise(0.0)).over(w))
    sign = F.when(F.sum((r < -1).cast("int")).over(w) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.max((r == -1).cast("int")).over(w) == 1, 0.0).otherwise(sign * size)


def sharpe(r: str = "r") -> Column:
    return _ratio(F.avg(r), F.stddev_samp(r)) * _ROOT


def sortino(r: str = "r") -> Column:
    down = F.sqrt(F.avg(F.when(F.col(r) < 0, F.col(r) * F.col(r))))
    return F.when(F.count(r) >= 2, _ratio(F.avg(r), down) * _ROOT)


def drawdowns(equity: DataFrame, key: str = "scenario_id", value: str = "equity") -> DataFrame:
    """key, date, drawdown (0 at a peak), under (number of the stretch below it)."""
    w = _by(key)
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = equity.select(key, "date", value, (_ratio(F.col(value), peak) - 1).alias("drawdown"))
    return rows.withColumn("under", F.sum(F.when(F.col("drawdown") < 0, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def underwater(equity: DataFrame, key: str = "scenario_id", value: str = "equity") -> DataFrame:
    """key, max_drawdown, longest_underwater_bars."""
    rows = drawdowns(equity, key, value)
    runs = rows.groupBy(key, "under").agg(F.sum(F.when(F.col("drawdown") < 0, 1).otherwise(0)).alias("bars"), F.min("drawdown").alias("drawdown"), F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.min("drawdown").alias("max_drawdown"), F.max("bars").cast("bigint").alias("longest_underwater_bars"), F.sum("n").alias("n")).select(
        key, F.when(F.col("n") >= 2, F.col("max_drawdown")).alias("max_drawdown"),
        F.when(F.col("n") >= 2, F.col("longest_underwater_bars")).otherwise(0).alias("longest_underwater_bars")
    )


def curve_metrics(equity: DataFrame, key: str = "scenario_id", value: str = "equity") -> DataFrame:
    """A row for each key: total_return, cagr, ann_vol, sharpe, sortino, max_drawdown, longest_underwater_bars, n_bars (and avg_exposure, if there is a column exposure)."""
    first, last = F.min_by(value, "date"), F.max_by(value, "date")
    exposure = [F.avg("exposure").alias("avg_exposure")] if "exposure" in equity.columns else []
    ends = equity.groupBy(key).agg(first.alias("first"), last.alias("last"), F.count("*").alias("n_bars"), *exposure)
    total = _ratio(F.col("last"), F.col("first"))
    growth = F.when(F.col("first") > 0, F.when(total <= 0, -1.0).otherwise(F.pow(total, YEAR / F.col("n_bars")) - 1))
    ends = ends.select(
        key, F.when(F.col("n_bars") >= 2, total - 1).alias("total_return"), F.when(F.col("n_bars") >= 2, growth).alias("cagr"), "n_bars",
        *(["avg_exposure"] if exposure else [])
    )
    of_returns = returns(equity, key, value).groupBy(key).agg((F.stddev_samp("r") * _ROOT).alias("ann_vol"), sharpe().alias("sharpe"), sortino().alias("sortino"))
    return ends.join(of_returns, key, "left").join(underwater(equity, key, value), key, "left")


def _losing_runs(batches):
    """Of sorted rows (key, lost, n): for each key's stretch, whether all were lost, the losing runs it begins and ends with, and the longest.

    A run is kept as a sum from batch to batch, so nothing grows with the rows."""
    part, seq, now, done = TaskContext.get().partitionId(), 0, None, []

    def rows(kind):
        columns = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 3))], ["key", "part", "seq", "whole", "head", "tail", "most"])

    kind = None
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.schema.field(0).type
        codes = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        lost, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for low, high in zip(edges, edges[1:]):
            key = b.column(0)[low].as_py()
            if now is None or now[0] != key:
                if now:
                    done.append(tuple(now))
                now, seq = [key, part, seq, True, 0, 0, 0], seq + 1
            stops = np.flatnonzero(~lost[low:high])
            sums = np.concatenate(([0], np.cumsum(np.where(lost[low:high], n[low:high], 0))))
            runs = np.diff(sums[stops], prepend=0, append=sums[-1])  # before the first stop, between stops, after the last
            runs[0] += now[5]
            if now[3]:
                now[4] = int(runs[0])
            now[3], now[5], now[6] = now[3] and not len(stops), int(runs[-1]), max(now[6], int(runs.max()))
        if done:
            yield rows(kind)
            done = []
    if now:
        done = [tuple(now)]
        yield rows(kind)


def losing_streaks(trades: DataFrame, key: str = "scenario_id", often: str | None = None) -> DataFrame:
    """key, longest_losing_streak: of trades by exit, then entry, then symbol; nulls come last. often: the column of how many trades a row stands for (none: one).

    Ranges of the whole order, whatever the keys, are folded one by one; a row for each range and key is then joined."""
    lost = F.coalesce(F.col("pnl") < 0, F.lit(False))
    rows = trades.select(F.col(key).alias("key"), "exit_ts", "entry_ts", "symbol", lost.alias("lost"), (F.col(often) if often else F.lit(1)).cast("bigint").alias("n"))
    order = [F.asc_nulls_last(c) for c in ("key", "exit_ts", "entry_ts", "symbol")] + [F.desc("lost")]
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "lost", "n").mapInArrow(
        _losing_runs, f"key {rows.schema['key'].dataType.simpleString()}, part int, seq bigint, whole boolean, head bigint, tail bigint, most bigint"
    )
    start = F.struct(F.lit(0).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("most"))

    def step(acc, x):
        return F.struct(
            F.when(x["whole"], acc["now"] + x["tail"]).otherwise(x["tail"]).alias("now"), F.greatest(acc["most"], x["most"], acc["now"] + x["head"]).alias("most")
        )

    ranges = F.array_sort(F.collect_list(F.struct("part", "seq", "whole", "head", "tail", "most")))  # of a key: as many as there are partitions, at most
    return runs.groupBy(F.col("key").alias(key)).agg(ranges.alias("ranges")).select(key, F.aggregate("ranges", start, step, lambda acc: acc["most"]).alias("longest_losing_streak"))


def trade_stats(trades: DataFrame, initial_capital: float, keys: DataFrame | None = None, key: str = "scenario_id") -> DataFrame:
    """A row for each key of `keys` (by default, of the trades): what trades won, lost and cost. A result of 0 counts as a loss."""
    won, lost = F.col("pnl") > 0, F.col("pnl") <= 0
    costs = F.sum("fees") + F.sum("slippage")
    one = trades.groupBy(key).agg(
        F.count("*").alias("n_trades"), F.avg(won.cast("double")).alias("win_rate"),
        F.coalesce(F.sum(F.when(won, F.col("pnl"))), F.lit(0.0)).alias("gross_profit_usd"), F.coalesce(-F.sum(F.when(lost, F.col("pnl"))), F.lit(0.0)).alias("gross_loss_usd"),
        F.avg("pnl").alias("expectancy_usd"), (F.avg("pnl") / initial_capital).alias("expectancy_pct"),
        F.avg(F.when(won, F.col("pnl"))).alias("avg_win_usd"), F.avg(F.when(lost, F.col("pnl"))).alias("avg_loss_usd"),
        F.sum("fees").alias("total_fees_usd"), F.sum("slippage").alias("total_slippage_usd"),
        _ratio(costs, F.abs(F.sum("pnl") + costs)).alias("cost_share_of_gross"), F.avg("holding_bars").alias("avg_holding_bars"),
    )
    one = one.withColumn("profit_factor", F.when(F.col("gross_loss_usd") > 0, F.col("gross_profit_usd") / F.col("gross_loss_usd"))).join(losing_streaks(trades, key), key, "left")
    if keys is not None:
        one = keys.select(key).distinct().join(one, key, "left").fillna(0, ["n_trades", "longest_losing_streak"]).fillna(
            0.0, ["total_fees_usd", "total_slippage_usd", "gross_profit_usd", "gross_loss_usd"]
        )
    return one


def _sum(array: Column, what) -> Column:
    """Sum of what(x) over an array; what is NULL adds nothing."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + F.coalesce(what(x).cast("double"), F.lit(0.0)))


def _streak(array: Column, under) -> Column:
    """The longest run of elements for which under(x) holds."""
    start = F.struct(F.lit(0).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("most"))

    def step(acc, x):
        now = F.when(under(x), acc["now"] + 1).otherwise(F.lit(0).cast("bigint"))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(array, start, step, lambda acc: acc["most"])


def scenario_metrics(results: DataFrame, initial_capital: float) -> DataFrame:
    """All metrics of ledger results: curve_metrics() and trade_stats() of each row's own arrays, so nothing is shuffled
    and the ledger runs once. Scenarios without bars have no row."""
    equity, trades = F.col("equity"), F.col("trades")
    worth = F.transform(equity, lambda x: x["equity"])
    rows = results.filter(F.size("equity") > 0).select(
        "scenario_id", equity.alias("equity"), worth.alias("worth"), F.size(equity).cast("bigint").alias("n_bars"),
        F.array_sort(
            F.transform(trades, lambda t: F.struct(*(t[c].alias(c) for c in ("exit_ts", "entry_ts", "symbol", "pnl", "fees", "slippage", "holding_bars"))))
        ).alias("trades"),
    )
    n = F.col("n_bars")
    later, earlier = F.slice("worth", 2, F.size("worth") - 1), F.slice("worth", 1, F.size("worth") - 1)
    start = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("peak", "worst")), *(F.lit(0).cast("bigint").alias(c) for c in ("now", "most")))

    def fall(acc, x):
        peak = F.greatest(acc["peak"], x)
        down = _ratio(x, peak) - 1
        now = F.when(down < 0, acc["now"] + 1).otherwise(F.lit(0).cast("bigint"))
        return F.struct(peak.alias("peak"), F.least(acc["worst"], down).alias("worst"), now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    rows = rows.withColumns({
        "r": F.filter(F.zip_with(later, earlier, lambda b, a: _ratio(b, a) - 1), lambda x: x.isNotNull()),
        "fall": F.aggregate("worth", start, fall),
        "total": _ratio(F.element_at("worth", -1), F.element_at("worth", 1)),
        "first": F.element_at("worth", 1),
    })
    k = F.size("r")
    rows = rows.withColumns({"k": k, "mean": F.when(k > 0, _sum(F.col("r"), lambda x: x) / k)})
    rows = rows.withColumns({
        "sd": F.when(k >= 2, F.sqrt(_sum(F.col("r"), lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / (k - 1))),
        "down": F.sqrt(_ratio(_sum(F.col("r"), lambda x: F.when(x < 0, x * x)), F.size(F.filter("r", lambda x: x < 0)).cast("double"))),
        "won": F.filter("trades", lambda t: t["pnl"] > 0),
        "lost": F.filter("trades", lambda t: t["pnl"] <= 0),
        **{c: _sum(F.col("trades"), lambda t, c=c: t[c]) for c in ("pnl", "fees", "slippage", "holding_bars")},
    })
    many = F.size("trades").cast("bigint")
    profit, loss = _sum(F.col("won"), lambda t: t["pnl"]), -_sum(F.col("lost"), lambda t: t["pnl"])
    of = lambda total, count: _ratio(total, count.cast("double"))
    growth = F.when(F.col("first") > 0, F.when(F.col("total") <= 0, -1.0).otherwise(F.pow("total", YEAR / n) - 1))
    costs = F.col("fees") + F.col("slippage")
    got = {
        "total_return": F.when(n >= 2, F.col("total") - 1), "cagr": F.when(n >= 2, growth), "n_bars": n,
        "avg_exposure": _sum(F.col("equity"), lambda x: x["exposure"]) / n,
        "ann_vol": F.col("sd") * _ROOT, "sharpe": _ratio(F.col("mean"), F.col("sd")) * _ROOT,
        "sortino": F.when(F.col("k") >= 2, _ratio(F.col("mean"), F.col("down")) * _ROOT),
        "max_drawdown": F.when(n >= 2, F.col("fall.worst")), "longest_underwater_bars": F.when(n >= 2, F.col("fall.most")).otherwise(F.lit(0).cast("bigint")),
        "n_trades": many, "win_rate": of(F.size("won"), many), "gross_profit_usd": profit, "gross_loss_usd": loss,
        "expectancy_usd": of(F.col("pnl"), many), "expectancy_pct": of(F.col("pnl"), many) / initial_capital,
        "avg_win_usd": of(profit, F.size("won")), "avg_loss_usd": of(-loss, F.size("lost")),
        "total_fees_usd": F.col("fees"), "total_slippage_usd": F.col("slippage"),
        "cost_share_of_gross": F.when(many > 0, _ratio(costs, F.abs(F.col("pnl") + costs))), "avg_holding_bars": of(F.col("holding_bars"), many),
        "profit_factor": F.when(loss > 0, profit / loss), "longest_losing_streak": _streak(F.col("trades"), lambda t: t["pnl"] < 0),
    }
    return rows.select("scenario_id", *(c.alias(name) for name, c in got.items()))


def compare(own: DataFrame, benchmark: DataFrame, key: str = "scenario_id") -> DataFrame:
    """key, alpha_ann, beta, correlation, information_ratio, active_return_ann of returns r against benchmark's (date, b); NULL under 20 common days."""
    both = own.join(benchmark, "date").filter("r is not null and b is not null").withColumn("active", F.col("r") - F.col("b"))
    beta = _ratio(F.covar_samp("r", "b"), F.var_samp("b"))
    got = both.groupBy(key).agg(
        F.count("*").alias("n"), beta.alias("beta"), F.avg("r").alias("mr"), F.avg("b").alias("mb"), F.corr("r", "b").alias("correlation"),
        F.avg("active").alias("ma"), F.stddev_samp("active").alias("sa")
    )
    ok = F.col("n") >= 20
    return got.select(
        key, F.when(ok, (F.col("mr") - F.col("beta") * F.col("mb")) * YEAR).alias("alpha_ann"), F.when(ok, F.col("beta")).alias("beta"), F.when(ok, F.col("correlation")).alias("correlation"),
        F.when(ok & (F.col("sa") > 0), F.col("ma") / F.col("sa") * _ROOT).alias("information_ratio"), F.when(ok, F.col("ma") * YEAR).alias("active_return_ann"),
    )


def buy_and_hold(bars: DataFrame, initial_capital: float, costs, first=None, last=None) -> DataFrame:
    """symbol, date, equity of buying each symbol at its first open, with costs, and keeping it.

    Symbols with fewer than two bars, or too dear for one share, have no rows."""
    if first is not None:
        bars = bars.filter(F.col("date") >= F.lit(first))
    if last is not None:
        bars = bars.filter(F.col("date") <= F.lit(last))
    numbered = bars.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    start = numbered.groupBy("symbol").agg(
        F.min_by("open", "date").alias("first_open"), F.avg(F.when(F.col("n") <= 20, F.col("volume"))).alias("adv"),
        F.count("*").alias("bars")
    ).filter("bars >= 2")

    def commission(q: Column) -> Column:
        return F.when(q > 0, F.greatest(F.lit(costs.min_commission), costs.commission_per_share * q) * costs.pessimism_multiplier).otherwise(0.0)

    wish = F.floor(initial_capital / F.col("first_open"))
    slip = (costs.half_spread_bps / 1e4 + costs.impact_coeff * F.when(F.col("adv") > 0, F.col("wish") / F.col("adv")).otherwise(0.0)) * costs.pessimism_multiplier
    sized = start.withColumn("wish", wish).withColumn("fill", F.col("first_open") * (1 + slip)).withColumn(
        "qty", F.floor((initial_capital - commission(F.col("wish"))) / F.col("fill"))
    ).filter("qty > 0")
    sized = sized.select("symbol", "qty", (initial_capital - F.col("qty") * F.col("fill") - commission(F.col("qty"))).alias("cash"))
    return bars.join(sized, "symbol").select("symbol", "date", (F.col("close") * F.col("qty") + F.col("cash")).alias("equity"))
