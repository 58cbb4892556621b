"""Walk-forward, resampling, stress, deflated Sharpe ratio and gates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import ledger, metrics
from barloom.operators.strategies import Strategy, params_key
from barloom.sources.synthetic import derive_seed

MIN_TRAIN_TRADES = 5
DRAWS = 1 << 20  # trades of a path that are held at once
CELLS = 1 << 25  # trades up to which amounts are repeated in a worker; beyond, the most cells of a table that finds them


# walk-forward


def folds(calendar: DataFrame, train: int, test: int, embargo: int) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end (dates, both ends within): every whole fold, `test` days apart."""
    need = train + embargo + test
    size = calendar.agg(F.count("*").alias("n")).filter(F.col("n") >= need)
    at = size.select(F.explode(F.sequence(F.lit(0), ((F.col("n") - need) / test).cast("int"))).alias("fold"))
    marks = at.select(
        "fold",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(k).alias("edge"), (F.col("fold") * test + d).cast("int").alias("idx"))
                    for k, d in (("train_start", 0), ("train_end", train - 1), ("test_start", train + embargo), ("test_end", need - 1))
                )
            )
        )
    )
    dated = marks.join(calendar, "idx")
    return dated.groupBy("fold").agg(*(F.max(F.when(F.col("edge") == e, F.col("date"))).alias(e) for e in ("train_start", "train_end", "test_start", "test_end")))


@dataclass
class WalkForward:
    folds: DataFrame  # fold, spans, params_key, train_sharpe, test_sharpe, test_return, test_trades
    oos_returns: DataFrame  # date, r
    oos_trades: DataFrame
    trials: DataFrame  # fold, params_key, sharpe, max_drawdown, n_trades
    n_trials: int
    n_configs: int
    oos_sharpe: float | None
    is_sharpe_mean: float | None
    efficiency: float
    stability: float
    held: tuple[DataFrame, ...] = ()  # what the frames above are read from

    def release(self) -> None:
        """Give back what is kept in memory; the frames can still be read, at the price of computing them again."""
        for df in self.held:
            df.unpersist()


def walk_forward(
    bars: DataFrame, strategy: type[Strategy], params: dict, universe: list[str], account: ledger.Account, train: int, test: int,
    embargo: int | None = None
) -> WalkForward:
    """Every combination on every train window in one pass; the best of each frozen and run on its test window in another."""
    from barloom.sources.bars import calendar

    spark, bars = bars.sparkSession, bars.persist()  # read by several jobs; see release()
    embargo = strategy.warmup(params) if embargo is None else embargo
    days = calendar(bars)
    spans = folds(days, train, test, embargo).orderBy("fold").collect()  # a row for each fold of a history of days
    if not spans:
        raise ValueError(f"one fold takes {train + embargo + test} days, the bars have {days.count()}")
    grid = strategy.grid()
    keys = [params_key(c) for c in grid]
    signals = strategy.signals(bars, grid).persist()
    wanted = [{"scenario_id": f"train/{s['fold']}/{i}", "params_key": k, "first": s["train_start"], "last": s["train_end"]} for s in spans for i, k in enumerate(keys)]
    trained = metrics.scenario_metrics(ledger.run(bars, signals, ledger.scenarios(spark, wanted), universe, account), account.initial_capital)
    part = F.split("scenario_id", "/")
    trials = trained.select(part[1].cast("int").alias("fold"), part[2].cast("int").alias("combo"), "sharpe", "max_drawdown", "n_trades").persist()
    order = Window.partitionBy("fold").orderBy(F.desc("sharpe"), F.desc("max_drawdown"), "combo")
    best = trials.filter((F.col("n_trades") >= MIN_TRAIN_TRADES) & F.col("sharpe").isNotNull()).withColumn("place", F.row_number().over(order)).filter("place = 1")
    chosen = {r["fold"]: r for r in best.collect()}
    tests = [
        {"scenario_id": f"test/{s['fold']}", "params_key": keys[chosen[s["fold"]]["combo"]], "first": s["test_start"], "last": s["test_end"]}
        for s in spans if s["fold"] in chosen
    ]
    tested = ledger.run(bars, signals, ledger.scenarios(spark, tests), universe, account).persist()
    of_test = {r["scenario_id"]: r for r in metrics.scenario_metrics(tested, account.initial_capital).collect()}
    rows = []
    for s in spans:
        won, m = chosen.get(s["fold"]), of_test.get(f"test/{s['fold']}")
        rows.append(
            (
                s["fold"], s["train_start"], s["train_end"], s["test_start"], s["test_end"], embargo,
                keys[won["combo"]] if won else params_key(params), won["sharpe"] if won else None, m["sharpe"] if m else None,
                m["total_return"] if m else 0.0, int(m["n_trades"]) if m else 0
            )
        )
    table = spark.createDataFrame(
        rows,
        "fold int, train_start date, train_end date, test_start date, test_end date, embargo_bars int, params_key string, train_sharpe double, test_sharpe double, test_return double, test_trades int"
    )
    oos = metrics.returns(ledger.equity_of(tested)).select("date", "r")
    sharpe = oos.agg(metrics.sharpe().alias("s")).first()["s"]
    scores = [r[7] for r in rows if r[7] is not None]
    mean = sum(scores) / len(scores) if scores else None
    picks = [r[6] for r in rows]
    named = trials.join(spark.createDataFrame(list(enumerate(keys)), "combo int, params_key string"), "combo").select("fold", "params_key", "sharpe", "max_drawdown", "n_trades")
    return WalkForward(
        table, oos, ledger.trades_of(tested), named, len(wanted), len(grid), sharpe, mean,
        sharpe / mean if mean and mean > 0 and sharpe is not None else 0.0, max(picks.count(p) for p in picks) / len(picks),
        (signals, trials, tested, bars)
    )


# resampling


def _paths(spark: SparkSession, n_paths: int, seed: int, make) -> DataFrame:
    """one(rng) -> (max drawdown, final) for each path, where one = make() in each task; every path has a seed of its own, so tasks don't matter."""

    def work(frames):
        one = make()
        for frame in frames:
            got = [one(np.random.default_rng(derive_seed(seed, "path", str(i)))) for i in frame["id"]]
            yield pd.DataFrame(got, columns=["drawdown", "final"])

    return spark.range(n_paths).mapInPandas(work, "drawdown double, final double")


def _drawdown(equity: np.ndarray) -> float:
    return float((equity / np.maximum.accumulate(equity) - 1).min())


def amounts(trades: DataFrame, column: str = "pnl") -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a column in order, and how many rows have each. They come to the driver packed, a partition at a time: 16 bytes a value."""

    def pack(batches):
        for b in batches:
            x, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], ["x", "n"])

    values, often = bytearray(), bytearray()
    counted = trades.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n")).orderBy("x")
    for row in counted.mapInArrow(pack, "x binary, n binary").toLocalIterator():
        values += row["x"]
        often += row["n"]
    return np.frombuffer(values, "<f8"), np.frombuffer(often, "<i8")


def _finder(ends: np.ndarray):
    """find(drawn): as np.searchsorted(ends, drawn, "right") for numbers below ends[-1], begun at what a table has for each 2**shift of them."""
    n = int(ends[-1])
    shift = max(0, (n - 1).bit_length() - CELLS.bit_length() + 1)
    cells = (n - 1 >> shift) + 1
    begin = np.empty(cells, np.min_scalar_type(len(ends)))
    for at in range(0, cells, DRAWS):
        some = np.arange(at, min(at + DRAWS, cells))
        begin[at : at + DRAWS] = np.searchsorted(ends, some << shift, "right")

    def find(drawn):
        found = begin[drawn >> shift]
        short = np.flatnonzero(ends[found] <= drawn) if shift else ()
        while len(short):
            found[short] += 1
            short = short[ends[found[short]] <= drawn[short]]
        return found

    return find


def trade_bootstrap(spark: SparkSession, pnls: list[float], capital: float, n_paths: int, seed: int, ruin_pct: float, often: list[int] | None = None) -> dict:
    """Trades drawn with replacement; equity never falls below a millionth of a cent. often: how many trades have each of pnls (none: one)."""
    x = np.asarray(pnls, float)
    if not len(x):
        return {"error": "no trades"}
    often = None if often is None else np.asarray(often, np.int64)
    n = len(x) if often is None else int(often.sum())
    held = spark.sparkContext.broadcast((x, often))

    def make():
        x, often = held.value
        find = None
        if often is not None and n <= CELLS:
            x = np.repeat(x, often)
        elif often is not None:
            find = _finder(np.cumsum(often))

        def one(rng):
            level = peak = last = capital
            worst = 0.0
            for at in range(0, n, DRAWS):
                drawn = rng.integers(0, n, min(DRAWS, n - at))
                path = level + np.cumsum(x[drawn if find is None else find(drawn)])
                level = path[-1]
                path = np.concatenate(([peak], np.maximum(path, 1e-9)))
                worst = min(worst, _drawdown(path))
                peak, last = path.max(), path[-1]
            return worst, float(last)

        return one

    r = _paths(spark, n_paths, seed, make).agg(
        F.percentile("drawdown", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.01))).alias("dd"), F.percentile("final", F.array(F.lit(0.05), F.lit(0.5))).alias("final"),
        F.avg((F.col("drawdown") <= -ruin_pct / 100).cast("double")).alias("ruin"), F.avg((F.col("final") < capital).cast("double")).alias("negative"),
    ).first()
    held.destroy()
    return {
        "dd_p50": r["dd"][0], "dd_p95": r["dd"][1], "dd_p99": r["dd"][2], "risk_of_ruin": r["ruin"], "ruin_drawdown_pct": ruin_pct,
        "final_equity_p5": r["final"][0], "final_equity_p50": r["final"][1], "prob_negative": r["negative"]
    }


def block_bootstrap(spark: SparkSession, returns: list[float], n_paths: int, seed: int, ruin_pct: float, block: int | None = None) -> dict:
    """Blocks of successive returns; a block is about the root of the history."""
    x = np.asarray(returns, float)
    t = len(x)
    if t < 40:
        return {"error": "too few return observations"}
    size = block or math.ceil(math.sqrt(t))
    count = math.ceil(t / size)

    def one(rng):
        starts = rng.integers(0, t - size + 1, count)
        equity = np.cumprod(1 + x[(starts[:, None] + np.arange(size)).ravel()[:t]])
        return _drawdown(np.concatenate(([1.0], equity))), float(equity[-1] ** (252 / t) - 1)

    r = _paths(spark, n_paths, seed, lambda: one).agg(
        F.percentile("drawdown", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.01))).alias("dd"), F.percentile("final", F.array(F.lit(0.05), F.lit(0.5))).alias("final"),
        F.avg((F.col("drawdown") <= -ruin_pct / 100).cast("double")).alias("ruin"), F.avg((F.col("final") < 0).cast("double")).alias("negative"),
    ).first()
    return {
        "block_len": size, "dd_p50": r["dd"][0], "dd_p95": r["dd"][1], "dd_p99": r["dd"][2], "risk_of_ruin": r["ruin"],
        "ruin_drawdown_pct": ruin_pct, "cagr_p5": r["final"][0], "cagr_p50": r["final"][1], "prob_negative_cagr": r["negative"]
    }


# stress and neighbours: more scenarios of the ledger


def neighbours(grid: list[dict], chosen: dict) -> list[dict]:
    """Combinations that differ from the chosen one in exactly one parameter, however far."""
    return [c for c in grid if sum(c.get(k) != v for k, v in chosen.items()) == 1]


@dataclass
class Stress:
    cost_table: list[dict]
    max_profitable_multiplier: float
    delay_table: list[dict]
    neighbour: dict


def stress(
    bars: DataFrame, strategy: type[Strategy], params: dict, universe: list[str], account: ledger.Account, multipliers: list[float],
    delays: list[int], samples: int, seed: int
) -> Stress:
    """Cost, delay and parameter reruns, all in one pass."""
    near = neighbours(strategy.grid(), params)
    if len(near) > samples:
        picked = np.random.default_rng(seed).choice(len(near), size=samples, replace=False)
        near = [near[i] for i in sorted(picked)]
    key = params_key(params)
    wanted = [{"scenario_id": "base", "params_key": key}]
    wanted += [{"scenario_id": f"cost/{m}", "params_key": key, "cost_mult": m} for m in sorted(multipliers)]
    wanted += [{"scenario_id": f"delay/{d}", "params_key": key, "delay": d} for d in sorted(delays)]
    wanted += [{"scenario_id": f"near/{i}", "params_key": params_key(c)} for i, c in enumerate(near)]
    signals = strategy.signals(bars, [params, *near])
    got = metrics.scenario_metrics(ledger.run(bars, signals, ledger.scenarios(bars.sparkSession, wanted), universe, account), account.initial_capital)
    m = {r["scenario_id"]: r for r in got.select("scenario_id", "cagr", "sharpe", "total_return").collect()}
    pick = lambda k: {c: m[k][c] for c in ("cagr", "sharpe", "total_return")}
    costs = [{"multiplier": x, **pick(f"cost/{x}")} for x in sorted(multipliers)]
    # the highest level that is profitable, even above one that is not
    breakeven = max((r["multiplier"] for r in costs if r["total_return"] is not None and r["total_return"] > 0), default=0.0)
    base = m["base"]["sharpe"]
    if near:
        sharpes = [m[f"near/{i}"]["sharpe"] or 0.0 for i in range(len(near))]
        median = float(np.median(sharpes))
        summary = {
            "neighbor_sharpes": [round(s, 4) for s in sharpes], "neighbor_median_sharpe": median, "chosen_sharpe": base,
            "neighbor_sharpe_ratio": median / base if base and base > 0 else 0.0
        }
    else:
        summary = {"error": "no grid neighbors"}
    return Stress(costs, breakeven, [{"extra_delay_bars": d, **pick(f"delay/{d}")} for d in sorted(delays)], summary)


# deflated Sharpe ratio

_NORMAL = NormalDist()
EULER = 0.5772156649015329


def moments(returns: DataFrame) -> DataFrame:
    """n, mean, sd, skew, kurt of column r: skewness and excess kurtosis without bias."""
    raw = returns.agg(F.count("r").cast("bigint").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(F.col("n") > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return raw.select("n", "mean", "sd", skew.alias("skew"), kurt.alias("kurt"))


def deflated_sharpe(returns: DataFrame, n_trials: int, trial_sharpes: list[float]) -> float | None:
    """Probability that the true Sharpe ratio is above what the best of n_trials would show by chance (Bailey and Lopez de Prado 2014)."""
    m = moments(returns).first()
    if m["n"] < 30 or not m["sd"]:
        return None
    per_bar = np.array([s for s in trial_sharpes if s is not None and s == s], float) / math.sqrt(252)
    spread = float(np.var(per_bar, ddof=1)) if len(per_bar) > 1 else 0.0
    spread = spread if spread > 0 else 1 / m["n"]
    n = max(int(n_trials), 1)
    chance = 0.0 if n == 1 else math.sqrt(spread) * ((1 - EULER) * _NORMAL.inv_cdf(1 - 1 / n) + EULER * _NORMAL.inv_cdf(1 - 1 / (n * math.e)))
    sr = m["mean"] / m["sd"]
    width = 1 - m["skew"] * sr + (m["kurt"] + 2) / 4 * sr * sr
    return _NORMAL.cdf((sr - chance) * math.sqrt(m["n"] - 1) / math.sqrt(width if width > 0 else 1e-9))


# gates


@dataclass(frozen=True)
class GateLimits:
    min_oos_trades: int = 30
    min_wf_efficiency: float = 0.5
    dsr_min: float = 0.0
    cost_breakeven_min: float = 1.5
    require_delay_survival: bool = True
    min_positive_regimes: int = 2
    max_single_regime_pnl_share: float = 0.8
    min_neighbor_sharpe_ratio: float = 0.25


@dataclass(frozen=True)
class Evidence:
    """What the gates judge; None where a figure is undefined."""

    oos_trades: float = 0
    expectancy: float | None = None
    oos_sharpe: float | None = None
    efficiency: float = 0.0
    dsr: float | None = None
    breakeven: float = 0.0
    delay_returns: tuple = ()  # of delays above 0
    regimes: tuple = ()  # P&L of each regime
    neighbour_ratio: float = 0.0
    max_drawdown: float | None = None
    losing_streak: float = 0


def gates(e: Evidence, limits: GateLimits = GateLimits()) -> list[dict]:
    """name, passed, measured, threshold, detail of each gate."""
    nan = float("nan")
    total = sum(e.regimes)
    share = max(max(p, 0.0) for p in e.regimes) / total if total > 0 else 1.0
    dsr_bar = 0.5 + limits.dsr_min / 2
    at_least = lambda x, bar: x is not None and x >= bar
    above = lambda x, bar: x is not None and x > bar
    out = [
        ("min_oos_trades", at_least(e.oos_trades, limits.min_oos_trades), e.oos_trades, limits.min_oos_trades, "trades on unseen bars"),
        ("oos_expectancy_positive", above(e.expectancy, 0), e.expectancy, 0.0, "what a trade on unseen bars earns after costs"),
        ("oos_sharpe_positive", above(e.oos_sharpe, 0), e.oos_sharpe, 0.0, "Sharpe ratio of the test windows put together"),
        ("wf_efficiency", at_least(e.efficiency, limits.min_wf_efficiency), e.efficiency, limits.min_wf_efficiency, "that ratio over the train windows' mean"),
        ("deflated_sharpe", above(e.dsr, dsr_bar), -1.0 if e.dsr is None else e.dsr, dsr_bar, "chance that it is more than the best of so many tries"),
        ("cost_breakeven", at_least(e.breakeven, limits.cost_breakeven_min), e.breakeven, limits.cost_breakeven_min, "costs multiplied by this still leave a profit"),
    ]
    if limits.require_delay_survival:
        survived = bool(e.delay_returns) and all(above(r, 0) for r in e.delay_returns)
        known = [r for r in e.delay_returns if r is not None]
        out.append(("delay_survival", survived, min(known, default=None), 0.0, "return where fills come a bar later"))
    out += [
        (
            "positive_regimes", sum(p > 0 for p in e.regimes) >= limits.min_positive_regimes, sum(p > 0 for p in e.regimes),
            limits.min_positive_regimes, "regimes of the benchmark that made money"
        ),
        ("regime_concentration", share <= limits.max_single_regime_pnl_share, share, limits.max_single_regime_pnl_share, "the best regime's share of all profit"),
        (
            "param_neighborhood", at_least(e.neighbour_ratio, limits.min_neighbor_sharpe_ratio), e.neighbour_ratio,
            limits.min_neighbor_sharpe_ratio, "neighbours' median Sharpe ratio over the chosen one's"
        ),
    ]
    return [{"name": n, "passed": bool(p), "measured": nan if m is None else float(m), "threshold": float(t), "detail": d} for n, p, m, t, d in out]


def verdict(found: list[dict]) -> tuple[str, list[str]]:
    failed = [g for g in found if not g["passed"]]
    return "fail" if failed else "pass", [f"{g['name']} at {g['measured']:.4g}, asked for {g['threshold']:.4g}" for g in failed]


MARGINAL = ("cost_breakeven", "wf_efficiency", "deflated_sharpe", "regime_concentration")


def weaknesses(found: list[dict], e: Evidence) -> list[str]:
    notes = [f"FAILED {g['name']}, {g['detail']}: {g['measured']:.4g} where {g['threshold']:.4g} is asked for" for g in found if not g["passed"]]
    by = {g["name"]: g for g in found}
    for name in MARGINAL:
        g = by.get(name)
        if g and g["passed"] and g["threshold"] and abs(g["measured"] - g["threshold"]) <= 0.2 * abs(g["threshold"]):
            notes.append(f"MARGINAL {name}: {g['measured']:.4g}, within a fifth of {g['threshold']:.4g}")
    if e.max_drawdown is not None and e.max_drawdown < -0.15:
        notes.append(f"DRAWDOWN of {-e.max_drawdown:.1%} on unseen bars, beyond the 15% that end an account")
    if e.losing_streak >= 8:
        notes.append(f"STREAK of {e.losing_streak:.0f} losing trades in a row on unseen bars")
    return notes or ["Nothing failed and nothing was close; that markets change is a risk no test of the past removes."]
