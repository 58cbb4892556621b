"""Queries over the driver's tables, and the same in SQL.

Bars are those of lineitem (see sources.bars); values are rounded on both sides,
and decisions near a threshold are not compared to more than that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import ledger_sql
from barloom.functions import indicators as ind
from barloom.operators import history, ledger, metrics, quality, regimes, search, validation
from barloom.operators.strategies import DipBuyer, RandomWalk, RsiMeanReversion, SmaCross, TimeSeriesMomentum, params_key
from barloom.plans import catalog, report, store
from barloom.sources import bars as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_ORDER = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
BARS_SQL = f"""bars AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, min_by(l_extendedprice, {_ORDER}) AS open,
 max(l_extendedprice) AS high, min(l_extendedprice) AS low, max_by(l_extendedprice, {_ORDER}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
 FROM lineitem GROUP BY 1, 2)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.replace("@BARS", BARS_SQL)
        return f

    return add


def _bars(spark, sf_dir) -> DataFrame:
    return src.lineitem_bars(spark, sf_dir)


def _r(c, digits=6):
    return F.round(c, digits)


# bars and calendar


@query("WITH @BARS SELECT * FROM bars")
def bars_daily(spark, sf_dir):
    return _bars(spark, sf_dir)


@query("""SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS BIGINT) AS volume FROM orders GROUP BY 1, 2""")
def bars_orders(spark, sf_dir):
    return src.orders_bars(spark, sf_dir)


@query("""SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
 max_by(value, event_id) AS close, CAST(count(*) AS BIGINT) AS volume FROM events GROUP BY 1, 2""")
def bars_hourly_events(spark, sf_dir):
    return src.event_bars(spark, sf_dir)


@query("WITH @BARS SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS idx FROM (SELECT DISTINCT date FROM bars)")
def calendar_union(spark, sf_dir):
    return src.calendar(_bars(spark, sf_dir))


_RAW = "SELECT symbol, date, open, high, low, close, volume, 1 AS seq FROM bars UNION ALL SELECT lower(symbol), date, open * 2, high * 2, low * 2, close * 2, volume, 2 FROM bars WHERE day(date) = 1"


@query("WITH @BARS SELECT symbol, date, open, high, low, close, volume FROM bars")
def normalised_bars(spark, sf_dir):
    """Bars handed in with odd names, text dates and second versions of some days."""
    b = _bars(spark, sf_dir).withColumn("seq", F.lit(1))
    again = b.filter(F.dayofmonth("date") == 1).select(F.lower("symbol").alias("symbol"), "date", *((F.col(c) * 2).alias(c) for c in src.PRICES), "volume", F.lit(2).alias("seq"))
    raw = b.unionByName(again).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return src.normalise(raw.toDF(*(f" {c.title()} " for c in raw.columns)))


@query("""WITH @BARS, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars WHERE date <= DATE '1997-06-30')
 SELECT symbol, date, close, volume FROM t WHERE k <= 20""")
def point_in_time_tail(spark, sf_dir):
    """The last 20 bars as of a day, and nothing after it."""
    return history.tail(_bars(spark, sf_dir), "1997-06-30", 20).select("symbol", "date", "close", "volume")


@query("WITH @BARS SELECT symbol, max_by(close, date) AS last_close FROM bars WHERE date <= DATE '1997-06-30' GROUP BY 1")
def last_close_as_of(spark, sf_dir):
    return history.last_close(_bars(spark, sf_dir), "1997-06-30")


# indicators

_W = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_WHOLE = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_O = "(PARTITION BY symbol ORDER BY date)"


@query(f"WITH @BARS SELECT symbol, date, CASE WHEN count(close) OVER {_W.format(19)} = 20 THEN round(avg(close) OVER {_W.format(19)}, 6) END AS sma_20 FROM bars")
def ind_sma(spark, sf_dir):
    return _bars(spark, sf_dir).select("symbol", "date", _r(ind.sma("close", 20)).alias("sma_20"))


@query(f"""WITH @BARS, h AS (SELECT symbol, date, list(close) OVER {_WHOLE} AS x FROM bars)
 SELECT symbol, date, CASE WHEN len(x) >= 20 THEN round(list_reduce(x, lambda a, v: a + (v - a) * CAST(2.0 / 21 AS DOUBLE)), 4) END AS ema_20 FROM h""")
def ind_ema(spark, sf_dir):
    return ind.recursive(_bars(spark, sf_dir), ema=(20,)).select("symbol", "date", _r("ema_20", 4).alias("ema_20"))


@query(f"WITH @BARS SELECT symbol, date, round(ln(close) - ln(lag(close) OVER {_O}), 8) AS log_return FROM bars")
def ind_log_return(spark, sf_dir):
    return _bars(spark, sf_dir).select("symbol", "date", _r(ind.log_return(), 8).alias("log_return"))


@query(f"""WITH @BARS, r AS (SELECT symbol, date, ln(close) - ln(lag(close) OVER {_O}) AS r FROM bars)
 SELECT symbol, date, CASE WHEN count(r) OVER {_W.format(19)} = 20 THEN round(stddev_samp(r) OVER {_W.format(19)} * sqrt(252), 6) END AS realized_vol_20 FROM r""")
def ind_realized_vol(spark, sf_dir):
    r = _bars(spark, sf_dir).withColumn("r", ind.log_return())
    return r.select("symbol", "date", _r(ind.realized_vol("r", 20)).alias("realized_vol_20"))


_FOLD = "list_reduce({}, lambda a, v: a + (v - a) * CAST(1.0 / {} AS DOUBLE))"
_STEPS = f"d AS (SELECT symbol, date, close - lag(close) OVER {_O} AS d FROM bars)"
_RSI = f"""{_STEPS}, g AS (SELECT symbol, date, list(greatest(d, 0)) FILTER (d IS NOT NULL) OVER {_WHOLE} AS up, list(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER {_WHOLE} AS dn FROM d),
 m AS (SELECT symbol, date, len(up) AS k, CASE WHEN len(up) >= $N THEN {_FOLD.format('up', '$N')} END AS u, CASE WHEN len(up) >= $N THEN {_FOLD.format('dn', '$N')} END AS n FROM g),
 rsi AS (SELECT symbol, date, CASE WHEN n = 0 AND u > 0 THEN 100.0 WHEN n = 0 AND u = 0 THEN 50.0 ELSE 100 - 100 / (1 + u / n) END AS rsi FROM m)"""


@query(f"WITH @BARS, {_RSI.replace('$N', '14')} SELECT symbol, date, round(rsi, 5) AS rsi_14 FROM rsi")
def ind_rsi(spark, sf_dir):
    return ind.recursive(_bars(spark, sf_dir), rsi=(14,)).select("symbol", "date", _r("rsi_14", 5).alias("rsi_14"))


_TR = f"t AS (SELECT *, CASE WHEN lag(close) OVER {_O} IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER {_O}), abs(low - lag(close) OVER {_O})) END AS tr FROM bars)"


@query(f"WITH @BARS, {_TR} SELECT symbol, date, round(tr, 6) AS true_range FROM t")
def ind_true_range(spark, sf_dir):
    return _bars(spark, sf_dir).select("symbol", "date", _r(ind.true_range()).alias("true_range"))


@query(f"""WITH @BARS, {_TR}, h AS (SELECT symbol, date, list(tr) FILTER (tr IS NOT NULL) OVER {_WHOLE} AS x FROM t)
 SELECT symbol, date, CASE WHEN len(x) >= 14 THEN round({_FOLD.format('x', '14')}, 4) END AS atr_14 FROM h""")
def ind_atr(spark, sf_dir):
    return ind.recursive(_bars(spark, sf_dir), atr=(14,)).select("symbol", "date", _r("atr_14", 4).alias("atr_14"))


@query(f"""WITH @BARS, {_TR}, h AS (SELECT symbol, date, list(tr) FILTER (tr IS NOT NULL) OVER {_W.format(13)} AS x FROM t)
 SELECT symbol, date, CASE WHEN len(x) = 14 THEN round({_FOLD.format('x', '14')}, 5) END AS tail_atr_14 FROM h""")
def engine_atr(spark, sf_dir):
    return _bars(spark, sf_dir).withColumn("tr", ind.true_range()).select("symbol", "date", _r(ind.tail_atr("tr", 14), 5).alias("tail_atr_14"))


@query(f"""WITH @BARS SELECT symbol, date, round(coalesce(avg(volume) OVER {_W.format(19)}, 0), 6) AS adv_in,
 round(coalesce(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 6) AS adv_ex FROM bars""")
def ind_adv(spark, sf_dir):
    return _bars(spark, sf_dir).select("symbol", "date", _r(ind.adv()).alias("adv_in"), _r(ind.adv(including=False)).alias("adv_ex"))


# signals

_N = f"row_number() OVER {_O} AS n"


@query(f"""WITH @BARS, s AS (SELECT symbol, date, {_N}, avg(close) OVER {_W.format(19)} AS f, avg(close) OVER {_W.format(99)} AS s FROM bars)
 SELECT symbol, date, CASE WHEN f > s THEN 'long' ELSE 'flat' END AS desired_state FROM s WHERE n >= 101""")
def sma_cross_signals(spark, sf_dir):
    return SmaCross.signals(_bars(spark, sf_dir), [{"fast": 20, "slow": 100}]).select("symbol", "date", "desired_state")


@query(f"""WITH @BARS, s AS (SELECT symbol, date, {_N}, {', '.join(f'avg(close) OVER {_W.format(k - 1)} AS s{k}' for k in (10, 20, 30, 50, 100, 200))} FROM bars),
 g AS (SELECT CAST(f AS INT) AS f, CAST(s AS INT) AS s FROM (VALUES (10), (20), (30)) a(f), (VALUES (50), (100), (200)) b(s)),
 x AS (SELECT g.f, g.s, symbol, date, n, CASE g.f WHEN 10 THEN s10 WHEN 20 THEN s20 ELSE s30 END AS fast, CASE g.s WHEN 50 THEN s50 WHEN 100 THEN s100 ELSE s200 END AS slow FROM s, g)
 SELECT '{{"fast":' || f || ',"slow":' || s || '}}' AS params_key, symbol, date, CASE WHEN fast > slow THEN 'long' ELSE 'flat' END AS desired_state FROM x WHERE n >= s + 1""")
def sma_cross_grid(spark, sf_dir):
    return SmaCross.signals(_bars(spark, sf_dir), SmaCross.grid()).select("params_key", "symbol", "date", "desired_state")


@query(f"""WITH @BARS, m AS (SELECT symbol, date, {_N}, lag(close, 21) OVER {_O} / lag(close, 273) OVER {_O} - 1 AS m FROM bars)
 SELECT symbol, date, CASE WHEN m > 0 THEN 'long' ELSE 'flat' END AS desired_state, round(m, 6) AS momentum FROM m WHERE n >= 275""")
def tsmom_signals(spark, sf_dir):
    got = TimeSeriesMomentum.signals(_bars(spark, sf_dir), [{"lookback": 252, "skip": 21}])
    return got.select("symbol", "date", "desired_state", F.get_json_object("context", "$.momentum").cast("double").alias("momentum"))


@query(f"""WITH @BARS, {_RSI.replace('$N', '2')}, t AS (SELECT symbol, date, close, {_N}, avg(close) OVER {_W.format(199)} AS trend FROM bars),
 x AS (SELECT symbol, date, CASE WHEN close > trend AND rsi < 10 THEN 'long' WHEN rsi > 60 OR NOT close > trend THEN 'flat' END AS desired_state FROM t JOIN rsi USING (symbol, date) WHERE n >= 201)
 SELECT * FROM x WHERE desired_state IS NOT NULL""")
def rsi_meanrev_signals(spark, sf_dir):
    return RsiMeanReversion.signals(_bars(spark, sf_dir), [{"rsi_n": 2, "buy_below": 10, "exit_above": 60, "trend_sma": 200}]).select("symbol", "date", "desired_state")


@query(f"""WITH @BARS, s AS (SELECT symbol, date, close, {_N}, avg(close) OVER {_W.format(19)} AS m FROM bars),
 x AS (SELECT symbol, date, CASE WHEN (close / m - 1) * 100 < -4 THEN 'long' WHEN close > m THEN 'flat' END AS desired_state FROM s WHERE n >= 21)
 SELECT * FROM x WHERE desired_state IS NOT NULL""")
def dip_buyer_signals(spark, sf_dir):
    return DipBuyer.signals(_bars(spark, sf_dir), [{"sma_n": 20, "entry_k": 4}]).select("symbol", "date", "desired_state")


_HEX = "(instr('0123456789abcdef', substr(h, 2, 1)) - 1)"


@query(f"""WITH @BARS, x AS (SELECT symbol, date, sha256('1|' || symbol || '|' || strftime(date, '%Y-%m-%d')) AS h FROM bars)
 SELECT symbol, date, CASE WHEN {_HEX} % 2 = 0 THEN 'long' ELSE 'flat' END AS desired_state FROM x""")
def random_walk_signals(spark, sf_dir):
    return RandomWalk.signals(_bars(spark, sf_dir), [{"p": 1}]).select("symbol", "date", "desired_state")


@query("""SELECT CAST(row_number() OVER (ORDER BY b, e, r) - 1 AS INT) AS combo, CAST(b AS INT) AS buy_below, CAST(e AS INT) AS exit_above, CAST(r AS INT) AS rsi_n, 200 AS trend_sma
 FROM (VALUES (10), (20), (30)) x(b), (VALUES (50), (60), (70)) y(e), (VALUES (2), (3), (4)) z(r)""")
def grid_enumeration(spark, sf_dir):
    rows = [(i, c["buy_below"], c["exit_above"], c["rsi_n"], c["trend_sma"]) for i, c in enumerate(RsiMeanReversion.grid())]
    return spark.createDataFrame(rows, "combo int, buy_below int, exit_above int, rsi_n int, trend_sma int")


@query("""SELECT CAST(f AS INT) AS fast, CAST(s AS INT) AS slow FROM (VALUES (10), (20), (30)) x(f), (VALUES (50), (100), (200)) y(s)
 WHERE CAST(f <> 20 AS INT) + CAST(s <> 100 AS INT) = 1""")
def param_neighbors(spark, sf_dir):
    near = validation.neighbours(SmaCross.grid(), {"fast": 20, "slow": 100})
    return spark.createDataFrame([(c["fast"], c["slow"]) for c in near], "fast int, slow int")


# data quality: bars with planted defects

_BAD_SQL = """b AS (SELECT symbol, date, open, high, low, CASE WHEN year(date) = 1995 AND month(date) = 3 AND symbol < 'B' THEN -close ELSE close END AS close, volume FROM bars
 WHERE NOT (year(date) = 1996 AND month(date) = 6 AND symbol > 'N'))"""


def _defective(spark, sf_dir) -> DataFrame:
    """Bars with a month of negative closes for some symbols and a month missing for others."""
    b = _bars(spark, sf_dir)
    b = b.filter(~((F.year("date") == 1996) & (F.month("date") == 6) & (F.col("symbol") > "N")))
    return b.withColumn("close", F.when((F.year("date") == 1995) & (F.month("date") == 3) & (F.col("symbol") < "B"), -F.col("close")).otherwise(F.col("close")))


@query("WITH @BARS SELECT symbol, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) < 2450")
def dq_length(spark, sf_dir):
    found = quality.lengths(_bars(spark, sf_dir), quality.Limits(min_bars=2450))
    return found.select("symbol", F.regexp_extract("detail", r"^(\d+)", 1).cast("bigint").alias("n"))


@query("""WITH @BARS, b AS (SELECT symbol, date FROM bars UNION ALL SELECT symbol, date FROM bars WHERE symbol < 'B' AND day(date) = 2)
 SELECT symbol, 'calendar' AS check_name, 'fail' AS severity FROM b GROUP BY symbol HAVING count(*) > count(DISTINCT date)""")
def dq_calendar(spark, sf_dir):
    b = _bars(spark, sf_dir)
    twice = b.unionByName(b.filter((F.col("symbol") < "B") & (F.dayofmonth("date") == 2)))
    return quality.doubled_dates(twice).select("symbol", "check_name", "severity")


@query(f"WITH @BARS, {_BAD_SQL} SELECT symbol, count(*) AS n, min(date) AS range_start, max(date) AS range_end FROM b WHERE least(open, high, low, close) <= 0 GROUP BY 1")
def dq_positivity(spark, sf_dir):
    return quality.positivity(_defective(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("range_start"), F.max("date").alias("range_end"))


@query(f"WITH @BARS, {_BAD_SQL} SELECT symbol, date FROM b WHERE low > least(open, close) + 1e-9 OR high < greatest(open, close) - 1e-9")
def dq_ohlc_bounds(spark, sf_dir):
    return quality.bounds(_defective(spark, sf_dir)).select("symbol", "date")


@query("WITH @BARS SELECT symbol, count(*) AS n FROM bars WHERE isodow(date) >= 6 GROUP BY 1")
def dq_weekend_bars(spark, sf_dir):
    return quality.weekends(_bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"))


_MISSING = """sp AS (SELECT symbol, min(date) AS a, max(date) AS z FROM b GROUP BY 1), dd AS (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
 mi AS (SELECT symbol, date FROM dd WHERE isodow(date) < 6 EXCEPT SELECT symbol, date FROM b)"""


@query(f"WITH @BARS, {_BAD_SQL}, {_MISSING} SELECT symbol, date FROM mi")
def missing_bdays(spark, sf_dir):
    return quality.missing_days(_defective(spark, sf_dir)).select("symbol", "date")


_RUNS = f"""{_MISSING}, nw AS (SELECT symbol, date, CASE WHEN date - lag(date) OVER {_O} <= 3 THEN 0 ELSE 1 END AS nw FROM mi), ru AS (SELECT symbol, date, sum(nw) OVER {_O} AS ru FROM nw),
 g AS (SELECT symbol, min(date) AS run_start, max(date) AS run_end FROM ru GROUP BY symbol, ru),
 gg AS (SELECT *, (SELECT count(*) FROM generate_series(g.run_start, g.run_end, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6) AS business_days FROM g)"""


@query(f"WITH @BARS, {_BAD_SQL}, {_RUNS} SELECT symbol, run_start, run_end, CAST(business_days AS BIGINT) AS business_days FROM gg")
def gap_runs(spark, sf_dir):
    return quality.gap_runs(_defective(spark, sf_dir))


@query(
    f"""WITH @BARS, {_BAD_SQL}, {_RUNS} SELECT symbol, CASE WHEN max(business_days) > 5 THEN 'fail' ELSE 'info' END AS severity, strftime(min(CASE WHEN business_days > 5 THEN run_start END), '%Y-%m-%d') AS range_start FROM gg GROUP BY 1"""
)
def dq_gaps(spark, sf_dir):
    return quality.gaps(_defective(spark, sf_dir), quality.Limits()).select("symbol", "severity", F.date_format("range_start", "yyyy-MM-dd").alias("range_start"))


_SPIKES = f"""r AS (SELECT symbol, date, volume, CASE WHEN close > 0 AND lag(close) OVER {_O} > 0 THEN ln(close) - ln(lag(close) OVER {_O}) END AS r FROM bars), c AS (SELECT symbol, median(r) AS m, count(r) AS n FROM r GROUP BY 1),
 d AS (SELECT symbol, median(abs(r - m)) AS mad FROM r JOIN c USING (symbol) GROUP BY 1),
 z AS (SELECT symbol, date, r, abs(r - m) / (mad * 1.4826) AS z, coalesce(lead(r) OVER {_O}, 0) AS nx, volume,
 CASE WHEN count(volume) OVER {_W.format(19)} >= 5 THEN quantile_cont(volume, 0.5) OVER {_W.format(19)} END AS usual,
 list_concat(coalesce(list(r) FILTER (r IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []), coalesce(list(r) FILTER (r IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), [])) AS near
 FROM r JOIN c USING (symbol) JOIN d USING (symbol)),
 l AS (SELECT *, list_aggregate(near, 'median') AS lm FROM z WHERE z > $Z),
 ll AS (SELECT *, list_aggregate(list_transform(near, lambda x: abs(x - lm)), 'median') * 1.4826 AS lmad FROM l)"""


_BAD_PRINT = """spk AS (SELECT symbol, date, (r * nx < 0 AND abs(r + nx) < 0.4 * abs(r)) AND NOT coalesce(usual > 0 AND volume > 1.5 * usual, false)
 AND CASE WHEN len(near) >= 5 AND lmad > 0 THEN abs(r - lm) / lmad > $Z ELSE true END AS bad_print FROM ll)"""


@query(f"WITH @BARS, {_SPIKES}, {_BAD_PRINT} SELECT * FROM spk".replace("$Z", "2.2"))
def dq_spikes(spark, sf_dir):
    """At a z-score of 2.2, so that noise has spikes of both kinds."""
    return quality.spike_rows(_bars(spark, sf_dir), quality.Limits(spike_zscore=2.2))


_SPLITS = f"""s AS (SELECT symbol, date, close / lag(close) OVER {_O} AS q, CASE WHEN count(volume) OVER {_W.format(19)} = 20 THEN volume / quantile_cont(volume, 0.5) OVER {_W.format(19)} END AS t FROM bars),
 split AS (SELECT symbol, date FROM s WHERE t > 3 AND (abs(q - 0.5) <= 1e-8 + 0.02 * 0.5 OR abs(q - 2.0) <= 1e-8 + 0.02 * 2.0 OR abs(q - 1.0 / 3) <= 1e-8 + 0.02 / 3 OR abs(q - 3.0) <= 1e-8 + 0.02 * 3.0))"""


@query(f"WITH @BARS, {_SPLITS} SELECT * FROM split")
def dq_split_echo(spark, sf_dir):
    return quality.split_rows(_bars(spark, sf_dir))


@query(f"WITH @BARS, v AS (SELECT symbol, date, avg(volume) OVER {_W.format(19)} AS m FROM bars) SELECT symbol FROM v GROUP BY 1 HAVING max_by(m, date) < 120")
def dq_volume(spark, sf_dir):
    return quality.thin_volume(_bars(spark, sf_dir), quality.Limits(min_avg_volume=120)).select("symbol")


def _found(relation: str, check: str, severity: str, text: str, where: str = "true", dated: bool = True) -> str:
    ends = "min(date), max(date)" if dated else "CAST(NULL AS DATE), CAST(NULL AS DATE)"
    return f"SELECT symbol, '{check}', '{severity}', count(*) || ' {text}', {ends} FROM {relation} WHERE {where} GROUP BY symbol"


_FINDINGS = " UNION ALL ".join((
    _found("b", "positivity", "fail", "bar(s) with a price of zero or less", "least(open, high, low, close) <= 0"),
    _found("b", "ohlc_bounds", "fail", "bar(s) whose low and high do not enclose open and close", "low > least(open, close) + 1e-9 OR high < greatest(open, close) - 1e-9"),
    _found("b", "weekend_bars", "warn", "bar(s) on a Saturday or Sunday", "isodow(date) >= 6", False),
    _found("spk", "spikes", "fail", "spike(s) taken back on the next bar, as bad prints are", "bad_print"),
    _found("spk", "spikes", "warn", "move(s) beyond 2 robust deviations that lasted", "NOT bad_print"),
    _found("split", "split_echo", "fail", "bar(s) that look like splits nobody adjusted for"),
    """SELECT symbol, 'gaps', 'fail', count(*) || ' gap(s) of more than 5 business days', min(run_start), min_by(run_end, run_start) FROM gg WHERE business_days > 5 GROUP BY symbol""",
    """SELECT symbol, 'gaps', 'info', count(*) || ' gap(s), none of them too long', NULL, NULL FROM gg GROUP BY symbol HAVING max(business_days) <= 5""",
    """SELECT symbol, 'volume', 'warn', 'mean volume of the last 20 bars is ' || format('{:,.0f}', max_by(m, date)) || ', under 10,000', NULL, NULL FROM tv GROUP BY symbol HAVING max_by(m, date) < 10000""",
))


@query(f"""WITH @BARS, {_BAD_SQL}, {_RUNS}, {_SPIKES.replace("FROM bars", "FROM b")}, {_BAD_PRINT}, {_SPLITS.replace("FROM bars", "FROM b")}, tv AS (SELECT symbol, date, avg(volume) OVER {_W.format(19)} AS m FROM b),
 short AS (SELECT symbol, 'length' AS check_name, 'fail' AS severity, count(*) || ' bars, fewer than the 2400 asked for' AS detail FROM b GROUP BY 1 HAVING count(*) < 2400),
 double AS (SELECT symbol, 'calendar', 'fail', 'a date occurs more than once' FROM b WHERE symbol NOT IN (SELECT symbol FROM short) GROUP BY 1 HAVING count(*) > count(DISTINCT date)),
 first AS (SELECT *, CAST(NULL AS DATE) AS range_start, CAST(NULL AS DATE) AS range_end FROM (FROM short UNION ALL FROM double)),
 rest(symbol, check_name, severity, detail, range_start, range_end) AS ({_FINDINGS})
 FROM first UNION ALL SELECT * FROM rest WHERE symbol NOT IN (SELECT symbol FROM first)""".replace("$Z", "2.2"))
def dq_issues(spark, sf_dir):
    """All rules together, at a z-score that noise exceeds and a length that some symbols lack."""
    return quality.issues(_defective(spark, sf_dir), quality.Limits(spike_zscore=2.2, min_bars=2400))


@query(f"""WITH @BARS, {_BAD_SQL}, {_RUNS}, f AS (SELECT symbol FROM b WHERE least(open, high, low, close) <= 0 UNION SELECT symbol FROM b WHERE low > least(open, close) + 1e-9 OR high < greatest(open, close) - 1e-9
 UNION SELECT symbol FROM gg WHERE business_days > 5) SELECT DISTINCT symbol, symbol NOT IN (SELECT symbol FROM f) AS passes FROM b""")
def dq_passes(spark, sf_dir):
    """Without the rules on spikes and splits, which have queries of their own."""
    b, limits = _defective(spark, sf_dir), quality.Limits(spike_zscore=1e9)
    found = quality.issues(b, limits).filter("check_name not in ('spikes', 'split_echo')")
    return quality.passing(b, found)


# metrics

_CURVE = f"""q AS (SELECT symbol, date, close AS e, close / lag(close) OVER {_O} - 1 AS r, close / max(close) OVER {_WHOLE} - 1 AS dd FROM bars)"""
_UNDER = f"""u AS (SELECT symbol, date, dd, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER {_WHOLE} AS g FROM q), v AS (SELECT symbol, g, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS k FROM u GROUP BY 1, 2),
 x AS (SELECT symbol, CAST(max(k) AS BIGINT) AS longest_underwater_bars FROM v GROUP BY 1)"""


@query(f"""WITH @BARS, {_CURVE}, {_UNDER}, m AS (SELECT symbol, max_by(e, date) / min_by(e, date) AS t, count(*) AS n_bars, stddev_samp(r) AS s, avg(r) AS a, sqrt(avg(r * r) FILTER (r < 0)) AS d, min(dd) AS md FROM q GROUP BY 1)
 SELECT symbol, round(t - 1, 6) AS total_return, round(pow(t, 252.0 / n_bars) - 1, 6) AS cagr, n_bars, round(s * sqrt(252), 6) AS ann_vol, round(a / s * sqrt(252), 6) AS sharpe, round(a / d * sqrt(252), 6) AS sortino,
 round(md, 6) AS max_drawdown, longest_underwater_bars FROM m JOIN x USING (symbol)""")
def equity_metrics(spark, sf_dir):
    m = metrics.curve_metrics(_bars(spark, sf_dir), "symbol", "close")
    return m.select("symbol", "n_bars", "longest_underwater_bars", *(_r(c).alias(c) for c in ("total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown")))


@query(f"WITH @BARS, {_CURVE}, {_UNDER}, m AS (SELECT symbol, round(min(dd), 8) AS max_drawdown FROM q GROUP BY 1) SELECT * FROM m JOIN x USING (symbol)")
def drawdown_underwater(spark, sf_dir):
    return metrics.underwater(_bars(spark, sf_dir), "symbol", "close").select("symbol", _r("max_drawdown", 8).alias("max_drawdown"), "longest_underwater_bars")


_HOLD = """f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars),
 s AS (SELECT symbol, min_by(open, date) AS o, avg(volume) FILTER (n <= 20) AS adv FROM f GROUP BY 1), w AS (SELECT *, floor(10000000 / o) AS w FROM s),
 k AS (SELECT *, o * (1 + (2.5 / 1e4 + 0.1 * (w / adv)) * 1.5) AS fill, CASE WHEN w > 0 THEN greatest(1.0, 0.005 * w) * 1.5 ELSE 0 END AS cw FROM w),
 j AS (SELECT *, floor((10000000 - cw) / fill) AS q FROM k), h AS (SELECT symbol, q, 10000000 - q * fill - greatest(1.0, 0.005 * q) * 1.5 AS cash FROM j WHERE q > 0)"""


@query(f"WITH @BARS, {_HOLD} SELECT symbol, date, round(close * q + cash, 4) AS equity FROM bars JOIN h USING (symbol)")
def buy_hold_equity(spark, sf_dir):
    return metrics.buy_and_hold(_bars(spark, sf_dir), 10_000_000.0, ledger.Costs()).select("symbol", "date", _r("equity", 4).alias("equity"))


@query(f"""WITH @BARS, q AS (SELECT symbol, date, close / lag(close) OVER {_O} - 1 AS r FROM bars), j AS (SELECT a.symbol, a.date, a.r AS s, b.r AS b FROM q a JOIN q b ON a.date = b.date AND b.symbol = 'NO' WHERE a.r IS NOT NULL AND b.r IS NOT NULL AND a.symbol <> 'NO'),
 m AS (SELECT symbol, covar_samp(s, b) / var_samp(b) AS beta, avg(s) AS ms, avg(b) AS mb, corr(s, b) AS c, avg(s - b) AS ma, stddev_samp(s - b) AS sa, count(*) AS n FROM j GROUP BY 1)
 SELECT symbol, CASE WHEN n >= 20 THEN round((ms - beta * mb) * 252, 5) END AS alpha_ann, CASE WHEN n >= 20 THEN round(beta, 6) END AS beta, CASE WHEN n >= 20 THEN round(c, 6) END AS correlation, CASE WHEN n >= 20 THEN round(ma / sa * sqrt(252), 6) END AS information_ratio, CASE WHEN n >= 20 THEN round(ma * 252, 5) END AS active_return_ann FROM m""")
def benchmark_comparison(spark, sf_dir):
    r = metrics.returns(_bars(spark, sf_dir), "symbol", "close")
    b = r.filter("symbol = 'NO'").select("date", F.col("r").alias("b"))
    got = metrics.compare(r.filter("symbol <> 'NO'"), b, "symbol")
    return got.select(
        "symbol", _r("alpha_ann", 5).alias("alpha_ann"), _r("active_return_ann", 5).alias("active_return_ann"),
        *(_r(c).alias(c) for c in ("beta", "correlation", "information_ratio"))
    )


def _trade_like(spark, sf_dir) -> DataFrame:
    """Order lines as trades: what the price was above or below 38000."""
    l = src.table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_returnflag").alias("scenario_id"), F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2)
        ).alias("symbol"), F.to_date("l_shipdate").alias("exit_ts"), F.date_sub(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")).alias("entry_ts"),
        F.round(F.col("l_extendedprice") - 38000, 2).alias("pnl"), F.round(F.col("l_extendedprice") * F.col("l_tax"), 2).alias("fees"), F.round(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("slippage"), F.col("l_quantity").cast("int").alias("holding_bars"),
    )


_TRADES = """t AS (SELECT l_returnflag AS scenario_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || round(l_extendedprice, 2) AS symbol, CAST(l_shipdate AS DATE) AS exit_ts, CAST(l_shipdate AS DATE) - CAST(l_quantity AS INT) AS entry_ts,
 round(l_extendedprice - 38000, 2) AS pnl, round(l_extendedprice * l_tax, 2) AS fees, round(l_extendedprice * l_discount, 2) AS slippage, CAST(l_quantity AS INT) AS holding_bars FROM lineitem)"""


@query(f"""WITH {_TRADES}, m AS (SELECT scenario_id, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS wr, sum(pnl) FILTER (pnl > 0) AS gp, -sum(pnl) FILTER (pnl <= 0) AS gl, avg(pnl) AS ex, avg(pnl) FILTER (pnl > 0) AS aw, avg(pnl) FILTER (pnl <= 0) AS al,
 sum(fees) AS fe, sum(slippage) AS sl, sum(pnl) AS sp, avg(holding_bars) AS hb FROM t GROUP BY 1)
 SELECT scenario_id, n AS n_trades, round(wr, 6) AS win_rate, round(gp, 0) AS gross_profit_usd, round(gl, 0) AS gross_loss_usd, round(ex, 3) AS expectancy_usd, round(ex / 100000, 6) AS expectancy_pct, round(aw, 3) AS avg_win_usd, round(al, 3) AS avg_loss_usd,
 round(fe, 0) AS total_fees_usd, round(sl, 0) AS total_slippage_usd, round((fe + sl) / abs(sp + fe + sl), 6) AS cost_share_of_gross, round(hb, 6) AS avg_holding_bars, round(gp / gl, 6) AS profit_factor FROM m""")
def trade_stats(spark, sf_dir):
    m = metrics.trade_stats(_trade_like(spark, sf_dir), 100_000.0)
    zero, three = ("gross_profit_usd", "gross_loss_usd", "total_fees_usd", "total_slippage_usd"), ("expectancy_usd", "avg_win_usd", "avg_loss_usd")
    six = ("win_rate", "expectancy_pct", "cost_share_of_gross", "avg_holding_bars", "profit_factor")
    return m.select("scenario_id", "n_trades", *(_r(c, d).alias(c) for d, cs in ((0, zero), (3, three), (6, six)) for c in cs))


@query(f"""WITH {_TRADES}, g AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY scenario_id ORDER BY exit_ts, entry_ts, pnl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM t),
 k AS (SELECT scenario_id, g, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS k FROM g GROUP BY 1, 2) SELECT scenario_id, CAST(max(k) AS BIGINT) AS longest_losing_streak FROM k GROUP BY 1""")
def losing_streak(spark, sf_dir):
    # by amount, losses come first: of one exit and entry there are two rows, however many trades
    t = _trade_like(spark, sf_dir).groupBy("scenario_id", "exit_ts", "entry_ts", F.coalesce(F.col("pnl") >= 0, F.lit(True)).alias("symbol"))
    return metrics.losing_streaks(t.agg(F.min("pnl").alias("pnl"), F.count("*").alias("n")), often="n")


# regimes, folds, statistics

_LABELS = f"""w AS (SELECT symbol, date, close / lag(close, 63) OVER {_O} - 1 AS w FROM bars WHERE symbol = 'NO'), c AS (SELECT quantile_cont(w, CAST(1.0 / 3 AS DOUBLE)) AS lo, quantile_cont(w, CAST(2.0 / 3 AS DOUBLE)) AS hi, count(w) AS n FROM w),
 lb AS (SELECT date, CASE WHEN n < 30 OR w IS NULL THEN 'flat' WHEN w >= hi THEN 'up' WHEN w <= lo THEN 'down' ELSE 'flat' END AS label FROM w, c)"""


@query(f"WITH @BARS, {_LABELS} SELECT date, label FROM lb")
def regime_labels(spark, sf_dir):
    return regimes.label(_bars(spark, sf_dir).filter("symbol = 'NO'")).select("date", "label")


@query(f"""WITH @BARS, {_LABELS}, {_TRADES}, a AS (SELECT t.scenario_id, coalesce(lb.label, 'flat') AS label, t.pnl FROM t ASOF LEFT JOIN lb ON t.exit_ts >= lb.date),
 e AS (SELECT DISTINCT scenario_id, l AS label FROM t, (VALUES ('down'), ('flat'), ('up')) v(l))
 SELECT scenario_id, label, round(coalesce(sum(pnl), 0), 2) AS pnl, count(pnl) AS n_trades FROM e LEFT JOIN a USING (scenario_id, label) GROUP BY 1, 2""")
def regime_pnl_asof(spark, sf_dir):
    labels = regimes.label(_bars(spark, sf_dir).filter("symbol = 'NO'")).select("date", "label")
    got = regimes.pnl(_trade_like(spark, sf_dir), labels)
    return got.select("scenario_id", "label", _r("pnl", 2).alias("pnl"), "n_trades")


@query(
    """WITH @BARS SELECT o.o_orderkey, o.o_orderpriority, strftime(b.date, '%Y-%m-%d') AS bar_date, b.close FROM orders o ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'NO') b ON CAST(o.o_orderdate AS DATE) >= b.date"""
)
def as_of_orders(spark, sf_dir):
    """Each order with the last bar of NO at or before its day."""
    o = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    b = _bars(spark, sf_dir).filter("symbol = 'NO'").select(F.col("date").alias("bar_date"), "close")
    return regimes.as_of(o, b, "day", "bar_date", ["bar_date", "close"]).select("o_orderkey", "o_orderpriority", F.date_format("bar_date", "yyyy-MM-dd").alias("bar_date"), "close")


@query("""WITH @BARS, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), n AS (SELECT count(*) AS n FROM c),
 f AS (SELECT CAST(unnest(range(0, CAST((n - 983) // 126 + 1 AS BIGINT))) AS INT) AS fold FROM n WHERE n >= 983)
 SELECT fold, a.date AS train_start, b.date AS train_end, d.date AS test_start, e.date AS test_end FROM f JOIN c a ON a.i = fold * 126 JOIN c b ON b.i = fold * 126 + 755 JOIN c d ON d.i = fold * 126 + 857 JOIN c e ON e.i = fold * 126 + 982""")
def wf_folds(spark, sf_dir):
    return validation.folds(src.calendar(_bars(spark, sf_dir)), 756, 126, 101)


@query(
    f"""WITH @BARS, r AS (SELECT symbol, close / lag(close) OVER {_O} - 1 AS r FROM bars) SELECT count(r) AS n, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS sd, round(skewness(r), 6) AS skew, round(kurtosis(r), 5) AS kurt FROM r WHERE symbol = 'NO'"""
)
def dsr_moments(spark, sf_dir):
    m = validation.moments(metrics.returns(_bars(spark, sf_dir).filter("symbol = 'NO'"), "symbol", "close"))
    return m.select("n", _r("mean", 8).alias("mean"), _r("sd", 8).alias("sd"), _r("skew", 6).alias("skew"), _r("kurt", 5).alias("kurt"))


# text, hashes, catalogue

_TERMS = ["anblewh", "from", "that", "thea", "with"]


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
 t AS (SELECT doc_id, len(w) AS s, unnest(w) AS t FROM w), f AS (SELECT doc_id, t, any_value(s) AS s, count(*) AS f FROM t WHERE t IN ({', '.join(f"'{t}'" for t in _TERMS)}) GROUP BY 1, 2),
 d AS (SELECT t, count(*) AS d FROM f GROUP BY 1) SELECT doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * s / m))), 5) AS score FROM f JOIN d USING (t), n GROUP BY 1""")
def bm25_similar_docs(spark, sf_dir):
    return search.bm25(src.table(spark, sf_dir, "documents"), search.query_terms(" ".join(_TERMS))).select("doc_id", _r("score", 5).alias("score"))


@query("""WITH x AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z]{4,}'), lambda w: lower(w)))) AS w FROM documents)
 SELECT doc_id, array_to_string(w[1:12], ' OR ') AS fts_query FROM x""")
def fts_queries(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", search.fts_query("text").alias("fts_query"))


@query(f"""WITH @BARS, l AS (SELECT symbol, date, strftime(date, '%Y-%m-%d') || '|' || {" || '|' || ".join(f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)" for c in src.PRICES)} || '|' || volume AS l FROM bars)
 SELECT symbol, sha256(string_agg(l, chr(10) ORDER BY date)) AS sha256, min(date) AS first, max(date) AS last FROM l GROUP BY symbol""")
def content_hash(spark, sf_dir):
    """The hashes by which snapshots are checked, of prices in whole cents."""
    cents = _bars(spark, sf_dir).select("symbol", "date", *(F.round(F.col(c) * 100).cast("bigint").alias(c) for c in src.PRICES), "volume")
    return store.row_hashes(cents)


_SEGMENT = 128


@query(f"""WITH l AS (SELECT CAST(o_orderkey AS BIGINT) AS seq, lag(CAST(o_orderkey AS BIGINT)) OVER (ORDER BY o_orderkey) AS p FROM orders)
 SELECT seq, p IS NULL OR p // {_SEGMENT} = seq // {_SEGMENT} AND p % 103 <> 29 AS prev_ok, seq % 101 <> 17 AND seq % 103 <> 29 AS hash_ok FROM l""")
def audit_chain_verify(spark, sf_dir):
    """A log of all orders, spliced from segments that are each a true chain; some entries' payloads were changed later, some entries' hashes were."""
    text = lambda c: F.col(c).cast("string")
    o = src.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("seq"), text("o_orderdate").alias("ts"), text("o_orderstatus").alias("actor"),
        text("o_orderpriority").alias("event_type"), text("o_custkey").alias("payload_json")
    )
    parts = ("ts", "actor", "event_type", "payload_json")
    held = o.groupBy(F.floor(F.col("seq") / _SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("seq", *parts))).alias("entries"))  # _SEGMENT entries at most
    start = held.agg(F.min("segment").alias("least"))
    seed = F.when(F.col("segment") == F.col("least"), F.lit(search.GENESIS)).otherwise(F.sha2(F.col("segment").cast("string"), 256))

    def chain(done, entry):
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["this_hash"], F.col("seed"))
        mine = search.entry_hash(before, *(entry[c] for c in parts))
        link = F.struct(entry["seq"].alias("seq"), *(entry[c].alias(c) for c in parts), before.alias("prev_hash"), mine.alias("this_hash"))
        return F.concat(done, F.array(link))

    none = F.array().cast("array<struct<seq:bigint,ts:string,actor:string,event_type:string,payload_json:string,prev_hash:string,this_hash:string>>")
    log = held.join(F.broadcast(start)).withColumn("seed", seed).select(F.inline(F.aggregate("entries", none, chain)))  # start: one row
    changed = F.when(F.col("seq") % 101 == 17, F.lit("tampered")).otherwise(F.col("payload_json"))
    forged = F.when(F.col("seq") % 103 == 29, F.sha2("this_hash", 256)).otherwise(F.col("this_hash"))
    return search.chain_state(log.withColumns({"payload_json": changed, "this_hash": forged}))


@query(
    """SELECT c_mktsegment AS family, CAST(sum(o_orderkey % 50) AS DOUBLE) AS n_configs, count(*) AS runs FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1"""
)
def family_config_counts(spark, sf_dir):
    """The counters of multiple testing: customers as hypotheses, orders as experiments with a run and a metric each."""
    hypotheses, experiments, runs, values = _research(spark, sf_dir)
    return catalog.family_totals(values, runs, experiments, hypotheses, "n_configs").select("family", F.col("total").alias("n_configs"), "runs")


@query("""WITH x AS (SELECT o_orderkey AS experiment_id, o_custkey AS hypothesis_id, c_mktsegment AS family, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'inconclusive' END AS verdict FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT experiment_id, hypothesis_id, family, CASE WHEN verdict = 'inconclusive' THEN 'running' ELSE 'complete' END AS status, CASE WHEN verdict <> 'inconclusive' THEN verdict END AS verdict FROM x""")
def experiment_states(spark, sf_dir):
    """Where each experiment stands by the last of its events: registered, running, complete with a verdict."""
    hypotheses, experiments, _, _ = _research(spark, sf_dir)
    return catalog.current(experiments, _events(spark, sf_dir), hypotheses).select("experiment_id", "hypothesis_id", "family", "status", "verdict")


@query("""WITH w AS (SELECT c_custkey AS h, c_mktsegment AS family, regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '[a-z0-9]+') AS w FROM customer), n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
 t AS (SELECT h, len(w) AS s, unnest(w) AS t FROM w), f AS (SELECT h, t, any_value(s) AS s, count(*) AS f FROM t WHERE t IN ('building', 'machinery') GROUP BY 1, 2), d AS (SELECT t, count(*) AS d FROM f GROUP BY 1),
 sc AS (SELECT h, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * s / m))) AS score FROM f JOIN d USING (t), n GROUP BY 1),
 failed AS (SELECT o_orderkey AS e, o_custkey AS h, c_mktsegment AS family FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
 near AS (SELECT e, h, family FROM failed JOIN sc USING (h) ORDER BY round(score, 9) DESC, e LIMIT 10)
 SELECT e AS experiment_id, h AS hypothesis_id, family, 'same family' AS kind FROM failed WHERE family = 'MACHINERY'
 UNION ALL SELECT e, h, family, 'similar text' FROM near WHERE family <> 'MACHINERY'""")
def similar_failures(spark, sf_dir):
    """Failed experiments of a new hypothesis' family, and of the ten that match its text best."""
    hypotheses, experiments, _, _ = _research(spark, sf_dir)
    failed = catalog.current(experiments, _events(spark, sf_dir), hypotheses).filter("verdict = 'fail'")
    found = catalog.resembling(failed, hypotheses, "MACHINERY", search.query_terms("building machinery"))
    return found.select("experiment_id", "hypothesis_id", "family", F.when(F.col("rank") == 0, "same family").otherwise("similar text").alias("kind"))


@query("""WITH v AS (SELECT 'R' || o_orderkey AS run_id, o_orderkey % 50 AS n, o_totalprice FROM orders)
 SELECT run_id, CAST(n AS DOUBLE) AS n_configs, CAST(n AS DOUBLE) AS n_trials FROM v""")
def metrics_pivot(spark, sf_dir):
    """The report's table of metrics: a row for each run, a column for each metric."""
    return report.pivoted(_research(spark, sf_dir)[3], ["n_configs", "n_trials"])


@query("""SELECT o_custkey AS experiment_id, CASE WHEN o_orderpriority < '3' THEN 'backtest' ELSE 'walkforward' END AS run_type,
 max_by('R' || o_orderkey, (CAST(o_orderdate AS DATE), 'R' || o_orderkey)) AS run_id, strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS started_at FROM orders GROUP BY 1, 2""")
def latest_runs(spark, sf_dir):
    """Customers as experiments, orders as their runs: the last of each type."""
    kind = F.when(F.col("o_orderpriority") < "3", "backtest").otherwise("walkforward")
    runs = src.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_custkey").alias("experiment_id"), kind.alias("run_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"),
    )
    return report.latest(runs)


@query("""WITH @BARS, q AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r, row_number() OVER (ORDER BY date) AS n FROM bars WHERE symbol = 'NO'),
 s AS (SELECT date, CASE WHEN n % 97 = 0 THEN -2 - r / 10000 ELSE r / 10000 END AS r FROM q WHERE r IS NOT NULL)
 SELECT date, round(exp(sum(ln(abs(1 + r))) OVER w) * CASE WHEN sum(CASE WHEN r < -1 THEN 1 ELSE 0 END) OVER w % 2 = 1 THEN -1 ELSE 1 END - 1, 6) AS growth
 FROM s WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def growth_curve(spark, sf_dir):
    """The report's cumulative return, of returns that lose more than everything now and then."""
    r = metrics.returns(_bars(spark, sf_dir).filter("symbol = 'NO'"), "symbol", "close")
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) + 1
    r = r.withColumn("r", F.when(n % 97 == 0, -2 - F.col("r") / 10000).otherwise(F.col("r") / 10000))
    return report.cumulative(r).select("date", _r("growth").alias("growth"))


@query("""WITH @BARS SELECT date, round(close / max(close) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 8) AS drawdown FROM bars WHERE symbol = 'NO'""")
def drawdown_curve(spark, sf_dir):
    curve = _bars(spark, sf_dir).filter("symbol = 'NO'").select("date", F.col("close").alias("equity"))
    return report.drawdown_curve(curve).select("date", _r("drawdown", 8).alias("drawdown"))


@query("""WITH @BARS SELECT symbol, count(*) AS bars, min(date) AS first_bar, max(date) AS last_bar FROM bars GROUP BY 1""")
def coverage(spark, sf_dir):
    """What the catalogue notes of instruments."""
    return store.coverage(_bars(spark, sf_dir))


def _research(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hypotheses, experiments, runs, run_metrics) made of customers and orders."""
    c, o = src.table(spark, sf_dir, "customer"), src.table(spark, sf_dir, "orders")
    hypotheses = c.select(
        F.col("c_custkey").cast("long").alias("hypothesis_id"), F.col("c_mktsegment").alias("family"), F.col("c_name").alias("statement"),
        F.col("c_mktsegment").alias("mechanism")
    )
    key = F.col("o_orderkey").cast("long")
    experiments = o.select(key.alias("experiment_id"), F.col("o_custkey").cast("long").alias("hypothesis_id"))
    run = F.concat(F.lit("R"), key.cast("string"))
    runs = o.select(run.alias("run_id"), key.alias("experiment_id"), F.when(F.col("o_orderpriority") == "5-LOW", "backtest").otherwise("walkforward").alias("run_type"))
    values = o.select(run.alias("run_id"), F.lit("n_configs").alias("metric"), F.lit("all").alias("period"), (key % 50).cast("double").alias("value"))
    return hypotheses, experiments, runs, values.unionByName(values.withColumn("metric", F.lit("n_trials")))


def _events(spark, sf_dir) -> DataFrame:
    o = src.table(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass")
    none, text = F.lit(None).cast("string"), F.lit("as measured")
    steps = F.array(
        F.struct(F.lit(1).cast("long").alias("seq"), F.lit("registered").alias("status"), none.alias("verdict"), none.alias("verdict_reason")),
        F.struct(F.lit(2).cast("long").alias("seq"), F.lit("running").alias("status"), none.alias("verdict"), none.alias("verdict_reason")),
        F.when(verdict.isNotNull(), F.struct(F.lit(3).cast("long").alias("seq"), F.lit("complete").alias("status"), verdict.alias("verdict"), text.alias("verdict_reason"))),
    )
    rows = o.select(F.col("o_orderkey").cast("long").alias("experiment_id"), F.inline(F.filter(steps, lambda x: x.isNotNull())))
    return rows.withColumn("ts", F.lit("2024-01-01T00:00:00Z"))


# ledger and validation: bars after a split of 1000 for 1, so that a share is a small part of an account

_UNIVERSE = ["AF", "NO", "RF"]
_ACCOUNT = ledger.Account(10_000_000.0, sizing=ledger.Sizing(atr_stop_mult=0.5))
_PARAMS = {"fast": 20, "slow": 100}
_MULTIPLIERS, _DELAYS = [1.0, 1.5, 2.0, 3.0], [0, 1]


def _split_bars(spark, sf_dir) -> DataFrame:
    return _bars(spark, sf_dir).select("symbol", "date", *((F.col(c) / 1000).alias(c) for c in src.PRICES), (F.col("volume") * 1000).alias("volume"))


_STATES = f"""sm AS (SELECT symbol, date, {_N}, {", ".join(f"avg(close) OVER {_W.format(k - 1)} AS s{k}" for k in (10, 20, 30, 50, 100, 200))} FROM bars),
 gr AS (SELECT row_number() OVER (ORDER BY f, s) - 1 AS combo, CAST(f AS INT) AS f, CAST(s AS INT) AS s, '{{"fast":' || f || ',"slow":' || s || '}}' AS key
  FROM (VALUES (10), (20), (30)) a(f), (VALUES (50), (100), (200)) b(s)),
 st AS (SELECT key, symbol, date, CAST(CASE f WHEN 10 THEN s10 WHEN 20 THEN s20 ELSE s30 END > CASE gr.s WHEN 50 THEN s50 WHEN 100 THEN s100 ELSE s200 END AS INT) AS state FROM sm, gr WHERE n >= gr.s + 1),
 sg AS MATERIALIZED (SELECT key, idx, {", ".join(f"max(state) FILTER (symbol = '{s}') AS state{k}" for k, s in enumerate(_UNIVERSE))} FROM st JOIN cal USING (date) GROUP BY key, idx)"""
_LEDGER = f"""WITH RECURSIVE {BARS_SQL.replace("bars AS", "whole AS", 1)},
 bars AS (SELECT symbol, date, open / 1000 AS open, high / 1000 AS high, low / 1000 AS low, close / 1000 AS close, volume * 1000 AS volume FROM whole),
 {ledger_sql.tape(_UNIVERSE, _ACCOUNT)}, {_STATES}"""
_GRID_RUN = f"""{_LEDGER}, sc AS (SELECT key AS sid, key, CAST(0 AS BIGINT) AS first, (SELECT max(idx) FROM cal) AS last, CAST(1 AS DOUBLE) AS mult, 0 AS delay FROM gr),
 {ledger_sql.ledger("lg", _UNIVERSE, _ACCOUNT, "sc", "sg")}"""


def _curve_sql(name: str) -> str:
    """CTEs <name>e (days), <name>m: sid, total (last over first), n, mean, sd, down, drawdown, under, exposure of a ledger's equity."""
    w = "(PARTITION BY sid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}e AS ({ledger_sql.equity(name)}),
 {name}q AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY sid ORDER BY date), 0) - 1 AS r, equity / nullif(max(equity) OVER {w}, 0) - 1 AS dd FROM {name}e WHERE sid IS NOT NULL),
 {name}g AS (SELECT sid, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER {w} AS g, dd FROM {name}q),
 {name}u AS (SELECT sid, CAST(max(k) AS BIGINT) AS under FROM (SELECT sid, g, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS k FROM {name}g GROUP BY ALL) GROUP BY 1),
 {name}m AS (SELECT sid, max_by(equity, date) / nullif(min_by(equity, date), 0) AS total, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(r * r) FILTER (r < 0)) AS down,
  min(dd) AS drawdown, avg(exposure) AS exposure FROM {name}q GROUP BY 1)"""


def _base_run(spark, sf_dir) -> DataFrame:
    b, grid = _split_bars(spark, sf_dir), SmaCross.grid()
    wanted = ledger.scenarios(spark, [{"scenario_id": params_key(c), "params_key": params_key(c)} for c in grid])
    return ledger.run(b, SmaCross.signals(b, grid), wanted, _UNIVERSE, _ACCOUNT)


_ROUNDED = ("fees", "slippage", "pnl", "mae", "mfe")  # by the ledger, to 6 digits


@query(f"""{_GRID_RUN} SELECT sid AS scenario_id, symbol, entry_ts, exit_ts, round(entry_px, 6) AS entry_px, round(exit_px, 6) AS exit_px, qty, holding_bars, exit_reason,
 {", ".join(_ROUNDED)} FROM ({ledger_sql.trades("lg", _UNIVERSE)})""")
def backtest_trades(spark, sf_dir):
    """Thousands of trades that end by signals, by stops and with the data."""
    t = ledger.trades_of(_base_run(spark, sf_dir))
    return t.select(
        "scenario_id", "symbol", "entry_ts", "exit_ts", "qty", "holding_bars", "exit_reason", *_ROUNDED, _r("entry_px").alias("entry_px"),
        _r("exit_px").alias("exit_px")
    )


@query(f"{_GRID_RUN} SELECT sid AS scenario_id, date, equity, cash, exposure FROM ({ledger_sql.equity('lg')})")
def backtest_equity(spark, sf_dir):
    return ledger.equity_of(_base_run(spark, sf_dir))


_OF_CURVE = {"total_return": 7, "cagr": 7, "ann_vol": 6, "sharpe": 6, "sortino": 6, "max_drawdown": 7, "avg_exposure": 6}
_OF_TRADES = {
    "win_rate": 6, "gross_profit_usd": 1, "gross_loss_usd": 1, "expectancy_usd": 2, "expectancy_pct": 8, "avg_win_usd": 2, "avg_loss_usd": 2,
    "total_fees_usd": 4, "total_slippage_usd": 1, "cost_share_of_gross": 6, "avg_holding_bars": 6, "profit_factor": 6,
}


@query(f"""{_GRID_RUN}, {_curve_sql("lg")}, t AS ({ledger_sql.trades("lg", _UNIVERSE)}),
 i AS (SELECT sid, pnl, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY exit_ts, entry_ts, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM t),
 k AS (SELECT sid, CAST(max(k) AS BIGINT) AS longest_losing_streak FROM (SELECT sid, i, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS k FROM i GROUP BY ALL) GROUP BY 1),
 m AS (SELECT sid, count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0 END) AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gross_profit_usd,
  coalesce(-sum(pnl) FILTER (pnl <= 0), 0) AS gross_loss_usd, avg(pnl) AS expectancy_usd, avg(pnl) / 1e7 AS expectancy_pct, avg(pnl) FILTER (pnl > 0) AS avg_win_usd,
  avg(pnl) FILTER (pnl <= 0) AS avg_loss_usd, sum(fees) AS total_fees_usd, sum(slippage) AS total_slippage_usd, (sum(fees) + sum(slippage)) / abs(sum(pnl) + sum(fees) + sum(slippage)) AS cost_share_of_gross,
  avg(holding_bars) AS avg_holding_bars, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl <= 0) AS profit_factor FROM t GROUP BY 1),
 c AS (SELECT sid, n AS n_bars, total - 1 AS total_return, CASE WHEN total <= 0 THEN -1 ELSE pow(total, 252e0 / n) - 1 END AS cagr, sd * sqrt(252) AS ann_vol, mean / sd * sqrt(252) AS sharpe,
  mean / down * sqrt(252) AS sortino, drawdown AS max_drawdown, under AS longest_underwater_bars, exposure AS avg_exposure FROM lgm JOIN lgu USING (sid))
 SELECT sid AS scenario_id, n_bars, longest_underwater_bars, n_trades, longest_losing_streak, {", ".join(f"round({c}, {d}) AS {c}" for c, d in (_OF_CURVE | _OF_TRADES).items())}
 FROM c JOIN m USING (sid) JOIN k USING (sid)""")
def backtest_metrics(spark, sf_dir):
    m = metrics.scenario_metrics(_base_run(spark, sf_dir), _ACCOUNT.initial_capital)
    return m.select("scenario_id", "n_bars", "longest_underwater_bars", "n_trades", "longest_losing_streak", *(_r(c, d).alias(c) for c, d in (_OF_CURVE | _OF_TRADES).items()))


@query(f"""{_LEDGER}, days AS (SELECT count(*) AS n FROM cal), fo AS (SELECT CAST(unnest(range(0, CAST((n - 983) // 126 + 1 AS BIGINT))) AS INT) AS fold FROM days WHERE n >= 983),
 sc AS (SELECT fold || '/' || combo AS sid, key, CAST(fold * 126 AS BIGINT) AS first, CAST(fold * 126 + 755 AS BIGINT) AS last, CAST(1 AS DOUBLE) AS mult, 0 AS delay, fold, combo FROM fo, gr),
 {ledger_sql.ledger("lg", _UNIVERSE, _ACCOUNT, "sc", "sg")}, {_curve_sql("lg")}, t AS ({ledger_sql.trades("lg", _UNIVERSE)}), tn AS (SELECT sid, count(*) AS n_trades FROM t GROUP BY 1),
 best AS (SELECT fold, sc.key, mean / sd * sqrt(252) AS train_sharpe FROM sc JOIN lgm USING (sid) JOIN tn USING (sid) WHERE n_trades >= 5 AND sd > 0
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mean / sd DESC, drawdown DESC, combo) = 1),
 ts AS (SELECT CAST(fold AS VARCHAR) AS sid, key, CAST(fold * 126 + 857 AS BIGINT) AS first, CAST(fold * 126 + 982 AS BIGINT) AS last, CAST(1 AS DOUBLE) AS mult, 0 AS delay FROM best),
 {ledger_sql.ledger("lt", _UNIVERSE, _ACCOUNT, "ts", "sg")}, {_curve_sql("lt")}, u AS ({ledger_sql.trades("lt", _UNIVERSE)}), un AS (SELECT sid, count(*) AS n FROM u GROUP BY 1)
 SELECT fo.fold, a.date AS train_start, b.date AS train_end, d.date AS test_start, e.date AS test_end, 101 AS embargo_bars, coalesce(best.key, '{params_key(_PARAMS)}') AS params_key,
 round(train_sharpe, 6) AS train_sharpe, round(mean / sd * sqrt(252), 6) AS test_sharpe, round(coalesce(total - 1, 0), 7) AS test_return, CAST(coalesce(un.n, 0) AS INT) AS test_trades
 FROM fo JOIN cal a ON a.idx = fold * 126 JOIN cal b ON b.idx = fold * 126 + 755 JOIN cal d ON d.idx = fold * 126 + 857 JOIN cal e ON e.idx = fold * 126 + 982
 LEFT JOIN best ON best.fold = fo.fold LEFT JOIN ltm ON ltm.sid = CAST(fo.fold AS VARCHAR) LEFT JOIN un ON un.sid = CAST(fo.fold AS VARCHAR)""")
def walkforward(spark, sf_dir):
    done = validation.walk_forward(_split_bars(spark, sf_dir), SmaCross, _PARAMS, _UNIVERSE, _ACCOUNT, 756, 126)
    done.release()
    return done.folds.withColumns({"train_sharpe": _r("train_sharpe"), "test_sharpe": _r("test_sharpe"), "test_return": _r("test_return", 7)})


_NEAR = "f <> 20 AND s = 100 OR f = 20 AND s <> 100"


@query(f"""{_LEDGER}, sc AS (SELECT 'cost/' || m AS sid, '{params_key(_PARAMS)}' AS key, CAST(0 AS BIGINT) AS first, (SELECT max(idx) FROM cal) AS last, CAST(m AS DOUBLE) AS mult, 0 AS delay
  FROM (VALUES {", ".join(f"({m})" for m in _MULTIPLIERS)}) v(m) UNION ALL SELECT 'delay/' || d, '{params_key(_PARAMS)}', 0, (SELECT max(idx) FROM cal), 1, d FROM (VALUES {", ".join(f"({d})" for d in _DELAYS)}) v(d)
  UNION ALL SELECT 'neighbor/' || (row_number() OVER (ORDER BY combo) - 1), key, 0, (SELECT max(idx) FROM cal), 1, 0 FROM gr WHERE {_NEAR}),
 {ledger_sql.ledger("lg", _UNIVERSE, _ACCOUNT, "sc", "sg")}, {_curve_sql("lg")}
 SELECT split_part(sid, '/', 1) AS method, CAST(split_part(sid, '/', 2) AS DOUBLE) AS level, CASE WHEN sid NOT LIKE 'n%' THEN round(total - 1, 7) END AS total_return,
 CASE WHEN sid LIKE 'n%' THEN round(coalesce(mean / sd * sqrt(252), 0), 4) ELSE round(mean / sd * sqrt(252), 6) END AS sharpe FROM lgm""")
def stress_tests(spark, sf_dir):
    s = validation.stress(_split_bars(spark, sf_dir), SmaCross, _PARAMS, _UNIVERSE, _ACCOUNT, _MULTIPLIERS, _DELAYS, 8, 1)
    rows = [("cost", float(r["multiplier"]), r["total_return"], r["sharpe"]) for r in s.cost_table] + [
        ("delay", float(r["extra_delay_bars"]), r["total_return"], r["sharpe"])
        for r in s.delay_table
    ]
    rows += [("neighbor", float(i), None, float(x)) for i, x in enumerate(s.neighbour.get("neighbor_sharpes", []))]
    table = spark.createDataFrame(rows, "method string, level double, total_return double, sharpe double")
    return table.withColumns({"total_return": _r("total_return", 7), "sharpe": _r("sharpe")})


@query()
def bootstrap_blocks(spark, sf_dir):
    r = [x["r"] for x in metrics.returns(_bars(spark, sf_dir).filter("symbol = 'NO'"), "symbol", "close").orderBy("date").collect()]
    got = validation.block_bootstrap(spark, r, 2000, 7, 15.0)
    return spark.createDataFrame([(k, float(v)) for k, v in got.items()], "stat string, value double")


@query()
def bootstrap_trades(spark, sf_dir):
    # a value for each amount: whole cents in the range of prices, however many trades
    pnls, often = validation.amounts(_trade_like(spark, sf_dir).filter("scenario_id = 'R'"))
    got = validation.trade_bootstrap(spark, pnls, 10_000_000.0, 2000, 7, 15.0, often)
    return spark.createDataFrame([(k, float(v)) for k, v in got.items()], "stat string, value double")


@query()
def synthetic_bars(spark, sf_dir):
    from barloom.sources.synthetic import synthetic_bars as make

    return make(spark, ["SYN1", "SYN2", "SYN3"], 600)
