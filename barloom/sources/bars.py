"""Daily and hourly price bars: one long DataFrame (symbol, date, open, high, low, close, volume)."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
COLUMNS = ("symbol", "date", *PRICES, "volume")
BARS = "symbol string, date date, open double, high double, low double, close double, volume bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, symbol: Column, when: Column, price: str, volume: Column, order: Column, time: str = "date") -> DataFrame:
    """First, highest, lowest and last price of each symbol and time; one aggregate, combined before the shuffle."""
    return rows.groupBy(symbol.alias("symbol"), when.alias(time)).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.cast("bigint").alias("volume")
    )


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols are flag and status; order keys alone are not unique, so ties go on to parts, suppliers and price."""
    keys = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _bars(table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), F.to_date("l_shipdate"), "l_extendedprice", F.sum("l_quantity"), keys)


def orders_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.to_date("o_orderdate"), "o_totalprice", F.count("*"), F.col("o_orderkey"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", "ts"), "value", F.count("*"), F.col("event_id"), "hour")


def normalise(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Bars from a vendor's table: any case and spacing of names, dates as text, repeated dates.

    Of rows with one date the first in `seq` stays (the order of ingestion; without
    that column rows have no order, and the least by its values stays). A missing column, a date that doesn't parse
    or a null price or volume is an error, raised when the bars are computed."""
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    who = f"{symbol}: " if symbol else ""
    if "date" not in named.columns:
        raise ValueError(f"{who}bars need a column of dates")
    missing = [c for c in (*PRICES, "volume") if c not in named.columns]
    if missing:
        raise ValueError(f"{who}bars lack {', '.join(missing)}")
    if symbol:
        named = named.withColumn("symbol", F.lit(symbol.upper()))
    seq = F.col("seq") if "seq" in named.columns else F.struct(*(F.col(c).cast("string") for c in (*PRICES, "volume")))
    typed = named.select(
        F.upper("symbol").alias("symbol"), F.to_date(F.to_timestamp(F.col("date").cast("string"))).alias("date"),
        *(F.col(c).cast("double").alias(c) for c in PRICES), F.col("volume").cast("double").cast("bigint").alias("volume"), seq.alias("seq")
    )
    for c in ("date", *PRICES, "volume"):
        bad = F.col(c).isNull() | F.isnan(c) if c in PRICES else F.col(c).isNull()
        typed = typed.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{who}a bar without {c}")).cast(typed.schema[c].dataType)).otherwise(F.col(c)))
    first = F.row_number().over(Window.partitionBy("symbol", "date").orderBy("seq"))
    return typed.withColumn("rank", first).filter("rank = 1").select(*COLUMNS)


def read_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """The order of rows is that of files by name, of places in them, and of lines."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return normalise(spark.read.option("header", True).csv(path).withColumn("seq", at), symbol)


def csv_text(spark: SparkSession, text: str, symbol: str) -> DataFrame:
    """Bars of a CSV document that is already in memory."""
    lines = [x for x in text.splitlines() if x.strip()]
    head, schema = lines[0].split(","), None
    schema = ", ".join(f"`{h}` string" for h in head)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines[1:])], "seq long, line string")
    return normalise(rows.select("seq", F.from_csv("line", schema).alias("r")).select("seq", "r.*"), symbol)


def stooq_ticker(symbol: str) -> str:
    return symbol.lower() if "." in symbol else f"{symbol.lower()}.us"


def stooq_bars(spark: SparkSession, symbol: str, text: str) -> DataFrame:
    """Bars of a Stooq answer; what isn't CSV means that there are none."""
    if not text.lower().startswith("date,"):
        raise ValueError(f"no bars of {symbol}: the answer for {stooq_ticker(symbol)} is no table")
    return csv_text(spark, text, symbol)


#: The vendor's adjusted columns, fixed values.
ADJUSTED = {"adjOpen": "open", "adjHigh": "high", "adjLow": "low", "adjClose": "close", "adjVolume": "volume"}


def tiingo_bars(spark: SparkSession, symbol: str, payload: str | list[dict]) -> DataFrame:
    """Bars of a Tiingo answer, from its adjusted columns; times are cut to UTC days."""
    rows = json.loads(payload) if isinstance(payload, str) else payload
    if not rows:
        raise ValueError(f"no bars of {symbol} in the answer")
    missing = [c for c in ("date", *ADJUSTED) if all(c not in r for r in rows)]
    if missing:
        raise ValueError(f"the answer for {symbol} lacks {', '.join(missing)}")
    kept = [(i, str(r.get("date")), *(None if r.get(c) is None else float(r[c]) for c in ADJUSTED)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(kept, "seq long, date string, " + ", ".join(f"{c} double" for c in ADJUSTED.values()))
    return normalise(df.withColumn("date", F.to_date(F.to_timestamp("date")).cast("string")), symbol)


def _get(url: str, headers: dict[str, str], timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8")


def fetch_stooq(spark: SparkSession, symbol: str, timeout: float = 30.0) -> tuple[DataFrame, str]:
    text = _get(f"https://stooq.com/q/d/l/?s={stooq_ticker(symbol)}&i=d", {}, timeout)
    return stooq_bars(spark, symbol, text), text


def fetch_tiingo(spark: SparkSession, symbol: str, token: str, timeout: float = 30.0) -> tuple[DataFrame, str]:
    """The token goes into a header, so that it can't end up in archived addresses."""
    if not token:
        raise ValueError("this source asks for a token, TIINGO_API_KEY in the environment")
    text = _get(f"https://api.tiingo.com/tiingo/daily/{symbol.lower()}/prices?startDate=1990-01-01&format=json", {"Authorization": f"Token {token}"}, timeout)
    return tiingo_bars(spark, symbol, text), text


def calendar(bars: DataFrame) -> DataFrame:
    """date, idx: the dates of all symbols together, numbered from 0. A calendar has a row for each day, however many symbols there are."""
    days = bars.select("date").distinct()
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("idx"))


def missing_from(bars: DataFrame, symbols: list[str]) -> list[str]:
    """Symbols that have no bars at all."""
    have = {r["symbol"] for r in bars.select("symbol").filter(F.col("symbol").isin([s.upper() for s in symbols])).distinct().collect()}
    return [s for s in symbols if s.upper() not in have]
