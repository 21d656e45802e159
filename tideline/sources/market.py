"""Bars and ticks: adapters, validation, preparation."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import indicators as I
from ..functions.series import pct, project

OHLCV = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
BAR_TYPES = ("time", "dollar", "volume", "volatility")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, *, format: str = "parquet", symbols: str | Sequence[str] | None = None, start: str | None = None, end: str | None = None, **options) -> DataFrame:
    """Bars of some symbols and times; both conditions reach the scan.  No row raises ValueError."""
    reader = spark.read.format(format).options(**options)
    df = canonical(reader.load(path))
    if symbols is not None:
        df = df.filter(F.col("symbol").isin([symbols] if isinstance(symbols, str) else list(symbols)))
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    if df.isEmpty():
        raise ValueError(f"no bars for {symbols} from {start} to {end}")
    return df


def index_bars(spark: SparkSession, path: str, symbol: str = "SPY", start: str = "2020-01-01", end: str | None = None, **options) -> DataFrame:
    """Bars of one symbol from a date on."""
    return read_bars(spark, path, symbols=symbol, start=start, end=end, **options)


def canonical(df: DataFrame) -> DataFrame:
    """OHLCV columns whatever the case of their names (date, datetime and timestamp stand for ts, ticker for symbol); others stay."""
    also = {"date": "ts", "datetime": "ts", "timestamp": "ts", "ticker": "symbol"}
    names: dict[str, str] = {}
    for c in df.columns:
        name = also.get(c.lower(), c.lower())
        if name in OHLCV.names and name not in names.values():
            names[c] = name
    out = df.withColumnsRenamed(names)
    if "symbol" not in out.columns:
        out = out.withColumn("symbol", F.lit(""))
    known = [F.col(f.name).cast(f.dataType).alias(f.name) for f in OHLCV if f.name in out.columns]
    return out.select(*known, *(c for c in out.columns if c not in OHLCV.names))


def _daily(df: DataFrame, symbol: Column) -> DataFrame:
    price = F.col("o_totalprice")
    return df.groupBy(symbol.alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, "o_orderkey").cast("double").alias("open"), F.max(price).cast("double").alias("high"), F.min(price).cast("double").alias("low"), F.max_by(price, "o_orderkey").cast("double").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, a symbol for each priority."""
    return _daily(table(spark, sf_dir, "orders"), F.col("o_orderpriority"))


def order_bars_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "orders"), F.lit("ALL"))


def event_ticks(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """symbol, ts, price, volume of events, and other columns of theirs."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), *also)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events."""
    e = table(spark, sf_dir, "events").withColumn("_o", F.struct("ts", "event_id"))
    v = F.col("value").cast("double")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(v, "_o").alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, "_o").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def tick_frame(bars: DataFrame) -> DataFrame:
    """Bars with dollar_volume and returns."""
    return project(bars, {"dollar_volume": I.CLOSE * I.VOLUME, "returns": pct(I.CLOSE)})


def with_basic_features(bars: DataFrame) -> DataFrame:
    return project(bars, I.basic_features())


def validate(bars: DataFrame, min_rows: int = 100) -> bool:
    """True; ValueError for missing columns, no rows or too few; a warning names columns with missing values."""
    missing = [c for c in ("open", "high", "low", "close", "volume") if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    counts = bars.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in bars.columns)).first()
    if not counts["_n"]:
        raise ValueError("no rows")
    if counts["_n"] < min_rows:
        raise ValueError(f"{counts['_n']} rows; {min_rows} are needed")
    holes = [c for c in bars.columns if counts[c]]
    if holes:
        warnings.warn(f"missing values in {holes}", stacklevel=2)
    return True


def prepare(bars: DataFrame, *, cusum: bool = True, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars without missing values, events symbol, t0).

    Events are CUSUM events, by default with the mean of the exponentially weighted
    deviation (span 100) of each symbol as its threshold, or all bars.
    """
    from ..operators.sequential import Cusum, cusum_events, daily_volatility, with_folds

    clean = bars.na.drop()
    if not cusum:
        return clean, clean.select("symbol", F.col("ts").alias("t0"))
    if threshold is not None:
        return clean, cusum_events(clean, threshold).select("symbol", "t0")
    means = daily_volatility(clean).groupBy("symbol").agg(F.avg("daily_vol").alias("_h"))
    ready = project(clean, {"_r": pct(I.CLOSE)}).join(means, "symbol")
    fired = with_folds(ready, {"_s": Cusum("_r", "_h")}).filter("_s is not null")
    return clean, fired.select("symbol", F.col("ts").alias("t0"))


def bar_columns() -> dict[str, Column]:
    """Derived properties of a bar."""
    h, lo, c, o = (F.col(x) for x in ("high", "low", "close", "open"))
    return {"typical_price": (h + lo + c) / 3.0, "range": h - lo, "body": F.abs(c - o)}


def as_bars(df: DataFrame, bar_type: str = "time") -> DataFrame:
    """One struct column, bar, of OHLCV rows and their type."""
    if bar_type not in BAR_TYPES:
        raise ValueError(f"unknown type of bar: {bar_type}")
    return df.select(F.struct(*OHLCV.names, F.lit(bar_type).alias("bar_type")).alias("bar"))


def from_bars(bars: DataFrame) -> DataFrame:
    return bars.select(*(F.col(f"bar.{c}").alias(c) for c in OHLCV.names))


def latest(bars: DataFrame, n: int = 1) -> DataFrame:
    """Each symbol's last n bars."""
    from pyspark.sql import Window

    place = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= n).drop("_n")


def quote_columns() -> dict[str, Column]:
    """Derived properties of a quote (close, volume, bid, ask); NULL where a side is missing."""
    return {"dollar_volume": F.col("close") * F.col("volume"), "vwap": F.col("close"), "mid": (F.col("bid") + F.col("ask")) / 2.0, "spread": F.col("ask") - F.col("bid")}
