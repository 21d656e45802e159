"""Market regimes, and timelines of them as gaps and islands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.series import EPS, Series, choose, col, frame, mean, ordered, pct, project, std, zscore

REGIMES = ("trend_regime", "vol_regime", "volume_regime", "micro_regime")
#: A symbol's canonical regimes.
TREND, VOLCRUSH, MEANREV = "TREND", "VOLCRUSH", "MEANREV"


def trend(window: int = 14, threshold: float = 25.0) -> Series:
    return choose((I.adx(window)["adx"] > threshold, "trending"), default="ranging")


def volatility(window: int = 20, threshold: float = 1.0) -> Series:
    vol = std(pct(I.CLOSE), window)
    z = (vol - mean(vol, 2 * window)) / (std(vol, 2 * window) + EPS)
    return choose((z > threshold, "high_vol"), (z < -threshold, "low_vol"), default="normal_vol")


def volume(window: int = 20, threshold: float = 1.5) -> Series:
    z = zscore(I.VOLUME, window)
    return choose((z > threshold, "high_volume"), (z < -threshold, "low_volume"), default="normal_volume")


def micro(window: int = 20, threshold: float = 1.5) -> Series:
    return choose((zscore(I.effective_spread(), window) > threshold, "wide"), default="tight")


NUMBERS = {"trending": 1, "ranging": 0, "high_vol": 1, "normal_vol": 0, "low_vol": -1, "high_volume": 1, "normal_volume": 0, "low_volume": -1, "wide": 1, "tight": 0}


def numeric(regime: str) -> Column:
    """The number of a regime column's label."""
    return F.create_map(*(F.lit(x) for item in NUMBERS.items() for x in item))[F.col(regime)]


def detect(bars: DataFrame, *, use: Sequence[str] = REGIMES, detectors: Mapping[str, Series] | None = None) -> DataFrame:
    """symbol, ts and a column for each regime; ``detectors`` adds or replaces some."""
    made = {"trend_regime": trend(), "vol_regime": volatility(), "volume_regime": volume(), "micro_regime": micro()}
    wanted = {k: v for k, v in made.items() if k in use} | dict(detectors or {})
    return project(bars, wanted, keep=["symbol", "ts"])


def composite(regimes: DataFrame) -> DataFrame:
    """regimes with composite_regime (trend and volatility) and canonical_regime."""
    out = regimes.withColumn("composite_regime", F.concat_ws("_", *(c for c in ("trend_regime", "vol_regime") if c in regimes.columns)))
    return out.withColumn("canonical_regime", canonical())


def canonical() -> Column:
    return F.when(F.col("trend_regime") == "trending", TREND).when(F.col("vol_regime") == "high_vol", VOLCRUSH).otherwise(MEANREV)


def regime_matrix(regimes: DataFrame) -> DataFrame:
    """symbol, ts and the regimes as numbers."""
    return regimes.select("symbol", "ts", *(numeric(c).alias(c) for c in REGIMES if c in regimes.columns))


def regime_at(regimes: DataFrame, back: int = 1) -> DataFrame:
    """Each symbol's row ``back`` bars from the end (1 is the last)."""
    place = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return regimes.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") == back).drop("_n")


def current_regime(bars: DataFrame) -> DataFrame:
    """symbol, ts and canonical regime of the last bar."""
    return regime_at(composite(detect(bars))).select("symbol", "ts", F.col("canonical_regime").alias("regime"))


# Statistics ---------------------------------------------------------------------------


def changed(column: str) -> Column:
    """The label differs from the row before; so it does in the first row."""
    return ~F.col(column).eqNullSafe(F.lag(column).over(ordered())) | (F.row_number().over(ordered()) == 1)


def change_probability(regimes: DataFrame, column: str, window: int = 50) -> DataFrame:
    marked = regimes.withColumn("_c", changed(column).cast("double"))
    return project(marked, {"change_probability": mean(col("_c"), window)}).drop("_c")


def smoothed(regimes: DataFrame, column: str, window: int = 3, name: str = "smoothed") -> DataFrame:
    """The most frequent of the labels around, the smallest of several; NULL at either end."""
    left, right = -(window // 2), window - 1 - window // 2
    around = F.when(F.count(column).over(frame(left, right)) == window, F.collect_list(column).over(frame(left, right)))
    held = regimes.withColumn("_a", around)
    counts = F.transform(F.array_distinct("_a"), lambda x: F.struct((-F.size(F.filter("_a", lambda y: y == x))).alias("n"), x.alias("v")))
    return held.withColumn(name, F.array_min(counts)["v"]).drop("_a")


def persistence(regimes: DataFrame, column: str, window: int = 20, name: str = "persistence") -> DataFrame:
    """Share of the rows before with the current label."""
    held = regimes.withColumn("_a", F.when(F.row_number().over(ordered()) > window, F.collect_list(column).over(frame(-window, -1))))
    return held.withColumn(name, F.size(F.filter("_a", lambda y: y == F.col(column))) / float(window)).withColumn(name, F.when(F.col("_a").isNotNull(), F.col(name))).drop("_a")


def regime_stats(rows: DataFrame, column: str, returns: str = "returns", year: int = 252) -> DataFrame:
    """Per symbol and regime: count, frequency, mean, std, sharpe, max and min of returns."""
    share = F.count(F.lit(1)) / F.first("_all")
    out = rows.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).groupBy("symbol", F.col(column).alias("regime"))
    r = F.col(returns)
    return out.agg(F.count(F.lit(1)).alias("count"), share.alias("frequency"), F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("std_return"), (F.avg(r) / (F.stddev_samp(r) + EPS) * F.sqrt(F.lit(float(year)))).alias("sharpe"), F.max(r).alias("max_return"), F.min(r).alias("min_return"))


def combination_frequency(regimes: DataFrame, columns: Sequence[str] = REGIMES) -> DataFrame:
    """symbol, combination (labels joined by _), count, frequency."""
    counted = regimes.groupBy("symbol", F.concat_ws("_", *columns).alias("combination")).agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("frequency", F.col("count") / F.sum("count").over(Window.partitionBy("symbol")))


def breadth(returns: DataFrame, threshold: float = 0.0) -> DataFrame:
    """ts and the share of all symbols whose return is above the threshold; a missing one isn't."""
    n = returns.agg(F.count_distinct("symbol").alias("_n"))
    counted = returns.groupBy("ts").agg(F.sum(F.when(F.col("returns") > threshold, 1).otherwise(0)).alias("_up"))
    return counted.join(F.broadcast(n), F.lit(True)).select("ts", (F.col("_up") / F.col("_n")).alias("breadth"))


# Timelines ----------------------------------------------------------------------------


def islands(regimes: DataFrame, column: str) -> DataFrame:
    """regimes with period (number of the run from 1) and run (length of it so far)."""
    marked = regimes.withColumn("_c", changed(column).cast("int")).withColumn("period", F.sum("_c").over(ordered()))
    return marked.withColumn("run", F.row_number().over(Window.partitionBy("symbol", "period").orderBy("ts"))).drop("_c")


def periods(regimes: DataFrame, column: str) -> DataFrame:
    """symbol, regime, start, end, duration (bars) of every run."""
    out = islands(regimes, column).groupBy("symbol", "period").agg(F.first(column).alias("regime"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("duration"))
    return out.drop("period")


def period_stats(regimes: DataFrame, column: str) -> DataFrame:
    d = F.col("duration")
    return periods(regimes, column).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("count"), F.sum(d).alias("total_duration"), F.avg(d).alias("avg_duration"), F.max(d).alias("max_duration"), F.min(d).alias("min_duration"))


def transitions(regimes: DataFrame, column: str) -> DataFrame:
    """symbol, ts, from_regime, to_regime, duration_in_previous."""
    marked = islands(regimes, column)
    before = marked.withColumn("from_regime", F.lag(column).over(ordered())).withColumn("duration_in_previous", F.lag("run").over(ordered()))
    out = before.filter((F.col("run") == 1) & (F.col("period") > 1))
    return out.select("symbol", "ts", "from_regime", F.col(column).alias("to_regime"), "duration_in_previous")


def transition_count(regimes: DataFrame, column: str) -> DataFrame:
    return transitions(regimes, column).groupBy("symbol").agg(F.count(F.lit(1)).alias("transitions"))


def lookup(regimes: DataFrame, column: str, at: str) -> DataFrame:
    """symbol, regime and run length so far at a timestamp."""
    return islands(regimes, column).filter(F.col("ts") == F.lit(at).cast("timestamp")).select("symbol", F.col(column).alias("regime"), F.col("run").alias("duration"))


def stable_periods(regimes: DataFrame, columns: Sequence[str] = REGIMES, least: int = 10) -> DataFrame:
    """Rows in which every regime has lasted for ``least`` bars, with the shortest as min_duration."""
    out = regimes
    for i, c in enumerate(columns):
        out = islands(out, c).drop("period").withColumnRenamed("run", f"_run{i}")
    runs = [F.col(f"_run{i}") for i in range(len(columns))]
    shortest = F.least(*runs) if len(runs) > 1 else runs[0]
    return out.withColumn("min_duration", shortest).filter(F.col("min_duration") >= least).select("symbol", "ts", *columns, "min_duration")
