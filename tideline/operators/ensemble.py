"""Aggregating, ranking and selecting the predictions of strategies.

Predictions are rows: keys (symbol, ts by default), strategy, side, probability, meta_probability,
regime; or strategy, signal, confidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol", "ts")


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def conflict_aware(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, side (weighted by meta probability), probability, meta_probability (halved if sides differ), regime."""
    m, total = F.col("meta_probability"), F.sum("meta_probability")
    calm = F.when(F.count_distinct("side") > 1, 0.5).otherwise(1.0)
    return predictions.groupBy(*keys).agg(
        F.when(total > 0, _over(F.sum(F.col("side") * m), total)).otherwise(0.0).alias("side"), F.avg("probability").alias("probability"),
        F.when(total > 0, F.avg(m) * calm).otherwise(0.0).alias("meta_probability"), F.min_by("regime", "strategy").alias("regime"))


def weighted_average(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    total = F.sum("confidence")
    return predictions.groupBy(*keys).agg(F.when(total > 0, _over(F.sum(F.col("signal") * F.col("confidence")), total)).otherwise(0.0).alias("signal"), F.when(total > 0, F.avg("confidence")).otherwise(0.0).alias("confidence"), F.count(F.lit(1)).alias("num_strategies"))


def majority_vote(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    votes = F.sum(F.signum("signal"))
    return predictions.groupBy(*keys).agg(F.signum(votes).alias("signal"), (F.abs(votes) / F.count(F.lit(1))).alias("confidence"), F.count(F.lit(1)).alias("num_strategies"))


def best_confidence(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of several with the highest confidence, the strategy that comes first by name."""
    place = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "strategy")
    return predictions.withColumn("_r", F.row_number().over(place)).filter("_r = 1").select(*keys, "signal", "confidence", F.col("strategy").alias("source"))


METHODS = {"conflict_aware": conflict_aware, "weighted_average": weighted_average, "majority_vote": majority_vote, "best_confidence": best_confidence}


def aggregate(predictions: DataFrame, method: str = "weighted_average", keys: Sequence[str] = KEYS) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return METHODS[method](predictions, keys)


def consensus(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean signal, how aligned signals are, share in the consensus direction (down unless the mean is above 0), mean confidence."""
    mean = F.avg("signal").over(Window.partitionBy(*keys))
    way = F.when(F.col("_mean") > 0, 1.0).otherwise(-1.0)
    return predictions.withColumn("_mean", mean).groupBy(*keys).agg(
        F.avg("signal").alias("consensus_signal"), (1.0 - F.least(F.stddev_pop("signal"), F.lit(1.0))).alias("consensus_strength"),
        F.avg(F.when(F.signum("signal") == way, 1.0).otherwise(0.0)).alias("agreement"), F.count(F.lit(1)).alias("num_strategies"), F.avg("confidence").alias("avg_confidence"))


def regime_filtered(predictions: DataFrame, preferred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Predictions of the strategies that their regime prefers (regime, strategy); all, where that leaves none."""
    marked = predictions.join(preferred.select("regime", "strategy").distinct().withColumn("_p", F.lit(1)), ["regime", "strategy"], "left")
    some = F.count("_p").over(Window.partitionBy(*keys))
    return marked.withColumn("_n", some).filter((F.col("_n") == 0) | F.col("_p").isNotNull()).select(*predictions.columns)


def compatible(rows: DataFrame, preferred: DataFrame) -> DataFrame:
    """rows with compatible: their regime prefers the strategy, or no preference of the regime is known."""
    known = preferred.groupBy("regime").agg(F.collect_set("strategy").alias("_s"))
    return rows.join(known, "regime", "left").withColumn("compatible", F.coalesce(F.array_contains("_s", F.col("strategy")), F.lit(True))).drop("_s")


def ranked(predictions: DataFrame, performance: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """predictions with rank by historical score (strategy, score), 0 where there is none; ties by strategy."""
    scored = predictions.join(performance.select("strategy", "score"), "strategy", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "strategy")))


def top(predictions: DataFrame, n: int = 3, criterion: str = "confidence", keys: Sequence[str] = KEYS) -> DataFrame:
    if criterion not in ("confidence", "signal_strength"):
        raise ValueError(f"unknown criterion: {criterion}")
    by = F.desc("confidence") if criterion == "confidence" else F.desc(F.abs("signal"))
    return predictions.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by, "strategy"))).filter(F.col("_r") <= n).drop("_r")
