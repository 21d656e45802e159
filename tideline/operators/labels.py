"""Triple-barrier and meta labels, sample weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import frame, ordered
from .sequential import daily_volatility

def _all():
    return Window.partitionBy("symbol")


def triple_barrier(
    bars: DataFrame, events: DataFrame | None = None, *, pt: float = 1.0, sl: float = 1.0, min_ret: float = 0.0, horizon: int = 5, span: int = 100, target: str | None = None, side: str | None = None,
) -> DataFrame:
    """symbol, t0, t1, ret, label of every event (every bar, if none are given).

    The path from t0 on is p / p0 - 1, times the event's ``side`` column if named.
    The first bar at or above pt times the target gives 1, at or below -sl times it
    -1; if both are first in the same bar, -1.  If neither is reached within
    ``horizon`` bars (or by the last bar), t1 is the last of them and the label 0 for
    a return below min_ret in size, else 1 above zero and -1 otherwise.  An event
    in the last bar has no path and is dropped.  Without a target only the time
    barrier holds.  ``target`` names a column of bars; by default it is the
    exponentially weighted deviation of returns.
    """
    if target is None:
        bars, target = daily_volatility(bars, span, "_target"), "_target"
    path = F.collect_list(F.struct("ts", "close")).over(frame(0, horizon))
    held = bars.select("symbol", F.col("ts").alias("t0"), "close", F.col(target).alias("_target"), path.alias("_path"))
    if events is not None:
        cols = ["symbol", "t0"] + ([side] if side else [])
        held = held.join(events.select(*cols).distinct(), ["symbol", "t0"])
    signed = F.col(side).cast("double") if side else F.lit(1.0)
    held = held.filter(F.size("_path") > 1).withColumn("_path", F.transform("_path", lambda b: F.struct(b["ts"].alias("ts"), ((b["close"] / F.col("close") - 1.0) * signed).alias("r"))))

    def first(hit) -> Column:
        return F.try_element_at(F.filter("_path", hit), F.lit(1))

    up, down = first(lambda b: b["r"] >= F.col("_target") * pt), first(lambda b: b["r"] <= -(F.col("_target") * sl))
    last = F.element_at("_path", -1)
    touched = held.select("symbol", "t0", up.alias("_up"), down.alias("_down"), last.alias("_last"))
    lower = F.col("_down").isNotNull() & (F.col("_up").isNull() | (F.col("_down.ts") <= F.col("_up.ts")))
    hit = F.when(lower, F.col("_down")).when(F.col("_up").isNotNull(), F.col("_up")).otherwise(F.col("_last"))
    timed = F.when(F.abs(F.col("_hit.r")) < min_ret, 0).when(F.col("_hit.r") > 0, 1).otherwise(-1)
    out = touched.withColumn("_hit", hit)
    label = F.when(lower, -1).when(F.col("_up").isNotNull(), 1).otherwise(timed)
    return out.select("symbol", "t0", F.col("_hit.ts").alias("t1"), F.col("_hit.r").alias("ret"), label.cast("int").alias("label"))


def label_columns(events: DataFrame) -> DataFrame:
    """symbol, t0, t1, label, ret; the label is the return's sign where there is none."""
    label = F.col("label") if "label" in events.columns else F.signum("ret").cast("int").alias("label")
    return events.select("symbol", "t0", "t1", label, "ret")


def drop_rare_labels(events: DataFrame, least: float = 0.05) -> DataFrame:
    """Without the labels that make up less than this share of a symbol's events."""
    share = F.count(F.lit(1)).over(Window.partitionBy("symbol", "label")) / F.count(F.lit(1)).over(_all())
    return events.withColumn("_share", share).filter(F.col("_share") >= least).drop("_share")


# Meta labels --------------------------------------------------------------------------


def meta_labels(primary: DataFrame, labels: DataFrame, *, threshold: float = 0.0, sized: bool = False) -> DataFrame:
    """symbol, t0, side, ret, label, sided_ret, meta_label, and size (of the sided return) if asked for.

    ``primary`` has symbol, t0, side.
    """
    out = primary.select("symbol", "t0", "side").join(labels.select("symbol", "t0", "ret", "label"), ["symbol", "t0"])
    out = out.withColumn("sided_ret", F.col("ret") * F.col("side")).withColumn("meta_label", (F.col("sided_ret") > threshold).cast("int"))
    return out.withColumn("size", F.abs("sided_ret")) if sized else out


def apply_meta(primary: DataFrame, meta: DataFrame) -> DataFrame:
    """symbol, t0, side: the side where the meta prediction (symbol, t0, meta) isn't 0; a missing one counts as 0."""
    joined = primary.select("symbol", "t0", "side").join(meta.select("symbol", "t0", "meta"), ["symbol", "t0"], "left")
    return joined.select("symbol", "t0", F.when(F.coalesce(F.col("meta"), F.lit(0)) != 0, F.col("side")).otherwise(0).cast("int").alias("side"))


def meta_features(features: DataFrame, primary: DataFrame) -> DataFrame:
    """Features with the primary model's prediction, and its probabilities and confidence (distance of the last from 0.5) if it has them.

    ``primary`` has symbol, t0, prediction and possibly probability (an array).
    """
    out = features.join(primary, ["symbol", "t0"])
    out = out.withColumnRenamed("prediction", "primary_pred")
    if "probability" in primary.columns:
        out = out.withColumn("primary_proba", F.col("probability")).withColumn("confidence", F.abs(F.try_element_at("probability", F.lit(2)) - 0.5)).drop("probability")
    return out


def combined_predictions(features: DataFrame, primary, meta, feature_columns: list[str]) -> DataFrame:
    """symbol, t0, side of two fitted models (see operators.models): the primary one's where the meta one says so."""
    first = primary.predict(features).select("symbol", "t0", F.col("prediction").cast("int").alias("side"))
    second = meta.predict(features).select("symbol", "t0", F.col("prediction").cast("int").alias("meta"))
    return apply_meta(first, second)


def meta_scores(scored: DataFrame, by: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """accuracy, precision, recall, f1, signal_precision, kept, total of meta_label against meta, and sided_ret.

    Scores without a denominator are 0.
    """
    said, true = F.col("meta") == 1, F.col("meta_label") == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = scored.groupBy(*by).agg(count(said & true).alias("tp"), count(said).alias("kept"), count(true).alias("positive"), count(F.col("meta") == F.col("meta_label")).alias("right"), F.count(F.lit(1)).alias("total"), count(said & (F.col("sided_ret") > 0)).alias("good"))
    tp, kept, positive = F.col("tp"), F.col("kept"), F.col("positive")
    return out.select(*by, ratio(F.col("right"), F.col("total")).alias("accuracy"), ratio(tp, kept).alias("precision"), ratio(tp, positive).alias("recall"), ratio(2 * tp, kept + positive).alias("f1"), ratio(F.col("good"), kept).alias("signal_precision"), "kept", "total")


# Sample weights -----------------------------------------------------------------------


def _normalised(weight: Column) -> Column:
    return F.try_divide(weight, F.sum(weight).over(_all()))


def weights_by_return(events: DataFrame, clip: tuple[float, float] | None = None) -> DataFrame:
    """events with weight: the return's size as a share of all, clipped and normalised again if asked for."""
    out = events.withColumn("weight", _normalised(F.abs("ret")))
    if clip:
        out = out.withColumn("weight", F.when(F.col("weight").isNotNull(), F.least(F.greatest("weight", F.lit(clip[0])), F.lit(clip[1])))).withColumn("weight", _normalised(F.col("weight")))
    return out


def weights_by_decay(events: DataFrame, half_life: float = 100.0) -> DataFrame:
    """weight halves every half_life positions from the last event back."""
    place = Window.partitionBy("symbol").orderBy("t0")
    age = F.count(F.lit(1)).over(_all()) - F.row_number().over(place)
    out = events.withColumn("weight", F.exp(-math.log(2) / half_life * age))
    return out.withColumn("weight", _normalised(F.col("weight")))


def weights_by_time(events: DataFrame, half_life: float = 1.0) -> DataFrame:
    """weight halves every half_life seconds before the last event."""
    seconds = F.unix_micros(F.col("t0").cast("timestamp")) / 1e6
    age = F.max(seconds).over(_all()) - seconds
    out = events.withColumn("weight", F.exp(-math.log(2) / half_life * age))
    return out.withColumn("weight", _normalised(F.col("weight")))


def indicator(events: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, t0, ts for every bar within an event's [t0, t1], both bars: the sparse indicator matrix.

    By positions, so that no event meets bars outside its span.
    """
    spans = _spans(events, bars).filter("_from is not null and _to is not null")
    cells = spans.select("symbol", "t0", F.explode(F.sequence("_from", "_to")).alias("_at"))
    return cells.join(_numbered(bars), ["symbol", "_at"]).select("symbol", "t0", "ts")


def _numbered(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", F.row_number().over(ordered()).alias("_at"))


def _spans(events: DataFrame, bars: DataFrame) -> DataFrame:
    """events with the positions _from and _to of t0 and t1, NULL where there is no such bar."""
    at = _numbered(bars)
    first, last = at.select("symbol", F.col("ts").alias("t0"), F.col("_at").alias("_from")), at.select("symbol", F.col("ts").alias("t1"), F.col("_at").alias("_to"))
    return events.join(first, ["symbol", "t0"], "left").join(last, ["symbol", "t1"], "left")


def weights_sequential(events: DataFrame, bars: DataFrame) -> DataFrame:
    """weight in proportion to the bars in [t0, t1].

    Bars are numbered, so that an event's count is the difference of two
    positions and no event is joined with its bars.
    """
    ends = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_all"))
    out = _spans(events, bars).join(ends, "symbol", "left")
    share = F.coalesce((F.col("_to") - F.col("_from") + 1) / F.col("_all"), F.lit(0.0))
    out = out.withColumn("weight", share).drop("_from", "_to", "_all")
    return out.withColumn("weight", _normalised(F.col("weight"))).select(*events.columns, "weight")


def sample_weights(events: DataFrame, bars: DataFrame | None = None, method: str = "return") -> DataFrame:
    if method == "return":
        if "ret" not in events.columns:
            raise ValueError("weights by return need ret")
        return weights_by_return(events)
    if method == "time_decay":
        return weights_by_decay(events)
    if method == "sequential":
        if bars is None or "t1" not in events.columns:
            raise ValueError("sequential weights need bars and t1")
        return weights_sequential(events, bars)
    raise ValueError(f"unknown method: {method}")


def weighted_bootstrap(events: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """n draws with replacement per symbol: draw and the event's columns, by inverse cumulative weight."""
    row = F.struct(*events.columns)
    ends = events.select("symbol", F.sum("weight").over(Window.partitionBy("symbol").orderBy("t0")).alias("_v"), row.alias("_row"), F.lit(None).cast("int").alias("draw"))
    totals = events.groupBy("symbol").agg(F.sum("weight").alias("_total"))
    uniform = F.pmod(F.xxhash64(F.lit(seed), "symbol", "draw"), F.lit(1 << 52)) / float(1 << 52)
    draws = totals.select("symbol", "_total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.select("symbol", (uniform * F.col("_total")).alias("_v"), F.lit(None).cast(ends.schema["_row"].dataType).alias("_row"), "draw")
    # in one line of cumulative weights, downwards: the last event met is the first one above the draw
    line = Window.partitionBy("symbol").orderBy(F.desc("_v"), F.desc(F.col("draw").isNotNull())).rowsBetween(Window.unboundedPreceding, 0)
    found = ends.union(draws).withColumn("_row", F.last("_row", True).over(line)).filter("draw is not null and _row is not null")
    return found.select("draw", "_row.*")


def balanced_weights(events: DataFrame, method: str = "inverse") -> DataFrame:
    """weight (1 where there is none) over its label's count, or its root, scaled to a sum of 1."""
    if method not in ("inverse", "sqrt_inverse"):
        raise ValueError(f"unknown method: {method}")
    count = F.count(F.lit(1)).over(Window.partitionBy("symbol", "label")).cast("double")
    base = F.col("weight") if "weight" in events.columns else F.lit(1.0)
    out = events.withColumn("weight", base / (count if method == "inverse" else F.sqrt(count)))
    return out.withColumn("weight", _normalised(F.col("weight")))
