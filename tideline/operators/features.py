"""Feature matrices: the 19-column one, the extended one, filling, scaling, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.series import EPS, absolute, log, lag, mean, pct, project, std, whole
from . import sequential as seq

STATIONARY = ("frac_diff_price",)
VOLATILITY = ("vol_parkinson", "vol_garman_klass", "vol_rogers_satchell", "vol_yang_zhang", "vol_ewma", "vol_realized")
MICRO = ("ofi_20", "vpin", "kyle_lambda")
TECHNICAL = ("rsi_14", "macd", "bb_position", "atr_14", "adx_14", "momentum_20", "volume_ratio", "price_sma_ratio_20", "stoch_k")
#: Quantiles of a whole frame are off by a share of 1 / ACCURACY of the rows; a task's summary stays bounded by it.
ACCURACY = 1_000_000
MATRIX = STATIONARY + VOLATILITY + MICRO + TECHNICAL


def feature_matrix(
    bars: DataFrame, events: DataFrame | None = None, *, microstructure: bool = True, technical: bool = True, volatility: bool = True, d: float = 0.4, threshold: float = 1e-5, vpin_mode: str = "reference", fill: str | None = "ffill_bfill",
) -> DataFrame:
    """symbol, ts and the columns of MATRIX, at the events (symbol, t0) if given, else at all bars.

    One window pass, then one sequential pass for fractional differences, VPIN and
    exponential means.  fill is "ffill_bfill" (which looks ahead at the head), "ffill"
    or None; rows of which every feature is missing are dropped.  Events that meet
    no row raise ValueError.
    """
    windows = {"_r": pct(I.CLOSE)}
    if volatility:
        windows |= {"vol_parkinson": I.parkinson(), "vol_garman_klass": I.garman_klass(), "vol_rogers_satchell": I.rogers_satchell(), "vol_yang_zhang": I.yang_zhang(), "vol_realized": I.realized()}
    if microstructure:
        windows |= {"ofi_20": I.ofi(20), "kyle_lambda": I.kyle_lambda(20), "_tick": I.tick_rule(), "_size": whole(F.sum, I.VOLUME) / 50.0}
    if technical:
        windows |= {"rsi_14": I.rsi(), "bb_position": I.bb_position(), "atr_14": I.atr(), "adx_14": I.adx()["adx"], "momentum_20": pct(I.CLOSE, 20), "volume_ratio": I.VOLUME / mean(I.VOLUME, 20), "price_sma_ratio_20": I.CLOSE / mean(I.CLOSE, 20), "stoch_k": I.stoch_raw()}
    folds: dict[str, seq.Fold] = {"frac_diff_price": seq.FracDiff("close", seq.frac_diff_weights(d, threshold))}
    if volatility:
        folds["vol_ewma"] = seq.EwmStd("_r", 20)
    if microstructure:
        folds["vpin"] = seq.Vpin("_tick", "volume", "_size", 20, vpin_mode)
    if technical:
        folds |= {"_fast": seq.EwmMean("close", 12), "_slow": seq.EwmMean("close", 26)}
    out = seq.with_folds(project(bars, windows), folds)
    if volatility:
        out = out.withColumn("vol_ewma", F.col("vol_ewma") * F.sqrt(F.lit(252.0)))
    if technical:
        out = out.withColumn("macd", F.col("_fast") - F.col("_slow"))
    names = [c for c in MATRIX if c in out.columns]
    out = out.select("symbol", "ts", *names)
    if fill:
        # a filter that names every filled column makes 2 ** len(names) constraints in the planner once something is joined
        out = seq.forward_filled(out.withColumn("_any", F.coalesce(*names)), [*names, "_any"], backward=fill == "ffill_bfill")
        out = out.filter("_any is not null").select("symbol", "ts", *names)
    else:
        out = out.na.drop("all", subset=names)
    if events is None:
        return out
    at = events.select("symbol", F.col("t0").alias("ts")).distinct()
    kept = out.join(at, ["symbol", "ts"], "left_semi")
    if kept.isEmpty() and not at.isEmpty():
        a, b = out.agg(F.min("ts"), F.max("ts")).first(), at.agg(F.min("ts"), F.max("ts")).first()
        raise ValueError(f"no event meets a row of features: features {a[0]} to {a[1]}, events {b[0]} to {b[1]}")
    return kept


def extended_features(bars: DataFrame, windows: Sequence[int] = (5, 10, 20, 50)) -> DataFrame:
    """symbol, ts and the extended set, unfilled: one window pass, then one pass of folds."""
    windows, base = tuple(windows), [c for c in bars.columns if c not in ("symbol", "ts")]
    r = pct(I.CLOSE)
    wide = {"log_returns": log(I.CLOSE / lag(I.CLOSE)), "hl_range": (I.HIGH - I.LOW) / I.CLOSE, "oc_range": absolute(I.CLOSE - I.OPEN) / I.OPEN}
    for w in windows:
        wide |= {f"returns_{w}": pct(I.CLOSE, w), f"volatility_{w}": std(r, w)}
    for prefix, part in (("vol", I.volatility_features()), ("micro", I.micro_features((10, 20))), ("tech", I.technical(windows))):
        wide |= {f"{prefix}_{k}": v for k, v in part.items()}
    inner = {"_r": r, "_tick": I.tick_rule(), "_size": whole(F.sum, I.VOLUME) / 50.0}
    folds = {"_fd4": seq.FracDiff("close", seq.frac_diff_weights(0.4)), "_fd6": seq.FracDiff("close", seq.frac_diff_weights(0.6)), "vol_ewma": seq.EwmStd("_r", 20), "micro_vpin": seq.Vpin("_tick", "volume", "_size")}
    out = seq.with_folds(project(bars, wide | inner), folds | seq.technical_folds(windows, "tech_"))
    out = seq.technical_folded(out.withColumn("vol_ewma", F.col("vol_ewma") * F.sqrt(F.lit(252.0))), windows, "tech_")
    return out.drop(*base, *inner).withColumnsRenamed({"_fd4": "frac_diff_0.4", "_fd6": "frac_diff_0.6"})


def normalise(features: DataFrame, method: str = "zscore", columns: Sequence[str] | None = None, *, by: str | None = "symbol") -> DataFrame:
    """Columns scaled over each symbol's rows, or, if ``by`` is None, over the whole frame: zscore, minmax or robust (median and quartiles).

    Medians and quartiles are exact within groups, and those of the whole frame
    within a millionth of the rows of their rank.
    """
    names = list(columns or [c for c, t in features.dtypes if t == "double"])
    if method not in ("zscore", "minmax", "robust"):
        raise ValueError(f"unknown method: {method}")
    if by is None:
        return _normalised_whole(features, method, names)
    w = Window.partitionBy(by)
    if method == "zscore":
        return features.withColumns({c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + EPS) for c in names})
    if method == "minmax":
        return features.withColumns({c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + EPS) for c in names})
    stats = features.groupBy(by).agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in names))
    joined = features.join(stats, by)
    q = lambda c, i: F.col(f"_q_{c}")[i]
    return joined.select(*((((F.col(c) - q(c, 1)) / (q(c, 2) - q(c, 0) + EPS)).alias(c)) if c in names else F.col(c) for c in features.columns))


def _normalised_whole(features: DataFrame, method: str, names: list[str]) -> DataFrame:
    """By one row of statistics, which partial aggregates make, and a projection without any exchange."""
    three = {"zscore": lambda c: (F.avg(c), F.avg(c), F.stddev_samp(c)), "minmax": lambda c: (F.min(c), F.min(c), F.max(c)), "robust": lambda c: tuple(F.approx_percentile(c, p, ACCURACY) for p in (0.5, 0.25, 0.75))}[method]
    row = features.agg(*(x.alias(f"{c}_{i}") for c in names for i, x in enumerate(three(c)))).first()
    lit = lambda x: F.lit(x).cast("double")
    out = {}
    for c in names:
        middle, low, high = (row[f"{c}_{i}"] for i in range(3))
        spread = lit(high) if method == "zscore" else lit(high) - lit(low)
        out[c] = (F.col(c) - lit(middle)) / (spread + EPS)
    return features.withColumns(out)


def feature_scores(features: DataFrame, label: str, columns: Sequence[str], method: str = "f_classif", bins: int = 10, seed: int = 42) -> DataFrame:
    """feature, score: ANOVA F, mutual information over quantile bins, or a forest's importances."""
    if method == "importance":
        from .models import Classifier

        model = Classifier(list(columns), label=label, seed=seed).fit(features)
        return features.sparkSession.createDataFrame(sorted(model.importances().items()), "feature string, score double")
    long = features.select(F.col(label).alias("label"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns))).alias("_x")).select("label", "_x.feature", "_x.x").filter("x is not null and label is not null")
    if method == "f_classif":
        groups = long.groupBy("feature", "label").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
        sums = groups.groupBy("feature").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("M"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"))
        between = F.col("mm") - F.col("N") * F.col("M") * F.col("M")
        return sums.select("feature", F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k"))).alias("score"))
    if method == "mutual_info":
        # bounds of each feature's bins in one row; a value's bin is the number of bounds below it
        bounds = long.groupBy("feature").agg(F.approx_percentile("x", [k / bins for k in range(1, bins)], ACCURACY).alias("_b"))
        binned = long.join(F.broadcast(bounds), "feature").withColumn("bin", F.size(F.filter("_b", lambda b: b < F.col("x"))))  # a row a feature
        joint = binned.groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).alias("n"))
        joint = joint.withColumns({"b": F.sum("n").over(Window.partitionBy("feature", "bin")), "l": F.sum("n").over(Window.partitionBy("feature", "label")), "_total": F.sum("n").over(Window.partitionBy("feature"))})
        return joint.groupBy("feature").agg(F.sum(F.col("n") / F.col("_total") * F.log(F.col("n") * F.col("_total") / (F.col("b") * F.col("l")))).alias("score"))
    raise ValueError(f"unknown method: {method}")


def select_features(features: DataFrame, label: str, columns: Sequence[str], n: int = 19, method: str = "f_classif", **how) -> list[str]:
    """Names of the n features of the highest scores."""
    top = feature_scores(features, label, columns, method, **how).orderBy(F.desc_nulls_last("score"), "feature").limit(n)
    return [r["feature"] for r in top.collect()]
