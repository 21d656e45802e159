"""Train, predict with and backtest an ensemble of strategies by regime."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bandit, ensemble, evaluation, labels, models, regimes, strategies
from ..operators.portfolio import Allocator
from ..sources import market
from ..sources.settings import Config
from ..sources.store import Store

#: The strategies that are trained, by name.
TRAINED: dict[str, type[strategies.Strategy]] = {"momentum": strategies.Momentum, "mean_reversion": strategies.MeanReversion, "volatility": strategies.Volatility}
LEAST_SAMPLES = 20
WINDOW_DAYS = 100
CRISES = (("2020 crash", "2020-02-01", "2020-04-30"), ("2022 bear market", "2022-01-01", "2022-10-31"), ("2023 banking crisis", "2023-03-01", "2023-05-31"))


def training_table(bars: DataFrame, config: Config | None = None, *, cusum: bool = True) -> DataFrame:
    """symbol, t0, t1, ret, label, regime, weight of the events: one lazy plan from bars to samples.

    A return at the time barrier counts whatever its size, unless the configuration
    says labeling.min_ret.
    """
    config = config or Config()
    clean, events = market.prepare(bars, cusum=cusum)
    pt, sl = config["labeling.pt_sl"]
    labelled = labels.triple_barrier(clean, events, pt=pt, sl=sl, min_ret=config.chosen("labeling.min_ret", 0.0), horizon=config["labeling.vertical_barrier_days"])
    regime = regimes.composite(detected(clean, config)).select("symbol", F.col("ts").alias("t0"), F.col("canonical_regime").alias("regime"))
    return labels.weights_by_return(labelled.join(regime, ["symbol", "t0"]))


def detected(bars: DataFrame, config: Config | None = None) -> DataFrame:
    """Regimes of bars by the configuration's periods and thresholds."""
    config = config or Config()
    return regimes.detect(bars, detectors={"trend_regime": regimes.trend(config["regime.adx_period"], config["regime.adx_threshold"]), "volume_regime": regimes.volume(config["regime.volume_window"])})


def strategy(name: str, config: Config | None = None) -> strategies.Strategy:
    """One of TRAINED by the configuration's lookbacks and thresholds."""
    config = config or Config()
    how = {"momentum": ("lookback", "momentum_lookback"), "mean_reversion": ("zscore_threshold", "mean_reversion_zscore"), "volatility": ("vol_threshold", "volatility_threshold")}
    argument, setting = how[name]
    return TRAINED[name](**{argument: config[f"strategy.{setting}"]})


def strategy_features(bars: DataFrame, name: str, config: Config | None = None) -> DataFrame:
    return strategy(name, config).feature_frame(bars)


def train(bars: DataFrame, symbol: str, store: Store | None = None, *, config: Config | None = None, least: int = LEAST_SAMPLES, cusum: bool = True, trees: int | None = None) -> dict:
    """Models for every (strategy, regime) of a symbol with enough samples: primary, and meta on where the primary is right.

    Returns regime_models, regime_metrics, total_models; saved if a store is given.
    """
    config = config or Config()
    bars = bars.filter(F.col("symbol") == symbol)
    samples = training_table(bars, config, cusum=cusum).persist()
    counts = {r["regime"]: r["count"] for r in samples.groupBy("regime").count().collect()}
    found: dict[tuple[str, str], dict] = {}
    said: dict[tuple[str, str], dict] = {}
    how = {"trees": trees} if trees else {"trees": config["model.n_estimators"], "depth": config["model.max_depth"]}
    for name in TRAINED:
        feats = strategy_features(bars, name, config)
        columns = [c for c in feats.columns if c not in ("symbol", "ts")]
        rows = samples.join(feats.withColumnRenamed("ts", "t0"), ["symbol", "t0"]).persist()
        for regime, n in sorted(counts.items()):
            if n < least:
                continue
            own = rows.filter(F.col("regime") == regime)
            primary, metrics = models.train_primary(own, columns, cv=min(config["model.cv_folds"], n // 10), weight="weight", **how)
            right = primary.predict(own).withColumn("meta_label", (F.col("prediction") * F.col("label") > 0).cast("int")).select(*own.columns, "meta_label")
            meta, meta_metrics = models.train_meta(right.drop("label").withColumnRenamed("meta_label", "label"), columns, held=config["model.test_size"], **({"trees": trees} if trees else {}))
            found[name, regime] = {"primary": primary, "meta": meta}
            said[name, regime] = {"primary": metrics, "meta": meta_metrics, "n_samples": n}
        rows.unpersist()
    samples.unpersist()
    if store is not None:
        store.save_ensemble(symbol, found, {"metrics": {f"{a}/{b}": m for (a, b), m in said.items()}})
    return {"symbol": symbol, "regime_models": found, "regime_metrics": said, "total_models": len(found)}


def predictions(bars: DataFrame, trained: Mapping[tuple[str, str], Mapping[str, models.Classifier]], config: Config | None = None) -> DataFrame:
    """symbol, ts, strategy, regime, side, probability, meta_probability of every bar, by the models of its regime.

    All dates are one batch: a transform of each model over the bars of its regime.
    """
    regime = regimes.composite(detected(bars, config)).select("symbol", "ts", F.col("canonical_regime").alias("regime"))
    out = None
    for name in sorted({k[0] for k in trained}):
        feats = strategy_features(bars, name, config).join(regime, ["symbol", "ts"])
        for (strategy, label), roles in sorted(trained.items()):
            if strategy != name:
                continue
            own = feats.filter(F.col("regime") == label)
            first = roles["primary"].predict(own)
            # the second class's probability, whatever it is; named ones are p_<class>
            p = F.coalesce(F.try_element_at("probability", F.lit(2)), F.lit(1.0))
            base = first.select(*own.columns, F.col("prediction").cast("double").alias("side"), p.alias("_p"))
            second = roles["meta"].predict(base)
            good = F.coalesce(F.col("p_1"), F.lit(0.0)) if 1 in roles["meta"].classes else F.lit(0.0)
            one = second.select("symbol", "ts", F.lit(name).alias("strategy"), "regime", "side", F.col("_p").alias("probability"), good.alias("meta_probability"))
            out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no models")
    return out


def sized(preds: DataFrame, arms: DataFrame | None = None, *, volatility: float = 0.02, n: int = 3, seed: int = 42, config: Config | None = None) -> DataFrame:
    """symbol, ts, regime, signal, confidence, position_size, active_strategies, strategy_votes, num_strategies, num_selected.

    A position may be all of the account, unless the configuration says allocation.max_position_size.
    """
    config = config or Config()
    allocator = Allocator(max_position=config.chosen("allocation.max_position_size", 1.0), kelly_fraction=config["allocation.kelly_fraction"], volatility_target=config["allocation.volatility_target"], leverage_limit=config["allocation.leverage_limit"])
    chosen = bandit.select(preds, arms, n=n, seed=seed) if arms is not None else preds
    agreed = ensemble.conflict_aware(chosen)
    votes = preds.groupBy("symbol", "ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("strategy", "side")))).alias("strategy_votes"), F.count(F.lit(1)).alias("num_strategies"))
    active = chosen.groupBy("symbol", "ts").agg(F.sort_array(F.collect_list("strategy")).alias("active_strategies"), F.count(F.lit(1)).alias("num_selected"))
    size = allocator.size(F.col("side"), F.col("meta_probability"), F.lit(volatility))
    out = agreed.join(votes, ["symbol", "ts"]).join(active, ["symbol", "ts"])
    return out.select("symbol", "ts", "regime", F.col("side").alias("signal"), F.col("meta_probability").alias("confidence"), size.alias("position_size"), "active_strategies", "strategy_votes", "num_strategies", "num_selected")


def predict(bars: DataFrame, symbol: str, store: Store, as_of: str | None = None, *, window_days: int = WINDOW_DAYS, volatility: float = 0.02, seed: int = 42, config: Config | None = None) -> dict:
    """The last bar's prediction as a dict; ValueError without models, or without any for the regime."""
    own = bars.filter(F.col("symbol") == symbol)
    if as_of is not None:
        end = datetime.fromisoformat(as_of)
        own = own.filter((F.col("ts") <= F.lit(end)) & (F.col("ts") >= F.lit(end - timedelta(days=window_days))))
    trained = store.load_ensemble(symbol)
    if not trained:
        raise ValueError(f"{symbol} isn't trained")
    last = market.latest(regimes.composite(detected(own, config))).select("ts", F.col("canonical_regime").alias("regime")).first()
    if last is None:
        raise ValueError(f"no bars of {symbol}")
    of = {k: v for k, v in trained.items() if k[1] == last["regime"]}
    if not of:
        raise ValueError(f"no models for the regime {last['regime']}")
    preds = predictions(own, of, config).filter(F.col("ts") == F.lit(last["ts"]))
    row = sized(preds, store.load_arms(symbol), volatility=volatility, seed=seed, config=config).first()
    if row is None:
        raise ValueError("no strategy predicts")
    out = row.asDict(recursive=True)
    return {k: out[k] for k in ("symbol", "regime", "signal", "position_size", "confidence", "active_strategies", "strategy_votes", "num_strategies", "num_selected")}


def strategy_returns(bars: DataFrame, signals: DataFrame, every: int = 1) -> DataFrame:
    """symbol, ts, signal, returns: signal times the return to the next sampled bar, of every k-th bar."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.select("symbol", "ts", "close").join(signals.select("symbol", "ts", "signal"), ["symbol", "ts"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    rows = rows.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") % every == 0)
    forward = F.try_divide(F.lead("close").over(w), F.col("close")) - 1.0
    return rows.withColumn("returns", F.col("signal") * forward).filter("returns is not null").select("symbol", "ts", "signal", "returns")


def summary(returns: DataFrame) -> DataFrame:
    """symbol, n, total_return, sharpe (as if bars were daily), max_drawdown (negative), win_rate."""
    curve = evaluation.equity(returns)
    sd = F.stddev_pop("returns")
    return curve.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), (F.product(1.0 + F.col("returns")) - 1.0).alias("total_return"), F.when(sd > 0, F.avg("returns") / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col("returns") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def _between(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))


def backtest(bars: DataFrame, signals: DataFrame, mode: str = "standard", *, crises: Sequence[tuple[str, str, str]] = CRISES, windows: int = 4, simulations: int = 100, draws: int = 30, seed: int = 42) -> DataFrame:
    """standard (every 5th bar), walk_forward (of 4 windows the last 3, every 10th), crisis (dated spans, every 2nd), monte_carlo (sums of drawn returns); "all" gives them with a column mode."""
    if mode == "standard":
        return summary(strategy_returns(bars, signals, 5))
    if mode == "walk_forward":
        w = Window.partitionBy("symbol").orderBy("ts")
        part = bars.withColumn("_w", F.ntile(windows).over(w)).filter("_w > 1")
        keyed = part.select(F.concat_ws("/", "symbol", "_w").alias("symbol"), "ts", "close", F.col("symbol").alias("_s"))
        own = keyed.join(signals.select(F.col("symbol").alias("_s"), "ts", "signal"), ["_s", "ts"], "left").select("symbol", "ts", F.coalesce("signal", F.lit(0.0)).alias("signal"))
        return summary(strategy_returns(keyed.drop("_s"), own, 10))
    if mode == "crisis":
        out = None
        for name, start, end in crises:
            one = summary(strategy_returns(_between(bars, start, end), signals, 2)).withColumn("symbol", F.concat_ws("/", "symbol", F.lit(name)))
            out = one if out is None else out.union(one)
        return out
    if mode == "monte_carlo":
        base = strategy_returns(bars, signals, 5)
        w = Window.partitionBy("symbol").orderBy("ts")
        numbered = base.withColumn("_at", F.row_number().over(w))
        sizes = base.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
        picks = sizes.select("symbol", "_n", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("sim")).select("symbol", "_n", "sim", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(draws)))).alias("k"))
        picks = picks.withColumn("_at", (F.pmod(F.xxhash64(F.lit(seed), "symbol", "sim", "k"), F.col("_n")) + 1).cast("int"))
        sums = picks.join(numbered.select("symbol", "_at", "returns"), ["symbol", "_at"]).groupBy("symbol", "sim").agg(F.sum("returns").alias("r"))
        return sums.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_return"), F.stddev_pop("r").alias("std_return"), F.percentile("r", 0.05).alias("percentile_5"), F.percentile("r", 0.95).alias("percentile_95"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("probability_profit"))
    if mode == "all":
        out = None
        for m in ("standard", "walk_forward", "crisis", "monte_carlo"):
            one = backtest(bars, signals, m, crises=crises, windows=windows, simulations=simulations, draws=draws, seed=seed).withColumn("mode", F.lit(m))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out
    raise ValueError(f"unknown mode: {mode}")


def report(results: DataFrame) -> str:
    """Text of backtest()'s rows, a line each."""
    lines = []
    for r in results.orderBy(*results.columns[:1]).collect():
        d = {k: v for k, v in r.asDict().items() if v is not None}
        head = " ".join(str(d.pop(k)) for k in ("mode", "symbol") if k in d)
        lines.append(f"{head}: " + ", ".join(f"{k} {v:.4f}" if isinstance(v, float) else f"{k} {v}" for k, v in d.items()))
    return "\n".join(lines)
