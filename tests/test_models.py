import os

import numpy as np
import pandas as pd
import pytest
from fixtures import frame, walk
from pyspark.sql import functions as F

from tideline.operators import features, models, statistics
from tideline.plans import cli, ensemble
from tideline.sources.settings import DEFAULTS, Config
from tideline.sources.store import Store, plain


def events(spark, n=103, spans=5):
    rows = [("A", i, i + spans) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, t0 int, t1 int")


def test_folds_are_contiguous_and_purged(spark):
    e = events(spark)
    folds = [r.fold for r in models.with_fold(e).orderBy("t0").collect()]
    assert [folds.count(k) for k in range(5)] == [21, 21, 21, 20, 20] and folds == sorted(folds)
    splits = models.purged_splits(e).toPandas()
    for k in range(5):
        own = splits[splits.fold == k]
        test, train = set(own[own.role == "test"].t0), set(own[own.role == "train"].t0)
        lo, hi = min(test), max(test)
        assert not test & train
        assert train == {i for i in range(103) if i + 5 < lo or i > hi + 1}


def table(spark, n=240, classes=(-1, 0, 1), seed=3):
    draw = np.random.default_rng(seed)
    y = draw.choice(classes, n)
    x = y + draw.normal(0, 0.3, n)
    rows = [("A", i, i + 1, float(a) if i % 17 else None, float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, draw.normal(size=n), y))]
    return spark.createDataFrame(rows, "symbol string, t0 int, t1 int, x double, noise double, label int")


@pytest.mark.parametrize("kind", ["rf", "gb"])
def test_classifiers_learn_three_classes(spark, kind):
    rows = table(spark)
    model = models.Classifier(["x", "noise"], kind=kind, trees=8, depth=3, least=5).fit(rows)
    out = model.predict(rows)
    assert model.classes == [-1, 0, 1] and models.scores(out)["accuracy"] > 0.75
    assert out.select(F.round(F.expr("`p_-1` + p_0 + p_1"), 6)).distinct().collect()[0][0] == 1.0
    if kind == "rf":
        assert next(iter(model.importances())) == "x"


def test_one_class_is_predicted_as_it_is(spark):
    rows = table(spark, 30, (1,))
    model = models.Classifier(["x", "noise"]).fit(rows)
    assert {r.prediction for r in model.predict(rows).collect()} == {1}


def test_cross_validation_and_selection(spark):
    rows = table(spark, 150)
    found = models.cross_validate(rows, lambda: models.Classifier(["x", "noise"], trees=5, depth=3, least=5), n_splits=3)
    assert len(found["scores"]) == 3 and 0.5 < found["mean"] <= 1
    assert features.select_features(rows, "label", ["x", "noise"], 1) == ["x"]
    assert features.select_features(rows, "label", ["x", "noise"], 1, "mutual_info") == ["x"]
    with pytest.raises(ValueError):
        features.feature_scores(rows, "label", ["x"], "nothing")


def test_store_round_trip(spark, tmp_path):
    rows, store = table(spark, 80), Store(spark, str(tmp_path))
    model = models.Classifier(["x", "noise"], trees=4, depth=2, least=5).fit(rows)
    store.save(model, "m", metrics={"a": np.float64(1), "b": [np.int64(2)], "c": float("inf")})
    again = store.load("m")
    assert store.names() == ["m"] and store.info("m")["metrics"] == {"a": 1.0, "b": [2], "c": "inf"}
    assert again.predict(rows).select("prediction").collect() == model.predict(rows).select("prediction").collect()
    with pytest.raises(FileNotFoundError):
        store.metadata("none")
    assert store.load_ensemble("X") is None and store.delete("m") and not store.exists("m")


def test_config(tmp_path):
    path = os.path.join(tmp_path, "c.yaml")
    with open(path, "w") as f:
        f.write("strategy:\n  mean_reversion_zscore: 3.0\n  pairs_window: 40\nrisk:\n  stop_loss: 0.07\nlabeling: {pt_sl: [2.0, 1.0]}\n")
    c = Config.load(path)
    assert (c["strategy.mean_reversion_zscore"], c["labeling.pt_sl"], c["model.cv_folds"], c.get("risk.stop_loss"), c.get("a.b", 7)) == (3.0, [2.0, 1.0], 5, 0.07, 7)
    assert c.unread() == ["risk.stop_loss", "strategy.pairs_window"] and c.chosen("labeling.min_ret", 0.0) == 0.0
    c.update({"labeling": {"min_ret": 0.02}})
    c["labeling.pt_sl"].append(9)
    c.save(path)
    again = Config.load(path)
    assert again["labeling.min_ret"] == again.chosen("labeling.min_ret", 0.0) == 0.02 and again.get("strategy.pairs_window") == 40 and set(DEFAULTS) <= set(again.said)
    assert DEFAULTS["labeling.pt_sl"] == [1.0, 1.0]
    with pytest.raises(KeyError):
        c["no.such"]
    assert plain({"x": pd.Series([1, 2])}) == {"x": [1, 2]}


def test_settings_reach_the_plans(spark):
    bars = frame(spark, walk("QQ", 120, 9)).cache()
    plain_, tight = Config(), Config({"labeling": {"min_ret": 10.0, "vertical_barrier_days": 1, "pt_sl": [50.0, 50.0]}})
    assert {r.label for r in ensemble.training_table(bars, tight, cusum=False).filter("t0 > '2022-01-10'").collect()} == {0}
    assert 0 not in {r.label for r in ensemble.training_table(bars, plain_, cusum=False).collect()}
    assert ensemble.strategy("momentum", Config({"strategy": {"momentum_lookback": 7}})).lookback == 7
    always = ensemble.detected(bars, Config({"regime": {"adx_threshold": -1.0}})).filter("trend_regime = 'trending'").count()
    assert always > ensemble.detected(bars).filter("trend_regime = 'trending'").count()
    preds = spark.createDataFrame([("QQ", "2022-01-03", "momentum", "TREND", 1.0, 0.9, 0.9)], "symbol string, ts string, strategy string, regime string, side double, probability double, meta_probability double")
    size = lambda c: ensemble.sized(preds, config=c).first().position_size
    assert size(Config({"allocation": {"max_position_size": 0.05}})) == 0.05 and size(None) > 0.05


def test_arms_and_rewards_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    outcomes = spark.createDataFrame([("momentum", "TREND", 1.0, 1), ("momentum", "TREND", 0.5, 2), ("volatility", "TREND", 0.0, 3)], "strategy string, regime string, reward double, ts long")
    assert store.load_arms("A") is None and store.rewards("A") is None
    first = {r.strategy: r for r in store.update_arms("A", outcomes).collect()}
    assert first["momentum"].pulls == 2 and first["momentum"].total_reward == 1.5
    for _ in range(2):
        last = store.update_arms("A", outcomes)
    assert {r.strategy: r.pulls for r in last.collect()} == {"momentum": 6, "volatility": 3}
    assert store.rewards("A").groupBy("update").count().count() == 3 and store.rewards("A").count() == 9
    store.save_arms("B", last)
    assert store.load_arms("B").count() == 2


def test_ensembles_can_be_deleted(spark, tmp_path):
    store, model = Store(spark, str(tmp_path)), models.Classifier(["x"], trees=1)
    rows = spark.createDataFrame([("A", i, float(i % 2), i % 2) for i in range(20)], "symbol string, t0 long, x double, label int")
    store.save_ensemble("A", {("momentum", "TREND"): {"primary": model.fit(rows)}})
    assert store.trained_symbols() == ["A"] and set(store.load_ensemble("A")) == {("momentum", "TREND")}
    assert store.delete_ensemble("A") and store.trained_symbols() == [] and store.load_ensemble("A") is None


def test_train_predict_backtest(spark, tmp_path):
    bars, store = frame(spark, walk("QQ", 260, 9)).cache(), Store(spark, str(tmp_path))
    config = Config({"model": {"cv_folds": 1}})
    out = ensemble.train(bars, "QQ", store, config=config, trees=2, cusum=False, least=90)
    assert out["total_models"] > 0 and all(len(k) == 2 and set(v) == {"primary", "meta"} for k, v in out["regime_models"].items())
    assert store.trained_symbols() == ["QQ"]
    preds = ensemble.predictions(bars, out["regime_models"])
    sized = ensemble.sized(preds)
    row = sized.first()
    assert set(row.active_strategies) <= set(row.strategy_votes) and row.num_strategies == len(row.strategy_votes)
    results = ensemble.backtest(bars, sized.select("symbol", "ts", "signal"), "all", crises=(("spring", "2022-03-01", "2022-05-31"),), simulations=5)
    assert {r["mode"] for r in results.collect()} == {"standard", "walk_forward", "crisis", "monte_carlo"} and "standard QQ" in ensemble.report(results)
    last = bars.agg(F.max("ts")).first()[0]
    try:
        said = ensemble.predict(bars, "QQ", store, str(last))
        assert set(said) == {"symbol", "regime", "signal", "position_size", "confidence", "active_strategies", "strategy_votes", "num_strategies", "num_selected"}
    except ValueError as e:
        assert "no models for the regime" in str(e)
    with pytest.raises(ValueError):
        ensemble.predict(bars, "ZZ", store)
    bars.write.parquet(str(tmp_path / "bars"))
    assert cli.main(["--home", str(tmp_path), "info"], spark) == 0
    assert cli.main(["--home", str(tmp_path), "--bars", str(tmp_path / "bars"), "backtest", "QQ"], spark) == 0
    assert cli.main(["--home", str(tmp_path), "predict", "QQ"], spark) == 2


def test_adf_tells_noise_from_a_walk(spark):
    draw = np.random.default_rng(5)
    noise = draw.normal(size=300)
    t, p, *_ = statistics.adf(noise)
    assert p < 0.01 and t < -5
    assert statistics.adf(np.cumsum(noise))[1] > 0.05
    assert statistics.adf(np.ones(50)) is None
    assert len(statistics.garch(noise)) == 300


def test_feature_matrix(spark):
    df = frame(spark, walk("A", 200), walk("B", 150, 2))
    out = features.feature_matrix(df, d=0.9, threshold=1e-3)
    assert out.columns == ["symbol", "ts", *features.MATRIX] and out.na.drop().count() == 350
    with pytest.raises(ValueError):
        features.feature_matrix(df, spark.createDataFrame([("A", None)], "symbol string, t0 timestamp_ntz"))
    assert features.extended_features(df).count() == 350


@pytest.mark.parametrize("fill", ["ffill_bfill", "ffill"])
def test_feature_matrix_is_planned_without_a_constraint_for_each_set_of_columns(spark, fill):
    out = features.feature_matrix(frame(spark, walk("A", 60)), d=0.9, threshold=1e-3, fill=fill)
    assert out._jdf.queryExecution().optimizedPlan().validConstraints().size() < 1000
