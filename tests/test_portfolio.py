import math

import numpy as np
import pytest
from fixtures import frame, walk
from pyspark.sql import functions as F

from tideline.operators import bandit, ensemble, evaluation, labels
from tideline.operators.portfolio import Allocator, Execution, Risk
from tideline.operators.sequential import Portfolio
from tideline.operators.strategies import MeanReversion

P = "symbol string, ts int, strategy string, side double, probability double, meta_probability double, regime string"


def size(spark, signal, confidence, vol, allocator=Allocator()):
    return spark.range(1).select(allocator.size(F.lit(float(signal)), F.lit(float(confidence)), F.lit(float(vol)))).first()[0]


def test_conflict_halves_confidence(spark):
    agree = spark.createDataFrame([("A", 1, "x", 1.0, 0.6, 0.6, "r"), ("A", 1, "y", 1.0, 0.6, 0.6, "r")], P)
    apart = spark.createDataFrame([("A", 1, "x", 1.0, 0.7, 0.7, "r"), ("A", 1, "y", -1.0, 0.7, 0.7, "r")], P)
    assert ensemble.conflict_aware(agree).first().meta_probability == pytest.approx(0.6)
    got = ensemble.conflict_aware(apart).first()
    assert got.meta_probability == pytest.approx(0.35) and got.side == 0
    with pytest.raises(ValueError):
        ensemble.aggregate(agree, "nothing")


def test_sizes(spark):
    assert size(spark, 0, 1, 0.2) == 0
    assert size(spark, 1, 0.05, 0.2) == pytest.approx(0.05) and size(spark, 1, 0.9, 0.2) == pytest.approx(0.1)
    assert size(spark, -1, 0.9, 0.2) == pytest.approx(-0.1) and size(spark, 1, 1, 0) == 0
    assert size(spark, 1, 0.4, 3.0, Allocator(max_position=1.0)) == pytest.approx(0.05)


def test_turnover_leaves_held_assets_alone(spark):
    a = Allocator(max_position=1.0)
    target = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.5)], "ts int, asset string, allocation double")
    held = spark.createDataFrame([(1, "z", 1.0)], "ts int, asset string, position double")
    got = {r.asset: r.allocation for r in a.limited(target, held).collect()}
    assert got == {"x": pytest.approx(0.125), "y": pytest.approx(0.125)}


def test_trades_and_stats(spark):
    orders = spark.createDataFrame([(1, "A", 1.0, 100.0, 10000.0, 0.1), (2, "A", 0.001, 100.0, 10000.0, 0.1)], "ts int, symbol string, signal double, price double, portfolio_value double, position_size double")
    t = Execution().trades(orders)
    row = t.first()
    assert t.count() == 1 and row.quantity == 10 and row.price == pytest.approx(100.05) and row.commission == 1.0
    assert Execution.stats(t).first().num_trades == 1 and Execution.stats(t.limit(0)).first().total_cost is None


def test_drawdown_breach_stays(spark):
    v = spark.createDataFrame([("A", i, x) for i, x in enumerate([100.0, 120.0, 90.0, 121.0])], "symbol string, ts int, value double")
    assert [r.breached for r in Risk().drawdown(v).orderBy("ts").collect()] == [False, False, True, True]
    e = spark.range(1).select(Risk().exits(F.lit(100.0), F.lit(95.0), F.lit("long")), Risk().exits(F.lit(100.0), F.lit(90.0), F.lit("short")), Risk().exits(F.lit(100.0), F.lit(101.0), F.lit("long"))).first()
    assert tuple(e) == ("stop_loss", "take_profit", None)


def test_replay_equals_a_loop(spark):
    outcomes = [("a", "r", 1.0, 1), ("b", "r", 0.0, 2), ("a", "r", 0.25, 3), ("a", "q", 1.0, 4)]
    arms: dict = {}
    for s, g, reward, _ in outcomes:
        arm = arms.setdefault((s, g), [1.0, 1.0])
        arm[0] += reward
        arm[1] += 1 - reward
        for (_, h), other in arms.items():
            if h == g:
                other[:] = [1 + (x - 1) * 0.995 for x in other]
    got = bandit.replay(spark.createDataFrame(outcomes, "strategy string, regime string, reward double, ts int")).collect()
    assert {(r.strategy, r.regime): (round(r.alpha, 12), round(r.beta, 12)) for r in got} == {k: (round(a, 12), round(b, 12)) for k, (a, b) in arms.items()}


def test_replay_orders_symbols_of_one_time(spark):
    rows = [("A", "m", "r", 1.0, 1), ("A", "n", "r", 0.0, 1), ("B", "m", "r", 0.25, 1), ("B", "n", "r", 0.5, 1)]
    alpha = {"m": 1 + 0.995**4 + 0.25 * 0.995**2, "n": 1 + 0.5 * 0.995}
    for one in (rows, rows[::-1]):
        got = bandit.replay(spark.createDataFrame(one, "symbol string, strategy string, regime string, reward double, ts int").coalesce(1)).collect()
        assert {r.strategy: round(r.alpha, 12) for r in got} == {k: round(v, 12) for k, v in alpha.items()}


def test_bandit_prefers_the_better_arm(spark):
    arms = spark.createDataFrame([("a", "r", 90.0, 10.0, 100, 90.0), ("b", "r", 10.0, 90.0, 100, 10.0)], bandit.ARMS)
    best = {r.strategy: r.probability for r in bandit.best_probability(arms, 200).collect()}
    assert best["a"] > 0.99 and best["a"] + best["b"] == pytest.approx(1)
    assert bandit.with_draws(arms, 3).collect() == bandit.with_draws(arms, 3).collect()
    flat = spark.createDataFrame([("a", 5.0, 5.0, 0, 0.0), ("b", 2.0, 2.0, 9, 0.9)], "name string, alpha double, beta double, total_trials int, avg_reward double")
    assert bandit.choose_arm(flat, "ucb").first().name == "a" and bandit.choose_arm(flat, "epsilon_greedy", epsilon=0.0).first().name == "b"
    with pytest.raises(ValueError):
        bandit.choose_arm(flat, "nothing")


def test_metrics_equal_pandas(spark):
    p = walk("A", 150, 3)
    r = p.close.pct_change().dropna()
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(r)], "symbol string, ts int, returns double")
    m = evaluation.metrics(df).first()
    curve = (1 + r).cumprod()
    assert m.sharpe_ratio == pytest.approx(r.mean() / r.std() * math.sqrt(252)) and m.max_drawdown == pytest.approx(-(curve / curve.cummax() - 1).min())
    assert m.skewness == pytest.approx(r.skew()) and m.kurtosis == pytest.approx(r.kurtosis()) and m.total_return == pytest.approx(curve.iloc[-1] - 1)
    one = evaluation.metrics(df.limit(1)).first()
    assert one.sharpe_ratio == 0 and one.avg_return is None


def test_backtest_never_closes_on_zero(spark):
    p = walk("A", 60, 4)
    df = frame(spark, p)
    signals = df.select("symbol", "ts", F.when(F.col("ts") == F.lit(p.ts[5].to_pydatetime()), 1).otherwise(0).alias("signal"))
    run = evaluation.run_backtest(signals, df).orderBy("ts").collect()
    assert [r.position for r in run[:5]] == [0] * 5 and {round(r.position, 9) for r in run[5:]} == {0.1}
    value = 100_000.0
    for i, r in enumerate(run):
        value = value * (1 - r.position) + r.position * value * p.close[i] / p.close[0]
    assert run[-1].value == pytest.approx(value)
    assert evaluation.backtest_trades(evaluation.run_backtest(signals, df)).count() == 1
    assert evaluation.simple_backtest(MeanReversion().signals(df), df).count() == 1
    mc = evaluation.monte_carlo(MeanReversion().signals(df), df, 10).first()
    assert mc.percentile_5 <= mc.median_final_value <= mc.percentile_95


def _shuffled(spark):
    """Rows that the session's stages have written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_monte_carlo_is_the_fold_of_each_simulation_and_makes_no_row_for_its_bars(spark):
    rows = [(s, t, [1.0, -1.0, 0.0, None, 0.004, 0.5][(7 * t + k) % 6], None if t % 17 == 3 else 50.0 + k + t % 13) for k, s in enumerate("AB") for t in range(300)]
    rows += [("C", t, 1.0, 0.0 if t == 0 else 5.0) for t in range(3)]  # a first price of 0 moves nothing
    df = spark.createDataFrame(rows, "symbol string, ts int, signal double, close double")
    n, capital, fold = 600, 1000.0, Portfolio("signal", "close", 1000.0)
    before = _shuffled(spark)
    got = {r.symbol: r for r in evaluation.monte_carlo(df.drop("close"), df.drop("signal"), n, capital).collect()}
    assert _shuffled(spark) - before < 20 * len(rows)
    ids = spark.range(1, n + 1).select(F.col("id").cast("int").alias("sim")).crossJoin(spark.range(1, 301).select(F.col("id").cast("int").alias("at")))
    for symbol in "ABC":
        own = [r for r in rows if r[0] == symbol]
        picks = np.zeros((n, len(own)), int)
        for r in ids.filter(F.col("at") <= len(own)).select("sim", "at", F.pmod(F.xxhash64(F.lit(42), F.lit(symbol), "sim", "at"), F.lit(len(own))).alias("p")).collect():
            picks[r.sim - 1, r.at - 1] = r.p
        last = [fold.step(fold.state(), [own[p][2] for p in line], [r[3] for r in own])[-1]["value"] for line in picks]
        r = got[symbol]
        assert (r.mean_final_value, r.median_final_value, r.std_final_value) == pytest.approx((np.mean(last), np.median(last), np.std(last)), rel=1e-12, abs=1e-9)
        assert (r.percentile_5, r.percentile_95) == pytest.approx(tuple(np.percentile(last, (5, 95))), rel=1e-12)
        assert r.probability_profit == pytest.approx(np.mean(np.array(last) > capital))
    with pytest.raises(ValueError):
        evaluation.monte_carlo(df.drop("close"), df.drop("signal"), 0)


def test_as_of(spark):
    prices = spark.createDataFrame([("A", 1, 10.0), ("A", 5, 20.0)], "symbol string, ts int, close double")
    times = spark.createDataFrame([("A", 0), ("A", 1), ("A", 4), ("A", 9), ("B", 3)], "symbol string, ts int")
    assert {(r.symbol, r.ts): r.close for r in evaluation.as_of(times, prices).collect()} == {("A", 0): None, ("A", 1): 10.0, ("A", 4): 10.0, ("A", 9): 20.0, ("B", 3): None}


def test_missing_signals_and_allocations_are_no_positions(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, None, None), (1, "b", None, 0.5, 0.2), (1, "c", -1.0, 0.5, -0.4)], "ts int, asset string, signal double, confidence double, allocation double")
    size = {r.asset: r.s for r in rows.select("asset", Allocator().size(F.col("signal"), F.col("confidence"), F.lit(0.5)).alias("s")).collect()}
    assert size == {"a": None, "b": None, "c": -0.1}
    got = {r.asset: r.allocation for r in Allocator().limited(rows).collect()}
    assert got == {"a": None, "b": 0.1, "c": -0.1}


def test_weights_of_missing_returns_are_missing(spark):
    rows = spark.createDataFrame([("A", 1, 0.5), ("A", 2, None), ("A", 3, 1.5)], "symbol string, t0 int, ret double")
    got = {r.t0: r.weight for r in labels.weights_by_return(rows, clip=(0.3, 0.9)).collect()}
    assert got[2] is None and abs(got[1] + got[3] - 1) < 1e-12
