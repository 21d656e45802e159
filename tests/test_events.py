import numpy as np
import pandas as pd
import pytest
from fixtures import frame, walk
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.operators import labels
from tideline.operators import sequential as seq
from tideline.sources import market


def rows(df, *names, by="ts"):
    return [tuple(r) for r in df.orderBy("symbol", by).select(*names).collect()]


def ticks(spark, prices, volumes, symbol="A"):
    ts = pd.date_range("2022-01-01", periods=len(prices), freq="min")
    return spark.createDataFrame([(symbol, t.to_pydatetime(), float(p), float(v)) for t, p, v in zip(ts, prices, volumes)], "symbol string, ts timestamp_ntz, price double, volume double")


def cusum(prices, h):
    up = down = 0.0
    out = []
    for i in range(1, len(prices)):
        r = prices[i] / prices[i - 1] - 1
        up, down = max(0, up + r), min(0, down + r)
        if up > h or down < -h:
            out.append((i, 1 if up > h else -1))
            up = down = 0.0
    return out


def test_cusum_equals_a_loop(spark):
    a, b = walk("A", 300, 5), walk("B", 250, 6)
    got = seq.cusum_events(frame(spark, a, b), 0.05).toPandas()
    for pdf in (a, b):
        own = got[got.symbol == pdf.symbol[0]].sort_values("t0")
        assert [(t, s) for t, s in zip(own.t0, own.side)] == [(pdf.ts[i], s) for i, s in cusum(pdf.close.to_numpy(), 0.05)]


def test_threshold_is_strict_and_sums_restart():
    fold = seq.Cusum("r", 0.5)
    state = fold.state()
    assert fold.step(state, [0.25, 0.25, 0.25, 0.5, -0.25, -0.75]) == [None, None, 0.75, None, None, -1.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(1, 100), st.integers(0, 50)), min_size=1, max_size=80), st.integers(1, 200), st.sampled_from(["dollar", "volume", "volatility", "imbalance"]))
def test_bar_numbers_only_grow_by_one_and_volume_is_kept(rows_, threshold, kind):
    fold = seq.BarIds(kind, threshold, "p", "v")
    state = fold.state()
    ids = fold.step(state, [p for p, _ in rows_], [float(v) for _, v in rows_])
    assert all(0 <= b - a <= 1 for a, b in zip(ids, ids[1:])) and ids[0] == 0
    if kind == "volume":
        for k in range(state["bar"]):
            own = [v for (_, v), i in zip(rows_, ids) if i == k]
            assert sum(own) >= threshold > sum(own[:-1])


def test_bars_close_at_equality_and_drop_the_tail(spark):
    t = ticks(spark, [1, 1, 1, 1, 1], [5, 5, 25, 3, 3])
    out = seq.bars(t, "volume", 10, price="price")
    assert rows(out, "bar_id", "volume", "close") == [(0, 10.0, 1.0), (1, 25.0, 1.0)]


def test_unknown_bars(spark):
    with pytest.raises(ValueError):
        seq.BarIds("tick", 1, "p", "v")
    with pytest.raises(ValueError):
        seq.bar_threshold(frame(spark, walk()), "imbalance")


def test_vpin_reference_is_a_half(spark):
    t = ticks(spark, np.random.default_rng(1).random(300) + 1, np.random.default_rng(2).integers(1, 9, 300)).withColumnRenamed("price", "close")
    values = {r[0] for r in seq.with_vpin(t).select("vpin").distinct().collect()}
    assert values == {None, 0.5}


def barrier(pdf, target, pt, sl, horizon, min_ret):
    out = {}
    p = pdf.close.to_numpy()
    for i in range(len(p) - 1):
        path = p[i : i + horizon + 1] / p[i] - 1
        up = next((k for k, x in enumerate(path) if x >= pt * target[i]), None) if target[i] == target[i] else None
        down = next((k for k, x in enumerate(path) if x <= -sl * target[i]), None) if target[i] == target[i] else None
        if down is not None and (up is None or down <= up):
            k, label = down, -1
        elif up is not None:
            k, label = up, 1
        else:
            k = len(path) - 1
            label = 0 if abs(path[k]) < min_ret else 1 if path[k] > 0 else -1
        out[pdf.ts[i]] = (pdf.ts[i + k], label)
    return out


def test_triple_barrier_equals_a_loop(spark):
    a, b = walk("A", 220, 7), walk("B", 180, 8)
    got = labels.triple_barrier(frame(spark, a, b), min_ret=0.01).toPandas()
    for pdf in (a, b):
        own = got[got.symbol == pdf.symbol[0]]
        target = pdf.close.pct_change().ewm(span=100).std().to_numpy()
        assert {t0: (t1, label) for t0, t1, label in zip(own.t0, own.t1, own.label)} == barrier(pdf, target, 1, 1, 5, 0.01)


def test_triple_barrier_of_flat_prices_ties_to_the_lower(spark):
    flat = walk("A", 30)
    for c in ("open", "high", "low", "close"):
        flat[c] = 100.0
    out = labels.triple_barrier(frame(spark, flat)).orderBy("t0").collect()
    assert len(out) == 29
    assert [r.label for r in out[2:]] == [-1] * 27 and out[5].t1 == out[5].t0  # no deviation: at once
    assert out[0].label == -1 and (out[0].t1 - out[0].t0).days == 5  # no target yet: a zero return counts as -1


def test_weights_sum_to_one(spark):
    df = frame(spark, walk("A", 120, 1), walk("B", 100, 2))
    events = labels.triple_barrier(df)
    for method in ("return", "time_decay", "sequential"):
        sums = labels.sample_weights(events, df, method).groupBy("symbol").sum("weight").collect()
        assert [round(r[1], 9) for r in sums] == [1.0, 1.0]
    for bad in ("nothing",):
        with pytest.raises(ValueError):
            labels.sample_weights(events, df, bad)
    counts = labels.balanced_weights(events).groupBy("symbol", "label").sum("weight").groupBy("symbol").agg({"sum(weight)": "min"}).count()
    assert counts == 2
    drawn = labels.weighted_bootstrap(labels.weights_by_return(events), 50)
    assert {r["count"] for r in drawn.groupBy("symbol").count().collect()} <= {49, 50}


def test_meta_labels(spark):
    e = spark.createDataFrame([("A", 1, 0.02, 1), ("A", 2, -0.01, -1), ("A", 3, 0.03, 1)], "symbol string, t0 int, ret double, label int")
    p = spark.createDataFrame([("A", 1, 1), ("A", 2, 1), ("A", 4, -1)], "symbol string, t0 int, side int")
    out = labels.meta_labels(p, e).orderBy("t0").collect()
    assert [(r.t0, r.meta_label) for r in out] == [(1, 1), (2, 0)]
    kept = labels.apply_meta(p, labels.meta_labels(p, e).withColumnRenamed("meta_label", "meta")).orderBy("t0").collect()
    assert [r.side for r in kept] == [1, 0, 0]


def test_prepare_and_validate(spark):
    df = frame(spark, walk("A", 150, 1))
    clean, events = market.prepare(df)
    assert 0 < events.count() < 0.9 * clean.count()
    assert market.validate(df)
    with pytest.raises(ValueError):
        market.validate(df.drop("volume"))
    with pytest.raises(ValueError):
        market.validate(df.limit(5))
    titled = df.toDF("Ticker", "Date", "Open", "High", "Low", "Close", "Volume")
    assert market.canonical(titled).columns == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    assert market.from_bars(market.as_bars(df)).count() == 150


def test_read_bars(spark, tmp_path):
    frame(spark, walk("SPY", 30), walk("B", 20, 2)).write.parquet(str(tmp_path / "b"))
    got = market.index_bars(spark, str(tmp_path / "b"), start="2022-01-10")
    assert got.count() == 23 and market.read_bars(spark, str(tmp_path / "b"), symbols=["B"], end="2022-01-05").count() == 2
    assert "PushedFilters: [IsNotNull" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        market.read_bars(spark, str(tmp_path / "b"), symbols="C")


@pytest.mark.parametrize("kind", ["dollar", "volume", "volatility", "imbalance"])
def test_bars_of_ticks_of_one_time_follow_the_order_of_ties_however_rows_are_dealt(spark, kind):
    draw = np.random.default_rng(4)
    rows = [("A", i // 60, i, float(draw.integers(1, 100)), float(draw.integers(1, 9))) for i in range(600)]
    limit = {"dollar": 900.0, "volume": 20.0, "volatility": 2.0, "imbalance": 15.0}[kind]
    ids = seq.BarIds(kind, limit, "price", "volume")
    at = ids.step(ids.state(), [r[3] for r in rows], [r[4] for r in rows])
    said = {b: [r[3] for r, own in zip(rows, at) if own == b] for b in set(at)}
    for seed in range(3):
        dealt = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
        df = spark.createDataFrame(dealt, "symbol string, ts long, event_id long, price double, volume double").repartition(3)
        got = seq.bars(df, kind, limit, price="price", ties=("event_id",)).collect()
        assert len(got) >= len(said) - 1 and all((r.open, r.close, r.high) == (said[r.bar_id][0], said[r.bar_id][-1], max(said[r.bar_id])) for r in got)
