import numpy as np
import pytest
from fixtures import column, frame, walk

from tideline.functions import indicators as I
from tideline.functions import series as s
from tideline.operators import sequential as seq
from tideline.operators import strategies as S

close = I.CLOSE


@pytest.fixture(scope="module")
def two():
    return walk("A", 160, 1), walk("B", 140, 2)


CASES = {
    "sma": (lambda: I.sma(window=20), lambda p: p.close.rolling(20).mean()),
    "std": (lambda: s.std(close, 10), lambda p: p.close.rolling(10).std()),
    "pct": (lambda: s.pct(close, 5), lambda p: p.close.pct_change(5)),
    "rank": (lambda: s.rank_pct(close, 30), lambda p: p.close.rolling(30).rank(pct=True)),
    "corr": (lambda: s.corr(s.pct(close), s.lag(s.pct(close)), 19), lambda p: p.close.pct_change().rolling(20).apply(lambda x: x.autocorr(1), raw=False)),
    "rsi": (I.rsi, lambda p: 100 - 100 / (1 + p.close.diff().where(lambda d: d > 0, 0).rolling(14).mean() / (-p.close.diff().where(lambda d: d < 0, 0).rolling(14).mean() + 1e-10))),
    "obv": (I.obv, lambda p: (np.sign(p.close.diff()).fillna(0) * p.volume).cumsum()),
    "parkinson": (I.parkinson, lambda p: np.sqrt((np.log(p.high / p.low) ** 2 / (4 * np.log(2))).rolling(20).mean() * 252)),
    "realized": (I.realized, lambda p: p.close.pct_change().rolling(20).std() * np.sqrt(252)),
    "vwap": (lambda: I.vwap(20), lambda p: ((p.high + p.low + p.close) / 3 * p.volume).rolling(20).sum() / p.volume.rolling(20).sum()),
    "z": (lambda: s.zscore(close, 20), lambda p: (p.close - p.close.rolling(20).mean()) / (p.close.rolling(20).std() + 1e-10)),
    "vol_of_vol": (lambda: s.std(s.std(s.pct(close), 10), 20), lambda p: p.close.pct_change().rolling(10).std().rolling(20).std()),
    "amihud": (lambda: I.amihud(10), lambda p: (p.close.pct_change().abs() / (p.close * p.volume + 1e-10)).rolling(10).mean()),
    "tick_ofi": (lambda: I.ofi(10), lambda p: (np.sign(p.close.diff()).replace(0, np.nan).ffill().fillna(0) * p.volume).rolling(10).sum()),
}


def test_series_equal_pandas_per_symbol(spark, two):
    df = s.project(frame(spark, *two), {k: make() for k, (make, _) in CASES.items()})
    df = df.cache()
    for pdf in two:
        for name, (_, oracle) in CASES.items():
            np.testing.assert_allclose(column(df, name, pdf.symbol[0]), oracle(pdf).to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=name)


def test_many_windows_need_one_exchange(spark, two):
    df = s.project(frame(spark, *two), {"a": I.adx()["adx"], "b": s.std(s.std(s.pct(close), 10), 20), "c": I.rsi(), "d": I.yang_zhang()})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [symbol") <= 1


def test_zero_volume_and_flat_prices_are_missing_not_infinite(spark):
    flat = walk("A", 60)
    for c in ("open", "high", "low", "close"):
        flat[c] = 100.0
    flat["volume"] = 0.0
    df = s.project(frame(spark, flat), {"r": s.mean(I.VOLUME / s.mean(I.VOLUME, 5), 5), "rsi": I.rsi(), "adx": I.adx()["adx"], "gk": I.garman_klass()})
    assert np.isnan(column(df, "r")).all() and np.isnan(column(df, "adx")).all()
    assert column(df, "rsi")[-1] == 0 and column(df, "gk")[-1] == 0


def test_folds_equal_pandas(spark, two):
    df = seq.with_folds(s.project(frame(spark, *two), {"r": s.pct(close)}), {"ema": seq.EwmMean("close", 20), "sd": seq.EwmStd("r", 50), "fd": seq.FracDiff("close", seq.frac_diff_weights(0.9, 1e-3))}).cache()
    w = seq.frac_diff_weights(0.9, 1e-3)
    for pdf in two:
        name = pdf.symbol[0]
        np.testing.assert_allclose(column(df, "ema", name), pdf.close.ewm(span=20, adjust=False).mean(), rtol=1e-12)
        np.testing.assert_allclose(column(df, "sd", name), pdf.close.pct_change().ewm(span=50).std(), rtol=1e-9)
        own = [np.nan if i < len(w) - 1 else float(w @ pdf.close.to_numpy()[i - len(w) + 1 : i + 1][::-1]) for i in range(len(pdf))]
        np.testing.assert_allclose(column(df, "fd", name), own, rtol=1e-9)


def test_folds_do_not_depend_on_batches(spark, two):
    df, before = frame(spark, *two), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = seq.with_vpin(seq.macd(df), mode="standard").orderBy("symbol", "ts").collect()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert seq.with_vpin(seq.macd(df), mode="standard").orderBy("symbol", "ts").collect() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_frac_diff_widths():
    assert len(seq.frac_diff_weights(0.4)) - 1 == 1457
    assert [len(seq.frac_diff_weights(d)) - 1 for d in (0.0, 1.0)] == [0, 1]


def test_strategies_emit_signals_in_range(spark, two):
    df = frame(spark, *two)
    for make in (S.Momentum, S.MeanReversion, S.Volatility, S.Scalping, S.Sentiment):
        strategy = make()
        out = strategy.signals(df)
        assert out.count() == sum(map(len, two)) and {r[0] for r in out.select("signal").distinct().collect()} <= {-1, 0, 1}
        assert strategy.feature_frame(df).count() == out.count()
        low, high = strategy.strengths(df).selectExpr("min(strength)", "max(strength)").first()
        assert 0 <= low <= high <= 1


def test_half_life_and_hedge_ratio(spark):
    a, b = walk("A", 130, 3), walk("B", 130, 4)
    pair = S.pair_bars(frame(spark, a, b), "A", "B")
    out = S.Pairs().feature_frame(pair)
    spread = np.log(a.close) - np.log(b.close)

    def life(i):
        x = spread.iloc[i - 60 : i]
        d, l_ = x.diff().iloc[1:], x.shift().iloc[1:]
        beta = (d * l_).sum() / (l_**2).sum()
        return -np.log(2) / beta if beta < 0 else np.inf

    np.testing.assert_allclose(column(out, "half_life", "A/B")[60:], [life(i) for i in range(60, 130)], rtol=1e-9)
    np.testing.assert_allclose(column(out, "hedge_ratio", "A/B")[60:], [(a.close * b.close).iloc[i - 60 : i].sum() / (b.close**2).iloc[i - 60 : i].sum() for i in range(60, 130)], rtol=1e-9)
    np.testing.assert_allclose(column(out, "coint_score", "A/B")[100:], [abs(spread.iloc[i - 100 : i].diff().autocorr(1)) for i in range(100, 130)], rtol=1e-9)
