import pytest
from fixtures import frame, walk

from tideline.operators import regimes as R


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [("A", i, x) for i, x in enumerate("aaabbaacccc")] + [("B", i, "z") for i in range(3)]
    return spark.createDataFrame(rows, "symbol string, ts int, r string")


def test_periods_and_transitions(labelled):
    got = [(r.regime, r.start, r.end, r.duration) for r in R.periods(labelled, "r").filter("symbol = 'A'").orderBy("start").collect()]
    assert got == [("a", 0, 2, 3), ("b", 3, 4, 2), ("a", 5, 6, 2), ("c", 7, 10, 4)]
    assert [(r.ts, r.from_regime, r.to_regime, r.duration_in_previous) for r in R.transitions(labelled, "r").orderBy("ts").collect()] == [(3, "a", "b", 3), (5, "b", "a", 2), (7, "a", "c", 2)]
    assert R.periods(labelled, "r").filter("symbol = 'B'").count() == 1


def test_persistence_and_stability(labelled):
    got = {r.ts: r.persistence for r in R.persistence(labelled, "r", 2).filter("symbol = 'A'").collect()}
    assert got[1] is None and got[2] == 1.0 and got[3] == 0.0 and got[4] == 0.5
    assert [r.ts for r in R.stable_periods(labelled, ["r"], 3).filter("symbol = 'A'").orderBy("ts").collect()] == [2, 9, 10]


def test_smoothing_takes_the_smallest_mode(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1, 0, 1, 2, 2])], "symbol string, ts int, r int")
    assert [r.smoothed for r in R.smoothed(df, "r").orderBy("ts").collect()] == [None, 1, 0, 2, None]


def test_head_defaults_and_canonical_labels(spark):
    out = R.composite(R.detect(frame(spark, walk("A", 120), walk("B", 30, 2)))).cache()
    first = out.orderBy("ts").first()
    assert (first.trend_regime, first.vol_regime, first.volume_regime, first.micro_regime) == ("ranging", "normal_vol", "normal_volume", "tight")
    assert {r[0] for r in out.select("canonical_regime").distinct().collect()} <= {"TREND", "MEANREV", "VOLCRUSH"}
    assert R.current_regime(frame(spark, walk("A", 120))).count() == 1
