import pandas as pd
import pytest
from fixtures import walk

from tideline.streaming import events


def source(spark, tmp_path, pdf, files=3):
    rows = [(r.symbol, r.ts.to_pydatetime(), float(r.close), float(r.volume)) for r in pdf.itertuples()]
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], "symbol string, ts timestamp, price double, volume double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema("symbol string, ts timestamp, price double, volume double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def run(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).toPandas()


def test_streamed_events_and_bars_equal_batch(spark, tmp_path):
    from tideline.operators import sequential as seq

    pdf = walk("A", 120, 11)
    batch = spark.createDataFrame([(r.symbol, r.ts.to_pydatetime(), r.close, r.volume) for r in pdf.itertuples()], "symbol string, ts timestamp, close double, volume double")
    stream = source(spark, tmp_path, pdf)
    got = run(spark, events.cusum_events(stream, 0.04), "ev")
    want = seq.cusum_events(batch, 0.04).toPandas()
    assert sorted(zip(got.t0, got.side)) == sorted(zip(want.t0, want.side)) and len(got)
    got = run(spark, events.information_bars(stream, "volume", 2000), "ib")
    want = seq.bars(batch, "volume", 2000).toPandas()
    assert sorted(zip(got.bar_id, got.volume, got.close)) == sorted(zip(want.bar_id, want.volume, want.close)) and len(got)


def test_missing_prices_and_volumes_leave_bars_alone(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, volume double"
    t = [pd.Timestamp("2022-01-01") + pd.Timedelta(days=i) for i in range(9)]
    prices, volumes = [1.0, None, 2.0, 3.0, float("nan"), 4.0, 5.0, 6.0, 7.0], [4.0, 4.0, None, 6.0, 9.0, 10.0, None, 5.0, 5.0]
    for i in range(3):
        rows = [("A", t[k].to_pydatetime(), prices[k], volumes[k]) for k in range(3 * i, 3 * i + 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = run(spark, events.information_bars(stream, "volume", 10), "mv").sort_values("bar_id")
    assert list(zip(got.open, got.close, got.volume)) == [(1.0, 3.0, 10.0), (4.0, 4.0, 10.0), (5.0, 7.0, 10.0)]
    assert len(run(spark, events.information_bars(stream, "dollar", 20), "md")) > 1


def test_time_bars(spark, tmp_path):
    pdf = walk("A", 40, 12)
    got = run(spark, events.time_bars(source(spark, tmp_path, pdf), "7 days", "1 day"), "tb")
    assert len(got) and set(got.columns) == {"symbol", "ts", "open", "high", "low", "close", "volume"}
    assert isinstance(pd.Timestamp(got.ts.iloc[0]), pd.Timestamp)


def test_models_follow_a_stream(spark, tmp_path):
    from tideline.operators.models import Classifier
    from tideline.sources.store import Store
    from tideline.streaming.models import updating

    schema = "symbol string, t0 long, x double, label int"
    for i in range(3):
        spark.createDataFrame([("A", 20 * i + k, float(k % 2 if i else 1 - k % 2), k % 2) for k in range(20)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    store, model = Store(spark, str(tmp_path)), Classifier(["x"], trees=3, depth=2, least=1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stream.writeStream.foreachBatch(updating(store, "m", model, batches=2)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert store.metadata("m")["batch"] == 2 and store.metadata("m")["n_samples"] == 40
    rows = spark.createDataFrame([("A", 0, 0.0, 0), ("A", 1, 1.0, 1)], schema)
    assert [r.prediction for r in store.load("m").predict(rows).orderBy("t0").collect()] == [0, 1]


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        events.information_bars(spark.range(1), "tick", 1)
