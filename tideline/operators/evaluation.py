"""Performance metrics and backtests."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .portfolio import Execution
from .sequential import Portfolio, with_folds

YEAR = 252


def equity(returns: DataFrame, column: str = "returns") -> DataFrame:
    """returns with cumulative (product of 1 + r, missing ones passed over), running_max and drawdown (negative)."""
    upto = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("cumulative", F.product(1.0 + F.col(column)).over(upto))
    out = out.withColumn("running_max", F.max("cumulative").over(upto))
    return out.withColumn("drawdown", F.try_divide(F.col("cumulative") - F.col("running_max"), F.col("running_max")))


def _ratio(mean: Column, spread: Column, year: int) -> Column:
    return F.when(spread > 0, mean / spread * F.sqrt(F.lit(float(year)))).otherwise(0.0)


def metrics(returns: DataFrame, column: str = "returns", risk_free: float = 0.0, year: int = YEAR) -> DataFrame:
    """One row per symbol of all metrics; 0, and means missing, for fewer than two returns.

    Skewness and kurtosis are bias-corrected.  Sortino and profit factor are infinite
    where there is no loss but a gain.
    """
    r = F.col(column).cast("double")
    x = r - risk_free / year
    n = F.count(r)
    curve = equity(returns.filter(F.col(column).isNotNull()), column)
    agg = curve.groupBy("symbol").agg(
        n.alias("n"), (F.product(1.0 + r) - 1.0).alias("total"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.avg(x).alias("excess"), F.stddev_samp(x).alias("esd"), F.sqrt(F.avg(F.when(x < 0, x * x))).alias("down"),
        F.abs(F.min("drawdown")).alias("dd"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("wins"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("profit"), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0))).alias("loss"),
        F.percentile(r, 0.5).alias("median"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    N, many = F.col("n").cast("double"), F.col("n") >= 2
    either = lambda c: F.when(many, c).otherwise(0.0)
    sortino = F.when(F.col("down").isNull(), F.when(F.col("excess") > 0, float("inf")).otherwise(0.0)).otherwise(_ratio(F.col("excess"), F.col("down"), year))
    factor = F.when(F.col("loss") == 0, F.when(F.col("profit") > 0, float("inf")).otherwise(0.0)).otherwise(F.try_divide(F.col("profit"), F.col("loss")))
    skew = F.when((N > 2) & (F.col("sd") > 0), F.sqrt(N * (N - 1)) / (N - 2) * F.col("g1"))
    kurt = F.when((N > 3) & (F.col("sd") > 0), (N - 1) / ((N - 2) * (N - 3)) * ((N + 1) * F.col("g2") + 6))
    return agg.select(
        "symbol", either(F.col("total")).alias("total_return"), either(F.col("mean") * year).alias("annual_return"), either(F.col("sd") * F.sqrt(F.lit(float(year)))).alias("annual_volatility"),
        either(_ratio(F.col("excess"), F.col("esd"), year)).alias("sharpe_ratio"), either(sortino).alias("sortino_ratio"), either(F.when(F.col("dd") > 0, F.col("mean") * year / F.col("dd")).otherwise(0.0)).alias("calmar_ratio"),
        either(F.col("dd")).alias("max_drawdown"), either(F.col("wins")).alias("win_rate"), either(factor).alias("profit_factor"), F.col("n").alias("num_periods"),
        F.when(many, F.col("mean")).alias("avg_return"), F.when(many, F.col("median")).alias("median_return"), F.when(many, F.col("sd")).alias("std_return"), F.when(many, skew).alias("skewness"), F.when(many, kurt).alias("kurtosis"))


def recovery_time(returns: DataFrame, column: str = "returns") -> DataFrame:
    """symbol, recovery: bars from the deepest point back to the peak before it; missing if there was none."""
    at = Window.partitionBy("symbol").orderBy("ts")
    curve = equity(returns.filter(F.col(column).isNotNull()), column).withColumn("_at", F.row_number().over(at))
    trough = curve.groupBy("symbol").agg(F.min_by(F.struct("_at", "running_max"), F.struct("drawdown", "_at")).alias("_t"))
    back = curve.join(trough, "symbol").filter((F.col("_at") >= F.col("_t._at")) & (F.col("cumulative") >= F.col("_t.running_max")))
    found = back.groupBy("symbol").agg(F.min(F.col("_at") - F.col("_t._at")).alias("recovery"))
    return trough.select("symbol").join(found, "symbol", "left")


# Backtests ----------------------------------------------------------------------------


def run_backtest(signals: DataFrame, bars: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """symbol, ts, signal, close, position, value, change, returns of an account per symbol, where both have a row."""
    rows = signals.select("symbol", "ts", "signal").join(bars.select("symbol", "ts", "close"), ["symbol", "ts"])
    out = with_folds(rows, {"_p": Portfolio("signal", "close", capital)}).select("symbol", "ts", "signal", "close", "_p.*")
    before = F.lag("value").over(Window.partitionBy("symbol").orderBy("ts"))
    return out.withColumn("returns", F.try_divide(F.col("value"), before) - 1.0)


def backtest_trades(run: DataFrame, execution: Execution | None = None, capital: float = 100_000.0) -> DataFrame:
    """The trades of run_backtest(): sized on the value of the account before the bar."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("symbol").orderBy("ts")), F.lit(capital))
    orders = run.withColumn("portfolio_value", before).filter("change <> 0")
    return (execution or Execution()).trades(orders.select("ts", "symbol", "signal", F.col("close").alias("price"), "portfolio_value", F.abs("change").alias("position_size")))


def simple_backtest(signals: DataFrame, bars: DataFrame, capital: float = 100_000.0, reference: bool = True) -> DataFrame:
    """One row per symbol: final_value, total_return, and metrics().

    With ``reference``, metrics are of the changes of cumulative return from bar to
    bar (the first of them, and any that would divide by zero, as 0); else of bar
    returns.
    """
    run = run_backtest(signals, bars, capital)
    order = Window.partitionBy("symbol").orderBy("ts")
    if reference:
        cumulative = (F.col("value") - capital) / capital
        moved = run.withColumn("_c", cumulative).withColumn("_n", F.row_number().over(order)).filter("_n > 1")
        moved = moved.withColumn("returns", F.coalesce(F.try_divide(F.col("_c"), F.lag("_c").over(order)) - 1.0, F.lit(0.0)))
    else:
        moved = run
    last = run.groupBy("symbol").agg(F.max_by("value", "ts").alias("final_value"))
    out = last.withColumn("account_return", F.col("final_value") / capital - 1.0)
    return out.join(metrics(moved), "symbol", "left")


def walk_forward_windows(n: int, train: int = 252, test: int = 63) -> list[tuple[int, int, int]]:
    """(train start, test start, test end) positions."""
    return [(s - train, s, s + test) for s in range(train, max(n - test, train), test) if s + test < n]


def walk_forward(features: DataFrame, bars: DataFrame, make_model, *, train: int = 252, test: int = 63, capital: float = 100_000.0) -> DataFrame:
    """simple_backtest() on predictions of models that are each trained on the rows before their test window.

    ``make_model()`` gives something with fit(frame) and predict(frame); features
    has symbol, ts and label.  The driver walks over the windows, of which there
    are few; rows stay where they are.
    """
    place = Window.partitionBy("symbol").orderBy("ts")
    numbered = features.withColumn("_at", F.row_number().over(place) - 1)
    n = numbered.agg(F.max("_at")).first()[0]
    predicted = None
    for a, b, c in walk_forward_windows((n if n is not None else -1) + 1, train, test):
        model = make_model().fit(numbered.filter((F.col("_at") >= a) & (F.col("_at") < b)))
        one = model.predict(numbered.filter((F.col("_at") >= b) & (F.col("_at") < c))).select("symbol", "ts", F.col("prediction").cast("double").alias("signal"))
        predicted = one if predicted is None else predicted.union(one)
    if predicted is None:
        raise ValueError("too few rows for a window")
    return simple_backtest(predicted, bars, capital)


#: Simulations that run side by side, and draws that are made at a time.
SIDE_BY_SIDE, DRAWS = 250, 1 << 18


def xxhash64_of_ints(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64() of ints from 0 on, carried on from the hash of the columns before; both unsigned, of 64 bits."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = seed + (p5 + np.uint64(4)) ^ values.astype(np.uint64) * p1
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _simulated(fold: Portfolio, signals: np.ndarray, closes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Last values of accounts, one for each seed, that follow a signal drawn anew for each bar."""
    state = fold.state() | {"position": np.zeros(len(seeds)), "value": np.full(len(seeds), fold.capital)}
    step = max(1, DRAWS // len(seeds))
    for a in range(0, len(closes), step):
        b = min(a + step, len(closes))
        picks = xxhash64_of_ints(np.arange(a + 1, b + 1)[:, None], seeds[None, :]).view(np.int64) % len(signals)
        fold.side_by_side(state, signals[picks], closes[a:b])
    return state["value"]


def monte_carlo(signals: DataFrame, bars: DataFrame, simulations: int = 1000, capital: float = 100_000.0, seed: int = 42) -> DataFrame:
    """Per symbol, over accounts that follow resampled signals: mean, median, std, percentiles of values, returns, chance of profit.

    A task takes a symbol's bars once for SIDE_BY_SIDE simulations, and each row of them for all of these at once, so that
    no row is made for a simulation's bar.  Signals are drawn from the whole symbol: a task holds 16 bytes a bar of it.
    """
    if simulations < 1:
        raise ValueError("there must be a simulation at least")
    fold = Portfolio("signal", "close", capital)
    rows = signals.select("symbol", "ts", F.col("signal").cast("double")).join(bars.select("symbol", "ts", F.col("close").cast("double")), ["symbol", "ts"])
    blocks = F.explode(F.sequence(F.lit(0), F.lit((simulations - 1) // SIDE_BY_SIDE)))
    keyed = rows.select("symbol", blocks.alias("_block"), "ts", F.xxhash64(F.lit(seed), "symbol").alias("_seed"), "signal", "close")
    dealt = keyed.repartition("symbol", "_block").sortWithinPartitions("symbol", "_block", "ts").drop("ts")
    types = [pa.string(), pa.float64()]

    def finals(symbol: str, block: int, start: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sims = np.arange(block * SIDE_BY_SIDE + 1, min((block + 1) * SIDE_BY_SIDE, simulations) + 1)
        seeds = xxhash64_of_ints(sims, np.array([start], np.int64).view(np.uint64))
        values = _simulated(fold, *(np.concatenate(x) for x in zip(*parts)), seeds)
        columns = [symbol] * len(sims), values
        return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, types)], names=["symbol", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, blocks, starts, *both = (batch[c].to_numpy(zero_copy_only=False) for c in ("symbol", "_block", "_seed", "signal", "close"))
            changes = (symbols[1:] != symbols[:-1]) | (blocks[1:] != blocks[:-1])
            cuts = [0, *(np.flatnonzero(changes) + 1), len(symbols)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                new = symbols[a], int(blocks[a]), int(starts[a])
                if parts and new != key:
                    yield finals(*key, parts)
                    parts = []
                key = new
                parts.append(tuple(x[a:b].astype(float) for x in both))
        if parts:
            yield finals(*key, parts)

    final = dealt.mapInArrow(run, "symbol string, v double").withColumn("r", F.col("v") / capital - 1.0)
    return final.groupBy("symbol").agg(
        F.avg("v").alias("mean_final_value"), F.percentile("v", 0.5).alias("median_final_value"), F.stddev_pop("v").alias("std_final_value"), F.avg("r").alias("mean_return"), F.percentile("r", 0.5).alias("median_return"), F.stddev_pop("r").alias("std_return"),
        F.percentile("v", 0.05).alias("percentile_5"), F.percentile("v", 0.95).alias("percentile_95"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("probability_profit"))


def regime_backtest(predictions: DataFrame, regimes: DataFrame, bars: DataFrame, preferred: Mapping[str, Sequence[str]], capital: float = 100_000.0) -> DataFrame:
    """simple_backtest() of the mean prediction (symbol, ts, strategy, signal) of the strategies that the regime (symbol, ts, regime) prefers, else 0."""
    spark = predictions.sparkSession
    table = spark.createDataFrame([(r, s) for r, names in preferred.items() for s in names] or [("", "")], "regime string, strategy string")
    chosen = predictions.join(regimes.select("symbol", "ts", "regime"), ["symbol", "ts"]).join(F.broadcast(table), ["regime", "strategy"])
    means = chosen.groupBy("symbol", "ts").agg(F.avg("signal").alias("_s"))
    signals = regimes.select("symbol", "ts").join(means, ["symbol", "ts"], "left").select("symbol", "ts", F.coalesce("_s", F.lit(0.0)).alias("signal"))
    return simple_backtest(signals, bars, capital)


def as_of(times: DataFrame, prices: DataFrame, column: str = "close") -> DataFrame:
    """times (symbol, ts) with the last price at or before: both sides in one line, the last price carried on."""
    a = prices.select("symbol", "ts", F.col(column).alias("_p"), F.lit(0).alias("_side"))
    b = times.select("symbol", "ts").distinct().select("symbol", "ts", F.lit(None).cast("double").alias("_p"), F.lit(1).alias("_side"))
    line = Window.partitionBy("symbol").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn(column, F.last("_p", True).over(line)).filter("_side = 1").select("symbol", "ts", column)
