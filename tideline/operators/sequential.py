"""Path-dependent operators: folds along a symbol's rows in order of time.

One pass runs any number of folds.  Rows are dealt by symbol and sorted by
(symbol, ts); workers read Arrow batches and carry each fold's state from batch to
batch, so that memory doesn't grow with the length of a symbol.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import indicators as I
from ..functions.series import col, diff, ffill, pct, project, rank_pct, whole

Values = list  # of float or None, None being missing


class Fold:
    """state() starts one symbol; step(state, *columns) gives the rows' outputs and moves the state on."""

    inputs: tuple[str, ...] = ()
    type: str = "double"

    def state(self) -> dict[str, Any]:
        return {}

    def step(self, state: dict[str, Any], *columns: Values) -> Values:
        raise NotImplementedError


class EwmMean(Fold):
    """y = x in the first row, then (1 - a) y + a x with a = 2 / (span + 1); missing x keeps y."""

    def __init__(self, column: str, span: float) -> None:
        self.inputs, self.a = (column,), 2.0 / (span + 1.0)

    def state(self):
        return {"y": None}

    def step(self, state, xs):
        y, a, out = state["y"], self.a, []
        for x in xs:
            if x is not None:
                y = x if y is None else (1.0 - a) * y + a * x
            out.append(y)
        state["y"] = y
        return out


class EwmStd(Fold):
    """Standard deviation under weights (1 - a)^age, bias-corrected; missing before two values."""

    def __init__(self, column: str, span: float) -> None:
        self.inputs, self.keep = (column,), 1.0 - 2.0 / (span + 1.0)

    def state(self):
        return {"mean": 0.0, "w": 0.0, "w2": 0.0, "m2": 0.0, "n": 0}

    def step(self, state, xs):
        mean, w, w2, m2, n = (state[k] for k in ("mean", "w", "w2", "m2", "n"))
        keep, out = self.keep, []
        for x in xs:
            w, w2, m2 = w * keep, w2 * keep * keep, m2 * keep
            if x is not None:
                n += 1
                w, w2 = w + 1.0, w2 + 1.0
                gap = x - mean
                mean += gap / w
                m2 += gap * (x - mean)
            left = w - w2 / w if w else 0.0
            out.append(math.sqrt(max(m2, 0.0) / left) if n > 1 and left > 0 else None)
        state.update(mean=mean, w=w, w2=w2, m2=m2, n=n)
        return out


class Cusum(Fold):
    """Signed sum of returns at which an event fires: above h or below -h (strictly), then both sums restart.

    ``threshold`` is a number or a column with one for each row; rows with none
    don't move the sums.
    """

    def __init__(self, returns: str, threshold: float | str) -> None:
        self.h = threshold if not isinstance(threshold, str) else None
        self.inputs = (returns,) if self.h is not None else (returns, threshold)

    def state(self):
        return {"up": 0.0, "down": 0.0}

    def step(self, state, rs, hs=None):
        up, down, out = state["up"], state["down"], []
        for i, r in enumerate(rs):
            h = self.h if hs is None else hs[i]
            fired = None
            if h is not None:
                up, down = max(0.0, up + (r or 0.0)), min(0.0, down + (r or 0.0))
                if up > h:
                    fired = up
                elif down < -h:
                    fired = down
                if fired is not None:
                    up = down = 0.0
            out.append(fired)
        state.update(up=up, down=down)
        return out


class BarIds(Fold):
    """Number of the information bar of each row, from 0; the bar closes in the row that fills it.

    kind: "dollar", "volume", "volatility" or "imbalance".  The sum restarts at zero,
    nothing is carried over.
    """

    type = "long"

    def __init__(self, kind: str, threshold: float, price: str, volume: str) -> None:
        if kind not in ("dollar", "volume", "volatility", "imbalance"):
            raise ValueError(f"unknown kind of bar: {kind}")
        self.kind, self.threshold, self.inputs = kind, threshold, (price, volume)

    def state(self):
        return {"bar": 0, "sum": 0.0, "prev": None, "rows": 0}

    def step(self, state, prices, volumes):
        bar, total, prev, rows = (state[k] for k in ("bar", "sum", "prev", "rows"))
        kind, limit, out = self.kind, self.threshold, []
        for p, v in zip(prices, volumes):
            rows += 1
            v = v or 0.0
            if kind == "dollar":
                total += (p or 0.0) * v
            elif kind == "volume":
                total += v
            elif prev is not None and p is not None:
                if kind == "imbalance":
                    total += v * ((p > prev) - (p < prev))
                elif prev:
                    total += abs((p - prev) / prev)
            prev = p if p is not None else prev
            out.append(bar)
            full = (abs(total) if kind == "imbalance" else total) >= limit
            if full and (rows > 1 or kind in ("dollar", "volume")):
                bar, total, rows = bar + 1, 0.0, 0
                if kind == "volatility":
                    prev = None
        state.update(bar=bar, sum=total, prev=prev, rows=rows)
        return out


class Vpin(Fold):
    """Volume-synchronised imbalance over the last ``window`` buckets, held until the next bucket closes.

    Volume whose tick is 0 counts on both sides.  mode "reference" divides the
    imbalances by twice their sum, so that the value is 0.5 (0 if all are 0);
    "standard" divides by the volume of the buckets.
    """

    def __init__(self, tick: str, volume: str, bucket: str, window: int = 20, mode: str = "reference") -> None:
        if mode not in ("reference", "standard"):
            raise ValueError(mode)
        self.inputs, self.window, self.mode = (tick, volume, bucket), window, mode

    def state(self):
        return {"sum": 0.0, "buy": 0.0, "sell": 0.0, "last": [], "value": None}

    def step(self, state, ticks, volumes, sizes):
        out = []
        for t, v, size in zip(ticks, volumes, sizes):
            v = v or 0.0
            state["sum"] += v
            state["buy"] += v if (t or 0) >= 0 else 0.0
            state["sell"] += v if (t or 0) <= 0 else 0.0
            if size is not None and state["sum"] >= size:
                state["last"] = [*state["last"], (abs(state["buy"] - state["sell"]), state["sum"])][-self.window :]
                state.update(sum=0.0, buy=0.0, sell=0.0)
                if len(state["last"]) == self.window:
                    gaps = sum(g for g, _ in state["last"])
                    whole_ = 2.0 * gaps if self.mode == "reference" else sum(s for _, s in state["last"])
                    state["value"] = gaps / whole_ if whole_ > 0 else 0.0
            out.append(state["value"])
        return out


class FracDiff(Fold):
    """Weighted sum of the last len(weights) values; missing while there are fewer, or where x is missing."""

    def __init__(self, column: str, weights: np.ndarray) -> None:
        self.inputs, self.weights = (column,), np.asarray(weights, float)

    def state(self):
        return {"tail": np.zeros(0)}

    def step(self, state, xs):
        values = np.array([np.nan if x is None else x for x in xs])
        joined, n = np.concatenate([state["tail"], values]), len(self.weights)
        out = np.full(len(joined), np.nan)
        if len(joined) >= n:
            out[n - 1 :] = np.convolve(joined, self.weights, "valid")
        state["tail"] = joined[len(joined) - min(n - 1, len(joined)) :] if n > 1 else np.zeros(0)
        return [None if math.isnan(y) else float(y) for y in out[len(out) - len(values) :]]


class Portfolio(Fold):
    """Value of a single-asset account that follows a signal: 10% of it a unit, revalued in each row.

    A change of more than one percent is traded unless the signal is 0, which
    never closes a position.
    """

    def __init__(self, signal: str, price: str, capital: float = 100_000.0, size: float = 0.1, least: float = 0.01) -> None:
        self.inputs, self.capital, self.size, self.least = (signal, price), capital, size, least

    type = "struct<position:double,value:double,change:double>"

    def state(self):
        return {"position": 0.0, "value": self.capital, "first": None}

    def step(self, state, signals, prices):
        position, value, first, out = state["position"], state["value"], state["first"], []
        for s, p in zip(signals, prices):
            first = p if first is None else first
            gap, change = abs((s or 0.0) * self.size - position), 0.0
            if gap > self.least and s and abs(s) >= 0.01:
                change = math.copysign(gap, s)
                position += change
            if p is not None and first:
                value = value * (1 - abs(position)) + position * value * p / first
            out.append({"position": position, "value": value, "change": change})
        state.update(position=position, value=value, first=first)
        return out

    def side_by_side(self, state, signals: np.ndarray, prices: np.ndarray) -> None:
        """step() of many accounts at once, a column of signals for each, without its rows; NaN stands for a missing one."""
        position, value, first = state["position"], state["value"], state["first"]
        with np.errstate(all="ignore"):
            for s, p in zip(np.where(np.isnan(signals), 0.0, signals), prices.tolist()):
                gap = np.abs(s * self.size - position)
                position = position + np.where((gap > self.least) & (np.abs(s) >= 0.01), np.copysign(gap, s), 0.0)
                if p == p:
                    first = p if first is None else first
                    if first:
                        value = value * (1 - np.abs(position)) + position * value * p / first
        state.update(position=position, value=value, first=first)


def with_folds(df: DataFrame, folds: Mapping[str, Fold], by: str = "symbol", order: str | Sequence[str] = "ts") -> DataFrame:
    """df with a column for each fold, in one pass."""
    kept = [c for c in df.columns if c not in folds]
    fields = [f for f in df.schema.fields if f.name in kept]
    schema = T.StructType([*fields, *(T.StructField(n, T._parse_datatype_string(f.type)) for n, f in folds.items())])
    items = list(folds.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, states, started = None, {}, False
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[by].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            columns = {c: [None if v is None or v != v else float(v) for v in pdf[c]] for _, f in items for c in f.inputs}
            outs: dict[str, list] = {n: [] for n, _ in items}
            for a, b in zip(cuts[:-1], cuts[1:]):
                if not started or keys[a] != symbol:
                    symbol, started, states = keys[a], True, {n: f.state() for n, f in items}
                for n, f in items:
                    outs[n] += f.step(states[n], *(columns[c][a:b] for c in f.inputs))
            yield pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in outs.items()})], axis=1)

    return df.repartition(by).sortWithinPartitions(by, *([order] if isinstance(order, str) else order)).mapInPandas(run, schema)


# Exponentially weighted ---------------------------------------------------------------


def with_ema(df: DataFrame, column: str, span: float, name: str) -> DataFrame:
    return with_folds(df, {name: EwmMean(column, span)})


class Macd(Fold):
    """Difference of two exponential means, and the exponential mean of it, in one go."""

    type = "struct<macd:double,signal:double>"

    def __init__(self, column: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> None:
        self.inputs = (column,)
        self.parts = (EwmMean(column, fast), EwmMean(column, slow), EwmMean("macd", signal))

    def state(self):
        return [p.state() for p in self.parts]

    def step(self, state, xs):
        fast, slow = (p.step(s, xs) for p, s in zip(self.parts[:2], state))
        lines = [None if a is None or b is None else a - b for a, b in zip(fast, slow)]
        return [{"macd": m, "signal": s} for m, s in zip(lines, self.parts[2].step(state[2], lines))]


def _macd_columns(line: str, prefix: str = "") -> dict:
    m, s = F.col(f"{line}.macd"), F.col(f"{line}.signal")
    return {f"{prefix}macd": m, f"{prefix}macd_signal": s, f"{prefix}macd_histogram": m - s}


def macd(df: DataFrame, column: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """df with macd, macd_signal and macd_histogram, in one pass."""
    return with_folds(df, {"_line": Macd(column, fast, slow, signal)}).withColumns(_macd_columns("_line")).drop("_line")


def ema_slope(df: DataFrame, column: str = "close", span: int = 50, lookback: int = 5) -> DataFrame:
    e = col("_ema")
    return project(with_ema(df, column, span, "_ema"), {"ema_slope": diff(e, lookback) / float(lookback)}).drop("_ema")


def daily_volatility(df: DataFrame, span: int = 100, name: str = "daily_vol") -> DataFrame:
    """Exponentially weighted deviation of returns, the barrier target."""
    return with_folds(project(df, {"_r": pct(I.CLOSE)}), {name: EwmStd("_r", span)}).drop("_r")


def ewma_volatility(df: DataFrame, span: int = 20, year: int = 252, name: str = "ewma_vol") -> DataFrame:
    return daily_volatility(df, span, name).withColumn(name, F.col(name) * math.sqrt(year))


def technical_folds(windows: tuple[int, ...] = (5, 10, 20, 50), prefix: str = "") -> dict[str, Fold]:
    """Folds of the technical set over bars with its window part; see technical_folded()."""
    return {f"{prefix}ema_{w}": EwmMean("close", w) for w in windows} | {f"{prefix}obv_ema": EwmMean(f"{prefix}obv", 20), f"_{prefix}line": Macd("close")}


def technical_folded(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 50), prefix: str = "") -> DataFrame:
    """df, with the columns of technical_folds(), and those that follow from them in a row."""
    out = df.withColumns(_macd_columns(f"_{prefix}line", prefix)).drop(f"_{prefix}line")
    return project(out, {f"{prefix}price_ema_ratio_{w}": I.CLOSE / col(f"{prefix}ema_{w}") for w in windows})


def technical_features(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """The full technical set, in columns after df's: one window pass and one pass of folds."""
    return technical_folded(with_folds(project(df, I.technical(windows)), technical_folds(windows)), windows)


def volatility_estimates(df: DataFrame, window: int = 20) -> DataFrame:
    """All six estimators."""
    return ewma_volatility(project(df, I.volatility_features(window)), window, name="ewma")


# Events and bars ----------------------------------------------------------------------


def cusum_events(df: DataFrame, threshold: float, column: str = "close") -> DataFrame:
    """symbol, t0, side (1 or -1), magnitude of every CUSUM event of a price column."""
    return _fired(with_folds(project(df, {"_r": pct(col(column))}), {"_s": Cusum("_r", threshold)}))


def adaptive_cusum_events(df: DataFrame, base_threshold: float, window: int = 20, column: str = "close") -> DataFrame:
    """CUSUM with a threshold of each row's own: the base times the rolling deviation of returns.

    Rows before number ``window`` (from 0) don't count; a missing deviation stands
    for the base.
    """
    from ..functions.series import choose, fill, position, std

    r = pct(col(column))
    h = choose((position() > window, fill(std(r, window), base_threshold) * base_threshold))
    return _fired(with_folds(project(df, {"_r": r, "_h": h}), {"_s": Cusum("_r", "_h")}))


def _fired(df: DataFrame) -> DataFrame:
    return df.filter("_s is not null").select("symbol", F.col("ts").alias("t0"), F.signum("_s").cast("int").alias("side"), F.abs("_s").alias("magnitude"))


def bars(df: DataFrame, kind: str, threshold: float, price: str = "close", volume: str = "volume", ties: Sequence[str] = ()) -> DataFrame:
    """Dollar, volume, volatility or imbalance bars: symbol, bar_id, ts (last), open, high, low, close, volume.

    The fold numbers the rows and Catalyst aggregates them; rows after the last
    full bar are dropped.  Rows of one ts come in the order of the columns ``ties``,
    then of price and volume, so that bars are the same however rows are dealt.
    """
    order = ["ts", *ties, price, volume]
    marked = with_folds(df.select("symbol", *order), {"bar_id": BarIds(kind, threshold, price, volume), "_done": _Closed(kind, threshold, price, volume)}, order=order)
    out = marked.groupBy("symbol", "bar_id").agg(
        F.max("ts").alias("ts"), F.min_by(price, F.struct(*order)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct(*order)).alias("close"), F.sum(volume).alias("volume"), F.max("_done").alias("_done"))
    return out.filter("_done = 1").drop("_done")


class _Closed(BarIds):
    """1 in the row that closes a bar, else 0."""

    type = "int"

    def step(self, state, prices, volumes):
        out = []
        for p, v in zip(prices, volumes):
            was = state["bar"]
            super().step(state, [p], [v])
            out.append(int(state["bar"] > was))
        return out


def bar_threshold(df: DataFrame, kind: str, target: int = 100) -> DataFrame:
    """symbol and threshold that gives about ``target`` bars."""
    if kind == "volatility":
        measured = project(df, {"_x": I.absolute(pct(I.CLOSE))})
    elif kind in ("dollar", "volume"):
        measured = df.withColumn("_x", F.col("close") * F.col("volume") if kind == "dollar" else F.col("volume").cast("double"))
    else:
        raise ValueError(f"no threshold rule for {kind}")
    return measured.groupBy("symbol").agg((F.sum("_x") / target).alias("threshold"))


def with_vpin(df: DataFrame, buckets: int = 50, window: int = 20, mode: str = "reference", name: str = "vpin", bucket_size: float | None = None) -> DataFrame:
    """df with VPIN; a bucket is the symbol's whole volume divided by ``buckets`` unless a size is given."""
    size = whole(F.sum, I.VOLUME) / float(buckets) if bucket_size is None else I.fill(I.VOLUME * 0.0, 0.0) + bucket_size
    ready = project(df, {"_tick": I.tick_rule(), "_size": size})
    return with_folds(ready, {name: Vpin("_tick", "volume", "_size", window, mode)}).drop("_tick", "_size")


def vpin_features(df: DataFrame, buckets: tuple[int, ...] = (25, 50, 100), mode: str = "reference") -> DataFrame:
    """vpin_n, its change and its rolling rank among 100, for each number of buckets; one pass."""
    sizes = {f"_size_{n}": whole(F.sum, I.VOLUME) / float(n) for n in buckets}
    out = with_folds(project(df, {"_tick": I.tick_rule(), **sizes}), {f"vpin_{n}": Vpin("_tick", "volume", f"_size_{n}", 20, mode) for n in buckets})
    more = {k: v for n in buckets for k, v in ((f"vpin_change_{n}", diff(col(f"vpin_{n}"))), (f"vpin_pct_{n}", rank_pct(col(f"vpin_{n}"), 100)))}
    return project(out.drop("_tick", *sizes), more)


# Stationarity -------------------------------------------------------------------------


def frac_diff_weights(d: float, threshold: float = 1e-5, most: int = 100_000) -> np.ndarray:
    """1, -d, d (d - 1) / 2, ... as far as they reach the threshold in size."""
    weights = [1.0]
    while len(weights) < most:
        k = len(weights)
        following = weights[-1] * (k - 1 - d) / k
        if abs(following) < threshold:
            break
        weights.append(following)
    return np.array(weights)


def with_frac_diff(df: DataFrame, d: float, threshold: float = 1e-5, column: str = "close", name: str = "frac_diff") -> DataFrame:
    return with_folds(df, {name: FracDiff(column, frac_diff_weights(d, threshold))})


def frac_diff_ffd(df: DataFrame, d: float, threshold: float = 1e-5, column: str = "close", name: str = "frac_diff") -> DataFrame:
    """Without the rows that have no value."""
    return with_frac_diff(df, d, threshold, column, name).filter(F.col(name).isNotNull())


def stationary(df: DataFrame, method: str, d: float = 0.5, column: str = "close", name: str = "stationary") -> DataFrame:
    """frac_diff, log_returns, diff or pct_change of a column."""
    x = col(column)
    if method == "frac_diff":
        return with_frac_diff(df, d, column=column, name=name)
    plain = {"log_returns": I.log(x / I.lag(x)), "diff": diff(x), "pct_change": pct(x)}
    if method not in plain:
        raise ValueError(f"unknown method: {method}")
    return project(df, {name: plain[method]})


def accumulated(df: DataFrame, returns: str = "returns") -> DataFrame:
    """df with cum_return, expanding_mean and expanding_std of a returns column."""
    from ..functions.series import cumulative

    r = col(returns)
    return project(df, {"cum_return": cumulative(F.product, r + 1.0) - 1.0, "expanding_mean": cumulative(F.avg, r), "expanding_std": cumulative(F.stddev_samp, r)})


def forward_filled(df: DataFrame, columns: list[str], backward: bool = True) -> DataFrame:
    """Missing values from the row before, then (which looks ahead) from the row after."""
    from ..functions.series import fill, head

    # after the row before, only the head is without a value
    return project(df, {c: fill(ffill(col(c)), head(col(c))) if backward else ffill(col(c)) for c in columns})
