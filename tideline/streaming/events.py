"""CUSUM events, information bars and time bars of a stream of ticks (symbol, ts, price, volume).

CUSUM sums and bars depend on the order of ticks, which streams don't keep: rows are
put in order within a trigger, and a tick that comes in a later trigger than one
after it counts when it comes.  A tick without a price is passed over; one without a
volume has none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequential import BarIds, Cusum

_EVENT = "symbol string, t0 timestamp, side int, magnitude double"
_BAR = "symbol string, bar_id long, ts timestamp, open double, high double, low double, close double, volume double"


def _missing(x: float | None) -> bool:
    """Arrow hands a NULL over as NaN."""
    return x is None or x != x


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("ts", kind="stable")


def cusum_events(ticks: DataFrame, threshold: float) -> DataFrame:
    """Events as they fire.  Sums and the last price are the state; rows are put in order within a trigger."""
    fold = Cusum("r", threshold)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else {"sums": fold.state(), "price": None}
        rows, out = _ordered(batches), []
        for ts, price in zip(rows["ts"], rows["price"]):
            if _missing(price):
                continue
            last, own["price"] = own["price"], float(price)
            fired = fold.step(own["sums"], [(price - last) / last if last else None])[0]
            if fired is not None:
                out.append((key[0], ts, 1 if fired > 0 else -1, abs(fired)))
        state.update((json.dumps(own),))
        yield pd.DataFrame(out, columns=["symbol", "t0", "side", "magnitude"])

    return ticks.select("symbol", "ts", "price").groupBy("symbol").applyInPandasWithState(step, _EVENT, "state string", "append", GroupStateTimeout.NoTimeout)


def information_bars(ticks: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Bars as they close; the open bar is the state."""
    fold = BarIds(kind, threshold, "price", "volume")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else {"fold": fold.state(), "bar": None}
        rows, out = _ordered(batches), []
        for ts, price, volume in zip(rows["ts"], rows["price"], rows["volume"]):
            if _missing(price):
                continue
            price, volume = float(price), 0.0 if _missing(volume) else float(volume)
            number = fold.step(own["fold"], [price], [volume])[0]
            bar = own["bar"] or {"open": price, "high": price, "low": price, "volume": 0.0}
            bar = {"open": bar["open"], "high": max(bar["high"], price), "low": min(bar["low"], price), "volume": bar["volume"] + volume}
            own["bar"] = bar
            if own["fold"]["bar"] > number:
                out.append((key[0], number, ts, bar["open"], bar["high"], bar["low"], price, bar["volume"]))
                own["bar"] = None
        state.update((json.dumps(own),))
        yield pd.DataFrame(out, columns=["symbol", "bar_id", "ts", "open", "high", "low", "close", "volume"])

    return ticks.select("symbol", "ts", "price", "volume").groupBy("symbol").applyInPandasWithState(step, _BAR, "state string", "append", GroupStateTimeout.NoTimeout)


def time_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV of tumbling windows; rows later than the watermark are dropped."""
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("_w"))
    out = grouped.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
