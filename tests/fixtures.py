"""Small bars, and pandas forms of them."""

import numpy as np
import pandas as pd


def walk(symbol: str = "A", n: int = 200, seed: int = 1) -> pd.DataFrame:
    draw = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(draw.normal(0, 0.02, n)))
    open_ = close * np.exp(draw.normal(0, 0.005, n))
    high, low = np.maximum(open_, close) * (1 + draw.random(n) * 0.01), np.minimum(open_, close) * (1 - draw.random(n) * 0.01)
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2022-01-03", periods=n, freq="D"), "open": open_, "high": high, "low": low, "close": close, "volume": draw.integers(0, 1000, n).astype(float)})


def frame(spark, *pdfs: pd.DataFrame, seed: int = 0):
    """The rows of all, in random order."""
    every = pd.concat(pdfs).sample(frac=1, random_state=seed)
    rows = [(r[0], r[1].to_pydatetime(), *map(float, r[2:])) for r in every.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def column(df, name: str, symbol: str = "A", by: str = "ts") -> np.ndarray:
    """Values of a symbol in order, missing ones as NaN."""
    rows = df.filter(df.symbol == symbol).orderBy(by).select(name).collect()
    return np.array([np.nan if r[0] is None else float(r[0]) for r in rows])
