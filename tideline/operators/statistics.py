"""Per-symbol statistics that need a regression: ADF test, optimal differencing order, GARCH."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.series import pct, project
from .sequential import frac_diff_weights

_ADF = "symbol string, adf_statistic double, p_value double, lags int, n_obs int, critical_1 double, critical_5 double, critical_10 double, is_stationary boolean"

# MacKinnon's published response surfaces for one series with a constant.
_CRITICAL = {1: (-3.43035, -6.5393, -16.786, -79.433), 5: (-2.86154, -2.8903, -4.234, -40.04), 10: (-2.56677, -1.5384, -2.809)}
_SMALL_P, _LARGE_P = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
_TAU_MAX, _TAU_MIN, _TAU_STAR = 2.74, -18.83, -1.61


def _p_value(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    terms = _SMALL_P if tau <= _TAU_STAR else _LARGE_P
    z = sum(c * tau**i for i, c in enumerate(terms))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ beta) ** 2).sum())
    scale = rss / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * scale, 0)), rss


def adf(values: np.ndarray) -> tuple | None:
    """(statistic, p, lags, observations, critical values) with a constant, lags by AIC; None for too short or constant series."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    n = len(x)
    most = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    if n < 10 or most < 0 or np.ptp(x) == 0:
        return None
    d = np.diff(x)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        columns = [x[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, lags + 1)] + [np.ones(len(d) - skip)]
        return d[skip:], np.column_stack(columns)

    best, least = 0, math.inf
    for lags in range(most + 1):
        y, z = design(lags, most)
        rss = _regress(y, z)[2]
        aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * z.shape[1]
        if aic < least:
            best, least = lags, aic
    y, z = design(best, best)
    beta, error, _ = _regress(y, z)
    tau = float(beta[0] / error[0]) if error[0] else -math.inf
    critical = [sum(c / len(y) ** i for i, c in enumerate(_CRITICAL[k])) for k in (1, 5, 10)]
    return tau, _p_value(tau), best, len(y), *critical


def adf_test(df: DataFrame, column: str = "close") -> DataFrame:
    """One row per symbol; all missing where the test can't be made."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        found = adf(pdf.sort_values("ts")["x"].to_numpy(float))
        row = [pdf["symbol"].iloc[0], *(found if found else [None] * 7), bool(found[1] < 0.05) if found else None]
        return pd.DataFrame([row], columns=["symbol", "adf_statistic", "p_value", "lags", "n_obs", "critical_1", "critical_5", "critical_10", "is_stationary"])

    return df.select("symbol", "ts", F.col(column).cast("double").alias("x")).groupBy("symbol").applyInPandas(test, _ADF)


def optimal_d(df: DataFrame, column: str = "close", low: float = 0.0, high: float = 1.0, step: float = 0.1, threshold: float = 1e-5) -> DataFrame:
    """symbol, d, p_value: the smallest order at which the differences are stationary, else the one of the smallest p.

    Orders are tried side by side, a group for each symbol and order.
    """
    grid = [round(low + i * step, 10) for i in range(int(round((high - low) / step)) + 1)]
    long = df.select("symbol", "ts", F.col(column).cast("double").alias("x"), F.explode(F.array(*map(F.lit, grid))).alias("d"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = pdf.sort_values("ts")["x"].to_numpy(float), frac_diff_weights(float(pdf["d"].iloc[0]), threshold)
        found = adf(np.convolve(x, w, "valid")) if len(x) > len(w) else None
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "d": [float(pdf["d"].iloc[0])], "p": [found[1] if found else None]})

    tried = long.groupBy("symbol", "d").applyInPandas(test, "symbol string, d double, p double")
    best = tried.groupBy("symbol").agg(F.min(F.when(F.col("p") < 0.05, F.col("d"))).alias("_first"), F.min_by("d", F.struct(F.coalesce("p", F.lit(2.0)), "d")).alias("_least"))
    chosen = best.select("symbol", F.coalesce("_first", "_least").alias("d"))
    return chosen.join(tried, ["symbol", "d"]).select("symbol", "d", F.col("p").alias("p_value"))


def garch(returns: np.ndarray) -> np.ndarray:
    """Conditional deviations of a GARCH(1,1) with a mean, by quasi maximum likelihood over a grid that narrows."""
    r = np.asarray(returns, float)
    e = r - r.mean()
    var = float(e.var()) or 1e-12

    def path(a: float, b: float) -> np.ndarray:
        h = np.empty(len(e))
        h[0] = var
        base = var * max(1 - a - b, 1e-6)
        for i in range(1, len(e)):
            h[i] = base + a * e[i - 1] ** 2 + b * h[i - 1]
        return h

    def loss(a: float, b: float) -> float:
        if a < 0 or b < 0 or a + b >= 0.9999:
            return math.inf
        h = path(a, b)
        return float((np.log(h) + e**2 / h).sum())

    a, b, width = 0.1, 0.8, 0.2
    for _ in range(6):
        a, b = min(((max(a + i * width / 2, 0.0), max(b + j * width / 2, 0.0)) for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2)), key=lambda p: loss(*p))
        width /= 2
    return np.sqrt(path(a, b))


def garch_volatility(df: DataFrame) -> DataFrame:
    """symbol, ts, garch_vol: GARCH(1,1) deviations of returns; symbols of fewer than 30 returns have none."""
    ready = project(df, {"r": pct(I.CLOSE)}, keep=["symbol", "ts"]).filter("r is not null")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        vol = garch(pdf["r"].to_numpy() * 100) / 100 if len(pdf) >= 30 else [None] * len(pdf)
        return pdf[["symbol", "ts"]].assign(garch_vol=vol)

    kind = dict(df.dtypes)["ts"]
    return ready.groupBy("symbol").applyInPandas(one, f"symbol string, ts {kind}, garch_vol double")
