"""Technical, volatility and microstructure series over bars (open, high, low, close, volume)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import functions as F

from .series import (
    EPS, Series, absolute, before, choose, col, cumulative, diff, ffill, fill, greatest, highest, lag, log, lowest, mean, pct, sign, sqrt, std, total, var,
)

OPEN, HIGH, LOW, CLOSE, VOLUME = map(col, ("open", "high", "low", "close", "volume"))
YEAR = 252

# Technical ----------------------------------------------------------------------------


def sma(x: Series = CLOSE, window: int = 20) -> Series:
    return mean(x, window)


def gains(x: Series) -> Series:
    d = diff(x)
    return choose((d > 0, d), default=0.0)


def losses(x: Series) -> Series:
    d = diff(x)
    return choose((d < 0, -d), default=0.0)


def rsi(x: Series = CLOSE, window: int = 14) -> Series:
    """Of simple means; the first row's change counts as none."""
    return 100.0 - 100.0 / (1.0 + mean(gains(x), window) / (mean(losses(x), window) + EPS))


def bollinger(x: Series = CLOSE, window: int = 20, width: float = 2.0) -> dict[str, Series]:
    middle, spread = mean(x, window), std(x, window)
    upper, lower = middle + width * spread, middle - width * spread
    return {"bb_upper": upper, "bb_middle": middle, "bb_lower": lower, "bb_width": upper - lower, "bb_pct": (x - lower) / (upper - lower + EPS)}


def bb_position(x: Series = CLOSE, window: int = 20, width: float = 2.0) -> Series:
    middle, spread = mean(x, window), std(x, window)
    return (x - (middle - width * spread)) / (2.0 * width * spread + EPS)


def true_range() -> Series:
    before_ = lag(CLOSE)
    return greatest(HIGH - LOW, absolute(HIGH - before_), absolute(LOW - before_))


def atr(window: int = 14) -> Series:
    return mean(true_range(), window)


def adx(window: int = 14) -> dict[str, Series]:
    """ADX and the two directional indices, of simple means throughout."""
    up, down = diff(HIGH), -diff(LOW)
    rises = choose(((up > down) & (up > 0), up), default=0.0)
    falls = choose(((down > up) & (down > 0), down), default=0.0)
    plus = 100.0 * (mean(rises, window) / atr(window))
    minus = 100.0 * (mean(falls, window) / atr(window))
    dx = 100.0 * absolute(plus - minus) / (plus + minus + EPS)
    return {"adx": mean(dx, window), "plus_di": plus, "minus_di": minus}


def stoch_raw(window: int = 14) -> Series:
    low = lowest(LOW, window)
    return 100.0 * (CLOSE - low) / (highest(HIGH, window) - low + EPS)


def stochastic(window: int = 14, smooth: int = 3, signal: int = 3) -> dict[str, Series]:
    k = mean(stoch_raw(window), smooth)
    return {"stoch_k": k, "stoch_d": mean(k, signal)}


def obv() -> Series:
    return cumulative(F.sum, fill(sign(diff(CLOSE)), 0.0) * VOLUME)


def typical() -> Series:
    return (HIGH + LOW + CLOSE) / 3.0


def vwap(window: int | None = None) -> Series:
    if window is None:
        return cumulative(F.sum, typical() * VOLUME) / cumulative(F.sum, VOLUME)
    return total(typical() * VOLUME, window) / total(VOLUME, window)


def acceleration(x: Series = CLOSE, window: int = 5) -> Series:
    return diff(pct(x), window)


def technical(windows: Sequence[int] = (5, 10, 20, 50)) -> dict[str, Series]:
    """The window part of the technical set; those of exponential means are operators.sequential.technical_features()."""
    out: dict[str, Series] = {}
    for w in windows:
        out[f"sma_{w}"] = mean(CLOSE, w)
        out[f"price_sma_ratio_{w}"] = CLOSE / mean(CLOSE, w)
    for w in (7, 14, 21):
        out[f"rsi_{w}"] = rsi(CLOSE, w)
    out |= bollinger()
    for w in (7, 14, 21):
        out[f"atr_{w}"] = atr(w)
    out |= adx() | stochastic() | {"obv": obv(), "vwap_20": vwap(20), "price_vwap_ratio": CLOSE / vwap(20)}
    for w in windows:
        out[f"momentum_{w}"] = pct(CLOSE, w)
        out[f"roc_{w}"] = (CLOSE - lag(CLOSE, w)) / lag(CLOSE, w)
    return out


# Volatility ---------------------------------------------------------------------------


def parkinson(window: int = 20, year: int = YEAR) -> Series:
    r = log(HIGH / LOW)
    return sqrt(mean(r * r / (4.0 * math.log(2)), window) * float(year))


def garman_klass(window: int = 20, year: int = YEAR) -> Series:
    hl, co = log(HIGH / LOW), log(CLOSE / OPEN)
    return sqrt(mean(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, window) * float(year))


def _rogers_satchell_term() -> Series:
    return log(HIGH / OPEN) * log(HIGH / CLOSE) + log(LOW / OPEN) * log(LOW / CLOSE)


def rogers_satchell(window: int = 20, year: int = YEAR) -> Series:
    return sqrt(mean(_rogers_satchell_term(), window) * float(year))


def yang_zhang(window: int = 20, year: int = YEAR) -> Series:
    """With the close-to-close variance in the weighted term."""
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    overnight, through = log(OPEN / lag(CLOSE)), log(CLOSE / lag(CLOSE))
    return sqrt((var(overnight, window) + k * var(through, window) + (1 - k) * mean(_rogers_satchell_term(), window)) * float(year))


def realized(x: Series | None = None, window: int = 20, year: int = YEAR) -> Series:
    return std(pct(CLOSE) if x is None else x, window) * math.sqrt(year)


# Microstructure -----------------------------------------------------------------------


def tick_rule(price: Series = CLOSE) -> Series:
    """Sign of the last change that wasn't zero; 0 before any."""
    d = diff(price)
    return fill(ffill(choose((d > 0, 1.0), (d < 0, -1.0))), 0.0)


def tick(price: Series = CLOSE) -> Series:
    """Sign of the change; 0 in the first row."""
    return fill(sign(diff(price)), 0.0)


def ofi(window: int = 20, price: Series = CLOSE, volume: Series = VOLUME) -> Series:
    return total(tick_rule(price) * volume, window)


def simple_ofi(window: int = 5) -> Series:
    return total(tick() * VOLUME, window)


def kyle_lambda(window: int = 20, price: Series = CLOSE, volume: Series = VOLUME) -> Series:
    """Slope of returns on signed volume over the rows before; carried forward."""
    r = pct(price)
    flow = tick_rule(price) * volume

    pairs = before(lambda a, b: F.count(F.when(b.isNotNull(), a)), window, r, flow, name="pairs")
    both = choose((r * 0.0 + 1.0 > 0, flow))  # flow where there is a return
    cov = before(F.covar_samp, window, r, flow)
    spread = before(F.var_samp, window, both)
    return ffill(choose(((pairs > 5) & (spread > 0), absolute(cov / (spread + EPS)))))


def effective_spread() -> Series:
    return (HIGH - LOW) / CLOSE


def roll_spread(window: int = 20, price: Series = CLOSE) -> Series:
    """From the covariance of successive changes over the rows before, not de-meaned; 0 if it isn't negative."""
    d = diff(price)
    cov = before(F.sum, window - 1, d * lag(d), least=window + 1) / float(window - 1)
    return choose((cov < 0, 2.0 * sqrt(-cov)), (cov >= 0, 0.0))


def amihud(window: int = 20, price: Series = CLOSE, volume: Series = VOLUME) -> Series:
    return mean(absolute(pct(price)) / (price * volume + EPS), window)


def micro_features(windows: Sequence[int] = (5, 10, 20)) -> dict[str, Series]:
    """All but vpin, which is sequential."""
    r = absolute(pct(CLOSE))
    out = {f"ofi_{w}": ofi(w) for w in windows} | {f"kyle_lambda_{w}": kyle_lambda(w) for w in windows}
    out |= {"effective_spread": effective_spread(), "roll_spread": roll_spread(20)} | {f"amihud_illiq_{w}": amihud(w) for w in windows}
    out |= {"volume_ma_20": mean(VOLUME, 20), "volume_std_20": std(VOLUME, 20), "volume_ratio": VOLUME / mean(VOLUME, 20)}
    out |= {f"price_impact_{w}": mean(r, w) / (mean(VOLUME, w) + EPS) for w in windows}
    return out | {f"trade_intensity_{w}": total(VOLUME, w) for w in windows}


def ofi_features(windows: Sequence[int] = (5, 10, 20, 50)) -> dict[str, Series]:
    out: dict[str, Series] = {}
    for w in windows:
        flow = ofi(w)
        out |= {f"ofi_{w}": flow, f"ofi_norm_{w}": flow / (std(flow, 2 * w) + EPS), f"ofi_change_{w}": diff(flow)}
    return out


def liquidity_features(windows: Sequence[int] = (10, 20, 50)) -> dict[str, Series]:
    out = {"effective_spread": effective_spread(), "roll_spread": roll_spread(20)}
    for w in windows:
        out |= {f"amihud_{w}": amihud(w), f"rel_spread_{w}": mean(effective_spread(), w), f"volume_vol_{w}": std(VOLUME, w)}
    return out


def impact_features(windows: Sequence[int] = (5, 10, 20)) -> dict[str, Series]:
    r, out = absolute(pct(CLOSE)), {}
    for w in windows:
        out |= {f"kyle_lambda_{w}": kyle_lambda(w), f"impact_per_dollar_{w}": mean(r, w) / (mean(CLOSE * VOLUME, w) + EPS), f"impact_per_volume_{w}": mean(r, w) / (mean(VOLUME, w) + EPS)}
    return out


def depth_features(windows: Sequence[int] = (10, 20, 50)) -> dict[str, Series]:
    out: dict[str, Series] = {}
    for w in windows:
        out |= {f"avg_volume_{w}": mean(VOLUME, w), f"volume_concentration_{w}": highest(VOLUME, w) / (total(VOLUME, w) + EPS), f"depth_ratio_{w}": mean(VOLUME, w) / (mean(HIGH - LOW, w) + EPS)}
    return out


def tick_features(windows: Sequence[int] = (10, 20, 50)) -> dict[str, Series]:
    t, out = tick(), {}
    for w in windows:
        out |= {f"tick_imbalance_{w}": total(t, w), f"uptick_pct_{w}": total(choose((t > 0, 1.0), default=0.0), w) / float(w), f"tick_vol_{w}": std(t, w)}
    return out


def basic_features() -> dict[str, Series]:
    """What a fetch adds to bars."""
    ratio = CLOSE / lag(CLOSE)
    return {
        "returns": pct(CLOSE), "log_returns": choose((ratio > 0, log(ratio)), default=0.0), "dollar_volume": CLOSE * VOLUME,
        "hl_range": HIGH - LOW, "oc_range": absolute(CLOSE - OPEN),
        "price_momentum_5": pct(CLOSE, 5), "price_momentum_20": pct(CLOSE, 20), "volume_ma_20": mean(VOLUME, 20), "volume_ratio": VOLUME / mean(VOLUME, 20),
    }


def volatility_features(window: int = 20) -> dict[str, Series]:
    """All but the exponentially weighted one, which is sequential."""
    return {"parkinson": parkinson(window), "garman_klass": garman_klass(window), "rogers_satchell": rogers_satchell(window), "yang_zhang": yang_zhang(window), "realized": realized(window=window)}

