"""Seven strategies: signals (-1, 0, 1), features, strength (0 to 1), favourable regimes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.indicators import CLOSE, HIGH, LOW, VOLUME
from ..functions.series import (
    EPS, Series, absolute, as_int, before, choose, clip, col, corr, cumulative, diff, fill, highest, lag, log, lowest, mean, pct, project, rank_pct, sign, sqrt, std, total, var, zscore,
)


def _strength(x: Series, window: int = 50) -> Series:
    return clip(absolute(x) / (highest(absolute(x), window) + EPS), 0.0, 1.0)


class Strategy:
    name: ClassVar[str]
    favours: ClassVar[tuple[str, ...]] = ()

    def signal(self) -> Series:
        raise NotImplementedError

    def features(self) -> dict[str, Series]:
        raise NotImplementedError

    def strength(self) -> Series:
        raise NotImplementedError

    def signals(self, bars: DataFrame) -> DataFrame:
        """symbol, ts, strategy, signal."""
        out = project(bars, {"signal": as_int(self.signal())}, keep=["symbol", "ts"])
        return out.select("symbol", "ts", F.lit(self.name).alias("strategy"), "signal")

    def feature_frame(self, bars: DataFrame) -> DataFrame:
        return project(bars, self.features(), keep=["symbol", "ts"])

    def strengths(self, bars: DataFrame) -> DataFrame:
        return project(bars, {"strength": self.strength()}, keep=["symbol", "ts"])

    def favourable(self, regime: Column) -> Column:
        """The regime's label contains one of those that the strategy favours."""
        out = F.lit(False)
        for part in self.favours:
            out = out | regime.contains(part)
        return out


@dataclass
class Momentum(Strategy):
    lookback: int = 20
    threshold: float = 0.02
    use_volume_confirmation: bool = True
    name: ClassVar[str] = "momentum"
    favours: ClassVar = ("trending", "trending_normal_vol", "trending_high_volume")

    def signal(self):
        m = pct(CLOSE, self.lookback)
        out = choose((m > self.threshold, 1), (m < -self.threshold, -1), default=0)
        return choose((VOLUME > mean(VOLUME, self.lookback), out), default=0) if self.use_volume_confirmation else out

    def features(self):
        fast, slow, r = mean(CLOSE, 20), mean(CLOSE, 50), pct(CLOSE)
        return {f"momentum_{n}": pct(CLOSE, n) for n in (5, 10, 20, 50)} | {
            "roc_20": (CLOSE - lag(CLOSE, 20)) / lag(CLOSE, 20), "sma_20": fast, "sma_50": slow, "ma_cross": choose((fast > slow, 1), default=0), "price_sma_ratio": CLOSE / fast,
            "momentum_strength": absolute(pct(CLOSE, 20)), "trend_consistency": mean(choose((r > 0, 1.0), (r <= 0, 0.0)), 20), "volume_trend": pct(VOLUME, self.lookback)}

    def strength(self):
        return _strength(pct(CLOSE, self.lookback))


@dataclass
class MeanReversion(Strategy):
    window: int = 20
    zscore_threshold: float = 2.0
    use_bb: bool = True
    name: ClassVar[str] = "mean_reversion"
    favours: ClassVar = ("ranging", "ranging_low_vol", "ranging_normal_vol")

    def signal(self):
        if self.use_bb:
            bands = I.bollinger(CLOSE, self.window)
            return choose((CLOSE > bands["bb_upper"], -1), (CLOSE < bands["bb_lower"], 1), default=0)
        z = zscore(CLOSE, self.window)
        return choose((z > self.zscore_threshold, -1), (z < -self.zscore_threshold, 1), default=0)

    def features(self):
        r = pct(CLOSE)
        out = {f"zscore_{n}": zscore(CLOSE, n) for n in (10, 20, 50)} | {"bb_position": I.bb_position(CLOSE, self.window)}
        out |= {f"mean_distance_{n}": (CLOSE - mean(CLOSE, n)) / mean(CLOSE, n) for n in (10, 20, 50)}
        full = choose((total(choose((r > -math.inf, 1.0)), 20) > 0, corr(r, lag(r), 19)))
        return out | {"rsi": I.rsi(), "stoch": I.stoch_raw(), "mean_reversion_speed": full}

    def strength(self):
        return _strength(zscore(CLOSE, self.window))


@dataclass
class Volatility(Strategy):
    window: int = 20
    vol_threshold: float = 0.02  # has no effect
    use_vol_breakout: bool = True
    name: ClassVar[str] = "volatility"
    favours: ClassVar = ("high_vol", "trending_high_vol")

    def signal(self):
        vol = std(pct(CLOSE), self.window)
        middle, spread = mean(vol, 2 * self.window), std(vol, 2 * self.window)
        if self.use_vol_breakout:
            on, way = vol > middle + spread, mean(pct(CLOSE), 5)
        else:
            on, way = vol < middle - spread, CLOSE - mean(CLOSE, 20)
        return choose((on & (way < 0.0), -1), (on & (way > 0.0), 1), default=0)

    def features(self):
        r, hl, co = pct(CLOSE), log(HIGH / LOW), log(CLOSE / I.OPEN)
        vol = std(r, 20)
        return {f"vol_realized_{n}": std(r, n) for n in (5, 10, 20, 50)} | {
            "vol_parkinson": std(hl, self.window), "vol_garman_klass": sqrt(mean(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, self.window)), "vol_regime": fill(vol / mean(vol, 50), 1.0),
            "vol_change": pct(vol), "atr": I.atr(14), "atr_ratio": I.atr(14) / CLOSE, "vol_percentile": rank_pct(vol, 100), "intraday_range": I.effective_spread()}

    def strength(self):
        vol = std(pct(CLOSE), self.window)
        middle = mean(vol, 2 * self.window)
        return _strength(absolute(vol - middle) / (middle + EPS))


@dataclass
class Scalping(Strategy):
    tick_threshold: float = 0.005
    holding_period: int = 1  # has no effect
    use_spread: bool = True
    name: ClassVar[str] = "scalping"
    favours: ClassVar = ("high_volume", "tight", "trending_high_volume")

    def signal(self):
        flow, way = I.simple_ofi(5), mean(pct(CLOSE), 3)
        cases = [((flow < 0.0) & (way < -self.tick_threshold), -1), ((flow > 0.0) & (way > self.tick_threshold), 1)]
        if self.use_spread:
            spread = I.effective_spread()
            cases.insert(0, (spread > mean(spread, 20), 0))
        return choose(*cases, default=0)

    def features(self):
        spread, way, r = I.effective_spread(), sign(diff(CLOSE)), pct(CLOSE)
        return {f"momentum_{n}": pct(CLOSE, n) for n in (1, 2, 3, 5)} | {"tick_direction": way} | {f"ofi_{n}": I.simple_ofi(n) for n in (3, 5, 10)} | {
            "spread": spread, "spread_ma": mean(spread, 20), "spread_ratio": spread / mean(spread, 20), "volume_surge": VOLUME / mean(VOLUME, 10), "price_velocity": diff(CLOSE) / lag(CLOSE),
            "microstructure_noise": 1.0 - var(r, 40) / (2.0 * var(r, 20) + EPS)} | {f"tick_imbalance_{n}": total(way, n) for n in (5, 10, 20)} | {
            "near_high": fill(CLOSE / highest(HIGH, 5), 1.0), "near_low": fill(CLOSE / lowest(LOW, 5), 1.0)}

    def strength(self):
        return _strength(I.simple_ofi(5))

    @staticmethod
    def costs(signals: DataFrame, spread: float = 0.001, commission: float = 0.0) -> DataFrame:
        """signals with cost: paid where the signal changes."""
        moved = absolute(diff(col("signal"))) > 0
        return project(signals, {"cost": choose((moved, spread + commission), default=0.0)})


@dataclass
class Sentiment(Strategy):
    sentiment_window: int = 20
    threshold: float = 1.5
    name: ClassVar[str] = "sentiment"
    favours: ClassVar = ("high_vol", "trending", "ranging")

    def score(self) -> Series:
        n, d = self.sentiment_window, diff(CLOSE)
        # in the first row, whose change is missing, volume counts on both sides
        up, down = total(choose((d <= 0, 0.0), default=VOLUME), n), total(choose((d >= 0, 0.0), default=VOLUME), n)
        high, low = highest(HIGH, n), lowest(LOW, n)
        place = ((CLOSE - low) / (high - low + EPS) - 0.5) * 2.0
        return 0.3 * ((up - down) / (up + down + EPS)) + 0.3 * zscore(pct(CLOSE, n), 50) + 0.2 * -pct(std(pct(CLOSE), n), n) + 0.2 * place

    def signal(self):
        z = zscore(self.score(), 2 * self.sentiment_window)
        return choose((z < -self.threshold, 1), (z > self.threshold, -1), default=0)

    def features(self):
        s, d, r = self.score(), diff(CLOSE), pct(CLOSE)
        up, down = choose((d > 0, VOLUME), default=0.0), choose((d < 0, VOLUME), default=0.0)
        vol = std(r, 20)
        out = {"sentiment_score": s} | {f"volume_sentiment_{n}": (total(up, n) - total(down, n)) / (total(up, n) + total(down, n) + EPS) for n in (5, 10, 20)}
        out |= {"put_call_proxy": total(down, 20) / (total(up, 20) + EPS), "fear_index": vol / mean(vol, 50), "advance_decline": cumulative(F.sum, I.tick())}
        out |= {f"sentiment_percentile_{n}": rank_pct(s, n) for n in (20, 50)}
        bulls, bears = choose((r > 0, 1.0), default=0.0), choose((r < 0, 1.0), default=0.0)
        return out | {"sentiment_change": diff(s), "sentiment_acceleration": diff(diff(s)), "bull_bear_spread": mean(bulls, 20) - mean(bears, 20)}

    def strength(self):
        return _strength(self.score())

    def extremes(self, bars: DataFrame) -> DataFrame:
        """symbol, ts, sentiment, zscore, is_extreme, extreme_type."""
        s = self.score()
        z = zscore(s, 50)
        kind = choose((z < -self.threshold, "extreme_bearish"), (z > self.threshold, "extreme_bullish"), default="neutral")
        return project(bars, {"sentiment": s, "zscore": z, "is_extreme": choose((absolute(z) > self.threshold, True), default=False), "extreme_type": kind}, keep=["symbol", "ts"])


@dataclass
class Seasonality(Strategy):
    use_day_of_week: bool = True
    use_month: bool = True
    use_time_of_day: bool = False
    name: ClassVar[str] = "seasonality"

    @staticmethod
    def _returns(bars: DataFrame) -> DataFrame:
        return project(bars, {"returns": pct(CLOSE)}).withColumns({"dow": F.weekday("ts"), "month": F.month("ts"), "hour": F.hour("ts")})

    def fit(self, bars: DataFrame) -> DataFrame:
        """symbol, kind (dow, month, hour), slot, mean_return; one pass over grouping sets."""
        kinds = [k for k, on in (("dow", self.use_day_of_week), ("month", self.use_month), ("hour", self.use_time_of_day)) if on]
        long = self._returns(bars).select("symbol", "returns", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("slot")) for k in kinds))).alias("_k"))
        return long.groupBy("symbol", F.col("_k.kind").alias("kind"), F.col("_k.slot").alias("slot")).agg(F.avg("returns").alias("mean_return"))

    def _looked_up(self, bars: DataFrame, patterns: DataFrame | None) -> DataFrame:
        out = self._returns(bars)
        for kind in ("dow", "month"):
            if patterns is None:
                out = out.withColumn(f"_{kind}", F.lit(0.0))
            else:
                one = patterns.filter(F.col("kind") == kind).select(F.col("symbol"), F.col("slot").alias(kind), F.col("mean_return").alias(f"_{kind}"))
                out = out.join(one, ["symbol", kind], "left").withColumn(f"_{kind}", F.coalesce(f"_{kind}", F.lit(0.0)))
        return out

    def signals(self, bars: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
        """0 without fitted patterns; hours are fitted but not scored."""
        scored = self._looked_up(bars, patterns).withColumn("_s", F.col("_dow") + F.col("_month"))
        scored = scored.withColumn("_sd", F.stddev_samp("_s").over(Window.partitionBy("symbol")))
        signal = F.when((F.col("_sd") > 0) & (F.col("_s") > F.col("_sd")), 1).when((F.col("_sd") > 0) & (F.col("_s") < -F.col("_sd")), -1).otherwise(0)
        return scored.select("symbol", "ts", F.lit(self.name).alias("strategy"), signal.cast("int").alias("signal"))

    def feature_frame(self, bars: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
        out, day = self._looked_up(bars, patterns), F.dayofmonth("ts")
        recent = F.avg("returns").over(Window.partitionBy("symbol", "dow").orderBy("ts").rowsBetween(-3, 0))
        out = out.withColumn("_recent", recent)
        cols = {f"dow_{d}": (F.col("dow") == d).cast("int") for d in range(5)} | {f"month_{m}": (F.col("month") == m).cast("int") for m in range(1, 13)}
        cols |= {"week_of_month": F.floor((day - 1) / 7).cast("int"), "is_month_start": (day <= 5).cast("int"), "is_month_end": (day >= 25).cast("int"), "quarter": F.quarter("ts")}
        if patterns is not None:
            cols |= {"seasonal_dow_return": F.col("_dow"), "seasonal_month_return": F.col("_month")}
        cols |= {f"recent_dow_{d}_return": F.coalesce(F.when(F.col("dow") == d, F.col("_recent")), F.lit(0.0)) for d in range(5)}
        return out.select("symbol", "ts", *(c.alias(n) for n, c in cols.items()))

    def strengths(self, bars: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
        out = self._looked_up(bars, patterns).withColumn("_s", F.abs("_dow")).withColumn("_top", F.max("_s").over(Window.partitionBy("symbol")))
        return out.select("symbol", "ts", F.when(F.col("_top") > 0, F.col("_s") / F.col("_top")).otherwise(0.0).alias("strength"))

    def favourable(self, regime: Column) -> Column:
        return F.lit(True)

    def anomalies(self, bars: DataFrame) -> DataFrame:
        """symbol, monday_effect, month_end_effect, january_effect: differences of mean returns."""
        r, day = F.col("returns"), F.dayofmonth("ts")
        gap = lambda a, b: F.avg(F.when(a, r)) - F.avg(F.when(b, r))
        return self._returns(bars).groupBy("symbol").agg(
            gap(F.col("dow") == 0, F.col("dow") != 0).alias("monday_effect"), gap(day >= 25, (day >= 10) & (day <= 20)).alias("month_end_effect"), gap(F.col("month") == 1, F.col("month") != 1).alias("january_effect"))


@dataclass
class Pairs(Strategy):
    """Over pair bars: symbol (of the pair), ts, price1, price2; see pair_bars()."""

    window: int = 60
    entry_threshold: float = 2.0
    exit_threshold: float = 0.5
    name: ClassVar[str] = "pairs"
    favours: ClassVar = ("ranging", "normal_vol", "low_vol")

    @staticmethod
    def spread() -> Series:
        return log(col("price1")) - log(col("price2"))

    def hedged_spread(self, pair: DataFrame) -> DataFrame:
        """pair with spread = price1 - h price2, h from the last ``window`` rows."""
        place = Window.partitionBy("symbol").orderBy(F.desc("ts"))
        last = pair.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= self.window)
        ratio = last.groupBy("symbol").agg(F.try_divide(F.sum(F.col("price1") * F.col("price2")), F.sum(F.col("price2") * F.col("price2"))).alias("hedge_ratio"))
        return pair.join(ratio, "symbol").withColumn("spread", F.col("price1") - F.col("hedge_ratio") * F.col("price2"))

    def signal(self):
        z = zscore(self.spread(), self.window)
        return choose((absolute(z) < self.exit_threshold, 0), (z < -self.entry_threshold, 1), (z > self.entry_threshold, -1), default=0)

    def half_life(self, window: int = 60) -> Series:
        """-ln 2 over the slope of changes on levels in the rows before; infinite if it isn't negative."""
        s = self.spread()
        level, d = lag(s), diff(s)
        up, down = before(F.sum, window - 1, d * level, least=window), before(F.sum, window - 1, level * level, least=window)
        slope = up / down
        return choose((slope < 0, -math.log(2) / slope), (slope >= 0, math.inf))

    def coint_score(self, window: int = 100) -> Series:
        """Size of the correlation of successive changes in the rows before."""
        d = diff(self.spread())
        return absolute(before(F.corr, window - 2, d, lag(d), least=window))

    def hedge_ratio(self, window: int | None = None) -> Series:
        w = window or self.window
        p, q = col("price1"), col("price2")
        return before(F.sum, w, p * q) / before(F.sum, w, q * q)

    def features(self):
        s = self.spread()
        return {"spread": s, "spread_zscore": zscore(s, self.window)} | {f"correlation_{n}": corr(col("price1"), col("price2"), n) for n in (20, 60, 120)} | {
            "spread_vol": std(s, 20), "half_life": self.half_life(), "coint_score": self.coint_score(), "hedge_ratio": self.hedge_ratio()}

    def strength(self):
        return clip(absolute(zscore(self.spread(), self.window)) / self.entry_threshold, 0.0, 1.0)


def pair_bars(bars: DataFrame, first: str, second: str) -> DataFrame:
    """symbol "first/second", ts, price1, price2 where both have a bar."""
    a = bars.filter(F.col("symbol") == first).select("ts", F.col("close").alias("price1"))
    b = bars.filter(F.col("symbol") == second).select("ts", F.col("close").alias("price2"))
    return a.join(b, "ts").select(F.lit(f"{first}/{second}").alias("symbol"), "ts", "price1", "price2")


ALL_STRATEGIES: tuple[type[Strategy], ...] = (Momentum, MeanReversion, Volatility, Pairs, Seasonality, Scalping, Sentiment)
