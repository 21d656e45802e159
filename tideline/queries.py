"""The engine's queries over the test tables, and the SQL that says the same.

A query is registered with its doubles, which both sides round to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import indicators as I
from .functions.series import col, mean, pct, project
from .operators import bandit, ensemble, evaluation, features, labels, models, regimes, statistics
from .operators import sequential as seq
from .operators import strategies as S
from .operators.portfolio import Allocator, Execution, Risk
from .sources import market

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Places of queries whose doubles have the size of prices; 6 for the others.
PLACES = dict.fromkeys(("sma_bollinger", "atr", "ema_macd", "ema_slope", "frac_diff", "stationary_diff", "momentum_features", "bar_threshold", "accumulated", "metrics"), 4)


#: Added before rounding to four places: averages of prices in cents stand half way between two such numbers now and then.
OFF_HALF = 3.3e-7


def _rounded(df: DataFrame, places: int) -> DataFrame:
    off = OFF_HALF if places == 4 else 0.0
    return df.select(*((F.round(F.col(f"`{c}`") + off, places) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _register(name: str, query: Query, sql: str | None = None, doubles: str = "") -> None:
    places = PLACES.get(name, 6)
    QUERIES[name] = lambda spark, sf: _rounded(query(spark, sf), places)
    if sql:
        off = f" + {OFF_HALF!r}::DOUBLE" if places == 4 else ""
        swap = ", ".join(f"round({c}{off}, {places}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
        body, _, last = sql.rpartition("\nSELECT ")
        inner = f"{body}, result_ AS (SELECT {last})" if body.lstrip().upper().startswith("WITH") else f"WITH result_ AS (SELECT {last})"
        SQL[name] = f"{inner} SELECT * {f'REPLACE ({swap})' if swap else ''} FROM result_"


# SQL pieces ---------------------------------------------------------------------------

W = "PARTITION BY symbol ORDER BY ts"


def _r(agg: str, x: str, n: int) -> str:
    rows = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {rows} = {n} THEN {agg}({x}) {rows} END)"


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def _pct(x: str, k: int = 1) -> str:
    return f"({x} / nullif({_lag(x, k)}, 0) - 1.0)"


_BAR = """{symbol} AS symbol, o_orderdate::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey)::DOUBLE AS open, max(o_totalprice)::DOUBLE AS high,
 min(o_totalprice)::DOUBLE AS low, arg_max(o_totalprice, o_orderkey)::DOUBLE AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2"""
BARS = "bars AS (SELECT " + _BAR.format(symbol="o_orderpriority") + ")"
BARS_ALL = "bars AS (SELECT " + _BAR.format(symbol="'ALL'") + ")"
TICKS = "ticks AS (SELECT event_type AS symbol, ts::TIMESTAMP AS ts, value::DOUBLE AS price, (props::JSON->>'$.k')::DOUBLE AS volume FROM events)"
HOURS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts::TIMESTAMP)::TIMESTAMP AS ts, arg_min(value::DOUBLE, (ts, event_id)) AS open, max(value)::DOUBLE AS high,
 min(value)::DOUBLE AS low, arg_max(value::DOUBLE, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
RETURNS = f"r AS (SELECT *, {_pct('close')} AS returns FROM bars)"
bars, bars_all, ticks = market.order_bars, market.order_bars_all, market.event_ticks


def _series(name: str, outputs: Callable[[], dict], sql: str, source: Query = bars) -> None:
    doubles = " ".join(outputs())
    _register(name, lambda spark, sf: project(source(spark, sf), outputs(), keep=["symbol", "ts"]), sql, doubles)


# Sources ------------------------------------------------------------------------------

_register("ohlcv_daily", bars, f"WITH {BARS}\nSELECT * FROM bars", "open high low close volume")
_register("ohlcv_hourly", market.event_bars, f"WITH {HOURS}\nSELECT * FROM bars", "open high low close volume")
_register("event_ticks", ticks, f"WITH {TICKS}\nSELECT * FROM ticks", "price volume")
_series("basic_features", I.basic_features, f"""WITH {BARS}
SELECT symbol, ts, {_pct('close')} AS returns, CASE WHEN close / nullif({_lag('close')}, 0) > 0 THEN ln(close / {_lag('close')}) ELSE 0 END AS log_returns, close * volume AS dollar_volume,
 high - low AS hl_range, abs(close - open) AS oc_range, {_pct('close', 5)} AS price_momentum_5, {_pct('close', 20)} AS price_momentum_20, {_r('avg', 'volume', 20)} AS volume_ma_20,
 volume / {_r('avg', 'volume', 20)} AS volume_ratio FROM bars""")
_register("bar_properties", lambda spark, sf: bars(spark, sf).select("symbol", "ts", *(c.alias(n) for n, c in market.bar_columns().items())), f"""WITH {BARS}
SELECT symbol, ts, (high + low + close) / 3.0 AS typical_price, high - low AS "range", abs(close - open) AS body FROM bars""", "typical_price body range")
_register("latest_bars", lambda spark, sf: market.latest(bars(spark, sf), 3), f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars)
SELECT symbol, ts, open, high, low, close, volume FROM n WHERE n <= 3""", "open high low close volume")

# Returns and stationarity -------------------------------------------------------------

_series("returns", lambda: {"log_return": I.log(I.CLOSE / I.lag(I.CLOSE)), "simple_return": pct(I.CLOSE)}, f"""WITH {BARS}
SELECT symbol, ts, ln(close / {_lag('close')}) AS log_return, {_pct('close')} AS simple_return FROM bars""")
_register("accumulated", lambda spark, sf: seq.accumulated(project(bars(spark, sf), {"returns": pct(I.CLOSE) * 0.001}, keep=["symbol", "ts"])), f"""WITH {BARS}, r AS (SELECT symbol, ts, {_pct('close')} * 0.001 AS returns FROM bars)
SELECT symbol, ts, returns, product(1 + returns) OVER c - 1 AS cum_return, avg(returns) OVER c AS expanding_mean, stddev_samp(returns) OVER c AS expanding_std FROM r WINDOW c AS ({W} ROWS UNBOUNDED PRECEDING)""", "returns cum_return expanding_mean expanding_std")
_WEIGHTS = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(seq.frac_diff_weights(0.9, 1e-4).tolist()))
_NW = len(seq.frac_diff_weights(0.9, 1e-4))
_register("frac_diff", lambda spark, sf: seq.with_frac_diff(bars_all(spark, sf), 0.9, 1e-4).select("symbol", "ts", "frac_diff"), f"""WITH {BARS_ALL}, w(k, w) AS (VALUES {_WEIGHTS}), n AS (SELECT *, row_number() OVER ({W}) AS i FROM bars),
d AS (SELECT a.symbol, a.ts, sum(w.w * b.close) AS y FROM n a JOIN w ON true JOIN n b ON b.symbol = a.symbol AND b.i = a.i - w.k WHERE a.i >= {_NW} GROUP BY 1, 2)
SELECT n.symbol, n.ts, d.y AS frac_diff FROM n LEFT JOIN d USING (symbol, ts)""", "frac_diff")
_register("stationary_diff", lambda spark, sf: seq.stationary(bars(spark, sf), "diff").select("symbol", "ts", "stationary"), f"WITH {BARS}\nSELECT symbol, ts, close - {_lag('close')} AS stationary FROM bars", "stationary")
_register("adf_test", lambda spark, sf: statistics.adf_test(bars(spark, sf)))
_register("optimal_d", lambda spark, sf: statistics.optimal_d(bars_all(spark, sf), low=0.7, high=1.0, threshold=1e-3))
_register("garch_volatility", lambda spark, sf: statistics.garch_volatility(bars_all(spark, sf)))

# Technical ----------------------------------------------------------------------------

_series("sma_bollinger", lambda: {"sma_20": mean(I.CLOSE, 20), **I.bollinger()}, f"""WITH {BARS}, s AS (SELECT symbol, ts, close, {_r('avg', 'close', 20)} AS m, {_r('stddev_samp', 'close', 20)} AS s FROM bars)
SELECT symbol, ts, m AS sma_20, m + 2 * s AS bb_upper, m AS bb_middle, m - 2 * s AS bb_lower, 4 * s AS bb_width, (close - (m - 2 * s)) / (4 * s + 1e-10) AS bb_pct FROM s""")
_GAIN = f"g AS (SELECT *, CASE WHEN close > {_lag('close')} THEN close - {_lag('close')} ELSE 0 END AS gain, CASE WHEN close < {_lag('close')} THEN {_lag('close')} - close ELSE 0 END AS loss FROM bars)"
_series("rsi", lambda: {"rsi_14": I.rsi()}, f"WITH {BARS}, {_GAIN}\nSELECT symbol, ts, 100 - 100 / (1 + {_r('avg', 'gain', 14)} / ({_r('avg', 'loss', 14)} + 1e-10)) AS rsi_14 FROM g")
_TR = f"t AS (SELECT *, greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) AS tr, high - {_lag('high')} AS up, {_lag('low')} - low AS down FROM bars)"
_series("atr", lambda: {"atr_14": I.atr()}, f"WITH {BARS}, {_TR}\nSELECT symbol, ts, {_r('avg', 'tr', 14)} AS atr_14 FROM t")
_ADX = f"""{_TR}, m AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mm FROM t),
di AS (SELECT *, 100 * {_r('avg', 'pm', 14)} / nullif({_r('avg', 'tr', 14)}, 0) AS plus_di, 100 * {_r('avg', 'mm', 14)} / nullif({_r('avg', 'tr', 14)}, 0) AS minus_di FROM m),
x AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10) AS dx FROM di), a AS (SELECT *, {_r('avg', 'dx', 14)} AS adx FROM x)"""
_series("adx", I.adx, f"WITH {BARS}, {_ADX}\nSELECT symbol, ts, adx, plus_di, minus_di FROM a")
_K = f"k AS (SELECT *, 100 * (close - {_r('min', 'low', 14)}) / ({_r('max', 'high', 14)} - {_r('min', 'low', 14)} + 1e-10) AS raw FROM bars), ks AS (SELECT *, {_r('avg', 'raw', 3)} AS stoch_k FROM k)"
_series("stochastic", I.stochastic, f"WITH {BARS}, {_K}\nSELECT symbol, ts, stoch_k, {_r('avg', 'stoch_k', 3)} AS stoch_d FROM ks")
_series("obv", lambda: {"obv": I.obv()}, f"WITH {BARS}, d AS (SELECT *, coalesce(sign(close - {_lag('close')}), 0) * volume AS f FROM bars)\nSELECT symbol, ts, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING)::DOUBLE AS obv FROM d")
_series("vwap", lambda: {"price_vwap": I.CLOSE / I.vwap(), "price_vwap_20": I.CLOSE / I.vwap(20)}, f"""WITH {BARS}, p AS (SELECT *, (high + low + close) / 3.0 * volume AS pv FROM bars)
SELECT symbol, ts, close / (sum(pv) OVER c / sum(volume) OVER c) AS price_vwap, close / ({_r('sum', 'pv', 20)} / {_r('sum', 'volume', 20)}) AS price_vwap_20 FROM p WINDOW c AS ({W} ROWS UNBOUNDED PRECEDING)""")
_series("momentum_roc", lambda: {"momentum_20": pct(I.CLOSE, 20), "roc_20": (I.CLOSE - I.lag(I.CLOSE, 20)) / I.lag(I.CLOSE, 20), "acceleration": I.acceleration()}, f"""WITH {BARS}, r AS (SELECT *, {_pct('close')} AS r FROM bars)
SELECT symbol, ts, {_pct('close', 20)} AS momentum_20, (close - {_lag('close', 20)}) / {_lag('close', 20)} AS roc_20, r - {_lag('r', 5)} AS acceleration FROM r""")


def _ema_sql(source: str, x: str, spans: dict[str, int]) -> str:
    """Rows of source with an exponential mean for each name, by recursion."""
    first = ", ".join(f"{x} AS {n}" for n in spans)
    step = ", ".join(f"(1 - 2.0::DOUBLE / {s + 1}) * e.{n} + 2.0::DOUBLE / {s + 1} * o.{x} AS {n}" for n, s in spans.items())
    return f"o AS (SELECT *, row_number() OVER ({W}) AS i FROM {source}), e AS (SELECT symbol, ts, i, {first} FROM o WHERE i = 1 UNION ALL SELECT o.symbol, o.ts, o.i, {step} FROM e JOIN o ON o.symbol = e.symbol AND o.i = e.i + 1)"


_register("ema_macd", lambda spark, sf: seq.macd(seq.with_ema(bars_all(spark, sf), "close", 20, "ema_20")).select("symbol", "ts", "ema_20", "macd", "macd_signal", "macd_histogram"), f"""WITH RECURSIVE {BARS_ALL}, {_ema_sql('bars', 'close', {'ema_20': 20, 'f': 12, 's': 26})},
o2 AS (SELECT symbol, ts, i, ema_20, f - s AS macd FROM e), e2 AS (SELECT symbol, ts, i, ema_20, macd, macd AS sig FROM o2 WHERE i = 1 UNION ALL SELECT o2.symbol, o2.ts, o2.i, o2.ema_20, o2.macd, 0.8::DOUBLE * e2.sig + 0.2::DOUBLE * o2.macd FROM e2 JOIN o2 ON o2.symbol = e2.symbol AND o2.i = e2.i + 1)
SELECT symbol, ts, ema_20, macd, sig AS macd_signal, macd - sig AS macd_histogram FROM e2""", "ema_20 macd macd_signal macd_histogram")
_register("ema_slope", lambda spark, sf: seq.ema_slope(bars_all(spark, sf)).select("symbol", "ts", "ema_slope"), f"WITH RECURSIVE {BARS_ALL}, {_ema_sql('bars', 'close', {'y': 50})}\nSELECT symbol, ts, (y - {_lag('y', 5)}) / 5 AS ema_slope FROM e", "ema_slope")
_EWS = f"""{RETURNS}, n AS (SELECT symbol, ts, returns, row_number() OVER ({W}) AS i FROM r), m AS (SELECT a.symbol, a.ts, sum(w) AS sw, sum(w * w) AS sw2, sum(w * x) / sum(w) AS mu, count(*) AS c, list(struct_pack(w := w, x := x)) AS l
 FROM (SELECT a.symbol, a.ts, pow(1 - 2.0::DOUBLE / 101, a.i - b.i) AS w, b.returns AS x FROM n a JOIN n b ON b.symbol = a.symbol AND b.i <= a.i AND b.returns IS NOT NULL) a GROUP BY 1, 2),
v AS (SELECT symbol, ts, CASE WHEN c > 1 THEN sqrt(list_sum(list_transform(l, lambda q: q.w * (q.x - mu) * (q.x - mu))) / (sw - sw2 / sw)) END AS daily_vol FROM m)"""
_register("ewm_volatility", lambda spark, sf: seq.daily_volatility(bars_all(spark, sf)).select("symbol", "ts", "daily_vol"), f"WITH {BARS_ALL}, {_EWS}\nSELECT bars.symbol, bars.ts, v.daily_vol FROM bars LEFT JOIN v USING (symbol, ts)", "daily_vol")

# Volatility ---------------------------------------------------------------------------

_LOGS = f"l AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close) AS rs, ln(open / {_lag('close')}) AS oc, ln(close / {_lag('close')}) AS cc, {_pct('close')} AS ret FROM bars), l2 AS (SELECT *, hl * hl / (4 * ln(2)) AS pk, 0.5 * hl * hl - (2 * ln(2) - 1) * co * co AS gk FROM l)"
_series("range_volatility", lambda: {"parkinson": I.parkinson(), "garman_klass": I.garman_klass(), "rogers_satchell": I.rogers_satchell()}, f"""WITH {BARS}, {_LOGS}, v AS (SELECT symbol, ts, {_r('avg', 'pk', 20)} * 252 AS a, {_r('avg', 'gk', 20)} * 252 AS b, {_r('avg', 'rs', 20)} * 252 AS c FROM l2)
SELECT symbol, ts, sqrt(a) AS parkinson, CASE WHEN b >= 0 THEN sqrt(b) END AS garman_klass, CASE WHEN c >= 0 THEN sqrt(c) END AS rogers_satchell FROM v""")
_series("yang_zhang_realized", lambda: {"yang_zhang": I.yang_zhang(), "realized": I.realized()}, f"""WITH {BARS}, {_LOGS}, v AS (SELECT symbol, ts, ({_r('var_samp', 'oc', 20)} + 0.34 / (1.34 + 21.0 / 19.0) * {_r('var_samp', 'cc', 20)} + (1 - 0.34 / (1.34 + 21.0 / 19.0)) * {_r('avg', 'rs', 20)}) * 252 AS a, {_r('stddev_samp', 'ret', 20)} AS b FROM l2)
SELECT symbol, ts, CASE WHEN a >= 0 THEN sqrt(a) END AS yang_zhang, b * sqrt(252) AS realized FROM v""")


def volatility_cone(df: DataFrame, windows=(5, 10, 20, 50, 100), quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """symbol, window, min, max, mean, current and quantiles of rolling volatility."""
    wide = project(df, {f"v{w}": I.realized(window=w) for w in windows}, keep=["symbol", "ts"])
    long = wide.select("symbol", "ts", F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.col(f"v{w}").alias("vol")) for w in windows))).alias("_x")).select("symbol", "ts", "_x.window", "_x.vol")
    return long.groupBy("symbol", "window").agg(F.min("vol").alias("min"), F.max("vol").alias("max"), F.avg("vol").alias("mean"), F.max_by("vol", "ts").alias("current"), *(F.percentile("vol", q).alias(f"q{int(q * 100)}") for q in quantiles))


_CONE = " UNION ALL ".join(f"SELECT symbol, ts, {w} AS \"window\", {_r('stddev_samp', 'returns', w)} * sqrt(252) AS vol FROM r" for w in (5, 10, 20, 50, 100))
_register("volatility_cone", lambda spark, sf: volatility_cone(bars(spark, sf)), f"""WITH {BARS}, {RETURNS}, c AS ({_CONE})
SELECT symbol, "window"::INT AS "window", min(vol) AS min, max(vol) AS max, avg(vol) AS mean, arg_max(vol, ts) AS current, quantile_cont(vol, 0.25) AS q25, quantile_cont(vol, 0.5) AS q50, quantile_cont(vol, 0.75) AS q75 FROM c GROUP BY 1, 2""", "min max mean current q25 q50 q75")

# Microstructure -----------------------------------------------------------------------

_TICK = f"d AS (SELECT *, close - {_lag('close')} AS dp, {_pct('close')} AS ret FROM bars), tk AS (SELECT *, coalesce(last_value(CASE WHEN dp > 0 THEN 1.0 WHEN dp < 0 THEN -1.0 END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS tick, coalesce(sign(dp), 0)::DOUBLE AS raw FROM d), sv AS (SELECT *, tick * volume AS flow FROM tk)"
_series("order_flow", lambda: {f"ofi_{w}": I.ofi(w) for w in (5, 10, 20)}, f"WITH {BARS}, {_TICK}\nSELECT symbol, ts, {', '.join(_r('sum', 'flow', w) + f' AS ofi_{w}' for w in (5, 10, 20))} FROM sv")
_PREV = f"OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_series("kyle_lambda", lambda: {"kyle_lambda": I.kyle_lambda(20)}, f"""WITH {BARS}, {_TICK}, b AS (SELECT *, CASE WHEN ret IS NOT NULL THEN flow END AS f2, row_number() OVER ({W}) AS i FROM sv),
q AS (SELECT *, CASE WHEN i > 20 AND count(f2) {_PREV} > 5 AND var_samp(f2) {_PREV} > 0 THEN abs(covar_samp(ret, flow) {_PREV} / (var_samp(f2) {_PREV} + 1e-10)) END AS k FROM b)
SELECT symbol, ts, last_value(k IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS kyle_lambda FROM q""")
_series("spreads", lambda: {"effective_spread": I.effective_spread(), "roll_spread": I.roll_spread(20), "amihud_20": I.amihud(20)}, f"""WITH {BARS}, {_TICK}, p AS (SELECT *, dp * {_lag('dp')} AS pp, abs(ret) / (close * volume + 1e-10) AS il, row_number() OVER ({W}) AS i FROM sv),
c AS (SELECT *, CASE WHEN i > 21 THEN sum(pp) OVER ({W} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) / 19.0 END AS cov FROM p)
SELECT symbol, ts, (high - low) / close AS effective_spread, CASE WHEN cov < 0 THEN 2 * sqrt(-cov) WHEN cov >= 0 THEN 0 END AS roll_spread, {_r('avg', 'il', 20)} AS amihud_20 FROM c""")
_series("market_depth", I.depth_features, f"WITH {BARS}, p AS (SELECT *, high - low AS rg FROM bars)\nSELECT symbol, ts, " + ", ".join(f"{_r('avg', 'volume', w)} AS avg_volume_{w}, {_r('max', 'volume', w)} / ({_r('sum', 'volume', w)} + 1e-10) AS volume_concentration_{w}, {_r('avg', 'volume', w)} / ({_r('avg', 'rg', w)} + 1e-10) AS depth_ratio_{w}" for w in (10, 20, 50)) + " FROM p")
_series("tick_features", I.tick_features, f"WITH {BARS}, {_TICK}, u AS (SELECT *, CASE WHEN raw > 0 THEN 1.0::DOUBLE ELSE 0 END AS up FROM tk)\nSELECT symbol, ts, " + ", ".join(f"{_r('sum', 'raw', w)} AS tick_imbalance_{w}, {_r('sum', 'up', w)} / {w} AS uptick_pct_{w}, {_r('stddev_samp', 'raw', w)} AS tick_vol_{w}" for w in (10, 20, 50)) + " FROM u")
_series("price_impact", lambda: {k: v for k, v in I.impact_features().items() if not k.startswith("kyle")}, f"WITH {BARS}, p AS (SELECT *, abs({_pct('close')}) AS ar, close * volume AS dv FROM bars)\nSELECT symbol, ts, " + ", ".join(f"{_r('avg', 'ar', w)} / ({_r('avg', 'dv', w)} + 1e-10) AS impact_per_dollar_{w}, {_r('avg', 'ar', w)} / ({_r('avg', 'volume', w)} + 1e-10) AS impact_per_volume_{w}" for w in (5, 10, 20)) + " FROM p")
_series("liquidity", lambda: {k: v for k, v in I.liquidity_features().items() if k[:3] in ("rel", "ami", "vol")}, f"WITH {BARS}, p AS (SELECT *, (high - low) / close AS sp, abs({_pct('close')}) / (close * volume + 1e-10) AS il FROM bars)\nSELECT symbol, ts, " + ", ".join(f"{_r('avg', 'il', w)} AS amihud_{w}, {_r('avg', 'sp', w)} AS rel_spread_{w}, {_r('stddev_samp', 'volume', w)} AS volume_vol_{w}" for w in (10, 20, 50)) + " FROM p")
_series("ofi_features", I.ofi_features, f"WITH {BARS}, {_TICK}, f AS (SELECT symbol, ts, " + ", ".join(f"{_r('sum', 'flow', w)} AS ofi_{w}" for w in (5, 10, 20, 50)) + " FROM sv)\nSELECT symbol, ts, " + ", ".join(f"ofi_{w}, ofi_{w} / ({_r('stddev_samp', f'ofi_{w}', 2 * w)} + 1e-10) AS ofi_norm_{w}, ofi_{w} - {_lag(f'ofi_{w}')} AS ofi_change_{w}" for w in (5, 10, 20, 50)) + " FROM f")


def _vpin_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).withColumnRenamed("price", "close")


_VPIN = f"""{TICKS}, d AS (SELECT *, price - {_lag('price')} AS dp, row_number() OVER ({W}) AS i, sum(volume) OVER (PARTITION BY symbol) / 50 AS size FROM ticks),
t AS (SELECT *, coalesce(last_value(CASE WHEN dp > 0 THEN 1 WHEN dp < 0 THEN -1 END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS tick FROM d),
v AS (SELECT symbol, ts, i, size, volume AS s, CASE WHEN tick >= 0 THEN volume ELSE 0 END AS buy, CASE WHEN tick <= 0 THEN volume ELSE 0 END AS sell, (volume >= size) AS shut FROM t WHERE i = 1
 UNION ALL SELECT t.symbol, t.ts, t.i, t.size, CASE WHEN v.shut THEN 0 ELSE v.s END + t.volume, CASE WHEN v.shut THEN 0 ELSE v.buy END + CASE WHEN tick >= 0 THEN t.volume ELSE 0 END, CASE WHEN v.shut THEN 0 ELSE v.sell END + CASE WHEN tick <= 0 THEN t.volume ELSE 0 END, CASE WHEN v.shut THEN 0 ELSE v.s END + t.volume >= t.size
 FROM v JOIN t ON t.symbol = v.symbol AND t.i = v.i + 1),
b AS (SELECT symbol, ts, CASE WHEN count(*) OVER w = 20 THEN sum(abs(buy - sell)) OVER w / sum(s) OVER w END AS x FROM v WHERE shut WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))"""
_register("vpin", lambda spark, sf: seq.with_vpin(_vpin_ticks(spark, sf), mode="standard").select("symbol", "ts", "vpin"), f"WITH RECURSIVE {_VPIN}\nSELECT ticks.symbol, ticks.ts, last_value(b.x IGNORE NULLS) OVER (PARTITION BY ticks.symbol ORDER BY ticks.ts ROWS UNBOUNDED PRECEDING) AS vpin FROM ticks LEFT JOIN b ON b.symbol = ticks.symbol AND b.ts = ticks.ts", "vpin")
_register("vpin_reference", lambda spark, sf: seq.with_vpin(_vpin_ticks(spark, sf)).select("symbol", "ts", "vpin"), f"WITH RECURSIVE {_VPIN}\nSELECT ticks.symbol, ticks.ts, last_value(CASE WHEN b.x > 0 THEN 0.5 WHEN b.x = 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticks.symbol ORDER BY ticks.ts ROWS UNBOUNDED PRECEDING)::DOUBLE AS vpin FROM ticks LEFT JOIN b ON b.symbol = ticks.symbol AND b.ts = ticks.ts", "vpin")

# Events and bars ----------------------------------------------------------------------


def _cusum_sql(h: str, start: str = "i >= 1") -> str:
    up, down = "greatest(0, (CASE WHEN c.hit <> 0 THEN 0 ELSE c.up END) + o.x)", "least(0, (CASE WHEN c.hit <> 0 THEN 0 ELSE c.down END) + o.x)"
    return f"""o AS (SELECT symbol, ts, row_number() OVER ({W}) AS i, {h} AS h, coalesce(returns, 0) AS x FROM r),
c AS (SELECT symbol, ts, i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS hit FROM o WHERE i = 1
 UNION ALL SELECT symbol, ts, i, up, down, CASE WHEN up > h THEN 1 WHEN down < -h THEN -1 ELSE 0 END FROM (SELECT o.symbol, o.ts, o.i, o.h, CASE WHEN o.h IS NULL THEN 0 ELSE {up} END AS up, CASE WHEN o.h IS NULL THEN 0 ELSE {down} END AS down FROM c JOIN o ON o.symbol = c.symbol AND o.i = c.i + 1))"""


_EVENTS = "\nSELECT symbol, ts AS t0, hit::INT AS side, CASE WHEN hit > 0 THEN up ELSE -down END AS magnitude FROM c WHERE hit <> 0"
_register("cusum_events", lambda spark, sf: seq.cusum_events(bars_all(spark, sf), 0.5), f"WITH RECURSIVE {BARS_ALL}, {RETURNS}, {_cusum_sql('0.5::DOUBLE')}{_EVENTS}", "magnitude")
_register("cusum_by_symbol", lambda spark, sf: seq.cusum_events(bars(spark, sf), 2.0), f"WITH RECURSIVE {BARS}, {RETURNS}, {_cusum_sql('2.0::DOUBLE')}{_EVENTS}", "magnitude")
_ADAPT = f"(CASE WHEN row_number() OVER ({W}) > 20 THEN coalesce({_r('stddev_samp', 'returns', 20)}, 0.5) * 0.5 END)"
_register("cusum_adaptive", lambda spark, sf: seq.adaptive_cusum_events(bars_all(spark, sf), 0.5), f"WITH RECURSIVE {BARS_ALL}, {RETURNS}, {_cusum_sql(_ADAPT)}{_EVENTS}", "magnitude")


def _bars_sql(kind: str, threshold: float) -> str:
    inc = {"dollar": "t.price * t.volume", "volume": "t.volume"}.get(kind)
    if inc:
        carry, first, rows = "CASE WHEN b.shut THEN 0 ELSE b.acc END", inc.replace("t.", ""), "true"
    elif kind == "volatility":
        inc, first = "CASE WHEN b.shut OR b.prev = 0 THEN 0 ELSE abs((t.price - b.prev) / b.prev) END", "0.0::DOUBLE"
        carry, rows = "CASE WHEN b.shut THEN 0 ELSE b.acc END", "NOT b.shut"
    else:
        inc, first = "sign(t.price - b.prev) * t.volume", "0.0::DOUBLE"
        carry, rows = "CASE WHEN b.shut THEN 0 ELSE b.acc END", "NOT b.shut"
    size = "abs({})" if kind == "imbalance" else "{}"
    start = f"{size.format(first)} >= {threshold}" if kind in ("dollar", "volume") else "false"
    return f"""{TICKS}, t AS (SELECT *, row_number() OVER ({W}) AS i FROM ticks), b AS (SELECT symbol, ts, i, price, volume, price AS prev, ({first})::DOUBLE AS acc, 0::BIGINT AS bar_id, {start} AS shut FROM t WHERE i = 1
 UNION ALL SELECT symbol, ts, i, price, volume, price, acc, bar_id, {size.format('acc')} >= {threshold} AND ok FROM (SELECT t.symbol, t.ts, t.i, t.price, t.volume, ({carry}) + ({inc}) AS acc, b.bar_id + CASE WHEN b.shut THEN 1 ELSE 0 END AS bar_id, {rows} AS ok FROM b JOIN t ON t.symbol = b.symbol AND t.i = b.i + 1))
SELECT symbol, bar_id, max(ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2 HAVING bool_or(shut)"""


for _kind, _threshold in (("dollar", 40000.0), ("volume", 500.0), ("volatility", 5.0), ("imbalance", 200.0)):
    _register(f"{_kind}_bars", lambda spark, sf, k=_kind, h=_threshold: seq.bars(ticks(spark, sf, "event_id"), k, h, price="price", ties=("event_id",)), "WITH RECURSIVE " + _bars_sql(_kind, _threshold), "open high low close volume")
_register("bar_threshold", lambda spark, sf: seq.bar_threshold(bars(spark, sf), "dollar", 100), f"WITH {BARS}\nSELECT symbol, sum(close * volume) / 100 AS threshold FROM bars GROUP BY 1", "threshold")

# Regimes ------------------------------------------------------------------------------

_REG = f"""{_ADX}, z AS (SELECT a.*, {_pct('close')} AS ret, (high - low) / close AS sp FROM a), vz AS (SELECT *, {_r('stddev_samp', 'ret', 20)} AS vol FROM z),
zz AS (SELECT *, (vol - {_r('avg', 'vol', 40)}) / ({_r('stddev_samp', 'vol', 40)} + 1e-10) AS volz, (volume - {_r('avg', 'volume', 20)}) / ({_r('stddev_samp', 'volume', 20)} + 1e-10) AS vz, (sp - {_r('avg', 'sp', 20)}) / ({_r('stddev_samp', 'sp', 20)} + 1e-10) AS spz FROM vz),
reg AS (SELECT symbol, ts, ret, CASE WHEN adx > 25 THEN 'trending' ELSE 'ranging' END AS trend_regime, CASE WHEN volz > 1 THEN 'high_vol' WHEN volz < -1 THEN 'low_vol' ELSE 'normal_vol' END AS vol_regime,
 CASE WHEN vz > 1.5 THEN 'high_volume' WHEN vz < -1.5 THEN 'low_volume' ELSE 'normal_volume' END AS volume_regime, CASE WHEN spz > 1.5 THEN 'wide' ELSE 'tight' END AS micro_regime FROM zz)"""
_CANON = "CASE WHEN trend_regime = 'trending' THEN 'TREND' WHEN vol_regime = 'high_vol' THEN 'VOLCRUSH' ELSE 'MEANREV' END"


def _regimes(spark: SparkSession, sf: str) -> DataFrame:
    return regimes.detect(bars(spark, sf))


_register("regimes", lambda spark, sf: regimes.composite(_regimes(spark, sf)), f"WITH {BARS}, {_REG}\nSELECT symbol, ts, trend_regime, vol_regime, volume_regime, micro_regime, trend_regime || '_' || vol_regime AS composite_regime, {_CANON} AS canonical_regime FROM reg")
_register("current_regime", lambda spark, sf: regimes.current_regime(bars(spark, sf)), f"WITH {BARS}, {_REG}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM reg)\nSELECT symbol, ts, {_CANON} AS regime FROM n WHERE n = 1")
_register("regime_matrix", lambda spark, sf: regimes.regime_matrix(_regimes(spark, sf)), f"""WITH {BARS}, {_REG}
SELECT symbol, ts, (trend_regime = 'trending')::INT AS trend_regime, (CASE vol_regime WHEN 'high_vol' THEN 1 WHEN 'low_vol' THEN -1 ELSE 0 END)::INT AS vol_regime, (CASE volume_regime WHEN 'high_volume' THEN 1 WHEN 'low_volume' THEN -1 ELSE 0 END)::INT AS volume_regime, (micro_regime = 'wide')::INT AS micro_regime FROM reg""")
_register("regime_stats", lambda spark, sf: regimes.regime_stats(_regimes(spark, sf).join(project(bars(spark, sf), {"returns": pct(I.CLOSE)}, keep=["symbol", "ts"]), ["symbol", "ts"]), "vol_regime"), f"""WITH {BARS}, {_REG}
SELECT symbol, vol_regime AS regime, count(*) AS count, count(*) / (sum(count(*)) OVER (PARTITION BY symbol))::DOUBLE AS frequency, avg(ret) AS mean_return, stddev_samp(ret) AS std_return, avg(ret) / (stddev_samp(ret) + 1e-10) * sqrt(252) AS sharpe, max(ret) AS max_return, min(ret) AS min_return FROM reg GROUP BY 1, 2""", "frequency mean_return std_return sharpe max_return min_return")
_ISLE = f"{_REG}, ch AS (SELECT *, CASE WHEN vol_regime IS DISTINCT FROM {_lag('vol_regime')} THEN 1 ELSE 0 END AS c FROM reg), pr AS (SELECT *, sum(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS period FROM ch), pp AS (SELECT symbol, period, any_value(vol_regime) AS regime, min(ts) AS \"start\", max(ts) AS \"end\", count(*) AS duration FROM pr GROUP BY 1, 2)"
_register("regime_periods", lambda spark, sf: regimes.periods(_regimes(spark, sf), "vol_regime"), f"WITH {BARS}, {_ISLE}\nSELECT symbol, regime, \"start\", \"end\", duration FROM pp")
_register("regime_period_stats", lambda spark, sf: regimes.period_stats(_regimes(spark, sf), "vol_regime"), f"WITH {BARS}, {_ISLE}\nSELECT symbol, regime, count(*) AS count, sum(duration)::BIGINT AS total_duration, avg(duration) AS avg_duration, max(duration) AS max_duration, min(duration) AS min_duration FROM pp GROUP BY 1, 2", "avg_duration")
_register("regime_transitions", lambda spark, sf: regimes.transitions(_regimes(spark, sf), "vol_regime").withColumn("duration_in_previous", F.col("duration_in_previous").cast("long")), f"""WITH {BARS}, {_ISLE}, tn AS (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY period) AS f, lag(duration) OVER (PARTITION BY symbol ORDER BY period) AS d FROM pp)
SELECT symbol, "start" AS ts, f AS from_regime, regime AS to_regime, d::BIGINT AS duration_in_previous FROM tn WHERE f IS NOT NULL""")
_register("regime_change_probability", lambda spark, sf: regimes.change_probability(_regimes(spark, sf), "vol_regime", 50).select("symbol", "ts", "change_probability"), f"WITH {BARS}, {_ISLE}\nSELECT symbol, ts, {_r('avg', 'c', 50)} AS change_probability FROM ch", "change_probability")
_register("regime_persistence", lambda spark, sf: regimes.persistence(_regimes(spark, sf), "vol_regime").select("symbol", "ts", "persistence"), f"""WITH {BARS}, {_REG}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM reg), p AS (SELECT a.symbol, a.ts, count(*) FILTER (b.vol_regime = a.vol_regime) / 20.0::DOUBLE AS x FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 20 AND a.i - 1 WHERE a.i > 20 GROUP BY 1, 2)
SELECT reg.symbol, reg.ts, p.x AS persistence FROM reg LEFT JOIN p USING (symbol, ts)""", "persistence")
_register("regime_combinations", lambda spark, sf: regimes.combination_frequency(_regimes(spark, sf)), f"""WITH {BARS}, {_REG}
SELECT symbol, concat_ws('_', trend_regime, vol_regime, volume_regime, micro_regime) AS combination, count(*) AS count, count(*) / (sum(count(*)) OVER (PARTITION BY symbol))::DOUBLE AS frequency FROM reg GROUP BY 1, 2""", "frequency")
_RUNS = ", ".join(f"c_{c} AS (SELECT *, sum(CASE WHEN {c} IS DISTINCT FROM p_{c} THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g_{c} FROM (SELECT *, {_lag(c)} AS p_{c} FROM {src})), n_{c} AS (SELECT *, row_number() OVER (PARTITION BY symbol, g_{c} ORDER BY ts) AS n_{c} FROM c_{c})" for c, src in (("trend_regime", "reg"), ("vol_regime", "n_trend_regime")))
_register("stable_periods", lambda spark, sf: regimes.stable_periods(_regimes(spark, sf), ("trend_regime", "vol_regime"), 5), f"WITH {BARS}, {_REG}, {_RUNS}\nSELECT symbol, ts, trend_regime, vol_regime, least(n_trend_regime, n_vol_regime)::INT AS min_duration FROM n_vol_regime WHERE least(n_trend_regime, n_vol_regime) >= 5")
_register("market_breadth", lambda spark, sf: regimes.breadth(project(bars(spark, sf), {"returns": pct(I.CLOSE)}, keep=["symbol", "ts"])), f"WITH {BARS}, {RETURNS}\nSELECT ts, sum(CASE WHEN returns > 0 THEN 1 ELSE 0 END) / (SELECT count(DISTINCT symbol) FROM r)::DOUBLE AS breadth FROM r GROUP BY 1", "breadth")

# Labels and weights -------------------------------------------------------------------


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    b = project(bars(spark, sf), {"target": I.std(pct(I.CLOSE), 20)})
    return labels.triple_barrier(b, pt=1.0, sl=1.0, min_ret=0.01, horizon=5, target="target")


_TB = f"""{RETURNS}, tg AS (SELECT *, {_r('stddev_samp', 'returns', 20)} AS target, row_number() OVER ({W}) AS i FROM r), pa AS (SELECT a.symbol, a.ts AS t0, a.target, b.i - a.i AS k, b.ts, b.close / a.close - 1 AS x FROM tg a JOIN tg b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + 5),
hit AS (SELECT symbol, t0, count(*) AS n, arg_max(ts, k) AS lt, arg_max(x, k) AS lx, min(CASE WHEN x >= target THEN k END) AS u, min(CASE WHEN x <= -target THEN k END) AS d FROM pa GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN d ELSE u END AS at FROM hit WHERE n > 1),
tb AS (SELECT w.symbol, w.t0, coalesce(pa.ts, lt) AS t1, coalesce(pa.x, lx) AS ret, (CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN -1 WHEN u IS NOT NULL THEN 1 WHEN abs(lx) < 0.01 THEN 0 WHEN lx > 0 THEN 1 ELSE -1 END)::INT AS label FROM w LEFT JOIN pa ON pa.symbol = w.symbol AND pa.t0 = w.t0 AND pa.k = w.at)"""
_register("triple_barrier", _labelled, f"WITH {BARS}, {_TB}\nSELECT symbol, t0, t1, ret, label FROM tb", "ret")
_register("drop_rare_labels", lambda spark, sf: labels.drop_rare_labels(_labelled(spark, sf), 0.3), f"WITH {BARS}, {_TB}, s AS (SELECT *, count(*) OVER (PARTITION BY symbol, label) / count(*) OVER (PARTITION BY symbol)::DOUBLE AS sh FROM tb)\nSELECT symbol, t0, t1, ret, label FROM s WHERE sh >= 0.3", "ret")


def _primary(spark: SparkSession, sf: str) -> DataFrame:
    return S.MeanReversion().signals(bars(spark, sf)).select("symbol", F.col("ts").alias("t0"), F.col("signal").alias("side"))


_SIDE = f"bb AS (SELECT symbol, ts, close, {_r('avg', 'close', 20)} AS m, {_r('stddev_samp', 'close', 20)} AS s FROM bars), side AS (SELECT symbol, ts AS t0, (CASE WHEN close > m + 2 * s THEN -1 WHEN close < m - 2 * s THEN 1 ELSE 0 END)::INT AS side FROM bb)"
_register("meta_labels", lambda spark, sf: labels.meta_labels(_primary(spark, sf), _labelled(spark, sf), sized=True), f"WITH {BARS}, {_TB}, {_SIDE}\nSELECT symbol, t0, side, ret, label, ret * side AS sided_ret, (ret * side > 0)::INT AS meta_label, abs(ret * side) AS size FROM tb JOIN side USING (symbol, t0)", "ret sided_ret size")
_register("apply_meta", lambda spark, sf: labels.apply_meta(_primary(spark, sf), labels.meta_labels(_primary(spark, sf), _labelled(spark, sf)).withColumnRenamed("meta_label", "meta")), f"WITH {BARS}, {_TB}, {_SIDE}\nSELECT symbol, t0, (CASE WHEN ret * side > 0 THEN side ELSE 0 END)::INT AS side FROM side LEFT JOIN tb USING (symbol, t0)")
_register("meta_scores", lambda spark, sf: labels.meta_scores(labels.meta_labels(_primary(spark, sf), _labelled(spark, sf)).withColumn("meta", F.abs("side"))), f"""WITH {BARS}, {_TB}, {_SIDE}, m AS (SELECT symbol, abs(side) AS said, ret * side AS sr, (ret * side > 0)::INT AS true_ FROM tb JOIN side USING (symbol, t0)),
c AS (SELECT symbol, count(*) AS total, sum(said)::BIGINT AS kept, sum(true_) AS pos, sum(CASE WHEN said = true_ THEN 1 ELSE 0 END) AS ok, sum(said * true_) AS tp, sum(CASE WHEN said = 1 AND sr > 0 THEN 1 ELSE 0 END) AS good FROM m GROUP BY 1)
SELECT symbol, ok / total AS accuracy, coalesce(tp / nullif(kept, 0), 0) AS "precision", coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(2 * tp / nullif(kept + pos, 0), 0) AS f1, coalesce(good / nullif(kept, 0), 0) AS signal_precision, kept, total FROM c""", "accuracy precision recall f1 signal_precision")
_register("weights_return", lambda spark, sf: labels.weights_by_return(_labelled(spark, sf)).select("symbol", "t0", "weight"), f"WITH {BARS}, {_TB}\nSELECT symbol, t0, abs(ret) / sum(abs(ret)) OVER (PARTITION BY symbol) AS weight FROM tb", "weight")
_register("weights_decay", lambda spark, sf: labels.weights_by_decay(_labelled(spark, sf)).select("symbol", "t0", "weight"), f"WITH {BARS}, {_TB}, a AS (SELECT symbol, t0, exp(-ln(2) / 100 * (count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY t0))) AS w FROM tb)\nSELECT symbol, t0, w / sum(w) OVER (PARTITION BY symbol) AS weight FROM a", "weight")
_register("weights_sequential", lambda spark, sf: labels.weights_sequential(_labelled(spark, sf), bars(spark, sf)).select("symbol", "t0", "weight"), f"WITH {BARS}, {_TB}, c AS (SELECT tb.symbol, t0, count(*) AS n FROM tb JOIN bars ON bars.symbol = tb.symbol AND bars.ts BETWEEN t0 AND t1 GROUP BY 1, 2)\nSELECT symbol, t0, n / sum(n) OVER (PARTITION BY symbol)::DOUBLE AS weight FROM c", "weight")
_register("weights_balanced", lambda spark, sf: labels.balanced_weights(_labelled(spark, sf)).select("symbol", "t0", "weight"), f"WITH {BARS}, {_TB}, c AS (SELECT symbol, t0, 1.0::DOUBLE / count(*) OVER (PARTITION BY symbol, label) AS w FROM tb)\nSELECT symbol, t0, w / sum(w) OVER (PARTITION BY symbol) AS weight FROM c", "weight")
_register("weighted_bootstrap", lambda spark, sf: labels.weighted_bootstrap(labels.weights_by_return(_labelled(spark, sf)), 100))
_register("indicator_matrix", lambda spark, sf: labels.indicator(_labelled(spark, sf), bars(spark, sf)), f"WITH {BARS}, {_TB}\nSELECT tb.symbol, t0, ts FROM tb JOIN bars ON bars.symbol = tb.symbol AND ts BETWEEN t0 AND t1")

# Strategies ---------------------------------------------------------------------------


def _signals(name: str, make: Callable[[], S.Strategy], expr: str, ctes: str = "") -> None:
    _register(f"{name}_signals", lambda spark, sf: make().signals(bars(spark, sf)), f"WITH {BARS}{ctes}\nSELECT symbol, ts, '{make().name}' AS strategy, ({expr})::INT AS signal FROM {'x' if ctes else 'bars'}")


_M = f", x AS (SELECT symbol, ts, {_pct('close', 20)} AS m, volume > {_r('avg', 'volume', 20)} AS ok FROM bars)"
_signals("momentum", S.Momentum, "CASE WHEN ok AND m > 0.02 THEN 1 WHEN ok AND m < -0.02 THEN -1 ELSE 0 END", _M)
_signals("mean_reversion", S.MeanReversion, "CASE WHEN close > m + 2 * s THEN -1 WHEN close < m - 2 * s THEN 1 ELSE 0 END", f", x AS (SELECT symbol, ts, close, {_r('avg', 'close', 20)} AS m, {_r('stddev_samp', 'close', 20)} AS s FROM bars)")
_signals("mean_reversion_z", lambda: S.MeanReversion(use_bb=False, zscore_threshold=1.5), "CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 ELSE 0 END", f", x AS (SELECT symbol, ts, (close - {_r('avg', 'close', 20)}) / ({_r('stddev_samp', 'close', 20)} + 1e-10) AS z FROM bars)")
_V = f", {RETURNS}, v AS (SELECT *, {_r('stddev_samp', 'returns', 20)} AS vol, {_r('avg', 'returns', 5)} AS way FROM r), x AS (SELECT *, {_r('avg', 'vol', 40)} AS m, {_r('stddev_samp', 'vol', 40)} AS s FROM v)"
_signals("volatility", S.Volatility, "CASE WHEN vol > m + s AND way > 0 THEN 1 WHEN vol > m + s AND way < 0 THEN -1 ELSE 0 END", _V)
_SC = f", d AS (SELECT *, coalesce(sign(close - {_lag('close')}), 0) * volume AS f, {_pct('close')} AS ret, (high - low) / close AS sp FROM bars), x AS (SELECT *, {_r('sum', 'f', 5)} AS flow, {_r('avg', 'ret', 3)} AS way, {_r('avg', 'sp', 20)} AS msp FROM d)"
_signals("scalping", S.Scalping, "CASE WHEN sp > msp THEN 0 WHEN flow > 0 AND way > 0.005 THEN 1 WHEN flow < 0 AND way < -0.005 THEN -1 ELSE 0 END", _SC)
_SENT = f"""d AS (SELECT *, CASE WHEN close - {_lag('close')} <= 0 THEN 0 ELSE volume END AS uv, CASE WHEN close - {_lag('close')} >= 0 THEN 0 ELSE volume END AS dv, {_pct('close')} AS ret, {_pct('close', 20)} AS mo FROM bars),
e AS (SELECT *, {_r('sum', 'uv', 20)} AS us, {_r('sum', 'dv', 20)} AS ds, (mo - {_r('avg', 'mo', 50)}) / ({_r('stddev_samp', 'mo', 50)} + 1e-10) AS mz, {_r('stddev_samp', 'ret', 20)} AS vol, {_r('max', 'high', 20)} AS hh, {_r('min', 'low', 20)} AS ll FROM d),
se AS (SELECT symbol, ts, 0.3 * ((us - ds) / (us + ds + 1e-10)) + 0.3 * mz + 0.2 * -{_pct('vol', 20)} + 0.2 * (((close - ll) / (hh - ll + 1e-10) - 0.5) * 2) AS score FROM e)"""
_signals("sentiment", S.Sentiment, "CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 ELSE 0 END", f", {_SENT}, x AS (SELECT symbol, ts, (score - {_r('avg', 'score', 40)}) / ({_r('stddev_samp', 'score', 40)} + 1e-10) AS z FROM se)")
_series("sentiment_score", lambda: {"score": S.Sentiment().score()}, f"WITH {BARS}, {_SENT}\nSELECT symbol, ts, score FROM se")
_SEAS = f"{RETURNS}, k AS (SELECT *, isodow(ts) - 1 AS dow, month(ts) AS mon, hour(ts) AS h FROM r)"
_register("seasonality_fit", lambda spark, sf: S.Seasonality(use_time_of_day=True).fit(bars(spark, sf)), f"""WITH {BARS}, {_SEAS}, g AS (SELECT symbol, 'dow' AS kind, dow AS slot, avg(returns) AS m FROM k GROUP BY 1, 3 UNION ALL SELECT symbol, 'month', mon, avg(returns) FROM k GROUP BY 1, 3 UNION ALL SELECT symbol, 'hour', h, avg(returns) FROM k GROUP BY 1, 3)
SELECT symbol, kind, slot::INT AS slot, m AS mean_return FROM g""", "mean_return")


def _seasonal(spark: SparkSession, sf: str) -> DataFrame:
    b, s = bars(spark, sf), S.Seasonality()
    return s.signals(b, s.fit(b))


_register("seasonality_signals", _seasonal, f"""WITH {BARS}, {_SEAS}, sc AS (SELECT symbol, ts, avg(returns) OVER (PARTITION BY symbol, dow) + avg(returns) OVER (PARTITION BY symbol, mon) AS s FROM k), sd AS (SELECT *, stddev_samp(s) OVER (PARTITION BY symbol) AS sd FROM sc)
SELECT symbol, ts, 'seasonality' AS strategy, (CASE WHEN s > sd THEN 1 WHEN s < -sd THEN -1 ELSE 0 END)::INT AS signal FROM sd""")
_register("calendar_anomalies", lambda spark, sf: S.Seasonality().anomalies(bars(spark, sf)), f"""WITH {BARS}, {_SEAS}
SELECT symbol, avg(returns) FILTER (dow = 0) - avg(returns) FILTER (dow <> 0) AS monday_effect, avg(returns) FILTER (day(ts) >= 25) - avg(returns) FILTER (day(ts) BETWEEN 10 AND 20) AS month_end_effect, avg(returns) FILTER (mon = 1) - avg(returns) FILTER (mon <> 1) AS january_effect FROM k GROUP BY 1""", "monday_effect month_end_effect january_effect")


def pair(spark: SparkSession, sf: str) -> DataFrame:
    return S.pair_bars(bars(spark, sf), "1-URGENT", "2-HIGH")


_PAIR = "pair AS (SELECT '1-URGENT/2-HIGH' AS symbol, ts, a.close AS price1, b.close AS price2 FROM bars a JOIN bars b USING (ts) WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH'), sp AS (SELECT *, ln(price1) - ln(price2) AS spread FROM pair)"
_Z60 = f"z AS (SELECT *, (spread - {_r('avg', 'spread', 60)}) / ({_r('stddev_samp', 'spread', 60)} + 1e-10) AS z FROM sp)"
_register("pairs_signals", lambda spark, sf: S.Pairs().signals(pair(spark, sf)), f"WITH {BARS}, {_PAIR}, {_Z60}\nSELECT symbol, ts, 'pairs' AS strategy, (CASE WHEN abs(z) < 0.5 THEN 0 WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 ELSE 0 END)::INT AS signal FROM z")
_P59, _P60, _P98 = (f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (59, 60, 98))
_register("pairs_features", lambda spark, sf: S.Pairs().feature_frame(pair(spark, sf)).withColumn("half_life", F.when(F.col("half_life") < float("inf"), F.col("half_life"))).drop("correlation_20", "correlation_60", "correlation_120"), f"""WITH {BARS}, {_PAIR}, {_Z60}, d AS (SELECT *, {_lag('spread')} AS l, spread - {_lag('spread')} AS d, row_number() OVER ({W}) AS i FROM z), dd AS (SELECT *, {_lag('d')} AS ld, d * l AS dl, l * l AS ll, price1 * price2 AS pq, price2 * price2 AS qq FROM d),
f AS (SELECT *, CASE WHEN i > 60 THEN sum(dl) {_P59} / sum(ll) {_P59} END AS beta, CASE WHEN i > 100 THEN abs(corr(d, ld) {_P98}) END AS cs, CASE WHEN i > 60 THEN sum(pq) {_P60} / sum(qq) {_P60} END AS hr FROM dd)
SELECT symbol, ts, spread, z AS spread_zscore, {_r('stddev_samp', 'spread', 20)} AS spread_vol, CASE WHEN beta < 0 THEN -ln(2) / beta END AS half_life, cs AS coint_score, hr AS hedge_ratio FROM f""", "spread spread_zscore spread_vol half_life coint_score hedge_ratio")
_register("pairs_correlation", lambda spark, sf: project(pair(spark, sf), {"correlation_20": I_corr(20), "correlation_60": I_corr(60)}, keep=["symbol", "ts"]), f"""WITH {BARS}, {_PAIR}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM pair)
SELECT symbol, ts, CASE WHEN i >= 20 THEN corr(price1, price2) OVER ({W} ROWS 19 PRECEDING) END AS correlation_20, CASE WHEN i >= 60 THEN corr(price1, price2) OVER ({W} ROWS 59 PRECEDING) END AS correlation_60 FROM n""", "correlation_20 correlation_60")


def I_corr(n: int):
    from .functions.series import corr

    return corr(col("price1"), col("price2"), n)


_series("momentum_features", lambda: {k: v for k, v in S.Momentum().features().items() if k != "ma_cross"}, f"WITH {BARS}, x AS (SELECT *, CASE WHEN {_pct('close')} > 0 THEN 1.0 WHEN {_pct('close')} <= 0 THEN 0.0 END AS up FROM bars)\nSELECT symbol, ts, " + ", ".join(f"{_pct('close', n)} AS momentum_{n}" for n in (5, 10, 20, 50)) + f", (close - {_lag('close', 20)}) / {_lag('close', 20)} AS roc_20, {_r('avg', 'close', 20)} AS sma_20, {_r('avg', 'close', 50)} AS sma_50, close / {_r('avg', 'close', 20)} AS price_sma_ratio, abs({_pct('close', 20)}) AS momentum_strength, {_r('avg', 'up', 20)} AS trend_consistency, {_pct('volume', 20)} AS volume_trend FROM x")
_series("momentum_strength", lambda: {"strength": S.Momentum().strength()}, f"WITH {BARS}, m AS (SELECT *, abs({_pct('close', 20)}) AS m FROM bars), x AS (SELECT symbol, ts, m / ({_r('max', 'm', 50)} + 1e-10) AS s FROM m)\nSELECT symbol, ts, CASE WHEN s IS NOT NULL THEN least(greatest(s, 0), 1) END AS strength FROM x")
_series("mean_reversion_features", lambda: {k: v for k, v in S.MeanReversion().features().items() if k[:5] in ("zscor", "bb_po", "mean_") and k != "mean_reversion_speed"}, f"WITH {BARS}\nSELECT symbol, ts, " + ", ".join(f"(close - {_r('avg', 'close', n)}) / ({_r('stddev_samp', 'close', n)} + 1e-10) AS zscore_{n}, (close - {_r('avg', 'close', n)}) / {_r('avg', 'close', n)} AS mean_distance_{n}" for n in (10, 20, 50)) + f", (close - ({_r('avg', 'close', 20)} - 2 * {_r('stddev_samp', 'close', 20)})) / (4 * {_r('stddev_samp', 'close', 20)} + 1e-10) AS bb_position FROM bars")
_register("sentiment_extremes", lambda spark, sf: S.Sentiment().extremes(bars(spark, sf)), f"""WITH {BARS}, {_SENT}, x AS (SELECT symbol, ts, score, (score - {_r('avg', 'score', 50)}) / ({_r('stddev_samp', 'score', 50)} + 1e-10) AS z FROM se)
SELECT symbol, ts, score AS sentiment, z AS zscore, coalesce(abs(z) > 1.5, false) AS is_extreme, CASE WHEN z < -1.5 THEN 'extreme_bearish' WHEN z > 1.5 THEN 'extreme_bullish' ELSE 'neutral' END AS extreme_type FROM x""", "sentiment zscore")
_register("transaction_costs", lambda spark, sf: S.Scalping.costs(S.MeanReversion().signals(bars(spark, sf))).select("symbol", "ts", "cost"), f"WITH {BARS}, {_SIDE}, l AS (SELECT symbol, t0 AS ts, side, lag(side) OVER (PARTITION BY symbol ORDER BY t0) AS p FROM side)\nSELECT symbol, ts, CASE WHEN abs(side - p) > 0 THEN 0.001::DOUBLE ELSE 0 END AS cost FROM l", "cost")

# Features -----------------------------------------------------------------------------



def _few(spark: SparkSession, sf: str) -> DataFrame:
    return project(bars(spark, sf), {"rsi_14": I.rsi(), "momentum_20": pct(I.CLOSE, 20), "atr_14": I.atr()}, keep=["symbol", "ts"])


_FEW = f"{_GAIN}, {_TR}, fw AS (SELECT g.symbol, g.ts, 100 - 100 / (1 + {_r('avg', 'gain', 14).replace('symbol', 'g.symbol').replace('BY ts', 'BY g.ts')} / ({_r('avg', 'loss', 14).replace('symbol', 'g.symbol').replace('BY ts', 'BY g.ts')} + 1e-10)) AS rsi_14 FROM g), mt AS (SELECT symbol, ts, {_pct('close', 20)} AS momentum_20, {_r('avg', 'tr', 14)} AS atr_14 FROM t), few AS (SELECT * FROM fw JOIN mt USING (symbol, ts))"
_P = "(PARTITION BY symbol)"
for _method, _expr in (("zscore", "({c} - avg({c}) OVER {P}) / (stddev_samp({c}) OVER {P} + 1e-10)"), ("minmax", "({c} - min({c}) OVER {P}) / (max({c}) OVER {P} - min({c}) OVER {P} + 1e-10)"), ("robust", "({c} - quantile_cont({c}, 0.5) OVER {P}) / (quantile_cont({c}, 0.75) OVER {P} - quantile_cont({c}, 0.25) OVER {P} + 1e-10)")):
    _register(f"normalise_{_method}", lambda spark, sf, m=_method: features.normalise(_few(spark, sf), m), f"WITH {BARS}, {_FEW}\nSELECT symbol, ts, " + ", ".join(f"{_expr.format(c=c, P=_P)} AS {c}" for c in ("rsi_14", "momentum_20", "atr_14")) + " FROM few", "rsi_14 momentum_20 atr_14")
_register("feature_scores", lambda spark, sf: features.feature_scores(_few(spark, sf).join(_labelled(spark, sf).withColumnRenamed("t0", "ts"), ["symbol", "ts"]), "label", ["rsi_14", "momentum_20", "atr_14"]), f"""WITH {BARS}, {_TB}, {_FEW}, long AS (SELECT label, feature, x FROM (SELECT label, rsi_14, momentum_20, atr_14 FROM few JOIN tb ON tb.symbol = few.symbol AND tb.t0 = few.ts) UNPIVOT (x FOR feature IN (rsi_14, momentum_20, atr_14))),
gr AS (SELECT feature, label, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2), al AS (SELECT feature, avg(x) AS am, count(x) AS an FROM long GROUP BY 1)
SELECT feature, (sum(n * (m - am) * (m - am)) / (count(*) - 1)) / (sum(n * v) / (max(an) - count(*))) AS score FROM gr JOIN al USING (feature) GROUP BY 1""", "score")
# Models -------------------------------------------------------------------------------

_register("purged_kfold", lambda spark, sf: models.purged_splits(_labelled(spark, sf)), f"""WITH {BARS}, {_TB}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM tb),
fo AS (SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS own FROM n), bo AS (SELECT symbol, own AS fold, min(t0) AS s, max(t0) AS e, max(pos) AS l FROM fo GROUP BY 1, 2),
ro AS (SELECT fo.symbol, t0, fold, CASE WHEN own = fold THEN 'test' WHEN t1 < s OR (t0 > e AND pos > l + floor(n * 0.01)) THEN 'train' END AS role FROM fo JOIN bo USING (symbol))
SELECT symbol, t0, fold::INT AS fold, role FROM ro WHERE role IS NOT NULL""")


def _trained(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    rows = _few(spark, sf).na.drop().withColumnRenamed("ts", "t0").join(_labelled(spark, sf), ["symbol", "t0"])
    return rows, ["rsi_14", "momentum_20", "atr_14"]


def _forest(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _trained(spark, sf)

    def own(rows: DataFrame) -> DataFrame:
        model = models.Classifier(names, trees=20).fit(rows)
        return model.predict(rows).select("symbol", "t0", "label", "prediction", *(f"p_{c}" for c in model.classes))

    out = models.by_symbol(rows, own)
    return out.fillna(0.0, [c for c in out.columns if c.startswith("p_")])  # a class that a symbol lacks


_register("forest_predictions", _forest)

# Ensemble, bandit, portfolio ------------------------------------------------------------


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of three strategies with confidences that the row's dates fix."""
    b = bars(spark, sf)
    every = None
    for k, s in enumerate((S.MeanReversion(), S.Momentum(), S.Volatility())):
        one = s.signals(b).withColumn("confidence", F.pmod(F.dayofyear("ts") * (k + 3), F.lit(10)) / 10.0)
        every = one if every is None else every.union(one)
    regime = regimes.composite(regimes.detect(b)).select("symbol", "ts", F.col("canonical_regime").alias("regime"))
    out = every.join(regime, ["symbol", "ts"])
    return out.withColumns({"side": F.col("signal").cast("double"), "signal": F.col("signal").cast("double"), "probability": F.col("confidence"), "meta_probability": F.col("confidence") * 0.8})


_VOTES = f"""{_REG}, {_M[2:].replace('x AS', 'xm AS')}, {_V[2:].split(', v AS')[0]}, v AS{_V.split(', v AS')[1].replace('x AS', 'xv AS')}, {_SIDE},
sg AS (SELECT symbol, t0 AS ts, 'mean_reversion' AS strategy, side AS signal, 3 AS k FROM side UNION ALL SELECT symbol, ts, 'momentum', CASE WHEN ok AND m > 0.02 THEN 1 WHEN ok AND m < -0.02 THEN -1 ELSE 0 END, 4 FROM xm UNION ALL SELECT symbol, ts, 'volatility', CASE WHEN vol > m + s AND way > 0 THEN 1 WHEN vol > m + s AND way < 0 THEN -1 ELSE 0 END, 5 FROM xv),
vo AS (SELECT sg.symbol, sg.ts, strategy, signal::DOUBLE AS signal, (dayofyear(sg.ts) * k % 10) / 10.0::DOUBLE AS confidence, {_CANON} AS regime FROM sg JOIN reg ON reg.symbol = sg.symbol AND reg.ts = sg.ts)"""
_VB = f"WITH {BARS}, {_VOTES}"
_register("ensemble_conflict_aware", lambda spark, sf: ensemble.conflict_aware(_votes(spark, sf)), f"""{_VB}
SELECT symbol, ts, CASE WHEN sum(confidence) > 0 THEN sum(signal * confidence * 0.8) / sum(confidence * 0.8) ELSE 0 END AS side, avg(confidence) AS probability, CASE WHEN sum(confidence) > 0 THEN avg(confidence * 0.8) * CASE WHEN count(DISTINCT signal) > 1 THEN 0.5 ELSE 1 END ELSE 0 END AS meta_probability, min(regime) AS regime FROM vo GROUP BY 1, 2""", "side probability meta_probability")
_register("ensemble_weighted_average", lambda spark, sf: ensemble.weighted_average(_votes(spark, sf)), f"{_VB}\nSELECT symbol, ts, coalesce(sum(signal * confidence) / nullif(sum(confidence), 0), 0) AS signal, avg(confidence) AS confidence, count(*) AS num_strategies FROM vo GROUP BY 1, 2", "signal confidence")
_register("ensemble_majority_vote", lambda spark, sf: ensemble.majority_vote(_votes(spark, sf)), f"{_VB}\nSELECT symbol, ts, sign(sum(sign(signal)))::DOUBLE AS signal, abs(sum(sign(signal))) / count(*)::DOUBLE AS confidence, count(*) AS num_strategies FROM vo GROUP BY 1, 2", "signal confidence")
_register("ensemble_best_confidence", lambda spark, sf: ensemble.best_confidence(_votes(spark, sf)), f"{_VB}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY confidence DESC, strategy) AS n FROM vo)\nSELECT symbol, ts, signal, confidence, strategy AS source FROM b WHERE n = 1", "signal confidence")
_register("ensemble_consensus", lambda spark, sf: ensemble.consensus(_votes(spark, sf)), f"""{_VB}, mean_ AS (SELECT *, avg(signal) OVER (PARTITION BY symbol, ts) AS mu FROM vo)
SELECT symbol, ts, avg(signal) AS consensus_signal, 1 - least(stddev_pop(signal), 1) AS consensus_strength, avg(CASE WHEN sign(signal) = CASE WHEN mu > 0 THEN 1 ELSE -1 END THEN 1.0 ELSE 0 END) AS agreement, count(*) AS num_strategies, avg(confidence) AS avg_confidence FROM mean_ GROUP BY 1, 2""", "consensus_signal consensus_strength agreement avg_confidence")
_register("ensemble_top", lambda spark, sf: ensemble.top(_votes(spark, sf), 2).select("symbol", "ts", "strategy", "signal", "confidence"), f"{_VB}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY confidence DESC, strategy) AS n FROM vo)\nSELECT symbol, ts, strategy, signal, confidence FROM b WHERE n <= 2", "signal confidence")


def _preferred(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("TREND", "momentum"), ("VOLCRUSH", "volatility"), ("MEANREV", "mean_reversion")], "regime string, strategy string")


_PREF = "pf(regime, strategy) AS (VALUES ('TREND', 'momentum'), ('VOLCRUSH', 'volatility'), ('MEANREV', 'mean_reversion'))"
_register("ensemble_by_regime", lambda spark, sf: ensemble.regime_filtered(_votes(spark, sf), _preferred(spark)).select("symbol", "ts", "strategy", "signal", "regime"), f"{_VB}, {_PREF}\nSELECT symbol, ts, strategy, signal, regime FROM vo JOIN pf USING (regime, strategy)", "signal")
_register("strategy_ranking", lambda spark, sf: ensemble.ranked(_votes(spark, sf), spark.createDataFrame([("momentum", 0.7), ("volatility", 0.4)], "strategy string, score double")).select("symbol", "ts", "strategy", "score", "rank"), f"""{_VB}, s AS (SELECT symbol, ts, strategy, CASE strategy WHEN 'momentum' THEN 0.7 WHEN 'volatility' THEN 0.4 ELSE 0 END::DOUBLE AS score FROM vo)
SELECT symbol, ts, strategy, score, (row_number() OVER (PARTITION BY symbol, ts ORDER BY score DESC, strategy))::INT AS rank FROM s""", "score")
_OUT = "oc AS (SELECT strategy, regime, confidence AS reward FROM vo)"


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _votes(spark, sf).select("strategy", "regime", F.col("confidence").alias("reward"), "symbol", "ts")


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf)
    return bandit.batch_update(bandit.fresh(o), o)


_register("bandit_batch", _arms, f"{_VB}, {_OUT}\nSELECT strategy, regime, greatest(1, 1 + sum(reward) * 0.995) AS alpha, greatest(1, 1 + (count(*) - sum(reward)) * 0.995) AS beta, count(*)::INT AS pulls, sum(reward) AS total_reward FROM oc GROUP BY 1, 2", "alpha beta total_reward")
_register("bandit_replay", lambda spark, sf: bandit.replay(_outcomes(spark, sf)), f"""{_VB}, o AS (SELECT strategy, regime, confidence AS reward, pow(0.995::DOUBLE, row_number() OVER (PARTITION BY regime ORDER BY ts DESC, symbol DESC, strategy DESC)) AS w FROM vo)
SELECT strategy, regime, 1 + sum(reward * w) AS alpha, 1 + sum((1 - reward) * w) AS beta, count(*)::INT AS pulls, sum(reward) AS total_reward FROM o GROUP BY 1, 2""", "alpha beta total_reward")
_register("bandit_select", lambda spark, sf: bandit.select(_votes(spark, sf), _arms(spark, sf), n=2).select("symbol", "ts", "strategy", "signal"))
_register("bandit_best_probability", lambda spark, sf: bandit.best_probability(_arms(spark, sf), 500))
_register("position_size", lambda spark, sf: _votes(spark, sf).select("symbol", "ts", "strategy", Allocator().size(F.col("signal"), F.col("confidence"), F.lit(0.5), F.lit(0.6), F.lit(0.02), F.lit(0.01)).alias("size")), f"""{_VB}
SELECT symbol, ts, strategy, sign(signal) * least(greatest(least(abs(signal) * confidence, least(0.15 / 0.5, 2.0), greatest(0, (0.6 * 0.02 - 0.4 * 0.01) / 0.02) * 0.25), 0), 0.1) AS size FROM vo""", "size")


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    vol = project(bars(spark, sf), {"volatility": I.std(pct(I.CLOSE), 20)}, keep=["symbol", "ts"])
    return _votes(spark, sf).filter(F.col("strategy") == "momentum").join(vol, ["symbol", "ts"]).select("ts", F.col("symbol").alias("asset"), "signal", "confidence", "volatility")


_AS = f"{RETURNS}, vl AS (SELECT symbol, ts, {_r('stddev_samp', 'returns', 20)} AS volatility FROM r), ast AS (SELECT vo.ts, vo.symbol AS asset, signal, confidence, volatility FROM vo JOIN vl ON vl.symbol = vo.symbol AND vl.ts = vo.ts WHERE strategy = 'momentum')"
_AB = f"WITH {BARS}, {_VOTES}, {_AS[len(RETURNS) + 2:]}"
_ALLOC = {"risk_parity": "coalesce((1 / (volatility + 1e-10)) / sum(1 / (volatility + 1e-10)) OVER (PARTITION BY ts), 0)", "equal_weight": "1.0::DOUBLE / count(*) OVER (PARTITION BY ts)", "signal_weight": "coalesce(abs(signal) * confidence / nullif(sum(abs(signal) * confidence) OVER (PARTITION BY ts), 0), 0)"}
for _method, _expr in _ALLOC.items():
    _register(f"allocation_{_method}", lambda spark, sf, m=_method: Allocator().allocate(_assets(spark, sf), m).select("ts", "asset", "allocation"), f"{_AB}\nSELECT ts, asset, sign(signal) * {_expr} AS allocation FROM ast", "allocation")
_register("allocation_limits", lambda spark, sf: Allocator(max_position=0.3, leverage_limit=0.5).limited(Allocator().allocate(_assets(spark, sf), "equal_weight")), f"""{_AB}, e AS (SELECT ts, asset, least(greatest(sign(signal) * (1.0::DOUBLE / count(*) OVER (PARTITION BY ts)), -0.3), 0.3) AS a FROM ast), g AS (SELECT *, sum(abs(a)) OVER (PARTITION BY ts) AS g FROM e)
SELECT ts, asset, a * CASE WHEN g > 0.5 THEN 0.5 / g ELSE 1 END AS allocation FROM g""", "allocation")
_register("trades", lambda spark, sf: Execution().trades(S.MeanReversion().signals(bars(spark, sf)).join(bars(spark, sf), ["symbol", "ts"]).select("ts", "symbol", "signal", F.col("close").alias("price"), F.lit(1e6).alias("portfolio_value"), F.lit(0.05).alias("position_size"))), f"""WITH {BARS}, {_SIDE}, t AS (SELECT t0 AS ts, side.symbol, side, close, 50000.0::DOUBLE / close AS q FROM side JOIN bars ON bars.symbol = side.symbol AND bars.ts = side.t0 WHERE side <> 0), p AS (SELECT *, close * CASE WHEN side > 0 THEN 1.0005 ELSE 0.9995 END::DOUBLE AS pr FROM t)
SELECT ts, symbol, CASE WHEN side > 0 THEN 'buy' ELSE 'sell' END AS side, q AS quantity, pr AS price, greatest(q * close * 0.001, 1) AS commission, q * close * 0.0005 AS slippage, q * pr + greatest(q * close * 0.001, 1) + q * close * 0.0005 AS total_cost FROM p""", "quantity price commission slippage total_cost")


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf).select("ts", "asset", (F.col("signal") * F.col("confidence") * 0.5).alias("position"))


_register("risk_positions", lambda spark, sf: Risk().positions(_positions(spark, sf)), f"""{_AB}, p AS (SELECT ts, asset, signal * confidence * 0.5 AS position FROM ast)
SELECT ts, asset, position, abs(position) <= 0.1 AS position_ok, sum(abs(position)) OVER (PARTITION BY ts) AS leverage, sum(abs(position)) OVER (PARTITION BY ts) <= 2 AS leverage_ok FROM p""", "position leverage")
_register("risk_concentration", lambda spark, sf: Risk().concentration(_positions(spark, sf), spark.createDataFrame([("1-URGENT", "high"), ("2-HIGH", "high")], "asset string, group string")), f"""{_AB}, p AS (SELECT ts, CASE WHEN asset IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'unknown' END AS grp, sum(abs(signal * confidence * 0.5)) AS e FROM ast GROUP BY 1, 2)
SELECT ts, max(e) AS concentration, max(e) <= 0.3 AS concentration_ok FROM p GROUP BY 1""", "concentration")
_register("risk_drawdown", lambda spark, sf: Risk().drawdown(bars(spark, sf).select("symbol", "ts", F.col("close").alias("value"))), f"""WITH {BARS}, p AS (SELECT symbol, ts, close AS value, max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM bars), d AS (SELECT *, (peak - value) / peak AS drawdown FROM p)
SELECT symbol, ts, value, peak, drawdown, drawdown <= 0.2 AS drawdown_ok, bool_or(drawdown > 0.2) OVER ({W} ROWS UNBOUNDED PRECEDING) AS breached FROM d""", "value peak drawdown")
_register("stop_take", lambda spark, sf: bars(spark, sf).select("symbol", "ts", Risk().exits(F.col("open"), F.col("close"), F.lit("long")).alias("long"), Risk().exits(F.col("open"), F.col("close"), F.lit("short")).alias("short")), f"""WITH {BARS}, g AS (SELECT symbol, ts, (close - open) / open AS l, (open - close) / open AS s FROM bars)
SELECT symbol, ts, CASE WHEN l <= -0.05 THEN 'stop_loss' WHEN l >= 0.10 THEN 'take_profit' END AS "long", CASE WHEN s <= -0.05 THEN 'stop_loss' WHEN s >= 0.10 THEN 'take_profit' END AS short FROM g""")
_register("rebalance", lambda spark, sf: Execution().rebalance(_positions(spark, sf).select((F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.col("asset").alias("symbol"), "position"), _positions(spark, sf).select("ts", F.col("asset").alias("symbol"), "position"), bars(spark, sf).select("ts", "symbol", F.col("close").alias("price")), 1e6).select("ts", "symbol", "side", "quantity"), f"""{_AB}, p AS (SELECT ts, asset AS symbol, signal * confidence * 0.5 AS position FROM ast), c AS (SELECT coalesce(a.ts, b.ts) AS ts, coalesce(a.symbol, b.symbol) AS symbol, coalesce(b.position, 0) - coalesce(a.position, 0) AS ch FROM (SELECT ts + INTERVAL 1 DAY AS ts, symbol, position FROM p) a FULL JOIN p b ON a.ts = b.ts AND a.symbol = b.symbol)
SELECT c.ts, c.symbol, CASE WHEN ch > 0 THEN 'buy' ELSE 'sell' END AS side, 1e6::DOUBLE * abs(ch) / close AS quantity FROM c JOIN bars ON bars.ts = c.ts AND bars.symbol = c.symbol WHERE abs(ch) > 0.01 AND close > 0""", "quantity")

# Evaluation ---------------------------------------------------------------------------


def _strategy_returns(spark: SparkSession, sf: str) -> DataFrame:
    r = project(bars(spark, sf), {"_n": I.lag(pct(I.CLOSE), -1)}, keep=["symbol", "ts"])
    return S.MeanReversion().signals(bars(spark, sf)).join(r, ["symbol", "ts"]).select("symbol", "ts", (F.col("signal") * F.col("_n") * 0.01).alias("returns")).filter("returns is not null")


_SR = f"{RETURNS}, nx AS (SELECT symbol, ts, lead(returns) OVER ({W}) AS nxt FROM r), {_SIDE}, sr AS (SELECT side.symbol, t0 AS ts, side * nxt * 0.01 AS returns FROM side JOIN nx ON nx.symbol = side.symbol AND nx.ts = side.t0 WHERE nxt IS NOT NULL)"
_EQ = f"{_SR}, eq AS (SELECT *, product(1 + returns) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cumulative FROM sr), eq2 AS (SELECT *, max(cumulative) OVER ({W} ROWS UNBOUNDED PRECEDING) AS running_max FROM eq), eq3 AS (SELECT *, (cumulative - running_max) / running_max AS drawdown FROM eq2)"
_register("equity_curve", lambda spark, sf: evaluation.equity(_strategy_returns(spark, sf)), f"WITH {BARS}, {_EQ}\nSELECT symbol, ts, returns, cumulative, running_max, drawdown FROM eq3", "returns cumulative running_max drawdown")
_register("metrics", lambda spark, sf: evaluation.metrics(_strategy_returns(spark, sf)), f"""WITH {BARS}, {_EQ}, m AS (SELECT symbol, count(*) AS n, product(1 + returns) - 1 AS t, avg(returns) AS mu, stddev_samp(returns) AS sd, sqrt(avg(CASE WHEN returns < 0 THEN returns * returns END)) AS dn, abs(min(drawdown)) AS dd, avg(CASE WHEN returns > 0 THEN 1.0 ELSE 0 END) AS wr, sum(CASE WHEN returns > 0 THEN returns ELSE 0 END) AS gp, abs(sum(CASE WHEN returns < 0 THEN returns ELSE 0 END)) AS gl, quantile_cont(returns, 0.5) AS md, skewness(returns) AS sk, kurtosis(returns) AS ku FROM eq3 GROUP BY 1)
SELECT symbol, t AS total_return, mu * 252 AS annual_return, sd * sqrt(252) AS annual_volatility, mu / sd * sqrt(252) AS sharpe_ratio, CASE WHEN dn IS NULL THEN CASE WHEN mu > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE mu / dn * sqrt(252) END AS sortino_ratio, CASE WHEN dd > 0 THEN mu * 252 / dd ELSE 0 END AS calmar_ratio, dd AS max_drawdown, wr AS win_rate, CASE WHEN gl = 0 THEN CASE WHEN gp > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE gp / gl END AS profit_factor, n AS num_periods, mu AS avg_return, md AS median_return, sd AS std_return, sk AS skewness, ku AS kurtosis FROM m""", "total_return annual_return annual_volatility sharpe_ratio sortino_ratio calmar_ratio max_drawdown win_rate profit_factor avg_return median_return std_return skewness kurtosis")
_register("recovery_time", lambda spark, sf: evaluation.recovery_time(_strategy_returns(spark, sf)), f"""WITH {BARS}, {_EQ}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM eq3), tr AS (SELECT symbol, arg_min(i, (drawdown, i)) AS ti, arg_min(running_max, (drawdown, i)) AS pk FROM n GROUP BY 1), bk AS (SELECT n.symbol, min(i - ti) AS rec FROM n JOIN tr USING (symbol) WHERE i >= ti AND cumulative >= pk GROUP BY 1)
SELECT tr.symbol, bk.rec::INT AS recovery FROM tr LEFT JOIN bk USING (symbol)""")
_BT = f"""{_SIDE}, q AS (SELECT side.symbol, t0 AS ts, side AS s, close AS p, row_number() OVER (PARTITION BY side.symbol ORDER BY t0) AS i, first_value(close) OVER (PARTITION BY side.symbol ORDER BY t0) AS p0 FROM side JOIN bars ON bars.symbol = side.symbol AND bars.ts = side.t0),
k AS (SELECT symbol, ts, i, CASE WHEN s <> 0 THEN sign(s) * 0.1 ELSE 0 END::DOUBLE AS pos, 100000.0::DOUBLE * (1 - abs(CASE WHEN s <> 0 THEN 0.1 ELSE 0 END)) + 100000.0::DOUBLE * CASE WHEN s <> 0 THEN sign(s) * 0.1 ELSE 0 END AS val FROM q WHERE i = 1
 UNION ALL SELECT symbol, ts, i, pos, val * (1 - abs(pos)) + pos * val * p / p0 FROM (SELECT q.symbol, q.ts, q.i, q.p, q.p0, k.val, k.pos + CASE WHEN abs(q.s * 0.1 - k.pos) > 0.01 AND q.s <> 0 THEN sign(q.s) * abs(q.s * 0.1 - k.pos) ELSE 0 END AS pos FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1))"""
_register("backtest_run", lambda spark, sf: evaluation.run_backtest(S.MeanReversion().signals(bars(spark, sf)), bars(spark, sf)).select("symbol", "ts", "position", F.log10("value").alias("log_value")), f"WITH RECURSIVE {BARS}, {_BT}\nSELECT symbol, ts, pos AS position, log10(val) AS log_value FROM k", "position log_value")
_register("backtest_summary", lambda spark, sf: evaluation.simple_backtest(S.MeanReversion().signals(bars(spark, sf)), bars(spark, sf)))
_register("monte_carlo", lambda spark, sf: evaluation.monte_carlo(S.MeanReversion().signals(bars(spark, sf)), bars(spark, sf)))
_register("regime_backtest", lambda spark, sf: evaluation.regime_backtest(_votes(spark, sf), regimes.composite(_regimes(spark, sf)).select("symbol", "ts", F.col("canonical_regime").alias("regime")), bars(spark, sf), {"TREND": ["momentum"], "MEANREV": ["mean_reversion"]}))
_register("as_of_prices", lambda spark, sf: evaluation.as_of(ticks(spark, sf).select("symbol", (F.col("ts") + F.expr("interval 17 minutes")).alias("ts")), market.event_bars(spark, sf)), f"""WITH {HOURS}, {TICKS}, q AS (SELECT DISTINCT symbol, ts + INTERVAL 17 MINUTE AS ts FROM ticks)
SELECT q.symbol, q.ts, b.close FROM q ASOF LEFT JOIN bars b ON b.symbol = q.symbol AND b.ts <= q.ts""", "close")


def _plan_signals(spark: SparkSession, sf: str) -> DataFrame:
    return S.MeanReversion().signals(bars(spark, sf)).withColumn("signal", F.col("signal") * 0.01)


def _plan(mode: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        from .plans.ensemble import backtest

        return backtest(bars(spark, sf), _plan_signals(spark, sf), mode, crises=(("spring", "1995-03-01", "1995-06-30"), ("autumn", "1996-09-01", "1996-12-31")))

    return run


_register("plan_monte_carlo", _plan("monte_carlo"))


_register("tick_frame", lambda spark, sf: market.tick_frame(market.event_bars(spark, sf)), f"""WITH {HOURS}
SELECT symbol, ts, open, high, low, close, volume, close * volume AS dollar_volume, {_pct('close')} AS returns FROM bars""", "open high low close volume dollar_volume returns")


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return market.prepare(bars_all(spark, sf))[1]


_THRESHOLD = "(SELECT avg(daily_vol) FROM v)"
_register("prepared_events", _prepared, f"WITH RECURSIVE {BARS_ALL}, {_EWS}, {_cusum_sql(_THRESHOLD)}\nSELECT symbol, ts AS t0 FROM c WHERE hit <> 0")
_register("frac_diff_ffd", lambda spark, sf: seq.frac_diff_ffd(bars_all(spark, sf), 1.0).select("symbol", "ts", "frac_diff"), f"WITH {BARS_ALL}, d AS (SELECT symbol, ts, close - {_lag('close')} AS frac_diff FROM bars)\nSELECT symbol, ts, frac_diff FROM d WHERE frac_diff IS NOT NULL", "frac_diff")
_register("regime_at", lambda spark, sf: regimes.regime_at(_regimes(spark, sf), 3), f"WITH {BARS}, {_REG}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM reg)\nSELECT symbol, ts, trend_regime, vol_regime, volume_regime, micro_regime FROM n WHERE n = 3")
_register("regime_transition_count", lambda spark, sf: regimes.transition_count(_regimes(spark, sf), "vol_regime"), f"WITH {BARS}, {_ISLE}\nSELECT symbol, count(*) - 1 AS transitions FROM pp GROUP BY 1 HAVING count(*) > 1")
_register("regime_lookup", lambda spark, sf: regimes.lookup(_regimes(spark, sf), "vol_regime", "1996-06-15").withColumn("duration", F.col("duration").cast("long")), f"""WITH {BARS}, {_ISLE}, ru AS (SELECT symbol, ts, vol_regime, row_number() OVER (PARTITION BY symbol, period ORDER BY ts) AS n FROM pr)
SELECT symbol, vol_regime AS regime, n AS duration FROM ru WHERE ts = TIMESTAMP '1996-06-15'""")
_register("train_times", lambda spark, sf: models.train_times(_labelled(spark, sf), F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-06-30").cast("timestamp_ntz")), f"WITH {BARS}, {_TB}\nSELECT symbol, t0, t1, ret, label FROM tb WHERE t1 < TIMESTAMP '1996-01-01' OR t0 > TIMESTAMP '1996-06-30'", "ret")
_register("weights_by_time", lambda spark, sf: labels.weights_by_time(_labelled(spark, sf), 86400.0 * 90).select("symbol", "t0", "weight"), f"""WITH {BARS}, {_TB}, a AS (SELECT symbol, t0, exp(-ln(2) / (86400.0::DOUBLE * 90) * (epoch(max(t0) OVER (PARTITION BY symbol)) - epoch(t0))) AS w FROM tb)
SELECT symbol, t0, w / sum(w) OVER (PARTITION BY symbol) AS weight FROM a""", "weight")
_register("label_columns", lambda spark, sf: labels.label_columns(_labelled(spark, sf).drop("label")), f"WITH {BARS}, {_TB}\nSELECT symbol, t0, t1, sign(ret)::INT AS label, ret FROM tb", "ret")
_register("bandit_flat", lambda spark, sf: bandit.flat_replay(_votes(spark, sf).select(F.col("strategy").alias("name"), (F.col("confidence") * 2 - 1).alias("reward"))), f"""{_VB}, f AS (SELECT strategy AS name, confidence * 2 - 1 AS reward, ((confidence * 2 - 1) + 1) / 2 AS r FROM vo)
SELECT name, 1 + sum(CASE WHEN r > 0.5 THEN r ELSE 0 END) AS alpha, 1 + sum(CASE WHEN r > 0.5 THEN 0 ELSE 1 - r END) AS beta, count(*) AS total_trials, sum(reward) AS total_reward, avg(reward) AS avg_reward FROM f GROUP BY 1""", "alpha beta total_reward avg_reward")
_register("bandit_choose", lambda spark, sf: bandit.choose_arm(bandit.flat_replay(_votes(spark, sf).select(F.col("strategy").alias("name"), (F.col("confidence") * 2 - 1).alias("reward"))), "ucb").select("name"))
_register("bandit_intervals", lambda spark, sf: bandit.intervals(_arms(spark, sf), 500))
_register("execution_stats", lambda spark, sf: Execution.stats(Execution().trades(S.MeanReversion().signals(bars(spark, sf)).join(bars(spark, sf), ["symbol", "ts"]).select("ts", "symbol", "signal", F.col("close").alias("price"), F.lit(1e6).alias("portfolio_value"), F.lit(0.05).alias("position_size")))), f"""WITH {BARS}, {_SIDE}, t AS (SELECT 50000.0::DOUBLE AS v FROM side WHERE side <> 0)
SELECT count(*) AS num_trades, sum(greatest(v * 0.001, 1)) AS total_commission, sum(v * 0.0005) AS total_slippage, avg(greatest(v * 0.001, 1)) AS avg_commission, avg(v * 0.0005) AS avg_slippage, sum(greatest(v * 0.001, 1)) + sum(v * 0.0005) AS total_cost FROM t""", "total_commission total_slippage avg_commission avg_slippage total_cost")
_register("favourable_regimes", lambda spark, sf: regimes.composite(_regimes(spark, sf)).select("symbol", "ts", S.Momentum().favourable(F.col("composite_regime")).alias("momentum"), S.Volatility().favourable(F.col("composite_regime")).alias("volatility")), f"WITH {BARS}, {_REG}\nSELECT symbol, ts, trend_regime = 'trending' AS momentum, vol_regime = 'high_vol' AS volatility FROM reg")
_register("compatible_strategies", lambda spark, sf: ensemble.compatible(_votes(spark, sf), _preferred(spark)).select("symbol", "ts", "strategy", "compatible"), f"{_VB}, {_PREF}\nSELECT symbol, ts, vo.strategy, pf.strategy = vo.strategy AS compatible FROM vo JOIN pf USING (regime)")
_register("hedged_spread", lambda spark, sf: S.Pairs().hedged_spread(pair(spark, sf)).select("symbol", "ts", "hedge_ratio"), f"""WITH {BARS}, {_PAIR}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM pair), h AS (SELECT symbol, sum(price1 * price2) / sum(price2 * price2) AS hedge_ratio FROM l WHERE n <= 60 GROUP BY 1)
SELECT pair.symbol, pair.ts, hedge_ratio FROM pair JOIN h USING (symbol)""", "hedge_ratio")


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _trained(spark, sf)

    def own(rows: DataFrame) -> DataFrame:
        primary = models.Classifier(names, trees=5, depth=3).fit(rows)
        right = primary.predict(rows).withColumn("good", (F.col("prediction") * F.col("label") > 0).cast("int")).select(*rows.columns, "good")
        meta = models.Classifier(names, label="good", trees=5, depth=3).fit(right)
        return models.gated(rows, primary, meta).select("symbol", "t0", "primary", "meta", "regime_ok", "final")

    return models.by_symbol(rows, own)


_register("gated_predictions", _gated)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Mean-reversion signals of daily bars, counted by symbol and signal."""
    return S.MeanReversion().signals(bars(spark, sf)).groupBy("symbol", "signal").agg(F.count(F.lit(1)).alias("n"))


_register("signal_counts", flagship, f"WITH {BARS}, {_SIDE}\nSELECT symbol, side AS signal, count(*) AS n FROM side GROUP BY 1, 2")
