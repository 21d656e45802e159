"""Queries of whole feature frames and of operators that join several others, with their SQL.

A frame's SQL is a chain of CTEs, each of which adds columns to the one before, so
that a window over a window stands one level further down.  Importing this module
registers its queries beside those of :mod:`tideline.queries`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import indicators as I
from .functions.series import pct, project
from .operators import bandit, evaluation, features, labels, models, regimes
from .operators import sequential as seq
from .operators import strategies as S
from .queries import W, _lag, _pct, _r
from .sources import market

BARS, BARS_ALL = Q.BARS, Q.BARS_ALL
Q.PLACES.update(dict.fromkeys(("technical_features", "feature_matrix", "extended_features", "volatility_feature_frame", "vpin_features"), 4))


def _chain(name: str, source: str, *levels: dict[str, str]) -> str:
    """CTEs from source to ``name``, one for each level of new columns."""
    ctes = []
    for k, level in enumerate(levels):
        own = name if k == len(levels) - 1 else f"{name}_{k}"
        cols = ", ".join(f'{expr} AS "{column}"' for column, expr in level.items())
        ctes.append(f"{own} AS (SELECT *, {cols} FROM {source})")
        source = own
    return ",\n".join(ctes)


def _means(name: str, source: str, spans: dict[str, tuple[str, int]]) -> str:
    """symbol, ts and an exponential mean (column, span) for each name, by recursion."""
    inputs = ", ".join(dict.fromkeys(x for x, _ in spans.values()))
    first = ", ".join(f"{x} AS {n}" for n, (x, _) in spans.items())
    step = ", ".join(f"(1 - 2.0::DOUBLE / {s + 1}) * e.{n} + 2.0::DOUBLE / {s + 1} * o.{x} AS {n}" for n, (x, s) in spans.items())
    return (
        f"{name}_o AS (SELECT symbol, ts, {inputs}, row_number() OVER ({W}) AS i FROM {source}),\n"
        f"{name} AS (SELECT symbol, ts, i, {first} FROM {name}_o WHERE i = 1 UNION ALL\n"
        f" SELECT o.symbol, o.ts, o.i, {step} FROM {name} e JOIN {name}_o o ON o.symbol = e.symbol AND o.i = e.i + 1)"
    )


def _deviation(name: str, source: str, x: str, span: int) -> str:
    """symbol, ts, sd: the exponentially weighted deviation of a column, from sums over all rows before."""
    return f"""{name}_n AS (SELECT symbol, ts, {x} AS x, row_number() OVER ({W}) AS i FROM {source}),
{name}_s AS (SELECT a.symbol, a.ts, count(*) AS c, sum(w) AS sw, sum(w * w) AS sw2, sum(w * x) AS swx, sum(w * x * x) AS swxx
 FROM (SELECT a.symbol, a.ts, pow(1 - 2.0::DOUBLE / {span + 1}, a.i - b.i) AS w, b.x FROM {name}_n a JOIN {name}_n b ON b.symbol = a.symbol AND b.i <= a.i AND b.x IS NOT NULL) a GROUP BY 1, 2),
{name} AS (SELECT symbol, ts, CASE WHEN c > 1 THEN sqrt(greatest(swxx - swx * swx / sw, 0) / (sw - sw2 / sw)) END AS sd FROM {name}_s)"""


def _rank(name: str, source: str, x: str, n: int) -> str:
    """symbol, ts, p: average rank of a column's value among the last n, as a share of n."""
    return f"""{name}_n AS (SELECT symbol, ts, {x} AS x, row_number() OVER ({W}) AS i FROM {source}),
{name} AS (SELECT a.symbol, a.ts, CASE WHEN count(b.x) = {n} THEN (count(*) FILTER (b.x < a.x) + (count(*) FILTER (b.x = a.x) + 1) / 2.0) / {n} END AS p
 FROM {name}_n a JOIN {name}_n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - {n - 1} AND a.i GROUP BY 1, 2, a.x)"""


def _guarded_root(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN sqrt({x}) END"


def _register(name: str, query: Q.Query, ctes: str, columns: dict[str, str], source: str, doubles: set[str] | None = None, recursive: bool = False) -> None:
    """The query and SELECT columns FROM source; all columns but symbol and ts are doubles unless said."""
    picked = ", ".join(f'{expr} AS "{c}"' for c, expr in columns.items())
    named = " ".join(f'"{c}"' for c in columns if c not in ("symbol", "ts") and (doubles is None or c in doubles))
    Q._register(name, query, f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\nSELECT {picked} FROM {source}", named)


def _plain(*names: str) -> dict[str, str]:
    return {n: f'"{n}"' for n in names}


UPTO = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"

# Pieces that several frames share -------------------------------------------------------

_ROW = {"pc": _lag("close"), "ph": _lag("high"), "pl": _lag("low")}
_STEP = {
    "d": "close - pc", "ret": "close / nullif(pc, 0) - 1.0",
    "gain": "CASE WHEN close > pc THEN close - pc ELSE 0 END", "loss": "CASE WHEN close < pc THEN pc - close ELSE 0 END",
    "tr": "greatest(high - low, abs(high - pc), abs(low - pc))",
    "pm": "CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END",
    "mm": "CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END",
    "raw": f"100 * (close - {_r('min', 'low', 14)}) / ({_r('max', 'high', 14)} - {_r('min', 'low', 14)} + 1e-10)",
    "pv": "(high + low + close) / 3.0 * volume", "tick": "coalesce(sign(close - pc), 0)::DOUBLE", "spread": "(high - low) / close",
    "rule": f"coalesce(last_value(CASE WHEN close > pc THEN 1.0 WHEN close < pc THEN -1.0 END IGNORE NULLS) {UPTO}, 0)::DOUBLE",
}


def _rsi(n: int) -> str:
    return f"100 - 100 / (1 + {_r('avg', 'gain', n)} / ({_r('avg', 'loss', n)} + 1e-10))"


def _zscore(x: str, n: int) -> str:
    return f"({x} - {_r('avg', x, n)}) / ({_r('stddev_samp', x, n)} + 1e-10)"


def _strength(x: str) -> dict[str, str]:
    """Two levels: the size, then its share of the largest among 50."""
    return {"size_": f"abs({x})"}, {"share_": f"size_ / ({_r('max', 'size_', 50)} + 1e-10)"}


_STRENGTH = {"symbol": "symbol", "ts": "ts", "strength": "CASE WHEN share_ IS NOT NULL THEN least(greatest(share_, 0), 1) END"}
_KEYS = {"symbol": "symbol", "ts": "ts"}
_OHLCV = _plain("open", "high", "low", "close", "volume")

# Technical ------------------------------------------------------------------------------

_WINDOWS = (5, 10, 20, 50)
_TECH = (
    _chain(
        "tech_w", "bars", _ROW, _STEP | {"obvf": "coalesce(sign(close - pc), 0) * volume"},
        {f"sma_{w}": _r("avg", "close", w) for w in _WINDOWS}
        | {f"rsi_{w}": _rsi(w) for w in (7, 14, 21)}
        | {f"atr_{w}": _r("avg", "tr", w) for w in (7, 14, 21)}
        | {"sd20": _r("stddev_samp", "close", 20), "plus_di": f"100 * ({_r('avg', 'pm', 14)} / nullif({_r('avg', 'tr', 14)}, 0))", "minus_di": f"100 * ({_r('avg', 'mm', 14)} / nullif({_r('avg', 'tr', 14)}, 0))"}
        | {"stoch_k": _r("avg", "raw", 3), "obv": f"(sum(obvf) {UPTO})::DOUBLE", "vwap_20": f"{_r('sum', 'pv', 20)} / nullif({_r('sum', 'volume', 20)}, 0)"}
        | {f"momentum_{w}": _pct("close", w) for w in _WINDOWS}
        | {f"roc_{w}": f"(close - {_lag('close', w)}) / nullif({_lag('close', w)}, 0)" for w in _WINDOWS},
        {"dx": "100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10)", "stoch_d": _r("avg", "stoch_k", 3)}
        | {f"price_sma_ratio_{w}": f"close / sma_{w}" for w in _WINDOWS}
        | {"bb_upper": "sma_20 + 2 * sd20", "bb_middle": "sma_20", "bb_lower": "sma_20 - 2 * sd20", "bb_width": "(sma_20 + 2 * sd20) - (sma_20 - 2 * sd20)", "bb_pct": "(close - (sma_20 - 2 * sd20)) / (4 * sd20 + 1e-10)", "price_vwap_ratio": "close / vwap_20"},
        {"adx": _r("avg", "dx", 14)},
    )
    + ",\n" + _means("tech_e", "tech_w", {f"ema_{w}": ("close", w) for w in _WINDOWS} | {"fast": ("close", 12), "slow": ("close", 26), "obv_ema": ("obv", 20)})
    + ",\ntech_m AS (SELECT symbol, ts, fast - slow AS macd FROM tech_e),\n" + _means("tech_s", "tech_m", {"macd_signal": ("macd", 9)})
    + ",\ntech AS (SELECT w.*, e.* EXCLUDE (symbol, ts, i), e.fast - e.slow AS macd, s.macd_signal, e.fast - e.slow - s.macd_signal AS macd_histogram, "
    + ", ".join(f"w.close / e.ema_{w} AS price_ema_ratio_{w}" for w in _WINDOWS) + " FROM tech_w w JOIN tech_e e USING (symbol, ts) JOIN tech_s s USING (symbol, ts))"
)
_TECH_NAMES = (
    [f"sma_{w}" for w in _WINDOWS] + [f"price_sma_ratio_{w}" for w in _WINDOWS] + [f"rsi_{w}" for w in (7, 14, 21)] + [f"bb_{x}" for x in ("upper", "middle", "lower", "width", "pct")]
    + [f"atr_{w}" for w in (7, 14, 21)] + ["adx", "plus_di", "minus_di", "stoch_k", "stoch_d", "obv", "vwap_20", "price_vwap_ratio"] + [f"momentum_{w}" for w in _WINDOWS] + [f"roc_{w}" for w in _WINDOWS]
    + [f"ema_{w}" for w in _WINDOWS] + ["obv_ema"] + [f"price_ema_ratio_{w}" for w in _WINDOWS] + ["macd", "macd_signal", "macd_histogram"]
)
_register("technical_features", lambda spark, sf: seq.technical_features(Q.bars(spark, sf)), f"{BARS},\n{_TECH}", _KEYS | _OHLCV | _plain(*_TECH_NAMES), "tech", recursive=True)

# Volatility -----------------------------------------------------------------------------

_K = "(0.34 / (1.34 + 21.0 / 19.0))"
_LOGS = {
    "hl": "ln(high / low)", "co": "ln(close / open)", "rs": "ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close)",
    "oc": f"ln(open / {_lag('close')})", "cc": f"ln(close / {_lag('close')})", "vret": _pct("close"),
}
_VOL_TERMS = {"pk": "hl * hl / (4 * ln(2))", "gk": "0.5 * hl * hl - (2 * ln(2) - 1) * co * co"}
_VOL_MEANS = {
    "v_pk": f"{_r('avg', 'pk', 20)} * 252", "v_gk": f"{_r('avg', 'gk', 20)} * 252", "v_rs": f"{_r('avg', 'rs', 20)} * 252",
    "v_yz": f"({_r('var_samp', 'oc', 20)} + {_K} * {_r('var_samp', 'cc', 20)} + (1 - {_K}) * {_r('avg', 'rs', 20)}) * 252",
}
_VOLS = {"parkinson": _guarded_root("v_pk"), "garman_klass": _guarded_root("v_gk"), "rogers_satchell": _guarded_root("v_rs"), "yang_zhang": _guarded_root("v_yz"), "realized": f"{_r('stddev_samp', 'vret', 20)} * sqrt(252)"}
_VOL = _chain("vol_w", "bars", _LOGS, _VOL_TERMS, _VOL_MEANS, _VOLS) + ",\n" + _deviation("vol_d", "vol_w", "vret", 20) + ",\nvol AS (SELECT w.*, d.sd * sqrt(252) AS ewma FROM vol_w w LEFT JOIN vol_d d USING (symbol, ts))"
_VOL_NAMES = ["parkinson", "garman_klass", "rogers_satchell", "yang_zhang", "realized", "ewma"]
_register("volatility_estimates", lambda spark, sf: seq.volatility_estimates(Q.bars(spark, sf)).select("symbol", "ts", *_VOL_NAMES), f"{BARS},\n{_VOL}", _KEYS | _plain(*_VOL_NAMES), "vol")

# Microstructure -------------------------------------------------------------------------


def _kyle(w: int) -> tuple[dict[str, str], dict[str, str]]:
    prev = f"OVER ({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    raw = f"CASE WHEN at_ > {w} AND count(f2) {prev} > 5 AND var_samp(f2) {prev} > 0 THEN abs(covar_samp(ret, flow) {prev} / (var_samp(f2) {prev} + 1e-10)) END"
    return {f"kyle_raw_{w}": raw}, {f"kyle_lambda_{w}": f"last_value(kyle_raw_{w} IGNORE NULLS) {UPTO}"}


def _micro(name: str, windows: tuple[int, ...]) -> str:
    raws = {k: v for w in windows for k, v in _kyle(w)[0].items()}
    held = {k: v for w in windows for k, v in _kyle(w)[1].items()}
    cov = f"CASE WHEN at_ > 21 THEN sum(dd) OVER ({W} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) / 19.0 END"
    return _chain(
        name, "bars", _ROW, _STEP, {"flow": "rule * volume", "dd": f"d * {_lag('d')}", "il": "abs(ret) / (close * volume + 1e-10)", "ar": "abs(ret)", "at_": f"row_number() OVER ({W})"},
        {"f2": "CASE WHEN ret IS NOT NULL THEN flow END", "cov": cov}, raws,
        held | {f"ofi_{w}": _r("sum", "flow", w) for w in windows} | {"effective_spread": "spread", "roll_spread": "CASE WHEN cov < 0 THEN 2 * sqrt(-cov) WHEN cov >= 0 THEN 0 END"}
        | {f"amihud_illiq_{w}": _r("avg", "il", w) for w in windows}
        | {"volume_ma_20": _r("avg", "volume", 20), "volume_std_20": _r("stddev_samp", "volume", 20), "volume_ratio": f"volume / {_r('avg', 'volume', 20)}"}
        | {f"price_impact_{w}": f"{_r('avg', 'ar', w)} / ({_r('avg', 'volume', w)} + 1e-10)" for w in windows} | {f"trade_intensity_{w}": _r("sum", "volume", w) for w in windows},
    )


def _micro_names(windows: tuple[int, ...]) -> list[str]:
    per = ("ofi", "kyle_lambda", "amihud_illiq", "price_impact", "trade_intensity")
    return [f"{p}_{w}" for p in per for w in windows] + ["effective_spread", "roll_spread", "volume_ma_20", "volume_std_20", "volume_ratio"]


_register("micro_features", lambda spark, sf: project(Q.bars(spark, sf), I.micro_features(), keep=["symbol", "ts"]), f"{BARS},\n{_micro('micro', (5, 10, 20))}", _KEYS | _plain(*_micro_names((5, 10, 20))), "micro")


def _vpin(name: str, buckets: int) -> str:
    """symbol, ts, vpin of bars, in the reference's form: 0.5 from the 20th full bucket on, 0 while none of the last 20 is uneven."""
    return f"""{name}_t AS (SELECT symbol, ts, volume, rule, sum(volume) OVER (PARTITION BY symbol) / {buckets}.0 AS size, row_number() OVER ({W}) AS i FROM {name}_1),
{name}_v AS (SELECT symbol, ts, i, volume AS s, CASE WHEN rule >= 0 THEN volume ELSE 0 END AS buy, CASE WHEN rule <= 0 THEN volume ELSE 0 END AS sell, (volume >= size) AS shut FROM {name}_t WHERE i = 1
 UNION ALL SELECT t.symbol, t.ts, t.i, CASE WHEN v.shut THEN 0 ELSE v.s END + t.volume, CASE WHEN v.shut THEN 0 ELSE v.buy END + CASE WHEN rule >= 0 THEN t.volume ELSE 0 END,
  CASE WHEN v.shut THEN 0 ELSE v.sell END + CASE WHEN rule <= 0 THEN t.volume ELSE 0 END, CASE WHEN v.shut THEN 0 ELSE v.s END + t.volume >= t.size FROM {name}_v v JOIN {name}_t t ON t.symbol = v.symbol AND t.i = v.i + 1),
{name}_b AS (SELECT symbol, ts, CASE WHEN count(*) OVER w = 20 THEN CASE WHEN sum(abs(buy - sell)) OVER w > 0 THEN 0.5 ELSE 0 END END::DOUBLE AS x FROM {name}_v WHERE shut WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
{name} AS (SELECT t.symbol, t.ts, last_value(b.x IGNORE NULLS) OVER (PARTITION BY t.symbol ORDER BY t.ts ROWS UNBOUNDED PRECEDING) AS vpin FROM {name}_t t LEFT JOIN {name}_b b ON b.symbol = t.symbol AND b.ts = t.ts)"""


def _vpin_of_bars(name: str, buckets: int) -> str:
    return f"{name}_0 AS (SELECT *, {_lag('close')} AS pc FROM bars), {name}_1 AS (SELECT *, {_STEP['rule']} AS rule FROM {name}_0),\n{_vpin(name, buckets)}"


_BUCKETS = (25, 50, 100)
_VF = ",\n".join(_vpin_of_bars(f"vp{n}", n) for n in _BUCKETS)
_VF += ",\nvps AS (SELECT b.symbol, b.ts, " + ", ".join(f"vp{n}.vpin AS vpin_{n}" for n in _BUCKETS) + " FROM bars b " + " ".join(f"JOIN vp{n} USING (symbol, ts)" for n in _BUCKETS) + ")"
_VF += ",\nvpc AS (SELECT *, " + ", ".join(f"vpin_{n} - {_lag(f'vpin_{n}')} AS vpin_change_{n}" for n in _BUCKETS) + " FROM vps),\n" + ",\n".join(_rank(f"vr{n}", "vps", f"vpin_{n}", 100) for n in _BUCKETS)
_VF += ",\nvpf AS (SELECT vpc.*, " + ", ".join(f"vr{n}.p AS vpin_pct_{n}" for n in _BUCKETS) + " FROM vpc " + " ".join(f"JOIN vr{n} USING (symbol, ts)" for n in _BUCKETS) + ")"
_VF_NAMES = [f"vpin{kind}_{n}" for n in _BUCKETS for kind in ("", "_change", "_pct")]
_register("vpin_features", lambda spark, sf: seq.vpin_features(Q.bars(spark, sf)).select("symbol", "ts", *_VF_NAMES), f"{BARS},\n{_VF}", _KEYS | _plain(*_VF_NAMES), "vpf", recursive=True)

# Feature matrices -----------------------------------------------------------------------


def _frac(name: str, d: float, threshold: float) -> str:
    weights = seq.frac_diff_weights(d, threshold)
    values = ", ".join(f"{w!r}::DOUBLE" for w in reversed(weights.tolist()))
    return f"""{name}_a AS (SELECT symbol, list(close ORDER BY ts) AS xs FROM bars GROUP BY 1), {name}_w AS (SELECT [{values}] AS ws), {name}_n AS (SELECT symbol, ts, row_number() OVER ({W}) AS i FROM bars),
{name} AS (SELECT symbol, ts, CASE WHEN i >= {len(weights)} THEN list_inner_product(xs[i - {len(weights) - 1}:i], ws) END AS y FROM {name}_n JOIN {name}_a USING (symbol), {name}_w)"""


_MATRIX_RAW = _chain(
    "fm_w", "micro",
    _LOGS, _VOL_TERMS, _VOL_MEANS,
    {f"vol_{k}": v for k, v in _VOLS.items()} | {"kyle_lambda": "kyle_lambda_20", "rsi_14": _rsi(14), "m20": _r("avg", "close", 20), "sd20": _r("stddev_samp", "close", 20), "atr_14": _r("avg", "tr", 14)}
    | {"plus_di": f"100 * ({_r('avg', 'pm', 14)} / nullif({_r('avg', 'tr', 14)}, 0))", "minus_di": f"100 * ({_r('avg', 'mm', 14)} / nullif({_r('avg', 'tr', 14)}, 0))", "momentum_20": _pct("close", 20), "stoch_k": "raw"},
    {"dx": "100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10)", "bb_position": "(close - (m20 - 2 * sd20)) / (4 * sd20 + 1e-10)", "price_sma_ratio_20": "close / m20"},
    {"adx_14": _r("avg", "dx", 14)},
)
_MATRIX = f"""{BARS},
{_micro('micro', (20,))},
{_MATRIX_RAW},
{_deviation('fm_d', 'fm_w', 'vret', 20)},
{_frac('fm_f', 0.9, 1e-4)},
{_vpin_of_bars('fm_v', 50)},
{_means('fm_e', 'bars', {'fast': ('close', 12), 'slow': ('close', 26)})},
fm_j AS (SELECT w.*, f.y AS frac_diff_price, d.sd * sqrt(252) AS vol_ewma, v.vpin, e.fast - e.slow AS macd FROM fm_w w JOIN fm_f f USING (symbol, ts) LEFT JOIN fm_d d USING (symbol, ts) JOIN fm_v v USING (symbol, ts) JOIN fm_e e USING (symbol, ts)),
fm AS (SELECT symbol, ts, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) {UPTO}, first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}' for c in features.MATRIX)} FROM fm_j)"""
_ANY = " OR ".join(f"{c} IS NOT NULL" for c in features.MATRIX)
_register("feature_matrix", lambda spark, sf: features.feature_matrix(Q.bars(spark, sf), d=0.9, threshold=1e-4), _MATRIX, _KEYS | _plain(*features.MATRIX), f"fm WHERE {_ANY}", set(features.MATRIX), recursive=True)

_EXT_MICRO = _micro_names((10, 20))
_EXT = f"""{BARS_ALL},
{_VOL},
{_micro('micro', (10, 20))},
{_TECH},
{_vpin_of_bars('xv', 50)},
{_frac('x4', 0.4, 1e-5)},
{_frac('x6', 0.6, 1e-5)},
{_chain('xr', 'bars', {'log_returns': f"ln(close / {_lag('close')})", 'xret': _pct('close'), 'hl_range': '(high - low) / close', 'oc_range': 'abs(close - open) / open'} | {f'returns_{w}': _pct('close', w) for w in _WINDOWS}, {f'volatility_{w}': _r('stddev_samp', 'xret', w) for w in _WINDOWS})}"""
_EXT_COLUMNS = (
    {"symbol": "xr.symbol", "ts": "xr.ts", "frac_diff_0.4": "x4.y", "frac_diff_0.6": "x6.y", "log_returns": "log_returns"}
    | {f"vol_{n}": f"vol.{n}" for n in _VOL_NAMES} | {f"micro_{n}": f"micro.{n}" for n in _EXT_MICRO} | {"micro_vpin": "xv.vpin"} | {f"tech_{n}": f"tech.{n}" for n in _TECH_NAMES}
    | _plain("hl_range", "oc_range") | {k: f"xr.{k}" for w in _WINDOWS for k in (f"returns_{w}", f"volatility_{w}")}
)
_register(
    "extended_features", lambda spark, sf: features.extended_features(Q.bars_all(spark, sf)), _EXT, _EXT_COLUMNS,
    "xr " + " ".join(f"JOIN {t} ON {t}.symbol = xr.symbol AND {t}.ts = xr.ts" for t in ("vol", "micro", "tech", "xv", "x4", "x6")), recursive=True,
)

# Strategies -----------------------------------------------------------------------------


def _frame(strategy: type, ctes: str, names: list[str], source: str) -> None:
    _register(f"{strategy.name}_feature_frame", lambda spark, sf, s=strategy: s().feature_frame(Q.bars(spark, sf)), f"{BARS},\n{ctes}", _KEYS | _plain(*names), source)


def _strengths(strategy: type, *levels: dict[str, str]) -> None:
    _register(f"{strategy.name}_strength", lambda spark, sf, s=strategy: s().strengths(Q.bars(spark, sf)), f"{BARS},\n{_chain('st', 'bars', *levels)}", _STRENGTH, "st")


_VF1 = _chain(
    "vf", "bars", _ROW, _STEP | {"hl": "ln(high / low)", "co": "ln(close / open)"},
    {"gk": "0.5 * hl * hl - (2 * ln(2) - 1) * co * co"} | {f"vol_realized_{n}": _r("stddev_samp", "ret", n) for n in (5, 10, 20, 50)} | {"vol_parkinson": _r("stddev_samp", "hl", 20), "atr": _r("avg", "tr", 14), "intraday_range": "spread"},
    {"gk_mean": _r("avg", "gk", 20), "vol_regime": f"coalesce(vol_realized_20 / nullif({_r('avg', 'vol_realized_20', 50)}, 0), 1.0)", "vol_change": _pct("vol_realized_20"), "atr_ratio": "atr / close"},
    {"vol_garman_klass": _guarded_root("gk_mean")},
)
_frame(S.Volatility, f"{_VF1},\n{_rank('vfr', 'vf', 'vol_realized_20', 100)},\nvff AS (SELECT vf.*, vfr.p AS vol_percentile FROM vf JOIN vfr USING (symbol, ts))",
       [f"vol_realized_{n}" for n in (5, 10, 20, 50)] + ["vol_parkinson", "vol_garman_klass", "vol_regime", "vol_change", "atr", "atr_ratio", "vol_percentile", "intraday_range"], "vff")
_strengths(S.Volatility, _ROW, _STEP, {"vol": _r("stddev_samp", "ret", 20)}, {"middle": _r("avg", "vol", 40)}, *_strength("abs(vol - middle) / (middle + 1e-10)"))

_SCALP = _chain(
    "sf", "bars", _ROW, _STEP | {"way": "sign(close - pc)::DOUBLE", "flow": "coalesce(sign(close - pc), 0) * volume"},
    {f"momentum_{n}": _pct("close", n) for n in (1, 2, 3, 5)} | {"tick_direction": "way"} | {f"ofi_{n}": _r("sum", "flow", n) for n in (3, 5, 10)}
    | {"spread_ma": _r("avg", "spread", 20), "volume_surge": f"volume / {_r('avg', 'volume', 10)}", "price_velocity": "(close - pc) / nullif(pc, 0)", "microstructure_noise": f"1.0 - {_r('var_samp', 'ret', 40)} / (2.0 * {_r('var_samp', 'ret', 20)} + 1e-10)"}
    | {f"tick_imbalance_{n}": _r("sum", "way", n) for n in (5, 10, 20)} | {"near_high": f"coalesce(close / nullif({_r('max', 'high', 5)}, 0), 1.0)", "near_low": f"coalesce(close / nullif({_r('min', 'low', 5)}, 0), 1.0)"},
    {"spread_ratio": "spread / nullif(spread_ma, 0)"},
)
_frame(S.Scalping, _SCALP, [f"momentum_{n}" for n in (1, 2, 3, 5)] + ["tick_direction"] + [f"ofi_{n}" for n in (3, 5, 10)] + ["spread", "spread_ma", "spread_ratio", "volume_surge", "price_velocity", "microstructure_noise"]
       + [f"tick_imbalance_{n}" for n in (5, 10, 20)] + ["near_high", "near_low"], "sf")
_strengths(S.Scalping, _ROW, _STEP, {"flow": "tick * volume"}, {"ofi": _r("sum", "flow", 5)}, *_strength("ofi"))

_SENT = f"""{Q._SENT},
{_chain('sx', 'bars', _ROW, _STEP | {'uv2': 'CASE WHEN close > pc THEN volume ELSE 0 END', 'dv2': 'CASE WHEN close < pc THEN volume ELSE 0 END'},
        {'bull': 'CASE WHEN ret > 0 THEN 1.0 ELSE 0 END', 'bear': 'CASE WHEN ret < 0 THEN 1.0 ELSE 0 END', 'vol2': _r('stddev_samp', 'ret', 20)},
        {f'volume_sentiment_{n}': f"({_r('sum', 'uv2', n)} - {_r('sum', 'dv2', n)}) / ({_r('sum', 'uv2', n)} + {_r('sum', 'dv2', n)} + 1e-10)" for n in (5, 10, 20)}
        | {'put_call_proxy': f"{_r('sum', 'dv2', 20)} / ({_r('sum', 'uv2', 20)} + 1e-10)", 'fear_index': f"vol2 / nullif({_r('avg', 'vol2', 50)}, 0)", 'advance_decline': f'sum(tick) {UPTO}', 'bull_bear_spread': f"{_r('avg', 'bull', 20)} - {_r('avg', 'bear', 20)}"})},
{_chain('sy', 'se', {'sentiment_score': 'score', 'sentiment_change': f"score - {_lag('score')}"}, {'sentiment_acceleration': f"sentiment_change - {_lag('sentiment_change')}"})},
{_rank('sr20', 'se', 'score', 20)},
{_rank('sr50', 'se', 'score', 50)},
sff AS (SELECT sx.*, sy.* EXCLUDE (symbol, ts), sr20.p AS sentiment_percentile_20, sr50.p AS sentiment_percentile_50 FROM sx JOIN sy USING (symbol, ts) JOIN sr20 USING (symbol, ts) JOIN sr50 USING (symbol, ts))"""
_frame(S.Sentiment, _SENT, ["sentiment_score"] + [f"volume_sentiment_{n}" for n in (5, 10, 20)] + ["put_call_proxy", "fear_index", "advance_decline", "sentiment_percentile_20", "sentiment_percentile_50", "sentiment_change", "sentiment_acceleration", "bull_bear_spread"], "sff")
_register("sentiment_strength", lambda spark, sf: S.Sentiment().strengths(Q.bars(spark, sf)), f"{BARS},\n{Q._SENT},\n{_chain('st', 'se', *_strength('score'))}", _STRENGTH, "st")

_RETURN_CORR = f"""CASE WHEN {_r('sum', 'CASE WHEN ret IS NOT NULL THEN 1.0 END', 20)} > 0 AND count(CASE WHEN lr IS NOT NULL THEN ret END) OVER ({W} ROWS 18 PRECEDING) = 19
 AND stddev_pop(ret) OVER ({W} ROWS 18 PRECEDING) > 0 AND stddev_pop(lr) OVER ({W} ROWS 18 PRECEDING) > 0 THEN corr(ret, lr) OVER ({W} ROWS 18 PRECEDING) END"""
_MR = _chain(
    "mr", "bars", _ROW, _STEP, {"lr": _lag("ret"), "sd20": _r("stddev_samp", "close", 20), "m20": _r("avg", "close", 20)} | {f"zscore_{n}": _zscore("close", n) for n in (10, 20, 50)}
    | {f"mean_distance_{n}": f"(close - {_r('avg', 'close', n)}) / {_r('avg', 'close', n)}" for n in (10, 20, 50)} | {"rsi": _rsi(14), "stoch": "raw"},
    {"bb_position": "(close - (m20 - 2 * sd20)) / (4 * sd20 + 1e-10)", "mean_reversion_speed": _RETURN_CORR},
)
_frame(S.MeanReversion, _MR, [f"zscore_{n}" for n in (10, 20, 50)] + ["bb_position"] + [f"mean_distance_{n}" for n in (10, 20, 50)] + ["rsi", "stoch", "mean_reversion_speed"], "mr")
_strengths(S.MeanReversion, *_strength(_zscore("close", 20)))
_MOM = _chain("mo", "bars", {"sma_20": _r("avg", "close", 20), "sma_50": _r("avg", "close", 50), "momentum_strength": f"abs({_pct('close', 20)})", "volume_trend": _pct("volume", 20)}, {"ma_cross": "CASE WHEN sma_20 > sma_50 THEN 1 ELSE 0 END::INT"})
_register("momentum_cross", lambda spark, sf: S.Momentum().feature_frame(Q.bars(spark, sf)).select("symbol", "ts", "sma_20", "sma_50", "momentum_strength", "volume_trend", "ma_cross"), f"{BARS},\n{_MOM}",
          _KEYS | _plain("sma_20", "sma_50", "momentum_strength", "volume_trend", "ma_cross"), "mo", {"sma_20", "sma_50", "momentum_strength", "volume_trend"})

_DAY = "day(ts)"
_SEASON = f"""{Q._SEAS}, sw AS (SELECT *, coalesce(avg(returns) OVER (PARTITION BY symbol, dow), 0) AS seasonal_dow_return, coalesce(avg(returns) OVER (PARTITION BY symbol, mon), 0) AS seasonal_month_return,
 avg(returns) OVER (PARTITION BY symbol, dow ORDER BY ts ROWS 3 PRECEDING) AS recent FROM k)"""
_SEASON_INTS = (
    {f"dow_{d}": f"(dow = {d})::INT" for d in range(5)} | {f"month_{m}": f"(mon = {m})::INT" for m in range(1, 13)}
    | {"week_of_month": f"(({_DAY} - 1) // 7)::INT", "is_month_start": f"({_DAY} <= 5)::INT", "is_month_end": f"({_DAY} >= 25)::INT", "quarter": "quarter(ts)::INT"}
)
_SEASON_DOUBLES = _plain("seasonal_dow_return", "seasonal_month_return") | {f"recent_dow_{d}_return": f"coalesce(CASE WHEN dow = {d} THEN recent END, 0)" for d in range(5)}


def _fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = Q.bars(spark, sf)
    return b, S.Seasonality().fit(b)


_register("seasonality_features", lambda spark, sf: S.Seasonality().feature_frame(*_fitted(spark, sf)), f"{BARS}, {_SEASON}", _KEYS | _SEASON_INTS | _SEASON_DOUBLES, "sw", set(_SEASON_DOUBLES))
_register("seasonality_strength", lambda spark, sf: S.Seasonality().strengths(*_fitted(spark, sf)), f"{BARS}, {_SEASON}, sz AS (SELECT *, max(abs(seasonal_dow_return)) OVER (PARTITION BY symbol) AS top_ FROM sw)",
          _KEYS | {"strength": "CASE WHEN top_ > 0 THEN abs(seasonal_dow_return) / top_ ELSE 0 END"}, "sz")

# Regimes and labels ---------------------------------------------------------------------

_SMOOTH = f"""{Q._REG}, rm AS (SELECT symbol, ts, (CASE vol_regime WHEN 'high_vol' THEN 1 WHEN 'low_vol' THEN -1 ELSE 0 END)::INT AS v FROM reg),
ra AS (SELECT *, lag(v) OVER ({W}) AS a, lead(v) OVER ({W}) AS c FROM rm)"""
_register("regime_smoothed", lambda spark, sf: regimes.smoothed(regimes.regime_matrix(Q._regimes(spark, sf)), "vol_regime").select("symbol", "ts", "smoothed"), f"{BARS}, {_SMOOTH}",
          _KEYS | {"smoothed": "CASE WHEN a IS NULL OR c IS NULL THEN NULL WHEN v = a OR v = c THEN v WHEN a = c THEN a ELSE least(a, v, c) END"}, "ra", set())

_EWM_BARRIER = f"""{BARS_ALL}, {Q.RETURNS},
{_deviation('bd', 'r', 'returns', 100)},
{Q._cusum_sql('0.5::DOUBLE')},
bn AS (SELECT bars.symbol, bars.ts, close, sd, row_number() OVER (PARTITION BY bars.symbol ORDER BY bars.ts) AS i FROM bars LEFT JOIN bd USING (symbol, ts)),
bp AS (SELECT a.symbol, a.ts AS t0, a.sd, b.i - a.i AS k, b.ts, b.close / a.close - 1 AS x FROM bn a JOIN c ON c.symbol = a.symbol AND c.ts = a.ts AND c.hit <> 0 JOIN bn b ON b.symbol = a.symbol AND b.i BETWEEN a.i AND a.i + 5),
bh AS (SELECT symbol, t0, count(*) AS n, arg_max(ts, k) AS lt, arg_max(x, k) AS lx, min(CASE WHEN x >= sd THEN k END) AS u, min(CASE WHEN x <= -sd THEN k END) AS d FROM bp GROUP BY 1, 2),
bw AS (SELECT *, (d IS NOT NULL AND (u IS NULL OR d <= u)) AS lower_ FROM bh WHERE n > 1),
bt AS (SELECT bw.*, bp.ts AS ht, bp.x AS hx FROM bw LEFT JOIN bp ON bp.symbol = bw.symbol AND bp.t0 = bw.t0 AND bp.k = CASE WHEN lower_ THEN d ELSE u END)"""
_register(
    "triple_barrier_ewm", lambda spark, sf: labels.triple_barrier(Q.bars_all(spark, sf), seq.cusum_events(Q.bars_all(spark, sf), 0.5)), _EWM_BARRIER,
    {"symbol": "symbol", "t0": "t0", "t1": "coalesce(ht, lt)", "ret": "coalesce(hx, lx)", "label": "(CASE WHEN lower_ THEN -1 WHEN u IS NOT NULL THEN 1 WHEN lx > 0 THEN 1 ELSE -1 END)::INT"}, "bt", {"ret"}, recursive=True,
)

# Sources --------------------------------------------------------------------------------


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    """valid: what validate() says of all bars, which raises where they won't do."""
    return spark.createDataFrame([(market.validate(Q.bars(spark, sf)), Q.bars(spark, sf).count())], "valid boolean, n long")


_register("validated", _validated, BARS, {"valid": "count(*) >= 100", "n": "count(*)"}, "bars", set())


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    quotes = Q.bars(spark, sf).withColumns({"bid": F.col("low"), "ask": F.when(F.col("volume") > 1, F.col("high"))})
    return quotes.select("symbol", "ts", *(c.alias(n) for n, c in market.quote_columns().items()))


_register("quote_properties", _quotes, f"{BARS}, qu AS (SELECT *, low AS bid, CASE WHEN volume > 1 THEN high END AS ask FROM bars)", _KEYS | {"dollar_volume": "close * volume", "vwap": "close", "mid": "(bid + ask) / 2.0", "spread": "ask - bid"}, "qu")

# Bandit ---------------------------------------------------------------------------------

_ARMS = f"{BARS}, {Q._VOTES}, {Q._OUT}, ar AS (SELECT strategy, regime, greatest(1, 1 + sum(reward) * 0.995) AS alpha, greatest(1, 1 + (count(*) - sum(reward)) * 0.995) AS beta, count(*)::INT AS pulls, sum(reward) AS total_reward FROM oc GROUP BY 1, 2)"
_WINS = f"{_ARMS}, wr AS (SELECT *, CASE WHEN alpha + beta <= 2 THEN 0.5 ELSE alpha / (alpha + beta) END AS win_rate FROM ar), rk AS (SELECT *, (row_number() OVER (PARTITION BY regime ORDER BY win_rate DESC, strategy))::INT AS rank FROM wr)"
_register("bandit_summary", lambda spark, sf: bandit.summary(Q._arms(spark, sf)).select("strategy", "regime", "win_rate", "rank"), _WINS, _plain("strategy", "regime", "win_rate", "rank"), "rk", {"win_rate"})
_RESET = {c: f"CASE WHEN strategy = 'momentum' AND regime = 'TREND' THEN {v} ELSE {c} END" for c, v in (("alpha", "1.0"), ("beta", "1.0"), ("pulls", "0"), ("total_reward", "0.0"))}
_register("bandit_reset", lambda spark, sf: bandit.reset(Q._arms(spark, sf), "momentum", "TREND"), _ARMS, _plain("strategy", "regime") | _RESET, "ar", {"alpha", "beta", "total_reward"})

_UCB = f"""{BARS}, {Q._VOTES}, fl AS (SELECT strategy AS name, count(*) AS n, avg(confidence * 2 - 1) AS m FROM vo GROUP BY 1), ub AS (SELECT *, m + 2.0 * sqrt(ln(sum(n) OVER ()) / n) AS b FROM fl), uo AS (SELECT *, row_number() OVER (ORDER BY b DESC, name) AS place FROM ub)"""
_register("bandit_choose", Q.QUERIES["bandit_choose"], _UCB, {"name": "name"}, "uo WHERE place = 1", set())

# Evaluation -----------------------------------------------------------------------------

_TRADES = f"{BARS}, {Q._BT}, kt AS (SELECT *, pos - coalesce(lag(pos) OVER ({W}), CASE WHEN i = 1 THEN 0 END) AS change FROM k)"
_register("backtest_trades", lambda spark, sf: evaluation.backtest_trades(evaluation.run_backtest(S.MeanReversion().signals(Q.bars(spark, sf)), Q.bars(spark, sf))).select("ts", "symbol", "side"), _TRADES,
          {"ts": "kt.ts", "symbol": "kt.symbol", "side": "CASE WHEN side.side > 0 THEN 'buy' ELSE 'sell' END"}, "kt JOIN side ON side.symbol = kt.symbol AND side.t0 = kt.ts WHERE change <> 0", set(), recursive=True)

#: Of a backtest's summary what does not hang on the last bit of an account's value: an account near nothing changes by less.
_STABLE = ("account_return", "total_return", "annual_return", "annual_volatility", "sharpe_ratio", "num_periods", "avg_return", "median_return", "std_return", "skewness")
_ACCOUNT = f"""bm AS (SELECT symbol, ts, i, val, (val - 100000.0) / 100000.0 AS c FROM k), bl AS (SELECT symbol, ts, c, lag(c) OVER ({W}) AS pc FROM bm WHERE i > 1),
br AS (SELECT symbol, ts, coalesce(c / nullif(pc, 0) - 1.0, 0) AS returns FROM bl), ba AS (SELECT symbol, arg_max(c, ts) AS account_return FROM bm GROUP BY 1),
bs AS (SELECT symbol, count(*) AS n, product(1 + returns) - 1 AS t, avg(returns) AS mu, stddev_samp(returns) AS sd, quantile_cont(returns, 0.5) AS md, skewness(returns) AS sk FROM br GROUP BY 1)"""
_ACCOUNT_COLUMNS = {"symbol": "symbol", "account_return": "account_return", "total_return": "t", "annual_return": "mu * 252", "annual_volatility": "sd * sqrt(252)", "sharpe_ratio": "mu / sd * sqrt(252)", "num_periods": "n", "avg_return": "mu", "median_return": "md", "std_return": "sd", "skewness": "sk"}
_register("backtest_metrics", lambda spark, sf: Q.QUERIES["backtest_summary"](spark, sf).select("symbol", *_STABLE), f"{BARS}, {Q._BT}, {_ACCOUNT}", _ACCOUNT_COLUMNS, "bs JOIN ba USING (symbol)", set(_STABLE) - {"num_periods"}, recursive=True)
_REGIME_SIDE = """sg2 AS (SELECT reg.symbol, reg.ts AS t0, coalesce(CASE WHEN regime = 'TREND' THEN mo WHEN regime = 'MEANREV' THEN me END, 0) AS side FROM reg JOIN (SELECT symbol, ts, min(regime) AS regime,
 max(CASE WHEN strategy = 'momentum' THEN signal END) AS mo, max(CASE WHEN strategy = 'mean_reversion' THEN signal END) AS me FROM vo GROUP BY 1, 2) p ON p.symbol = reg.symbol AND p.ts = reg.ts)"""
_REGIME_BT = Q._BT.removeprefix(f"{Q._SIDE}, ").removeprefix(f"{Q._SIDE},\n").replace("FROM side JOIN bars", "FROM sg2 AS side JOIN bars")
_register("regime_backtest_metrics", lambda spark, sf: Q.QUERIES["regime_backtest"](spark, sf).select("symbol", *_STABLE), f"{BARS}, {Q._VOTES}, {_REGIME_SIDE}, {_REGIME_BT}, {_ACCOUNT}", _ACCOUNT_COLUMNS, "bs JOIN ba USING (symbol)", set(_STABLE) - {"num_periods"}, recursive=True)

_SUMS = """count(*) AS n, product(1.0 + returns) - 1.0 AS total_return, CASE WHEN stddev_pop(returns) > 0 THEN avg(returns) / stddev_pop(returns) * sqrt(252) ELSE 0 END AS sharpe,
 min(dd) AS max_drawdown, avg(CASE WHEN returns > 0 THEN 1.0 ELSE 0 END) AS win_rate"""


def _plan_sql(rows: str, every: int) -> str:
    """symbol and summary of the returns to the next of every k-th row; rows: symbol, ts, close, signal."""
    return f"""ps AS ({rows}), pn AS (SELECT *, row_number() OVER ({W}) - 1 AS n FROM ps), pk AS (SELECT * FROM pn WHERE n % {every} = 0),
pr AS (SELECT symbol, ts, signal * (lead(close) OVER ({W}) / nullif(close, 0) - 1.0) AS returns FROM pk), pc AS (SELECT * FROM pr WHERE returns IS NOT NULL),
pe AS (SELECT *, product(1.0 + returns) {UPTO} AS eq FROM pc), pm AS (SELECT *, max(eq) {UPTO} AS top_ FROM pe), pd AS (SELECT *, (eq - top_) / top_ AS dd FROM pm), po AS (SELECT symbol, {_SUMS} FROM pd GROUP BY 1)"""


_PLAN_ROWS = "SELECT bars.symbol, bars.ts, close, coalesce(side * 0.01, 0) AS signal FROM bars LEFT JOIN side ON side.symbol = bars.symbol AND side.t0 = bars.ts"
_SUMMARY = _plain("symbol", "n", "total_return", "sharpe", "max_drawdown", "win_rate")
_SUMMARY_DOUBLES = {"total_return", "sharpe", "max_drawdown", "win_rate"}
_register("plan_standard", Q._plan("standard"), f"{BARS}, {Q._SIDE}, {_plan_sql(_PLAN_ROWS, 5)}", _SUMMARY, "po", _SUMMARY_DOUBLES)
_FORWARD = f"SELECT symbol || '/' || part AS symbol, ts, close, signal FROM (SELECT *, ntile(4) OVER ({W}) AS part FROM ({_PLAN_ROWS})) WHERE part > 1"
_register("plan_walk_forward", Q._plan("walk_forward"), f"{BARS}, {Q._SIDE}, {_plan_sql(_FORWARD, 10)}", _SUMMARY, "po", _SUMMARY_DOUBLES)
_CRISES = " UNION ALL ".join(f"SELECT symbol || '/{name}' AS symbol, ts, close, signal FROM ({_PLAN_ROWS}) WHERE ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for name, a, b in (("spring", "1995-03-01", "1995-06-30"), ("autumn", "1996-09-01", "1996-12-31")))
_register("plan_crisis", Q._plan("crisis"), f"{BARS}, {Q._SIDE}, {_plan_sql(_CRISES, 2)}", _SUMMARY, "po", _SUMMARY_DOUBLES)

# Scaling and scores ---------------------------------------------------------------------

_COLUMNS = ("rsi_14", "momentum_20", "atr_14")
_WHOLE = {
    "zscore": "({c} - (SELECT avg({c}) FROM few)) / ((SELECT stddev_samp({c}) FROM few) + 1e-10)",
    "minmax": "({c} - (SELECT min({c}) FROM few)) / ((SELECT max({c}) - min({c}) FROM few) + 1e-10)",
    "robust": "({c} - (SELECT quantile_disc({c}, 0.5) FROM few)) / ((SELECT quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25) FROM few) + 1e-10)",
}
for _method, _expr in _WHOLE.items():
    _register(f"normalise_frame_{_method}", lambda spark, sf, m=_method: features.normalise(Q._few(spark, sf), m, by=None), f"{BARS}, {Q._FEW}", _KEYS | {c: _expr.format(c=c) for c in _COLUMNS}, "few")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return Q._few(spark, sf).join(Q._labelled(spark, sf).withColumnRenamed("t0", "ts"), ["symbol", "ts"])


_MI = f"""{BARS}, {Q._TB}, {Q._FEW}, long AS (SELECT label, feature, x FROM (SELECT label, rsi_14, momentum_20, atr_14 FROM few JOIN tb ON tb.symbol = few.symbol AND tb.t0 = few.ts) UNPIVOT (x FOR feature IN (rsi_14, momentum_20, atr_14)) WHERE x IS NOT NULL),
so AS (SELECT feature, list(x ORDER BY x) AS xs FROM long GROUP BY 1), bo AS (SELECT feature, list_transform(range(1, 10), lambda k: xs[ceil(k * len(xs) / 10.0)::BIGINT]) AS b FROM so),
bi AS (SELECT long.*, len(list_filter(b, lambda q: q < x)) AS bin FROM long JOIN bo USING (feature)),
jo AS (SELECT feature, bin, label, count(*) AS n FROM bi GROUP BY 1, 2, 3),
jt AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, label) AS l, sum(n) OVER (PARTITION BY feature) AS t FROM jo),
mi AS (SELECT feature, sum(n / t * ln(n * t / (b * l))) AS score FROM jt GROUP BY 1)"""
_register("mutual_information", lambda spark, sf: features.feature_scores(_scored(spark, sf), "label", _COLUMNS, "mutual_info"), _MI, _plain("feature", "score"), "mi", {"score"})

_register("selected_features", lambda spark, sf: spark.createDataFrame([(i + 1, c) for i, c in enumerate(features.select_features(_scored(spark, sf), "label", _COLUMNS, 2))], "rank int, feature string"),
          Q.SQL["feature_scores"].split(", result_ AS (")[0].removeprefix("WITH ") + ", fs AS (SELECT feature, (sum(n * (m - am) * (m - am)) / (count(*) - 1)) / (sum(n * v) / (max(an) - count(*))) AS score FROM gr JOIN al USING (feature) GROUP BY 1), fr AS (SELECT feature, (row_number() OVER (ORDER BY score DESC, feature))::INT AS rank FROM fs)",
          _plain("rank", "feature"), "fr WHERE rank <= 2", set())

# What plans are made of -----------------------------------------------------------------

_register("feature_matrix_at_events", lambda spark, sf: features.feature_matrix(Q.bars(spark, sf), seq.cusum_events(Q.bars(spark, sf), 2.0), d=0.9, threshold=1e-4),
          f"{_MATRIX}, {Q.RETURNS}, {Q._cusum_sql('2.0::DOUBLE')}", {"symbol": "fm.symbol", "ts": "fm.ts"} | {c: f"fm.{c}" for c in features.MATRIX}, f"fm JOIN c ON c.symbol = fm.symbol AND c.ts = fm.ts AND c.hit <> 0 WHERE {' OR '.join(f'fm.{c} IS NOT NULL' for c in features.MATRIX)}", set(features.MATRIX), recursive=True)
Q.PLACES["feature_matrix_at_events"] = 4


def _training_samples(spark: SparkSession, sf: str) -> DataFrame:
    from .plans import ensemble

    return ensemble.training_table(Q.bars_all(spark, sf)).select("symbol", "t0", "t1", "ret", "label", "regime", "weight")


_SAMPLES = f"""{BARS_ALL}, {Q.RETURNS},
{_deviation('bd', 'r', 'returns', 100)},
{Q._cusum_sql('(SELECT avg(sd) FROM bd)')},
{Q._REG},
{_EWM_BARRIER[_EWM_BARRIER.index('bn AS ('):]},
bx AS (SELECT bt.symbol, t0, coalesce(ht, lt) AS t1, coalesce(hx, lx) AS ret, (CASE WHEN lower_ THEN -1 WHEN u IS NOT NULL THEN 1 WHEN lx > 0 THEN 1 ELSE -1 END)::INT AS label, {Q._CANON} AS regime FROM bt JOIN reg ON reg.symbol = bt.symbol AND reg.ts = bt.t0)"""
_register("training_samples", _training_samples, _SAMPLES, _plain("symbol", "t0", "t1", "ret", "label", "regime") | {"weight": "abs(ret) / sum(abs(ret)) OVER (PARTITION BY symbol)"}, "bx", {"ret", "weight"}, recursive=True)


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    every = [labels.sample_weights(Q._labelled(spark, sf), Q.bars(spark, sf), m).select("symbol", "t0", F.lit(m).alias("method"), "weight") for m in ("return", "time_decay", "sequential")]
    return every[0].union(every[1]).union(every[2])


_WEIGHTS = f"""{BARS}, {Q._TB}, wd AS (SELECT symbol, t0, exp(-ln(2) / 100 * (count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY t0))) AS w FROM tb),
wc AS (SELECT tb.symbol, t0, count(*) AS w FROM tb JOIN bars ON bars.symbol = tb.symbol AND bars.ts BETWEEN t0 AND t1 GROUP BY 1, 2),
wu AS (SELECT symbol, t0, 'return' AS method, abs(ret) AS w FROM tb UNION ALL SELECT symbol, t0, 'time_decay', w FROM wd UNION ALL SELECT symbol, t0, 'sequential', w FROM wc)"""
_register("sample_weights", _weights, _WEIGHTS, _plain("symbol", "t0", "method") | {"weight": "w / sum(w) OVER (PARTITION BY symbol, method)"}, "wu", {"weight"})
_register("pairs_strength", lambda spark, sf: S.Pairs().strengths(Q.pair(spark, sf)), f"{BARS}, {Q._PAIR}, {Q._Z60}", _KEYS | {"strength": "CASE WHEN z IS NOT NULL THEN least(greatest(abs(z) / 2.0, 0), 1) END"}, "z")
_register("regimes_with_detector", lambda spark, sf: regimes.detect(Q.bars(spark, sf), use=("vol_regime",), detectors={"trend_regime": regimes.trend(14, 40.0)}), f"{BARS}, {Q._REG}, rd AS (SELECT reg.symbol, reg.ts, vol_regime, CASE WHEN a.adx > 40 THEN 'trending' ELSE 'ranging' END AS trend_regime FROM reg JOIN a ON a.symbol = reg.symbol AND a.ts = reg.ts)",
          _KEYS | _plain("vol_regime", "trend_regime"), "rd", set())
_register("bars_as_structs", lambda spark, sf: market.from_bars(market.as_bars(Q.bars(spark, sf))), BARS, _KEYS | _OHLCV, "bars")

# Models: forests are not SQL; the queries run what a user calls ---------------------------


def _samples(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    rows, names = Q._trained(spark, sf)
    regime = regimes.composite(Q._regimes(spark, sf)).select("symbol", F.col("ts").alias("t0"), F.col("canonical_regime").alias("regime"))
    return rows.join(regime, ["symbol", "t0"]), names


def _by_regime(spark: SparkSession, sf: str) -> DataFrame:
    """regime, n_samples and classes of a model for each regime."""
    rows, names = _samples(spark, sf)
    trained = models.train_by(rows.persist(), "regime", names, cv=1, trees=3, depth=3)
    return spark.createDataFrame([(k, m["n_samples"], len(model.classes)) for k, (model, m) in trained.items()], "regime string, n_samples long, classes int")


def _searched(spark: SparkSession, sf: str) -> DataFrame:
    """depth and score of the best of two settings."""
    rows, names = Q._trained(spark, sf)
    _, said = models.search(rows.persist(), names, grid={"trees": (3,), "depth": (2, 4)}, method="grid", cv=2)
    return spark.createDataFrame([(said["params"]["depth"], said["score"])], "depth int, score double")


def _refitted(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a model of the samples up to a date that was fitted again on all of them."""
    rows, names = Q._trained(spark, sf)
    model = models.Classifier(names, trees=3, depth=3).fit(rows.filter("t0 < timestamp_ntz'1996-01-01'"))
    return models.refit(model, rows).predict(rows).select("symbol", "t0", "label", "prediction")


def _meta_frame(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = Q._trained(spark, sf)
    primary = models.Classifier(names, trees=3, depth=3).fit(rows).predict(rows).select("symbol", "t0", "prediction", "probability")
    return labels.meta_features(rows.select("symbol", "t0", *names), primary).drop("primary_proba")


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = Q._trained(spark, sf)
    primary = models.Classifier(names, trees=3, depth=3).fit(rows)
    right = primary.predict(rows).withColumn("good", (F.col("prediction") * F.col("label") > 0).cast("int")).select(*rows.columns, "good")
    return labels.combined_predictions(rows, primary, models.Classifier(names, label="good", trees=3, depth=3).fit(right), names)


def _walked(spark: SparkSession, sf: str) -> DataFrame:
    """Backtest of predictions by models of the rows before each of the windows over the series of all orders."""
    b = Q.bars_all(spark, sf)
    rows = project(b, {"rsi_14": I.rsi(), "momentum_20": pct(I.CLOSE, 20)}, keep=["symbol", "ts"]).na.drop()
    rows = rows.join(labels.triple_barrier(b).select("symbol", F.col("t0").alias("ts"), "label"), ["symbol", "ts"])
    out = evaluation.walk_forward(rows, b, lambda: models.Classifier(["rsi_14", "momentum_20"], trees=2, depth=2), train=500, test=450)
    return out.select("symbol", "num_periods")


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """What an ensemble, trained on the series of all orders, predicts for every bar of it."""
    from .plans import ensemble
    from .sources.settings import Config

    b = Q.bars_all(spark, sf)
    out = ensemble.train(b, "ALL", config=Config({"model": {"cv_folds": 1}}), trees=2)
    return ensemble.sized(ensemble.predictions(b, out["regime_models"])).select("symbol", "ts", "regime", "signal", "confidence", "position_size", "num_strategies", "num_selected")


for _name, _query in {"models_by_regime": _by_regime, "model_search": _searched, "model_refit": _refitted, "meta_feature_frame": _meta_frame, "combined_predictions": _combined, "walk_forward": _walked, "ensemble_predictions": _predicted}.items():
    Q._register(_name, _query)
