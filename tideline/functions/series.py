"""Series algebra over keyed bars.

A :class:`Series` is an expression over the columns of a (symbol, ts, ...) frame.
Spark has no window function of a window function, so a Series knows how many
window levels it has; what is inside another window becomes a column of an
earlier projection.  :func:`project` lays out these projections.  All windows are
PARTITION BY symbol ORDER BY ts, so that however many series are asked for, there is one
exchange and one sort.

Missing is NULL, never NaN; division by zero gives NULL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10
BY = ["symbol", "ts"]


def frame(start: int | None = None, end: int | None = 0):
    """Rows from start to end around the current one; None is unbounded."""
    low = Window.unboundedPreceding if start is None else start
    high = Window.unboundedFollowing if end is None else end
    return Window.partitionBy("symbol").orderBy("ts").rowsBetween(low, high)


def ordered():
    return Window.partitionBy("symbol").orderBy("ts")


class Series:
    """make: builds the expression at its level; key: its text, equal for equal expressions; parts: what must be projected before."""

    def __init__(self, make: Callable[[], Column], key: str, level: int = 0, parts: Mapping[str, tuple[int, Callable[[], Column]]] | None = None) -> None:
        self.make, self.key, self.level, self.parts = make, key, level, dict(parts or {})

    def settled(self) -> Series:
        """The same, as a column that an earlier projection makes if it holds a window."""
        if not self.level:
            return self
        name = "_" + hashlib.md5(self.key.encode()).hexdigest()[:12]
        return Series(lambda: F.col(name), self.key, self.level, {**self.parts, name: (self.level, self.make)})

    def __add__(self, o): return _merge("+", lambda a, b: a + b, self, o)
    def __radd__(self, o): return _merge("+", lambda a, b: a + b, o, self)
    def __sub__(self, o): return _merge("-", lambda a, b: a - b, self, o)
    def __rsub__(self, o): return _merge("-", lambda a, b: a - b, o, self)
    def __mul__(self, o): return _merge("*", lambda a, b: a * b, self, o)
    def __rmul__(self, o): return _merge("*", lambda a, b: a * b, o, self)
    def __truediv__(self, o): return _merge("/", _divide, self, o)
    def __rtruediv__(self, o): return _merge("/", _divide, o, self)
    def __pow__(self, o): return _merge("^", F.pow, self, o)
    def __neg__(self): return _merge("neg", lambda a: -a, self)
    def __gt__(self, o): return _merge(">", lambda a, b: a > b, self, o)
    def __lt__(self, o): return _merge("<", lambda a, b: a < b, self, o)
    def __ge__(self, o): return _merge(">=", lambda a, b: a >= b, self, o)
    def __le__(self, o): return _merge("<=", lambda a, b: a <= b, self, o)
    def same(self, o): return _merge("=", lambda a, b: a == b, self, o)
    def __and__(self, o): return _merge("&", lambda a, b: a & b, self, o)
    def __or__(self, o): return _merge("|", lambda a, b: a | b, self, o)
    def __invert__(self): return _merge("!", lambda a: ~a, self)


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _lift(x) -> Series:
    return x if isinstance(x, Series) else Series(lambda: F.lit(x), repr(x))


def _merge(name: str, f: Callable[..., Column], *args) -> Series:
    given = [_lift(a) for a in args]
    parts: dict = {}
    for s in given:
        parts.update(s.parts)
    return Series(lambda: f(*(s.make() for s in given)), f"{name}({','.join(s.key for s in given)})", max(s.level for s in given), parts)


def _window(name: str, f: Callable[..., Column], *args: Series) -> Series:
    merged = _merge(name, f, *(s.settled() for s in args))
    return Series(merged.make, merged.key, merged.level + 1, merged.parts)


def col(name: str) -> Series:
    return Series(lambda: F.col(name), name)


def project(df: DataFrame, outputs: Mapping[str, Series], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those to keep) and the outputs, in order."""
    kept = df.columns if keep is None else keep
    kept = [c for c in kept if c not in outputs]
    parts: dict[str, tuple[int, Callable[[], Column]]] = {}
    for s in outputs.values():
        parts.update(s.parts)
    for level in sorted({v[0] for v in parts.values()}):
        df = df.withColumns({name: make() for name, (at, make) in parts.items() if at == level})
    return df.select(*(f"`{c}`" for c in kept), *(s.make().alias(name) for name, s in outputs.items()))


# Rolling, expanding and shifted -------------------------------------------------------


def roll(agg: Callable[..., Column], x: Series, n: int, *more: Series, name: str | None = None) -> Series:
    """agg over the last n rows, where all of them have a value (of all arguments)."""
    def over(*columns: Column) -> Column:
        whole = columns[0]
        for c in columns[1:]:
            whole = F.when(c.isNotNull(), whole)
        return F.when(F.count(whole).over(frame(1 - n)) == n, agg(*columns).over(frame(1 - n)))
    return _window(f"roll:{name or agg.__name__}:{n}", over, _lift(x), *more)


def mean(x: Series, n: int) -> Series: return roll(F.avg, x, n)
def std(x: Series, n: int) -> Series: return roll(F.stddev_samp, x, n)
def var(x: Series, n: int) -> Series: return roll(F.var_samp, x, n)
def total(x: Series, n: int) -> Series: return roll(F.sum, x, n)
def lowest(x: Series, n: int) -> Series: return roll(F.min, x, n)
def highest(x: Series, n: int) -> Series: return roll(F.max, x, n)


def corr(x: Series, y: Series, n: int) -> Series:
    """Rolling correlation of n complete pairs; NULL where either is constant."""
    return _window(f"corr:{n}", lambda a, b: F.when((F.count(F.when(b.isNotNull(), a)).over(frame(1 - n)) == n) & (F.stddev_pop(a).over(frame(1 - n)) > 0) & (F.stddev_pop(b).over(frame(1 - n)) > 0), F.corr(a, b).over(frame(1 - n))), x, y)


def cumulative(agg: Callable[..., Column], x: Series) -> Series:
    return _window(f"cum:{agg.__name__}", lambda a: agg(a).over(frame(None)), _lift(x))


def whole(agg: Callable[..., Column], x: Series) -> Series:
    """agg over all rows of the symbol."""
    return _window(f"all:{agg.__name__}", lambda a: agg(a).over(Window.partitionBy("symbol")), _lift(x))


def before(agg: Callable[..., Column], n: int, *xs: Series, least: int = 0, name: str | None = None) -> Series:
    """agg over the n rows before the current one, from the row that has so many (or ``least``) before it."""
    return _window(f"before:{name or agg.__name__}:{n}:{least}", lambda *c: F.when(F.row_number().over(ordered()) > max(n, least), agg(*c).over(frame(-n, -1))), *xs)


def lag(x: Series, k: int = 1) -> Series:
    f = (lambda a: F.lag(a, k).over(ordered())) if k >= 0 else (lambda a: F.lead(a, -k).over(ordered()))
    return _window(f"lag:{k}", f, _lift(x))


def lead(x: Series, k: int = 1) -> Series: return lag(x, -k)
def diff(x: Series, k: int = 1) -> Series: return x - lag(x, k)
def pct(x: Series, k: int = 1) -> Series: return x / lag(x, k) - 1.0


def ffill(x: Series) -> Series:
    return _window("ffill", lambda a: F.last(a, True).over(frame(None)), x)


def bfill(x: Series) -> Series:
    """Along the reversed order, which needs a sort but no look at every row after."""
    back = lambda: Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    return _window("bfill", lambda a: F.last(a, True).over(back()), x)


def head(x: Series) -> Series:
    """The symbol's first value."""
    return _window("head", lambda a: F.first(a, True).over(frame(None, None)), x)


def position() -> Series:
    """Row number within the symbol, from 1."""
    return Series(lambda: F.row_number().over(ordered()), "position", 1)


def zscore(x: Series, n: int) -> Series:
    return (x - mean(x, n)) / (std(x, n) + EPS)


def rank_pct(x: Series, n: int) -> Series:
    """Average rank of the current value among the last n, as a share of n."""
    held = _window(f"held:{n}", lambda a: F.when(F.count(a).over(frame(1 - n)) == n, F.collect_list(a).over(frame(1 - n))), x).settled()
    return _merge(f"rank:{n}", lambda a, v: (F.size(F.filter(a, lambda y: y < v)) + (F.size(F.filter(a, lambda y: y == v)) + 1) / 2.0) / float(n), held, x.settled())


# Scalars ------------------------------------------------------------------------------


def log(x: Series) -> Series: return _merge("log", lambda a: F.when(a > 0, F.log(a)), _lift(x))
def sqrt(x: Series) -> Series: return _merge("sqrt", lambda a: F.when(a >= 0, F.sqrt(a)), _lift(x))
def absolute(x: Series) -> Series: return _merge("abs", F.abs, _lift(x))
def sign(x: Series) -> Series: return _merge("sign", F.signum, _lift(x))
def as_double(x: Series) -> Series: return _merge("double", lambda a: a.cast("double"), _lift(x))
def as_int(x: Series) -> Series: return _merge("int", lambda a: a.cast("int"), _lift(x))
def fill(x: Series, value) -> Series: return _merge("fill", F.coalesce, x, value)
def greatest(*xs: Series) -> Series: return _merge("greatest", F.greatest, *xs)
def least(*xs: Series) -> Series: return _merge("least", F.least, *xs)


def clip(x: Series, low: float, high: float) -> Series:
    """NULL stays NULL."""
    return _merge("clip", lambda a, b, c: F.when(a.isNotNull(), F.least(F.greatest(a, b), c)), x, low, high)


def choose(*cases: tuple[Series, object], default: object = None) -> Series:
    """The value of the first condition that holds; a NULL condition doesn't."""
    flat = [_lift(v) for case in cases for v in case]
    def build(*c: Column) -> Column:
        out = F.when(c[0], c[1])
        for i in range(2, 2 * len(cases), 2):
            out = out.when(c[i], c[i + 1])
        return out.otherwise(c[-1])
    return _merge("choose", build, *flat, _lift(default))


def text(name: str, f: Callable[..., Column], *xs: Series) -> Series:
    """Any other scalar function of series."""
    return _merge(name, f, *xs)
