"""Numeric expressions: safe division, series windows, ranks, the normal law."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Num = Column | float | int


def col(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(a: Column | str | float, b: Column | str | float) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def positive_div(a: Column | str, b: Column | str) -> Column:
    """a / b where b > 0, else null."""
    return F.when(col(b) > 0, col(a) / col(b))


def log(x: Column | str) -> Column:
    """ln x, null unless x > 0."""
    return F.when(col(x) > 0, F.ln(col(x)))


class Series:
    """Windows of one ordered series per key: all expressions of an operator
    share the partitioning, so they cost one exchange and one sort."""

    def __init__(self, keys: Sequence[str] = ("ticker",), order: Sequence[str] = ("date",)):
        self.keys, self.order = list(keys), list(order)

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def all(self):
        return Window.partitionBy(*self.keys)

    @property
    def so_far(self):
        return self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.w)

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.w)

    def diff(self, x: Column | str, n: int = 1) -> Column:
        return col(x) - self.lag(x, n)

    def change(self, x: Column | str, n: int = 1) -> Column:
        """x / x[-n] - 1."""
        return div(x, self.lag(x, n)) - 1

    def roll(self, agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
        """An aggregate over the last n rows, null unless all n are there and not null."""
        frame = self.w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(col(x)).over(frame) == n, agg(col(x)).over(frame))

    def mean(self, x: Column | str, n: int) -> Column:
        return self.roll(F.avg, x, n)

    def std(self, x: Column | str, n: int) -> Column:
        return self.roll(F.stddev_samp, x, n)

    def fill(self, x: Column | str) -> Column:
        """The last value that is not null."""
        return F.last(col(x), ignorenulls=True).over(self.so_far)

    def total(self, agg: Callable[[Column], Column], x: Column | str) -> Column:
        return agg(col(x)).over(self.so_far)


def percent_rank_avg(x: Column | str, keys: Sequence[str] = ()) -> Column:
    """Rank in percent, ties at their mean; null stays null."""
    x = col(x)
    by = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    same = Window.partitionBy(*keys, x)
    whole = Window.partitionBy(*keys)
    rank = F.rank().over(by) + (F.count(x).over(same) - 1) / 2
    return F.when(x.isNotNull(), div(rank, F.count(x).over(whole)) * 100)


def share_below(x: Column, of: Column) -> Column:
    """Aggregate: percent of values below x."""
    return F.avg((of < x).cast("double")) * 100


# Coefficients of Acklam's rational approximation of the normal
# quantile and of Abramowitz and Stegun 7.1.26 for erf.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _poly(cs: Sequence[float], x):
    out = cs[0]
    for c in cs[1:]:
        out = out * x + c
    return out


def norm_ppf(p: float) -> float:
    """The normal quantile of a fixed level."""
    import math

    if p < 0.02425:
        q = math.sqrt(-2 * math.log(p))
        return _poly(_C, q) / (_poly(_D, q) * q + 1)
    if p > 1 - 0.02425:
        return -norm_ppf(1 - p)
    q = p - 0.5
    r = q * q
    return _poly(_A, r) * q / (_poly(_B, r) * r + 1)


def norm_ppf_col(p: Column) -> Column:
    """The normal quantile as an expression; null outside (0, 1)."""
    low = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.ln(low))
    tail = _poly(_C, q) / (_poly(_D, q) * q + 1)
    c = p - 0.5
    r = c * c
    mid = _poly(_A, r) * c / (_poly(_B, r) * r + 1)
    return F.when((p > 0) & (p < 1), F.when(low < 0.02425, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(mid))


def norm_cdf_col(x: Column) -> Column:
    z = F.abs(x) / (2**0.5)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - _poly(_ERF[::-1], t) * t * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


#: Nudges exact halves, on which engines round differently, off the border.
NUDGE = 1.000000000001


def near(x: Column | str, digits: int) -> Column:
    """Rounded; the same on every engine that multiplies by NUDGE first. Never -0."""
    return F.round(col(x) * NUDGE, digits) + F.lit(0.0)


def rounded(df, digits: int = 6, **special: int):
    """All double columns rounded; ``special`` names other digits."""
    out = {c: near(c, special.get(c, digits)) for c, t in df.dtypes if t == "double"}
    return df.withColumns(out) if out else df
