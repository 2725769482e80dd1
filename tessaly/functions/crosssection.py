"""Cross-sectional operators: one date's instruments, or a group of them, as native window expressions.

Null and NaN are missing. Deviations are of the population, quantiles
interpolate linearly, and ranks are ordinal: equal values follow `ts_code` in
either direction. Rows of a null or empty group have no value; filling leaves
them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .timeseries import EPS, clean


@dataclass(frozen=True)
class Cross:
    """Operators over the rows of a date; with `group`, over those of a date and group."""

    date: str = "trade_date"
    code: str = "ts_code"
    group: str | None = None

    def by(self, group: str) -> Cross:
        return Cross(self.date, self.code, group)

    @property
    def keys(self) -> list:
        return [self.date] if self.group is None else [self.date, self.group]

    @property
    def rows(self):
        return Window.partitionBy(*self.keys)

    def _in_group(self, value: Column) -> Column:
        if self.group is None:
            return value
        return F.when(F.col(self.group).isNotNull() & (F.col(self.group).cast("string") != ""), value)

    def _agg(self, x: Column, f) -> Column:
        return self._in_group(f(clean(x)).over(self.rows))

    def sum(self, x):
        return self._agg(x, F.sum)

    def mean(self, x):
        return self._agg(x, F.avg)

    def max(self, x):
        return self._agg(x, F.max)

    def min(self, x):
        return self._agg(x, F.min)

    def std_dev(self, x):
        return self._agg(x, F.stddev_pop)

    def quantile(self, x, q: float):
        return self._agg(x, lambda c: F.percentile(c, F.lit(q)))

    def median(self, x):
        return self.quantile(x, 0.5)

    def demean(self, x):
        return clean(x) - self.mean(x)

    neutralize = demean

    def demean_abs(self, x):
        return F.abs(self.demean(x))

    def demedian(self, x):
        return clean(x) - self.median(x)

    def dequantile(self, x, q: float):
        return clean(x) - self.quantile(x, q)

    def fill_mean(self, x):
        return F.coalesce(clean(x), self.mean(x))

    def fill_max(self, x):
        return F.coalesce(clean(x), self.max(x))

    def fill_min(self, x):
        return F.coalesce(clean(x), self.min(x))

    def fill_median(self, x):
        return F.coalesce(clean(x), self.median(x))

    def fill_quantile(self, x, q: float):
        return F.coalesce(clean(x), self.quantile(x, q))

    def minmax_scale(self, x):
        width = self.max(x) - self.min(x)
        return F.when(width > EPS, (clean(x) - self.min(x)) / width)

    def scale(self, x):
        total = self._agg(F.abs(x), F.sum)
        return F.when(total > EPS, clean(x) / total)

    def zscore(self, x):
        sigma = self.std_dev(x)
        return F.when(sigma > EPS, (clean(x) - self.mean(x)) / sigma)

    def zscore_abs(self, x):
        return F.abs(self.zscore(x))

    # the least and the greatest z-score are those of the least and the greatest value
    def nonnegative(self, x):
        sigma = self.std_dev(x)
        return F.when(sigma > EPS, (clean(x) - self.min(x)) / sigma)

    def nonpositive(self, x):
        sigma = self.std_dev(x)
        return F.when(sigma > EPS, (clean(x) - self.max(x)) / sigma)

    def winsorize_quantile(self, x, low: float, high: float):
        return F.when(clean(x).isNotNull(), F.least(F.greatest(clean(x), self.quantile(x, low)), self.quantile(x, high)))

    def winsorize(self, x, high: float):
        return F.when(clean(x).isNotNull(), F.least(clean(x), self.quantile(x, high)))

    def winsorize95(self, x):
        return self.winsorize(x, 0.95)

    # ranks
    def _ranked(self, x: Column, ascending: bool, *more: Column) -> tuple[Column, Column]:
        """Ordinal rank and count among the rows that hold a value (and agree on `more`)."""
        x = clean(x)
        alike = Window.partitionBy(*self.keys, x.isNull(), *more)
        order = x.asc() if ascending else x.desc()
        return F.row_number().over(alike.orderBy(order, F.col(self.code))), F.count(x).over(alike)

    def rank(self, x, ascending: bool = True):
        rank, _ = self._ranked(x, ascending)
        return self._in_group(F.when(clean(x).isNotNull(), rank.cast("double")))

    def pctrank(self, x, ascending: bool = True):
        rank, n = self._ranked(x, ascending)
        return self._in_group(F.when(clean(x).isNotNull() & (n > 1), (rank - 1) / (n - 1)))

    def _rank_by_side(self, x: Column, side: Column) -> Column:
        """Percent ranks apart below and above, where `side` is -1 or 1; at 0 none."""
        rank, n = self._ranked(x, True, side)
        return F.when(clean(x).isNotNull() & (side != 0) & (n > 1), (rank - 1) / (n - 1))

    def rank_by_sign(self, x):
        return self._rank_by_side(x, F.signum(clean(x)))

    def rank_by_side(self, x: Column, middle: Column) -> Column:
        """Apart below and above `middle`, a column that is computed already (windows don't nest)."""
        return self._rank_by_side(x, F.signum(clean(x) - middle))

    def rank_y_add_x(self, y, x):
        return self.pctrank(y) + self.pctrank(x)

    def rank_y_sub_x(self, y, x):
        return self.pctrank(y) - self.pctrank(x)

    def rank_y_mul_x(self, y, x):
        return self.pctrank(y) * self.pctrank(x)

    def rank_y_div_x(self, y, x):
        below = self.pctrank(x)
        return F.when(F.abs(below) > EPS, self.pctrank(y) / below)

    def groups(self, x, n: int):
        """Groups 0 to n - 1 by value: floor((rank - 1) * n / count)."""
        rank, count = self._ranked(x, True)
        return F.when(clean(x).isNotNull(), F.least(F.floor((rank - 1) * n / count), F.lit(n - 1)).cast("int"))

    # regressions
    def regression_residual(self, y, x):
        """y less its least-squares line on x, where both are there; a constant x gives the deviation from the mean."""
        both = clean(y).isNotNull() & clean(x).isNotNull()
        y, x = F.when(both, y), F.when(both, x)
        var, my, mx = F.var_pop(x).over(self.rows), F.avg(y).over(self.rows), F.avg(x).over(self.rows)
        slope = F.when(var > EPS, F.covar_pop(y, x).over(self.rows) / var).otherwise(F.lit(0.0))
        return self._in_group(F.when(both & (F.count(x).over(self.rows) >= 2), y - my - slope * (x - mx)))

    def gaussian_rank(self, x):
        """The normal quantile of (rank - 0.5) / count, kept within [1e-6, 1 - 1e-6]."""
        rank, n = self._ranked(x, True)
        p = F.least(F.greatest((rank - 0.5) / n, F.lit(1e-6)), F.lit(1 - 1e-6))
        return self._in_group(F.when(clean(x).isNotNull(), normal_quantile(p)))


# Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients: tuple, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function, to about 1e-9."""
    q = p - 0.5
    r = q * q
    middle = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    tail = lambda t: _poly(_C, t) / (_poly(_D, t) * t + 1)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(middle)
