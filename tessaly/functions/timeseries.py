"""Rolling operators over a dense panel, as native window expressions.

A frame is the last `n` slots of an instrument's dates, shorter at the start.
A value is given where at least max(m, 1) slots of the frame hold one; null and
NaN are missing. Operators on pairs and triples use the slots where all hold
one. Deviations and moments are of the population. Built-in aggregates are used
wherever one has the meaning; what depends on places in the frame folds an
array of the frame's slots, still inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def clean(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def _over_eps(x: Column, value: Column) -> Column:
    return F.when(x > EPS, value)


@dataclass(frozen=True)
class Rolling:
    """Operators over frames of `n` slots that hold at least `m` values."""

    n: int
    m: int
    partition: str = "ts_code"
    order: str = "trade_date"

    def __post_init__(self):
        if self.n < 1:
            raise ValueError("a frame has at least one slot")

    @property
    def ordered(self):
        return Window.partitionBy(self.partition).orderBy(self.order)

    @property
    def frame(self):
        return self.ordered.rowsBetween(1 - self.n, 0)

    def _where(self, x: Column, value: Column) -> Column:
        least = max(self.m, 1)
        if least > self.n:
            return F.lit(None).cast("double")
        return F.when(F.count(x).over(self.frame) >= least, value)

    def _agg(self, x: Column, f) -> Column:
        x = clean(x)
        return self._where(x, f(x).over(self.frame))

    # sums, extremes, moments
    def sum(self, x):
        return self._agg(x, F.sum)

    def mean(self, x):
        return self._agg(x, F.avg)

    def max(self, x):
        return self._agg(x, F.max)

    def min(self, x):
        return self._agg(x, F.min)

    def prod(self, x):
        return self._agg(x, F.product)

    def variance(self, x):
        return self._agg(x, F.var_pop)

    def std_dev(self, x):
        return self._agg(x, F.stddev_pop)

    def quantile(self, x, q: float):
        return self._agg(x, lambda c: F.percentile(c, F.lit(q)))

    def median(self, x):
        return self.quantile(x, 0.5)

    def skew(self, x):
        return _over_eps(self.std_dev(x), self._agg(x, F.skewness))

    def kurt(self, x):
        return _over_eps(self.std_dev(x), self._agg(x, F.kurtosis) + 3)

    def cv(self, x):
        mean = self.mean(x)
        return F.when(F.abs(mean) > EPS, self.std_dev(x) / mean)

    def ir(self, x):
        sigma = self.std_dev(x)
        return _over_eps(sigma, self.mean(x) / sigma)

    def zscore(self, x):
        sigma = self.std_dev(x)
        return _over_eps(sigma, (clean(x) - self.mean(x)) / sigma)

    def diff_avg(self, x):
        return clean(x) - self.mean(x)

    def diff_max(self, x):
        return clean(x) - self.max(x)

    def diff_min(self, x):
        return clean(x) - self.min(x)

    def diff_median(self, x):
        return clean(x) - self.median(x)

    def minmax_diff(self, x):
        return self.max(x) - self.min(x)

    def minmax_scale(self, x):
        return _over_eps(self.minmax_diff(x), (clean(x) - self.min(x)) / self.minmax_diff(x))

    def minmax_cps(self, x):
        return self.minmax_scale(x) * 2 - 1

    # shifts
    def delay(self, x, k: int):
        return F.lag(clean(x), k).over(self.ordered) if k else clean(x)

    def diff(self, x, k: int):
        return clean(x) - self.delay(x, k)

    def pctchg(self, x, k: int):
        before = self.delay(x, k)
        return F.when(F.abs(before) > EPS, clean(x) / before - 1)

    def pctchg_abs(self, x, k: int):
        return F.abs(self.pctchg(x, k))

    # places in the frame
    def slots(self, *columns: Column) -> Column:
        """The frame's slots, oldest first, as structs of v0, v1 ..., missing values as nulls."""
        return F.collect_list(F.struct(*[clean(c).alias(f"v{i}") for i, c in enumerate(columns)])).over(self.frame)

    def _full(self, *columns: Column) -> Column:
        """The slots in which every value is there."""
        kept = self.slots(*columns)
        return F.filter(kept, lambda s: F.lit(True) if not columns else _all(*[s[f"v{i}"].isNotNull() for i in range(len(columns))]))

    def _place(self, x: Column, best) -> Column:
        found = best(clean(x)).over(self.frame)
        return self._where(clean(x), (F.array_position(F.transform(self.slots(x), lambda s: s["v0"]), found) - 1).cast("double"))

    def argmax(self, x):
        return self._place(x, F.max)

    def argmin(self, x):
        return self._place(x, F.min)

    def central_moment(self, x, order: int):
        mean = F.avg(clean(x)).over(self.frame)
        values = F.filter(F.transform(self.slots(x), lambda s: s["v0"]), lambda v: v.isNotNull())
        deviations = F.transform(values, lambda v: F.pow(v - mean, F.lit(float(order))))
        return self._where(clean(x), _sum(deviations) / F.size(values))

    def decay_linear(self, x):
        weighted = F.transform(self.slots(x), lambda s, i: F.when(s["v0"].isNotNull(), F.struct((s["v0"] * (i + 1)).alias("a"), (i + 1.0).alias("b"))))
        held = F.filter(weighted, lambda s: s.isNotNull())
        return self._where(clean(x), _sum(F.transform(held, lambda s: s["a"])) / _sum(F.transform(held, lambda s: s["b"])))

    def entropy(self, x):
        total = F.sum(F.abs(clean(x))).over(self.frame)
        shares = F.transform(F.filter(F.transform(self.slots(x), lambda s: F.abs(s["v0"])), lambda v: v.isNotNull()), lambda v: v / total)
        terms = F.transform(F.filter(shares, lambda p: p > EPS), lambda p: -p * F.log(p))
        return self._where(clean(x), _over_eps(total, _sum(terms)))

    def _last_rank(self, x) -> tuple[Column, Column]:
        values = F.filter(F.transform(self.slots(x), lambda s: s["v0"]), lambda v: v.isNotNull())
        last = F.element_at(values, -1)
        below, equal = F.size(F.filter(values, lambda v: v < last)), F.size(F.filter(values, lambda v: v == last))
        return below + (equal + 1) / 2, F.size(values)

    def rank(self, x):
        """Average rank of the last value that is there."""
        return self._where(clean(x), self._last_rank(x)[0])

    def pctrank(self, x):
        rank, n = self._last_rank(x)
        return self._where(clean(x), F.when(n == 1, F.lit(1.0)).when(n > 1, (rank - 1) / (n - 1)))

    # exponential weights
    def _weighted(self, half_life: float, *columns: Column) -> Column:
        """Structs w, v0, v1 ... of the full slots; the weight halves each `half_life` slots back."""
        kept = self.slots(*columns)
        decay = 0.5 ** (1 / half_life)
        aged = F.transform(kept, lambda s, i: F.struct(F.pow(F.lit(decay), (F.size(kept) - 1 - i).cast("double")).alias("w"), *[s[f"v{k}"].alias(f"v{k}") for k in range(len(columns))]))
        return F.filter(aged, lambda s: _all(*[s[f"v{k}"].isNotNull() for k in range(len(columns))]))

    def ew_sum(self, x, half_life: float):
        return self._where(clean(x), _sum(F.transform(self._weighted(half_life, x), lambda s: s["w"] * s["v0"])))

    def ew_std_dev(self, x, half_life: float):
        held = self._weighted(half_life, x)
        w, sx, sxx = (_sum(F.transform(held, f)) for f in (lambda s: s["w"], lambda s: s["w"] * s["v0"], lambda s: s["w"] * s["v0"] * s["v0"]))
        return self._where(clean(x), F.sqrt(F.greatest((sxx - sx * sx / w) / w, F.lit(0.0))))

    def ew_regression(self, y, x, half_life: float) -> Column:
        """Struct of alpha, beta and residual_sigma of y on x."""
        held = self._weighted(half_life, y, x)
        part = lambda f: _sum(F.transform(held, f))
        w, sy, sx = part(lambda s: s["w"]), part(lambda s: s["w"] * s["v0"]), part(lambda s: s["w"] * s["v1"])
        sxx, sxy, syy = part(lambda s: s["w"] * s["v1"] * s["v1"]) - sx * sx / w, part(lambda s: s["w"] * s["v0"] * s["v1"]) - sx * sy / w, part(lambda s: s["w"] * s["v0"] * s["v0"]) - sy * sy / w
        beta = sxy / sxx
        out = F.struct((sy / w - beta * sx / w).alias("alpha"), beta.alias("beta"), F.sqrt(F.greatest((syy - beta * sxy) / w, F.lit(0.0))).alias("residual_sigma"))
        return F.when((F.size(held) >= max(self.m, 1)) & (w > EPS), F.when(sxx > EPS, out))

    # pairs and triples
    def _pair(self, *columns: Column) -> list[Column]:
        held = [clean(c) for c in columns]
        there = _all(*[c.isNotNull() for c in held])
        return [F.when(there, c) for c in held]

    def covariance(self, x, y):
        x, y = self._pair(x, y)
        return self._where(x, F.covar_pop(x, y).over(self.frame))

    def _corr(self, x, y):
        both = F.stddev_pop(x).over(self.frame) * F.stddev_pop(y).over(self.frame)
        return self._where(x, _over_eps(both, F.covar_pop(x, y).over(self.frame) / both))

    def corr(self, x, y):
        return self._corr(*self._pair(x, y))

    def regression(self, y, x):
        y, x = self._pair(y, x)
        var = F.var_pop(x).over(self.frame)
        return self._where(x, _over_eps(var, F.covar_pop(y, x).over(self.frame) / var))

    def partial_corr_xy_z(self, x, y, z):
        x, y, z = self._pair(x, y, z)
        xy, xz, yz = self._corr(x, y), self._corr(x, z), self._corr(y, z)
        rest = F.sqrt((1 - xz * xz) * (1 - yz * yz))
        return _over_eps(rest, (xy - xz * yz) / rest)

    def _co_moment(self, y, x, of_y: int, of_x: int):
        y, x = self._pair(y, x)
        my, mx = F.avg(y).over(self.frame), F.avg(x).over(self.frame)
        sy, sx = F.stddev_pop(y).over(self.frame), F.stddev_pop(x).over(self.frame)
        held = F.filter(self.slots(y, x), lambda s: s["v0"].isNotNull() & s["v1"].isNotNull())
        product = F.transform(held, lambda s: F.pow(s["v0"] - my, F.lit(float(of_y))) * F.pow(s["v1"] - mx, F.lit(float(of_x))))
        scale = F.pow(sy, F.lit(float(of_y))) * F.pow(sx, F.lit(float(of_x)))
        return self._where(x, F.when((sy > EPS) & (sx > EPS), _over_eps(scale, _sum(product) / F.size(held) / scale)))

    def coskew_yxx(self, y, x):
        return self._co_moment(y, x, 1, 2)

    def co_kurt_yxxx(self, y, x):
        return self._co_moment(y, x, 1, 3)

    def co_kurt_yyxx(self, y, x):
        return self._co_moment(y, x, 2, 2)

    def rankcorr(self, x, y):
        """Pearson correlation of average ranks within the frame."""
        held = F.filter(self.slots(x, y), lambda s: s["v0"].isNotNull() & s["v1"].isNotNull())
        rank = lambda f, s: F.size(F.filter(held, lambda t: t[f] < s[f])) + (F.size(F.filter(held, lambda t: t[f] == s[f])) + 1) / 2
        n = F.size(held)
        centred = F.transform(held, lambda s: F.struct((rank("v0", s) - (n + 1) / 2).alias("a"), (rank("v1", s) - (n + 1) / 2).alias("b")))
        aa, bb, ab = (_sum(F.transform(centred, f)) for f in (lambda s: s["a"] * s["a"], lambda s: s["b"] * s["b"], lambda s: s["a"] * s["b"]))
        return F.when(n >= max(self.m, 1), _over_eps(F.sqrt(aa * bb), ab / F.sqrt(aa * bb)))

    def theilsen(self, y, x):
        """Median slope of all pairs in the frame whose x differ."""
        held = F.filter(self.slots(y, x), lambda s: s["v0"].isNotNull() & s["v1"].isNotNull())
        slopes = F.flatten(
            F.transform(held, lambda a, i: F.transform(F.slice(held, i + 2, F.size(held)), lambda b: F.when(F.abs(b["v1"] - a["v1"]) > EPS, (b["v0"] - a["v0"]) / (b["v1"] - a["v1"]))))
        )
        ordered = F.sort_array(F.filter(slopes, lambda v: v.isNotNull()))
        n = F.size(ordered)
        middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
        return F.when((F.size(held) >= max(self.m, 1)) & (n > 0), middle)


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ewm(panel: DataFrame, value: str, span: int, m: int, out: str = "ewm", partition: str = "ts_code", order: str = "trade_date") -> DataFrame:
    """The infinite exponential mean with weight 2 / (span + 1): missing slots neither move it nor show it.

    Its state reaches back to an instrument's first value, which no bounded
    frame holds, so each instrument is one Arrow batch in a pandas function.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields] + [f"`{out}` double"]

    def run(pdf):
        pdf = pdf.sort_values(order)
        x = pdf[value].astype("float64")
        state = x.ewm(alpha=2 / (span + 1), adjust=False, ignore_na=True).mean()
        shown = x.notna() & (x.notna().cumsum() >= max(m, 1)) & (max(m, 1) <= span)
        return pdf.assign(**{out: state.where(shown)})

    return panel.groupBy(partition).applyInPandas(run, ", ".join(fields))
