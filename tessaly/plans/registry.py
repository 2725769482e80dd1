"""Factors and labels as registered expressions over one panel: one scan, one shuffle by instrument, one by date.

A factor is a rolling column and, after it, steps by date: clipping to
quantiles, z-scores, Gaussian ranks, the residual on size within sectors. All
factors of a run take each step together, so a step costs one window over the
date however many factors there are. Labels look forward over the dense axis: a
signal of a date trades on the next, and a label of k settles k dates after.

The factors here are general families by length; ``labels`` and the risk
exposures (``operators.exposures``) follow their conventional definitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.crosssection import Cross
from tessaly.functions.elementwise import safe_div
from tessaly.functions.timeseries import EPS, Rolling, clean

DATE, CODE = "trade_date", "ts_code"


@dataclass(frozen=True)
class Spec:
    """A named column of the panel: what it needs, how far back (or, a label, forward) it looks, how it is made, and its steps by date."""

    id: str
    inputs: tuple[str, ...]
    lookback: int
    make: Callable[[], Column]
    tags: tuple[str, ...] = field(default=())
    deprecated: bool = False
    steps: tuple[str, ...] = field(default=())
    aliases: tuple[str, ...] = field(default=())
    generated: bool = False


FACTORS: dict[str, Spec] = {}
LABELS: dict[str, Spec] = {}


def _register(into: dict[str, Spec], spec: Spec) -> Spec:
    if taken := {spec.id, *spec.aliases} & {n for s in into.values() for n in (s.id, *s.aliases)}:
        raise ValueError(f"registered already: {sorted(taken)}")
    into[spec.id] = spec
    return spec


def factor(id: str, inputs: Sequence[str], lookback: int = 0, tags: Sequence[str] = (), deprecated: bool = False, steps: Sequence[str] = (), aliases: Sequence[str] = (), generated: bool = False):
    """Registers a function that makes a factor's column; ids and aliases are unique."""

    def add(make: Callable[[], Column]):
        _register(FACTORS, Spec(id, tuple(inputs), lookback, make, tuple(tags), deprecated, tuple(steps), tuple(aliases), generated))
        return make

    return add


def select(ids: Sequence[str] = (), tags: Sequence[str] = (), with_deprecated: bool = False, with_generated: bool = False, among: dict[str, Spec] | None = None) -> list[Spec]:
    """Specs that have all `tags`, and of `ids` (or aliases) if there are any; deprecated and model-made ones only by id or if asked for."""
    among = FACTORS if among is None else among
    named = {n: s.id for s in among.values() for n in (s.id, *s.aliases)}
    if unknown := [i for i in ids if i not in named]:
        raise KeyError(f"unknown: {unknown}")
    wanted = {named[i] for i in ids}
    chosen = [s for s in among.values() if (not ids or s.id in wanted) and set(tags) <= set(s.tags)]
    return [s for s in chosen if s.id in wanted or ((with_deprecated or not s.deprecated) and (with_generated or not s.generated))]


def _winsorized(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: Cross().winsorize_quantile(F.col(c), 0.01, 0.99) for c in columns})


def _zscored(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: Cross().zscore(F.col(c)) for c in columns})


def _gaussian(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: Cross().gaussian_rank(F.col(c)) for c in columns})


def size_sector_residuals(rows: DataFrame, columns: Sequence[str], size: str = "size", sector: str = "sector", fill: bool = False) -> DataFrame:
    """Each column's residual on size within sectors, by date: both less their sector's mean, one slope a date.

    All columns share two windows. With `fill`, a missing value gets 0 where
    its size is there and its sector has a residual.
    """
    inside = F.col(sector).isNotNull() & (F.col(sector) != "")
    usable = lambda c: clean(F.col(c)).isNotNull() & clean(F.col(size)).isNotNull() & inside
    d, g = Window.partitionBy(DATE), Window.partitionBy(DATE, sector)
    out = rows.select("*", *[x.alias(n) for c in columns for n, x in ((f"_y_{c}", F.when(usable(c), F.col(c))), (f"_x_{c}", F.when(usable(c), F.col(size))))])
    out = out.withColumns({f"_{k}_{c}": F.col(f"_{k}_{c}") - F.avg(f"_{k}_{c}").over(g) for c in columns for k in "yx"})
    slope = lambda c: F.sum(F.col(f"_y_{c}") * F.col(f"_x_{c}")).over(d) / F.sum(F.col(f"_x_{c}") * F.col(f"_x_{c}")).over(d)
    ok = lambda c: (F.count(f"_y_{c}").over(d) >= 2) & (F.sum(F.col(f"_x_{c}") * F.col(f"_x_{c}")).over(d) > 1e-12)
    out = out.withColumns({c: F.when(ok(c), F.col(f"_y_{c}") - slope(c) * F.col(f"_x_{c}")) for c in columns})
    out = out.drop(*[f"_{k}_{c}" for c in columns for k in "yx"])
    if fill:
        out = out.withColumns({c: F.coalesce(F.col(c), F.when(inside & clean(F.col(size)).isNotNull() & (F.count(c).over(g) > 0), F.lit(0.0))) for c in columns})
    return out


STEPS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "winsorize": _winsorized, "zscore": _zscored, "gaussian": _gaussian, "neutral": size_sector_residuals, "neutral_filled": lambda rows, columns: size_sector_residuals(rows, columns, fill=True),
}


def compute(panel: DataFrame, specs: Sequence[Spec], start: int | None = None, end: int | None = None) -> DataFrame:
    """The specs' columns for present rows from `start` to `end`; the panel must reach back (and forward) by their lookback."""
    need = {c for s in specs for c in s.inputs} | ({"size", "sector"} if any(step.startswith("neutral") for s in specs for step in s.steps) else set())
    if lost := need - set(panel.columns):
        raise ValueError(f"the panel lacks {sorted(lost)}")
    context = [c for c in ("size", "sector") if c in panel.columns]
    out = panel.select(DATE, CODE, "present", *context, *[s.make().alias(s.id) for s in specs]).filter("present")
    if start is not None:
        out = out.filter(F.col(DATE) >= start)
    if end is not None:
        out = out.filter(F.col(DATE) <= end)
    for turn in range(max((len(s.steps) for s in specs), default=0)):
        for name, step in STEPS.items():
            if columns := [s.id for s in specs if turn < len(s.steps) and s.steps[turn] == name]:
                out = step(out, columns)
    return out.select(DATE, CODE, *[s.id for s in specs])


def _price(c: str = "close") -> Column:
    return F.col(c)


def _families() -> None:
    """The registered factors; lengths are sessions."""
    ret = lambda: F.col("ret")
    for n in (3, 6, 12):
        least = n // 2 + 1
        r = Rolling(n, least)
        for name, inputs, make, tags in (
            ("momentum", ["close"], lambda n=n: Rolling(n + 1, 1).pctchg(_price(), n), ["price"]),
            ("volatility", ["ret"], lambda r=r: r.std_dev(ret()), ["price", "risk"]),
            ("skewness", ["ret"], lambda r=r: r.skew(ret()), ["price", "risk"]),
            ("kurtosis", ["ret"], lambda r=r: r.kurt(ret()), ["price", "risk"]),
            ("best_return", ["ret"], lambda r=r: r.max(ret()), ["price"]),
            ("worst_return", ["ret"], lambda r=r: r.min(ret()), ["price"]),
            ("sharpe", ["ret"], lambda r=r: r.ir(ret()), ["price", "risk"]),
            ("downside", ["ret"], lambda r=r: F.sqrt(r.mean(F.when(ret().isNotNull(), F.least(ret(), F.lit(0.0)) ** 2))), ["price", "risk"]),
            ("turnover", ["turnover"], lambda r=r: r.mean(F.col("turnover")), ["volume"]),
            ("turnover_deviation", ["turnover"], lambda r=r: r.std_dev(F.col("turnover")), ["volume", "risk"]),
            ("volume_surprise", ["vol"], lambda r=r: safe_div(F.col("vol"), r.mean(F.col("vol"))) - 1, ["volume"]),
            ("illiquidity", ["ret", "amount"], lambda r=r: r.mean(safe_div(F.abs(ret()), F.col("amount"))), ["volume"]),
            ("price_volume", ["close", "vol"], lambda r=r: r.corr(_price(), F.col("vol")), ["price", "volume"]),
            ("return_turnover", ["ret", "turnover"], lambda r=r: r.corr(ret(), F.col("turnover")), ["price", "volume"]),
            ("market_beta", ["ret", "market"], lambda r=r: r.regression(ret(), F.col("market")), ["risk"]),
            ("price_place", ["close"], lambda r=r: r.minmax_scale(_price()), ["price"]),
            ("vwap_gap", ["close", "vwap"], lambda r=r: r.mean(safe_div(_price(), F.col("vwap")) - 1), ["price"]),
        ):
            factor(f"{name}_{n}", inputs, n, tags)(make)
    for base, steps in (("momentum_6", ("winsorize", "zscore", "neutral")), ("volatility_6", ("zscore", "neutral")), ("turnover_12", ("neutral_filled",)), ("illiquidity_12", ("gaussian", "neutral")), ("market_beta_12", ("winsorize", "neutral", "zscore"))):
        spec = FACTORS[base]
        _register(FACTORS, Spec(f"{base}_neutral", spec.inputs, spec.lookback, spec.make, (*spec.tags, "neutral"), steps=steps, aliases=(f"pure_{base}",)))


def forward(price: str, k: int) -> Column:
    """price[t + k + 1] / price[t + 1] - 1 of the adjusted price over the dense axis; null where the first is about zero."""
    order = Window.partitionBy(CODE).orderBy(DATE)
    value = F.col(price) * F.col("adj")
    entry = F.lead(value, 1).over(order)
    return F.when(F.abs(entry) > EPS, F.lead(value, k + 1).over(order) / entry - 1)


def _labels() -> None:
    for kind, horizons in (("close", (1, 5, 10, 20)), ("open", (1, 5, 10, 20)), ("vwap", (1, 5, 10, 20)), ("open_5m_vwap", (1, 5, 20)), ("open_10m_vwap", (1, 5, 20))):
        for k in horizons:
            _register(LABELS, Spec(f"future_{kind}_return_{k}d", (kind, "adj"), k + 1, lambda kind=kind, k=k: forward(kind, k), ("label", kind)))


_families()
_labels()
