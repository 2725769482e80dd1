"""Named per-date transforms of a training table's features and labels.

Infinite values and NaN are missing, ranks are average ranks, and a date without
spread gives 0, not null. Features that are still missing take a fill value;
labels stay missing. Each name says what it does to both kinds of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import normal_quantile
from .elementwise import finite
from .timeseries import EPS

DATE = "trade_date"
_NAMES: dict[str, tuple[str, str]] = {}


def register(*names: str, features: str, labels: str) -> None:
    """Makes a transform known by its names: the kind of step for features, and for labels."""
    for name in names:
        if name in _NAMES:
            raise ValueError(f"there is a transform {name} already")
        _NAMES[name] = (features, labels)


def names() -> list[str]:
    return [*_NAMES]


def _d():
    return Window.partitionBy(DATE)


def average_rank(x: Column) -> tuple[Column, Column]:
    """(average rank from 1, number of values) among the date's values."""
    held = Window.partitionBy(DATE, x.isNull())
    alike = F.count(F.lit(1)).over(Window.partitionBy(DATE, x))
    rank = F.rank().over(held.orderBy(x)) + (alike - 1) / 2
    return F.when(x.isNotNull(), rank), F.count(x).over(_d())


def _standard(c: str) -> Column:
    x, mean, spread = F.col(c), F.avg(c).over(_d()), F.stddev_pop(c).over(_d())
    return F.when(x.isNotNull(), F.when(spread > EPS, (x - mean) / spread).otherwise(F.lit(0.0)))


def _clipped(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(-3.0)), F.lit(3.0)))


def _ranked(c: str, f: Callable[[Column, Column], Column]) -> Column:
    rank, n = average_rank(F.col(c))
    return F.when(rank.isNotNull(), f(rank, n))


#: By kind, what is done in turn; each step is a column of its own, as windows don't nest.
_STEPS: dict[str, tuple[Callable[[str], Column], ...]] = {
    "none": (), "zscore": (_standard,), "zscore_clip3": (_standard, _clipped),
    "log_rank": (lambda c: _ranked(c, lambda r, n: F.log(r)), _standard), "normal_rank": (lambda c: _ranked(c, lambda r, n: normal_quantile((r - 0.5) / n)), _standard),
    "rank": (lambda c: _ranked(c, lambda r, n: r), _standard),
}

register("none", "", features="none", labels="none")
register("zscore", "cs_zscore", features="zscore", labels="zscore")
register("zscore_clip3", features="zscore_clip3", labels="zscore")
register("zscore_log_rank", "log_rank_zscore", "cs_zscore_log_rank", features="log_rank", labels="log_rank")
register("zscore_erfinv_rank", "zscore_inverf_rank", "erfinv_rank_zscore", "rank_gauss", features="normal_rank", labels="normal_rank")
register("mad5_zscore_features", features="mad5", labels="none")
register("mad5_zscore_rank_label", features="mad5", labels="rank")


def _mad5(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clips to five median absolute deviations about the date's median."""
    rows = rows.select("*", *[F.percentile(c, F.lit(0.5)).over(_d()).alias(f"_median_{c}") for c in columns])
    rows = rows.select("*", *[F.percentile(F.abs(F.col(c) - F.col(f"_median_{c}")), F.lit(0.5)).over(_d()).alias(f"_mad_{c}") for c in columns])
    clip = lambda c: F.least(F.greatest(F.col(c), F.col(f"_median_{c}") - 5 * F.col(f"_mad_{c}")), F.col(f"_median_{c}") + 5 * F.col(f"_mad_{c}"))
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), clip(c)) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in ("median", "mad")])


def apply(rows: DataFrame, name: str, features: Sequence[str], labels: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """`rows` with features and labels transformed by date; labels that `rows` lacks are left out."""
    if name not in _NAMES:
        raise KeyError(f"unknown transform: {name}")
    kinds = dict.fromkeys(features, _NAMES[name][0]) | {c: _NAMES[name][1] for c in labels if c in rows.columns}
    # a transform that leaves a column alone leaves infinite labels alone as well
    out = rows.withColumns({c: finite(F.col(c).cast("double")) for c, kind in kinds.items() if kind != "none" or c in features})
    if clipped := [c for c, kind in kinds.items() if kind == "mad5"]:
        out = _mad5(out, clipped)
    steps = {c: _STEPS["zscore" if kind == "mad5" else kind] for c, kind in kinds.items()}
    for turn in range(max(map(len, steps.values()), default=0)):
        out = out.withColumns({c: own[turn](c) for c, own in steps.items() if turn < len(own)})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in features}).select(*rows.columns)


def tail_label(x: Column, share: float) -> Column:
    """1 for the date's top `share` by mid-rank, 0 for its bottom `share`, null between."""
    rank, n = average_rank(finite(x))
    place = (rank - 0.5) / n
    return F.when(place >= 1 - share, F.lit(1)).when(place <= share, F.lit(0))
