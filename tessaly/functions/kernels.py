"""Statistics of a series as a whole, for grouped pandas functions: autocorrelation, runs, long memory, variance ratio.

A series keeps its gaps (not a number), so neighbours are neighbours in time.
"""

from __future__ import annotations

from math import lgamma, log, pi, sqrt, tanh

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = 2.220446049250313e-16
LAGS = 5
#: Sample sizes whose rescaled ranges are compared.
SCALES = (4, 8, 16)


def _enough(there: int, slots: int) -> bool:
    """Three fifths of the slots."""
    return 5 * there >= 3 * slots


def autocorrelations(x: np.ndarray, lags: int) -> list[tuple[float, int]]:
    """(correlation, pairs) at lags 1 to `lags` about the mean of all values; empty for a constant series or one with too many gaps."""
    c = x - np.nanmean(x)
    total = float(np.nansum(c * c))
    out = []
    for k in range(1, lags + 1):
        products = c[k:] * c[:-k]
        pairs = int((~np.isnan(products)).sum())
        if total <= EPS or not pairs or not _enough(pairs, len(x) - k):
            return []
        out.append((float(np.nansum(products)) / total, pairs))
    return out


def ljung_box(x: np.ndarray, lags: int = LAGS) -> tuple[float, float]:
    """(energy, signed): the sum of n (n + 2) rho**2 / pairs, and the sign-weighted part of it, scaled by how far the energy passes the number of lags."""
    n = int((~np.isnan(x)).sum())
    found = autocorrelations(x, lags) if n > lags + 1 and _enough(n, len(x)) else []
    if not found:
        return float("nan"), float("nan")
    terms = [n * (n + 2) * rho**2 / pairs for rho, pairs in found]
    energy = sum(terms)
    if energy <= lags:
        return energy, 0.0
    signed = sum(t if rho >= 0 else -t for t, (rho, _) in zip(terms, found, strict=True))
    return energy, (energy - lags) / (energy + lags) * signed / energy


def runs_score(x: np.ndarray) -> float:
    """How few changes the order of signs has, against all orders of the same signs over the same neighbours, halved, through tanh.

    Zero counts as a gain. Positive where gains and losses keep together. 0
    where all signs are alike; needs 4 values, three fifths of the slots and 3
    neighbouring pairs.
    """
    there = ~np.isnan(x)
    up = x >= 0
    n = int(there.sum())
    if n < 4 or not _enough(n, len(x)):
        return float("nan")
    edge = there[1:] & there[:-1]
    edges = int(edge.sum())
    if edges < 3:
        return float("nan")
    a, b = int((there & ~up).sum()), int((there & up).sum())
    if a == 0 or b == 0:
        return 0.0
    switches = int((edge & (up[1:] != up[:-1])).sum())
    shared = int((edge[1:] & edge[:-1]).sum())  # pairs of edges that meet in a value
    p = 2 * a * b / (n * (n - 1))
    joint = 4 * a * (a - 1) * b * (b - 1) / (n * (n - 1) * (n - 2) * (n - 3))
    apart = edges * (edges - 1) / 2 - shared
    variance = edges * p * (1 - p) + 2 * (shared * (p / 2 - p * p) + apart * (joint - p * p))
    return tanh((edges * p - switches) / (2 * sqrt(variance))) if variance > 0 else 0.0


def rescaled_range(x: np.ndarray) -> float:
    """The range of the running sum of deviations, from 0 on, over the deviation; not a number with a gap or without spread."""
    sigma = float(x.std()) if len(x) and not np.isnan(x).any() else 0.0
    if not sigma > EPS:
        return float("nan")
    path = np.cumsum(x - x.mean())
    return float((max(path.max(), 0) - min(path.min(), 0)) / sigma)


def expected_range(n: int) -> float:
    """The exact mean rescaled range of n independent normal values."""
    return float(np.exp(lgamma((n - 1) / 2) - lgamma(n / 2)) / sqrt(pi) * sum(sqrt((n - k) / k) for k in range(1, n)))


def long_memory(x: np.ndarray, scales: tuple[int, ...] = SCALES) -> float:
    """tanh of twice the slope of log mean rescaled range, over its mean for independent values, on log sample size.

    Blocks count back from the end; a scale needs 2 of them and half of all.
    """
    points = []
    for s in scales:
        blocks = len(x) // s
        found = [rescaled_range(x[len(x) - (k + 1) * s : len(x) - k * s]) for k in range(blocks)]
        held = [f for f in found if f == f]
        if len(held) < 2 or 2 * len(held) < blocks or sum(held) <= 0:
            return float("nan")
        points.append((log(s), log(sum(held) / len(held) / expected_range(s))))
    a = np.array(points)
    c = a[:, 0] - a[:, 0].mean()
    return tanh(2 * float(c @ a[:, 1] / (c @ c)))


def variance_ratio(x: np.ndarray, q: int) -> float:
    """Variance of sums of `q` neighbours over `q` times the variance; values in order, gaps left out."""
    x = x[~np.isnan(x)]
    if len(x) < q + 1:
        return float("nan")
    mean, one = x.mean(), float(x.var())
    sums = np.convolve(x, np.ones(q), "valid")
    return float(np.mean((sums - q * mean) ** 2) / (q * one)) if one > EPS else float("nan")


KERNELS = {
    "ljung_box": lambda x: ljung_box(x)[0], "ljung_box_signed": lambda x: ljung_box(x)[1], "runs": runs_score, "long_memory": long_memory, "variance_ratio": lambda x: variance_ratio(x, 2),
}


def series_statistics(panel: DataFrame, value: str, key: str = "ts_code", order: str = "trade_date") -> DataFrame:
    """All kernels of each instrument's values in order, gaps kept; one row an instrument."""
    kind = panel.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].astype("float64").to_numpy()
        n = int((~np.isnan(x)).sum())
        found = {k: f(x) if n else float("nan") for k, f in KERNELS.items()}
        return pd.DataFrame([{key: pdf[key].iloc[0], "n": n, **{k: None if v != v else v for k, v in found.items()}}])

    return panel.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kind}, n long, " + ", ".join(f"{k} double" for k in KERNELS))
