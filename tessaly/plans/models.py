"""Models over panels: feature providers by name, and linear models fitted on windows of dates and applied to the next.

Fitting needs only sums of products by date, so a window's model is a small
matrix from one aggregate, and no date's rows leave the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE, CODE = "trade_date", "ts_code"
PROVIDERS: dict[str, Callable[..., DataFrame]] = {}


def provider(name: str):
    """Makes a function that returns a table of (trade_date, ts_code, features) known by name."""

    def add(f):
        if name in PROVIDERS:
            raise ValueError(f"there is a provider {name} already")
        PROVIDERS[name] = f
        return f

    return add


class AlphaModel(Protocol):
    """What a model does: learn from rows, score rows, and be written down and read."""

    def fit(self, rows: DataFrame) -> AlphaModel: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...

    def dump(self) -> str: ...


@dataclass
class Ridge:
    """Least squares with a penalty on all but the intercept; rows with a missing feature or label take no part in fitting and get no score."""

    features: Sequence[str]
    label: str
    penalty: float = 1.0
    weights: list[float] = field(default_factory=list)

    def fit(self, rows: DataFrame) -> Ridge:
        used = [*self.features, self.label]
        held = rows.select(*[F.col(c).cast("double").alias(c) for c in used]).dropna()
        held = held.filter(F.forall(F.array(*used), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
        columns = [F.lit(1.0), *[F.col(c) for c in self.features]]
        n = len(columns)
        cells = [F.sum(columns[i] * columns[j]) for i in range(n) for j in range(i, n)] + [F.sum(c * F.col(self.label)) for c in columns]
        found = [x or 0.0 for x in held.agg(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).first()]  # one row
        a = np.zeros((n, n))
        a[np.triu_indices(n)] = found[: n * (n + 1) // 2]
        a = a + np.triu(a, 1).T + self.penalty * np.diag([0.0] + [1.0] * (n - 1))
        self.weights = np.linalg.lstsq(a, np.array(found[n * (n + 1) // 2 :]), rcond=None)[0].tolist()
        return self

    def predict(self, rows: DataFrame, out: str = "score") -> DataFrame:
        if not self.weights:
            raise ValueError("the model isn't fitted")
        total = F.lit(self.weights[0])
        for w, c in zip(self.weights[1:], self.features, strict=True):
            total = total + F.lit(w) * F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        return rows.withColumn(out, total)

    def dump(self) -> str:
        return json.dumps({"features": [*self.features], "label": self.label, "penalty": self.penalty, "weights": self.weights})

    @staticmethod
    def load(text: str) -> Ridge:
        return Ridge(**json.loads(text))


def walk_forward(rows: DataFrame, make: Callable[[], AlphaModel], dates: Sequence[int], train: int, test: int, gap: int = 1) -> DataFrame:
    """Scores of each span of `test` dates by a model fitted on the `train` dates that end `gap` dates before it."""
    out = None
    for at in range(train + gap, len(dates), test):
        fitted = make().fit(rows.filter(F.col(DATE).between(dates[at - gap - train], dates[at - gap - 1])))
        span = fitted.predict(rows.filter(F.col(DATE).between(dates[at], dates[min(at + test, len(dates)) - 1])))
        out = span if out is None else out.unionByName(span)
    return out if out is not None else make().fit(rows.limit(0)).predict(rows.limit(0))


def load_features(spark: SparkSession, names: Sequence[str], keys: Sequence[str] = (DATE, CODE), **options) -> DataFrame:
    """The providers' tables joined on their keys; every key of any is there."""
    out = None
    for name in names:
        rows = PROVIDERS[name](spark, **options)
        out = rows if out is None else out.join(rows, list(keys), "full")
    return out
