"""Regression residuals by date, with group effects and weights, as window sums and a solved normal equation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.timeseries import clean

#: A pivot at or below this makes the equations singular, and all residuals of the date missing.
PIVOT = 1e-12


def residualise(panel: DataFrame, y: str, regressors: list[str], group: str | None = None, weight: str | None = None, date: str = "trade_date", out: str = "residual") -> DataFrame:
    """Adds the residual of `y` on the regressors of each date.

    Without a group there is an intercept; with one, values are taken less their
    weighted group mean instead. Rows with a missing value, a weight that isn't
    positive, or a null or empty group take no part and get null, as do dates
    with fewer rows than coefficients. Equations are solved in column arithmetic
    by elimination, so a date costs one shuffle and no row leaves the JVM.
    """
    columns = [y, *regressors]
    usable = reduce(Column.__and__, [clean(F.col(c)).isNotNull() for c in columns])
    w = F.lit(1.0)
    if weight is not None:
        usable, w = usable & (F.col(weight) > 0), F.col(weight).cast("double")
    if group is not None:
        usable = usable & F.col(group).isNotNull() & (F.col(group) != "")
    by_date = Window.partitionBy(date)
    centred = by_date if group is None else Window.partitionBy(date, group)
    rows = panel.withColumn("_w", F.when(usable, w))
    total = F.sum("_w").over(centred)
    rows = rows.select("*", *[F.when(F.col("_w").isNotNull(), F.col(c) - F.sum(F.col("_w") * F.col(c)).over(centred) / total).alias(f"_c{i}") for i, c in enumerate(columns)])
    k = len(regressors)
    cell = lambda i, j: F.sum(F.col("_w") * F.col(f"_c{i}") * F.col(f"_c{j}")).over(by_date)
    # one column a cell of the augmented matrix, then one a step of elimination
    sums = [cell(i + 1, j + 1).alias(f"_a{i}_{j}") for i in range(k) for j in range(i, k)] + [cell(i + 1, 0).alias(f"_a{i}_{k}") for i in range(k)]
    rows = rows.select("*", F.count("_w").over(by_date).alias("_n"), *sums)
    for p in range(k):
        steps = []
        for i in range(p + 1, k):
            for j in [*range(i, k), k]:
                factor = F.col(f"_a{p}_{i}") / F.col(f"_a{p}_{p}")
                steps.append((f"_a{i}_{j}", F.when(F.abs(F.col(f"_a{p}_{p}")) > PIVOT, F.col(f"_a{i}_{j}") - factor * F.col(f"_a{p}_{j}"))))
        rows = rows.withColumns(dict(steps)) if steps else rows
    for i in reversed(range(k)):
        known = sum((F.col(f"_a{i}_{j}") * F.col(f"_b{j}") for j in range(i + 1, k)), F.lit(0.0))
        rows = rows.withColumn(f"_b{i}", F.when(F.abs(F.col(f"_a{i}_{i}")) > PIVOT, (F.col(f"_a{i}_{k}") - known) / F.col(f"_a{i}_{i}")))
    fitted = sum((F.col(f"_b{i}") * F.col(f"_c{i + 1}") for i in range(k)), F.lit(0.0))
    least = k + (1 if group is None else 0) + 1
    residual = F.when(F.col("_w").isNotNull() & (F.col("_n") >= least), F.col("_c0") - fitted)
    return rows.select(*panel.columns, residual.alias(out))
