"""Risk exposures by family, over a dense panel: size, volatility, liquidity, momentum, and their composites.

Raw measures roll over an instrument's sessions; each is clipped to its date's
1 % and 99 % quantiles and standardised with the root of the float value as weight.
A composite is the mean of its parts that are there, standardised again.
`month` and `year` are lengths in sessions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.crosssection import Cross
from tessaly.functions.timeseries import EPS, Rolling, clean

from .neutralize import residualise

DATE, CODE = "trade_date", "ts_code"
#: Exposures by family; the last of each is the composite.
FAMILIES: dict[str, tuple[str, ...]] = {
    "SIZE": ("Size", "Mid_Cap"),
    "VOLATILITY": ("Beta", "Historical_Sigma", "Daily_Std", "Cumulative_Range"),
    "LIQUIDITY": ("Monthly_Share_Turnover", "Quarterly_Share_Turnover", "Annual_Share_Turnover", "Annualized_Traded_Value_Ratio"),
    "MOMENTUM": ("Historical_Alpha", "Relative_Strength", "Short_Term_Reversal"),
}


def _weight() -> Column:
    mv = clean(F.col("circ_mv"))
    return F.when(mv > 0, F.sqrt(mv))


def weighted_zscore(x: Column) -> Column:
    """Over the date: less the weighted mean, over the weighted deviation; weights that aren't positive count for nothing."""
    d = Window.partitionBy(DATE)
    w = F.when(clean(x).isNotNull(), _weight())
    total = F.sum(w).over(d)
    mean = F.sum(w * x).over(d) / total
    square = F.sum(w * x * x).over(d) / total - mean * mean
    return F.when(w.isNotNull() & (square > 1e-12), (x - mean) / F.sqrt(F.greatest(square, F.lit(0.0))))


def standardised(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = rows.withColumns({c: Cross().winsorize_quantile(F.col(c), 0.01, 0.99) for c in columns})
    return rows.withColumns({c: weighted_zscore(F.col(c)) for c in columns})


def composite(rows: DataFrame, parts: Sequence[str], out: str) -> DataFrame:
    there = reduce(Column.__add__, [F.col(p).isNotNull().cast("int") for p in parts])
    total = reduce(Column.__add__, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts])
    rows = rows.withColumn(out, F.when(there > 0, total / there))
    return rows.withColumn(out, weighted_zscore(F.col(out)))


def liquidity(month: int, year: int, half_life: float) -> dict[str, Column]:
    """Logs of turnover over one, three and twelve months, all sessions of a month needed, and the yearly weighted mean."""
    t = F.col("turnover")
    order = Window.partitionBy(CODE).orderBy(DATE)
    total = Rolling(month, month).sum(t)
    monthly = lambda k: F.when(total > EPS, F.log(total)) if not k else None
    return {"_sum": F.when(total > EPS, total), "Monthly_Share_Turnover": monthly(0), "Annualized_Traded_Value_Ratio": Rolling(year, year).ew_sum(t, half_life) / F.lit(sum(0.5 ** (k / half_life) for k in range(year))) * year, "_order": F.row_number().over(order)}


def raw_exposures(panel: DataFrame, month: int = 21, year: int = 252, lag: int = 11) -> DataFrame:
    """The measures before anything by date; `panel` has circ_mv, turnover, ret (the return) and market (the index's)."""
    order = Window.partitionBy(CODE).orderBy(DATE)
    months = year // month
    r, lr = F.col("ret"), F.when(F.col("ret") > -1, F.log1p("ret"))
    fit = Rolling(year, 1).ew_regression(r, F.col("market"), year / 4)
    base = liquidity(month, year, year / 4)
    first = panel.select(
        DATE, CODE, "present", "circ_mv", F.when(F.col("circ_mv") > 0, F.log("circ_mv")).alias("Size"), base["_sum"].alias("_sum"), base["Monthly_Share_Turnover"].alias("Monthly_Share_Turnover"),
        base["Annualized_Traded_Value_Ratio"].alias("Annualized_Traded_Value_Ratio"), fit.alias("_fit"), Rolling(year, 1).ew_std_dev(r, year / 6).alias("Daily_Std"), Rolling(year, 1).ew_sum(lr, year / 2).alias("_strength"),
        Rolling(month, 1).ew_sum(lr, month / 4).alias("_reversal"), *[Rolling(month * k, 1).sum(lr).alias(f"_c{k}") for k in range(1, months + 1)],
    )
    mean_log = lambda n: F.when(reduce(Column.__and__, [F.lag("_sum", month * k).over(order).isNotNull() for k in range(n)]), F.log(reduce(Column.__add__, [F.lag("_sum", month * k).over(order) for k in range(n)]) / n))
    lagged = Window.partitionBy(CODE).orderBy(DATE).rowsBetween(-2 * lag + 1, -lag)
    ranges = [F.col(f"_c{k}") for k in range(1, months + 1)]
    return first.select(
        DATE, CODE, "present", "circ_mv", "Size", F.col("_fit.beta").alias("Beta"), F.col("_fit.residual_sigma").alias("Historical_Sigma"), "Daily_Std", (F.greatest(*ranges) - F.least(*ranges)).alias("Cumulative_Range"),
        "Monthly_Share_Turnover", mean_log(3).alias("Quarterly_Share_Turnover"), mean_log(months).alias("Annual_Share_Turnover"), "Annualized_Traded_Value_Ratio",
        F.col("_fit.alpha").alias("Historical_Alpha"), F.avg("_strength").over(lagged).alias("Relative_Strength"), F.lag("_reversal", 1).over(order).alias("Short_Term_Reversal"),
    )


def risk_exposures(panel: DataFrame, month: int = 21, year: int = 252, lag: int = 11) -> DataFrame:
    """All exposures of present rows: parts standardised, Mid_Cap as the cube of Size less its weighted line on Size, and the composites."""
    raw = raw_exposures(panel, month, year, lag).filter("present").withColumn("_w", _weight())
    sized = standardised(raw, ["Size"])
    sized = residualise(sized.withColumn("_cube", F.col("Size") ** 3), "_cube", ["Size"], weight="_w", date=DATE, out="Mid_Cap").drop("_cube", "_w")
    parts = [p for own in FAMILIES.values() for p in own if p != "Size"]
    out = standardised(sized, parts)
    for name, own in FAMILIES.items():
        out = composite(out, own, name)
    return out.select(DATE, CODE, "Size", *parts, *FAMILIES)
