"""Quality rules: fixed base rules, then robust multivariate outliers.

Per text, native functions compute counts and four transformed statistics. Per
language and source, the minimum-covariance-determinant estimate is sought from
several starts: all rows' mean and covariance, medians with median absolute
deviations, and the covariance of spatial signs about the medians. From each,
concentration steps run until no determinant falls any more: the Mahalanobis
distance of all rows, the closest three quarters, their mean and covariance. Of
a group's estimates the one of least determinant is taken. A last step takes all
rows within the 97.5 % quantile. A text is rejected when its squared distance
passes the chi-square quantile of ``1 - tail``.

Nothing gathers a group: moments are partial sums per task, medians come from
sketches of bounded size, and the distance that parts the closest share is found by counting distances in bins of 2 %
width, so it is exact to a bin, the same on each run, and bounded in memory.
A group with fewer than ``least`` usable rows is judged by the estimate over all
usable rows of its language, and where these are fewer too, by that over all of
the table; with fewer still, the base rules decide alone.
Distances use an explicit Cholesky factor in plain column arithmetic.

Defined results: a null text has no words, so the base rules reject it; null
languages and sources are values of their own; repeated rows and null ids are
rows like any other, and equal rows have equal verdicts; rows at equal distance are
closest together; a text of any length is read whole; columns of any other name,
whatever it is, play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, in_sieve, stored, words_column

STATISTICS = ("f_length", "f_symbols", "f_capitals", "f_marks")
#: What each statistic's deviation is at least: texts that all share a value are no reason to reject the first that differs.
FLOORS = (0.25, 0.25, 0.25, 0.25)

SYMBOLS = "#*$%&|<>"
_MIN_WORDS = 50
#: What the median absolute deviation of normal values is to be multiplied by for the deviation.
_NORMAL_MAD = 1.4826


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    if k % 2:
        raise ValueError("even degrees of freedom only")
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _window_hashes(words: Column) -> Column:
    n = F.size(words)
    return F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _placed(hashes: Column) -> Column:
    """The hashes with their places, sorted; empty where all differ."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeated(placed: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more; `placed` must be a column, as each element looks at its neighbours."""
    again = F.transform(
        placed, lambda p, k: F.when((p["h"] == F.get(placed, k - 1)["h"]) | (p["h"] == F.get(placed, k + 1)["h"]), F.array(p["i"], p["i"] + 1, p["i"] + 2))
    )
    return F.size(F.array_distinct(F.flatten(F.filter(again, lambda x: x.isNotNull()))))


def _row_key(*columns: Column) -> Column:
    """What tells a row from others, whatever of it is null: 128 bits of hashes."""
    held = [x for c in columns for x in (c, c.isNull())]
    return F.struct(F.xxhash64(F.lit(1), *held).alias("a"), F.xxhash64(F.lit(2), *held).alias("b"))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: id, lang, source, the counts of the base rules and the transformed statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("words")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SEPARATORS) != "")
    windows = (
        docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
        .withColumn("words", words_column(F.col("text")))
        .withColumn("lines", lines)
        .withColumn("hashes", _window_hashes(words))
        .withColumn("placed", _placed(F.col("hashes")))
    )
    chars = F.length(_without(text, SEPARATORS))
    counted = windows.select(
        "id", "lang", "source",
        _row_key(F.col("id"), F.col("text"), F.col("lang"), F.col("source")).alias("row_key"),
        F.size("words").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("placed")).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit(r"\p{P}")).cast("long").alias("n_marks"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        counted.withColumn("base_failed", (F.col("n_words") < _MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
        .withColumn("f_length", F.log((F.col("word_chars") + 1) / n) * 4)
        .withColumn("f_symbols", F.sqrt(F.col("n_symbols") / n) * 4)
        .withColumn("f_capitals", F.sqrt(F.col("n_capitals") / n) * 4)
        .withColumn("f_marks", F.sqrt(F.col("n_marks") / n) * 4)
    )


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """Adds `g`, the group whose estimate judges a row, or null, and `feeds`, the groups whose estimates its source's usable rows are part of."""
    usable = F.col("usable").cast("long")
    counts = rows.groupBy("lang", "source").agg(F.sum(usable).alias("n"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    by_lang = Window.partitionBy("lang")
    named = counts.withColumn("own", F.when(F.col("n") >= least, F.to_json(F.array(name("lang"), name("source")))))
    named = named.withColumn("lang_n", F.sum("n").over(by_lang)).withColumn("lang_asked", F.max(F.col("own").isNull()).over(by_lang))
    named = named.withColumn("of_lang", F.when(F.col("lang_asked") & (F.col("lang_n") >= least), F.to_json(F.array(name("lang")))))
    # languages with too few rows in all their sources ask for the estimate over the table
    asked = F.max(F.col("own").isNull() & F.col("of_lang").isNull())
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(asked, F.lit(False)).alias("all_asked"))
    of_all = F.when(F.col("all_asked") & (F.col("all_n") >= least), F.lit("[]"))
    named = named.crossJoin(F.broadcast(total)).withColumn("of_all", of_all)
    groups = stored(named.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), F.coalesce("own", "of_lang", "of_all").alias("g"), F.array_compact(F.array("own", "of_lang", "of_all")).alias("feeds")))
    return rows.join(groups, F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")), "left").drop("gl", "gs")


_PAIRS = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
_ESTIMATE = [*(f"m_{i}" for i in range(len(STATISTICS))), *(f"l_{i}_{j}" for i, j in _PAIRS)]


def _factored(out: DataFrame, inflate: float, *more: str) -> DataFrame:
    """From means m_i and covariances c_i_j of groups g, stored: the means, the lower triangle l_i_j of the Cholesky factor, and the columns `more`."""
    for i, j in _PAIRS:
        c = F.col(f"c_{i}_{j}") * inflate + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l_{j}_{j}"))
    return stored(out.select(F.col("g").alias("mg"), *_ESTIMATE, *more))


def _covariances(mean: str = "m") -> list[Column]:
    """Of a group's rows: the means, named by `mean`, and the covariances c_i_j."""
    return [F.avg(x).alias(f"{mean}_{i}") for i, x in enumerate(STATISTICS)] + [F.coalesce(F.covar_pop(STATISTICS[i], STATISTICS[j]), F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS]


def _moments(rows: DataFrame, inflate: float) -> DataFrame:
    """Per group: means m_i and the lower triangle l_i_j of the Cholesky factor of the covariance."""
    return _factored(rows.groupBy("g").agg(*_covariances()), inflate)


def _starts(core: DataFrame) -> DataFrame:
    """First estimates of groups named start:group; ``_distance`` of rows that name them so starts the search."""
    p = len(STATISTICS)
    middles = [F.percentile_approx(x, 0.5).alias(f"m_{i}") for i, x in enumerate(STATISTICS)]
    middle = stored(core.groupBy(F.col("g").alias("mg")).agg(*middles, *_covariances("a")))
    away = core.join(middle.select("mg", *[f"m_{i}" for i in range(p)]), F.col("g") == F.col("mg"))
    spread = away.groupBy("g").agg(*[(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5) * _NORMAL_MAD).alias(f"d_{i}") for i, x in enumerate(STATISTICS)])
    both = stored(spread.join(middle, F.col("g") == F.col("mg")).drop("g"))
    wide = [F.sqrt(F.col(f"d_{i}") ** 2 + FLOORS[i] ** 2) for i in range(p)]
    near = both.select("mg", *[f"m_{i}" for i in range(p)], *[f"d_{i}" for i in range(p)])
    scaled = core.join(near, F.col("g") == F.col("mg")).select("g", *[((F.col(x) - F.col(f"m_{i}")) / wide[i]).alias(f"z_{i}") for i, x in enumerate(STATISTICS)])
    length = F.sqrt(sum((F.col(f"z_{i}") ** 2 for i in range(1, p)), F.col("z_0") ** 2))
    signs = scaled.withColumn("r", F.greatest(length, F.lit(1e-9))).groupBy("g").agg(*[(F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("r") ** 2) * p).alias(f"s_{i}_{j}") for i, j in _PAIRS])
    plain = {(i, j): F.col(f"d_{i}") ** 2 if i == j else F.lit(0.0) for i, j in _PAIRS}
    signed = {(i, j): F.col(f"s_{i}_{j}") * F.col(f"d_{i}") * F.col(f"d_{j}") for i, j in _PAIRS}
    whole = {(i, j): F.col(f"c_{i}_{j}") for i, j in _PAIRS}
    found = [
        F.struct(F.concat(F.lit(f"{k}:"), F.col("g")).alias("g"), *[F.col(f"{mean}_{i}").alias(f"m_{i}") for i in range(p)], *[covariance[x].alias("c_{}_{}".format(*x)) for x in _PAIRS])
        for k, (mean, covariance) in enumerate((("a", whole), ("m", plain), ("m", signed)))
    ]
    return _factored(signs.join(both, F.col("g") == F.col("mg")).select(F.explode(F.array(*found)).alias("start")).select("start.*"), 1.0)


def _determinant() -> Column:
    """The logarithm of an estimate's determinant."""
    return sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(STATISTICS))), F.log(F.col("l_0_0"))) * 2


def _concentrated(rows: DataFrame, moments: DataFrame, share: float, inflate: float) -> DataFrame:
    """A concentration step: the moments of each group's closest `share` of rows by the estimates `moments`, and `before`, the determinant that these had.

    One pass over the rows adds up each distance bin, and the bins up to the
    edge are a group's closest, so a step is one query that sends one small
    table to all tasks.
    """
    sums = {f"t_{i}": F.col(x) for i, x in enumerate(STATISTICS)} | {f"t_{i}_{j}": F.col(STATISTICS[i]) * F.col(STATISTICS[j]) for i, j in _PAIRS}
    measured = _distance(rows, moments.select("mg", *_ESTIMATE, _determinant().alias("before")))
    inner = _within(_binned(measured, F.max("before").alias("before"), *[F.sum(x).alias(k) for k, x in sums.items()]), share)
    n = F.sum("n")
    means = inner.groupBy("g").agg(F.max("before").alias("before"), *[(F.sum(f"t_{i}") / n).alias(f"m_{i}") for i in range(len(STATISTICS))], *[(F.sum(f"t_{i}_{j}") / n).alias(f"t_{i}_{j}") for i, j in _PAIRS])
    return _factored(means.select("*", *[(F.col(f"t_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")).alias(f"c_{i}_{j}") for i, j in _PAIRS]), inflate, "before")


def least_determinant(core: DataFrame, share: float, steps: int) -> DataFrame:
    """Per group `g` of `core`, the moments of the closest `share` of its rows, of least determinant over all starts.

    Concentration steps end when no determinant falls by a thousandth, and after `steps` at most.
    """
    inflate = share / chi2_cdf(chi2_quantile(share, len(STATISTICS)), len(STATISTICS) + 2)
    tried = core.withColumn("g", F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.col("g")) for k in range(3)])))
    moments = _starts(core)
    for step in range(steps):
        moments = _concentrated(tried, moments, share, inflate)
        if step and moments.filter(F.col("before") - _determinant() >= 1e-3).isEmpty():
            break
    named = moments.withColumn("start", F.substring("mg", 1, 1).cast("int")).withColumn("mg", F.expr("substring(mg, 3)")).withColumn("det", _determinant())
    # a row a start: starts that end alike differ by rounding only, so the first of them is taken
    best = F.min(F.struct(F.round("det", 6).alias("det"), "start", *_ESTIMATE)).alias("best")
    return stored(named.groupBy("mg").agg(best).select("mg", *[f"best.{c}" for c in _ESTIMATE]))


def _distance(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """Adds `d2`, the squared Mahalanobis distance, by forward substitution."""
    p = len(STATISTICS)
    out = rows.join(moments, F.col("g") == F.col("mg"), "left")
    for i in range(p):
        y = F.col(STATISTICS[i]) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, p)), F.col("y_0") * F.col("y_0"))
    return out.withColumn("d2", d2).drop("mg", *_ESTIMATE, *[f"y_{i}" for i in range(p)])


def _binned(measured: DataFrame, *sums: Column) -> DataFrame:
    """Per group and distance bin: the number of rows `n`, and `sums`."""
    return measured.groupBy("g", F.floor(F.log(F.col("d2") + 1e-6) * 50).alias("bin")).agg(F.count(F.lit(1)).alias("n"), *sums)


def _within(bins: DataFrame, share: float) -> DataFrame:
    """The bins of each group up to the one in which `share` of its rows is reached."""
    upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
    return counted.filter(F.col("upto") - F.col("n") < F.col("all") * share)


def _closest(measured: DataFrame, share: float) -> DataFrame:
    """Per group the edge of the distance bin in which `share` of the rows is reached."""
    edge = F.exp((F.max("bin") + 1) / 50) - 1e-6
    return stored(_within(_binned(measured), share).groupBy(F.col("g").alias("eg")).agg(edge.alias("edge")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, steps: int = 8, tail: float = 1e-9, least: int = 60) -> DataFrame:
    """Counts, base verdict, squared distance and verdict of each document.

    `share` is the part of a group that an estimate rests on, `steps` the most
    concentration steps, `tail` the share of normal rows that may be rejected.
    """
    p = len(STATISTICS)
    rows = stored(_grouped(stored(statistics(docs, id_col, text_col, lang_col, source_col).withColumn("usable", ~F.col("base_failed"))), least))
    core = rows.filter("usable").select(F.explode("feeds").alias("g"), *STATISTICS)
    moments = least_determinant(core, share, steps)
    moments = _moments(_distance(core, moments).filter(F.col("d2") <= chi2_quantile(0.975, p)), 0.975 / chi2_cdf(chi2_quantile(0.975, p), p + 2))
    cut = chi2_quantile(1 - tail, p)
    judged = _distance(rows, moments).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("d2") > cut, F.lit(False)))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "row_key")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, all columns as they are, that ``judge`` keeps."""
    rejected = judge(docs, id_col, text_col, lang_col, source_col, **options).filter(~F.col("kept")).select(F.col("row_key").alias("id")).distinct()
    rejected, columns = stored(rejected), docs.columns
    whole = docs.select(F.struct(*columns).alias("row"), _row_key(F.col(id_col), F.col(text_col), F.col(lang_col), F.col(source_col)).alias("id"))
    known = in_sieve(whole, rejected, "known")
    # only texts that are rejected, or look so in the bitmap, are moved
    return known.filter("not known").select("row").union(known.filter("known").join(rejected, "id", "left_anti").select("row")).select("row.*")
