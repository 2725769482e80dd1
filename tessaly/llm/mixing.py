"""Mixing sources to target weights.

Each document gets a hash-random key, which orders its source. Word counts are
summed per source and key range, a prefix sum over the ranges finds the one
range in which the source's budget ends, and a prefix sum over that range's
documents finds the document. So a source of any size is never sorted or
gathered as a whole, and what the documents are joined with has one row a source.

A budget of more than the source repeats it in whole epochs; the rest is the
start of the source in key order, cut at the exact word (``taken``) or at the
nearest whole document (``copies``).

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; repeated rows of one id and size share a cut evenly; where all
sizes are 0 all targets are 0; texts of any length count whole; columns of any
other name, in any order, stay as they are; an empty table gives an empty table.

Windows without a partition run over one row a source, or a source and range of
keys, not over documents: sources are some thousands at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_column, stored

#: Hexadecimal digits of the key that name its range: 4,096 ranges a source.
RANGE_DIGITS = 3


def _key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Adds `target` to rows (source, source_size): shares by weight, at most `most` times a source's size.

    Shares beyond that are dealt again by weight until none is above. In the
    order of most * size / weight the capped sources come first, so one pass of
    running sums finds the level at which the others end.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
    )
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    open_level = F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level"))
    return (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("free", F.max(open_level).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("free") * F.col("weight")), F.col("cap").cast("double")))
        .select("source", "source_size", "target")
    )


def plan(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source from rows (source, key, size): size, target, budget, epochs, and where the last epoch is cut."""
    ranges = stored(sized.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("range_size")))
    sources = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    sources = stored(
        sources.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(1)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        ranges.withColumn("start", F.sum("range_size").over(upto) - F.col("range_size"))
        .join(sources.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("rest") > F.col("start")) & (F.col("rest") <= F.col("start") + F.col("range_size")))
        .select("s", "range", "start", "rest")
    )
    last = stored(found)  # a row for each source with a rest
    inside = sized.join(last, sized["source"].eqNullSafe(last["s"]) & (F.substring("key", 1, RANGE_DIGITS) == last["range"])).groupBy("s", "start", "rest", "key", "size").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("s").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        inside.withColumn("before", F.col("start") + F.sum(F.col("size") * F.col("rows")).over(order) - F.col("size") * F.col("rows"))
        .filter((F.col("rest") > F.col("before")) & (F.col("rest") <= F.col("before") + F.col("size") * F.col("rows")))
        .select("s", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.expr("(rest - before) div rows").alias("cut_words"))
    )
    joined = sources.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return stored(joined.select("source", "source_size", "target", "epochs", "cut_key", "cut_size", "cut_words"))


def assign(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds source_size, target, taken and copies to rows that hold source, key and size."""
    planned = planned.withColumnRenamed("source", "s")
    # F.struct compares field by field, so rows before the cut are one comparison away
    place, cut = F.struct("key", "size"), F.struct(F.col("cut_key").alias("key"), F.col("cut_size").alias("size"))
    extra = F.when(F.col("cut_key").isNull(), F.lit(0)).when(place < cut, F.col("size")).when(place == cut, F.col("cut_words")).otherwise(F.lit(0))
    once = F.when(F.col("cut_key").isNull(), F.lit(0)).when(place < cut, F.lit(1)).when((place == cut) & (F.col("cut_words") * 2 >= F.col("size")), F.lit(1)).otherwise(F.lit(0))
    return (
        sized.join(planned, F.col("source").eqNullSafe(F.col("s")), "left")
        .drop("s")
        .withColumn("taken", (F.col("epochs") * F.col("size") + extra).cast("long"))
        .withColumn("copies", (F.col("epochs") + once).cast("int"))
        .drop("epochs", "cut_key", "cut_size", "cut_words")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """What the mix takes of each document: the id, source, size, source_size, target, taken and copies."""
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _key(F.col(id_col), seed).alias("key"), n_words_column(F.col(text_col)).alias("size")))
    return assign(sized, plan(sized, weights, most)).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: whole rows of `docs`, each as often as its source's target asks; texts aren't shuffled."""
    columns = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs[source_col].alias("source"), _key(docs[id_col], seed).alias("key"), n_words_column(docs[text_col]).alias("size"))
    taken = assign(whole, plan(stored(whole.select("source", "key", "size")), weights, most))
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('0:' || coalesce(doc_id::varchar, '')) as key from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) as rank from d group by source),
w as (
  select *, (rank - 1) % 3 + 1 as weight, 3 * source_size as cap, sum(source_size) over () as total, sum((rank - 1) % 3 + 1) over () as weights from s),
l as (
  select *, (total - coalesce(sum(cap) over before, 0))::double / (weights - coalesce(sum(weight) over before, 0))::double as level
  from w window before as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
f as (
  select *, max(case when level < cap / weight then level end) over () as free from l),
t as (
  select source, source_size, coalesce(least(cap::double, free * weight), cap::double) as target from f),
b as (
  select *, floor(target + 0.5)::bigint as budget, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 1 end as epochs from t),
r as (
  select d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size as rest,
         sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and current row) - d.size as before
  from d join b on d.source is not distinct from b.source)
select doc_id, size::bigint as size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from r
"""
