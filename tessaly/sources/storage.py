"""Reading and writing keyed tables: declared schemas, pruned scans, column merges, missing keys, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ("trade_date", "ts_code")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, start: int | None = None, end: int | None = None, codes: Sequence[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """A pruned scan: columns, date range and instruments all reach the reader.

    Key columns that are missing are an error; value columns that are missing
    are left out unless all are. A schema gives types to columns that hold only
    nulls.
    """
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if start is not None:
        rows = rows.filter(F.col("trade_date") >= start)
    if end is not None:
        rows = rows.filter(F.col("trade_date") <= end)
    if codes is not None:
        rows = rows.filter(F.col("ts_code").isin(*codes))
    if columns is None:
        return rows
    keys = [c for c in columns if c in (*KEYS, "trade_time")]
    if lost := [c for c in keys if c not in rows.columns]:
        raise ValueError(f"key columns are missing: {lost}")
    values = [c for c in columns if c not in keys]
    there = [c for c in values if c in rows.columns]
    if values and not there:
        raise ValueError(f"none of the columns is there: {values}")
    return rows.select(*keys, *there)


def merge_columns(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of both: where a key has a new row, its columns replace the old ones, null or not; all other cells stay."""
    marked = new.withColumn("_new", F.lit(True))
    both = old.alias("o").join(marked.alias("n"), list(keys), "full")
    columns = [c for c in old.columns if c not in keys] + [c for c in new.columns if c not in keys and c not in old.columns]

    def cell(c: str):
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c not in old.columns:
            return F.col(f"n.{c}")
        return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*keys, *[cell(c).alias(c) for c in columns])


def missing(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The wanted keys that aren't done yet."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_factors(rows: DataFrame, path: str, keys: Sequence[str] = KEYS, date: str = "trade_date") -> None:
    """Values as 32-bit floats, one partition a date; dates that `rows` holds replace stored ones as a whole, others stay."""
    narrowed = rows.select(*[F.col(c).cast("float") if t == "double" and c not in keys else F.col(c) for c, t in rows.dtypes])
    narrowed.repartition(date).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def drop_columns(spark: SparkSession, path: str, out: str, columns: Sequence[str], date: str = "trade_date") -> None:
    """The table at `path` without some columns, written to `out`."""
    spark.read.parquet(path).drop(*columns).write.partitionBy(date).parquet(out)


def metadata(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A registry's rows, tags as JSON lists."""
    frame = spark.createDataFrame([(r["id"], r.get("version", 1), list(r.get("tags", ())), r.get("deprecated", False)) for r in rows], "id string, version int, tags array<string>, deprecated boolean")
    return frame.withColumn("tags", F.to_json("tags"))


def select_metadata(registry: DataFrame, tags: Sequence[str] = (), ids: Sequence[str] = (), with_deprecated: bool = False) -> DataFrame:
    """Entries that hold every tag; the ids asked for, if any; deprecated ones only if asked for."""
    held = F.from_json("tags", "array<string>")
    rows = registry if with_deprecated else registry.filter(~F.col("deprecated"))
    for tag in tags:
        rows = rows.filter(F.array_contains(held, tag))
    return rows.filter(F.col("id").isin(*ids)) if ids else rows
