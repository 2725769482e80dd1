"""Logical datasets over partitioned Parquet: daily by year and date, minutes by date, dimensions, disclosures, raw caches, upserts, sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import KEYS, merge_columns

DATE = "trade_date"


@dataclass(frozen=True)
class Dataset:
    """A table's folder below the root, the columns that a row is known by, and its layout: `year` and `date` are partition columns.

    Partitions of a `wide` table may hold different columns; a scan reads the union.
    """

    folder: str
    keys: tuple[str, ...] = KEYS
    layout: str = "date"
    wide: bool = False


class Catalogue:
    """Datasets below one root; reads push dates into partition folders and columns into the files."""

    def __init__(self, spark: SparkSession, root: str, datasets: dict[str, Dataset]):
        self.spark, self.root, self.datasets = spark, root.rstrip("/"), dict(datasets)

    def path(self, name: str) -> str:
        return f"{self.root}/{self.datasets[name].folder}"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", self.datasets[name].wide).parquet(self.path(name))

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces the partitions that `rows` holds; others stay."""
        layout = self.datasets[name].layout
        out = rows.withColumn("year", F.floor(F.col(DATE) / 10000).cast("int")) if layout == "year" else rows
        parts = {"year": ["year"], "date": [DATE], "whole": []}[layout]
        writer = (out.repartition(*parts).sortWithinPartitions(*self.datasets[name].keys) if parts else out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*parts) if parts else writer).parquet(self.path(name))

    def whole(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        rows = self._read(name)
        return rows.drop("year") if columns is None else rows.select(*columns)

    def load(self, name: str, columns: Sequence[str] | None = None, start: int | None = None, end: int | None = None, codes: Sequence[str] | None = None) -> DataFrame:
        """A range of dates; in yearly files the year's folder is pruned as well."""
        rows = self._read(name)
        yearly = self.datasets[name].layout == "year"
        for bound, holds in ((start, Column.__ge__), (end, Column.__le__)):
            if bound is not None:
                rows = rows.filter(holds(F.col(DATE), bound))
                rows = rows.filter(holds(F.col("year"), bound // 10000)) if yearly else rows
        if codes is not None:
            rows = rows.filter(F.col("ts_code").isin(*codes))
        rows = rows.drop("year") if yearly else rows
        return rows if columns is None else rows.select(*dict.fromkeys([*self.datasets[name].keys, *columns]))

    def load_dates(self, name: str, dates: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        """Some dates: a list that reaches the scan, by year and date."""
        rows = self.load(name, columns, min(dates), max(dates)) if dates else self.load(name, columns).limit(0)
        return rows.filter(F.col(DATE).isin(*dates)) if dates else rows

    def load_index(self, name: str, code: str, columns: Sequence[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        return self.load(name, columns, start, end, [code])

    def load_disclosed(self, name: str, end: int, quarters: int, disclosed: str = "f_ann_date", period: str = "end_date") -> DataFrame:
        """What was disclosed by `end`, of the last `quarters` periods before it."""
        year, quarter = end // 10000, (end // 100 % 100 + 2) // 3
        first = year * 4 + quarter - quarters
        floor = (first - 1) // 4 * 10000 + ((first - 1) % 4 * 3 + 1) * 100
        return self.whole(name).filter(F.col(disclosed).isNotNull() & (F.col(disclosed) <= end) & (F.col(period) >= floor))

    # caches and upserts
    def missing_dates(self, name: str, wanted: DataFrame) -> DataFrame:
        """The wanted dates that aren't stored; an empty or absent dataset lacks all."""
        try:
            done = self.whole(name).select(DATE).distinct()
        except Exception as error:  # noqa: BLE001 - Spark says so only by an error of its own
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return wanted.select(DATE).distinct()
        return wanted.select(DATE).distinct().join(done, DATE, "left_anti")

    def complete(self, name: str, wanted: DataFrame, make) -> DataFrame:
        """The dataset with what it lacked of the wanted dates made by `make` (rows of some dates) and stored."""
        lost = [r[0] for r in self.missing_dates(name, wanted).orderBy(DATE).collect()]  # a calendar at most
        if lost:
            self.write(name, make(lost))
        return self.load_dates(name, [r[0] for r in wanted.select(DATE).distinct().collect()])

    def upsert(self, name: str, rows: DataFrame, replace_series: bool = False) -> None:
        """Puts columns into the stored wide table: of rows with new values those cells, all other cells stay.

        With `replace_series` a written column is new for the whole date: cells that
        `rows` lacks become null. Values are kept as 32-bit floats. Only the
        dates that `rows` holds are read and written again.
        """
        keys = self.datasets[name].keys
        narrow = rows.select(*[F.col(c).cast("float") if t == "double" and c not in keys else F.col(c) for c, t in rows.dtypes])
        dates = [r[0] for r in narrow.select(DATE).distinct().collect()]  # a calendar at most
        try:
            old = self.load_dates(name, dates)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            old = None
        if old is not None:
            if replace_series:
                old = old.drop(*[c for c in narrow.columns if c not in keys])
            narrow = merge_columns(old, narrow, keys)
        # the result is written beside the table first, as it reads what it replaces
        staged = f"{self.path(name)}__staged"
        narrow.write.mode("overwrite").parquet(staged)
        self.write(name, self.spark.read.parquet(staged))
        self._delete(staged)

    def remove_columns(self, name: str, columns: Sequence[str]) -> None:
        """The table in place without some columns; keys can't go."""
        if kept := [c for c in columns if c in self.datasets[name].keys]:
            raise ValueError(f"keys can't be removed: {kept}")
        staged = f"{self.path(name)}__staged"
        self.whole(name).drop(*columns).write.mode("overwrite").parquet(staged)
        self.write(name, self.spark.read.parquet(staged))
        self._delete(staged)

    def _delete(self, path: str) -> None:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(held, True)

    def write_reports(self, name: str, factor_id: str, tables: dict[str, DataFrame]) -> None:
        """A backtest's tables, each below its name in a folder of the factor; a factor's earlier results are replaced."""
        for kind, rows in tables.items():
            rows.withColumn("factor_id", F.lit(factor_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor_id").parquet(f"{self.path(name)}/{kind}")


def paired(manual: DataFrame, generated: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two files of factors as one table: the union of their keys; a column that both have is the manual file's."""
    own = [c for c in generated.columns if c not in manual.columns]
    return manual.join(generated.select(*keys, *own), list(keys), "full")
