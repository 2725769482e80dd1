"""The dense date-by-instrument panel that factor operators run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def date_key(day: Column) -> Column:
    """A date as the integer YYYYMMDD."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def densify(rows: DataFrame, date: str = "trade_date", code: str = "ts_code") -> DataFrame:
    """Every date by every instrument that `rows` has; `present` marks the cells that have a row.

    The calendar is one row (an array of its dates), so instruments are exploded
    against it and nothing but the final join moves.
    """
    calendar = rows.select(date).distinct().agg(F.sort_array(F.collect_set(date)).alias("_dates"))
    grid = rows.select(code).distinct().crossJoin(F.broadcast(calendar)).select(F.explode("_dates").alias(date), code)
    return grid.join(rows.withColumn("present", F.lit(True)), [date, code], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def trade_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows by supplier from `lineitem`: three numbers with gaps, a group and a weight."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = F.trunc("l_shipdate", "month")
    flag = F.col("l_returnflag")
    return (
        lines.groupBy(date_key(month).alias("trade_date"), F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("ts_code"))
        .agg(
            (F.sum(F.when(flag == "R", F.col("l_quantity"))) / 97).alias("x"),
            (F.round(F.sum(F.when(flag == "A", F.col("l_extendedprice"))), 2) / 99991).alias("y"),
            (F.round(F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_extendedprice") * F.col("l_discount"))), 4) / 9973).alias("z"),
            F.count(F.lit(1)).alias("w"),
            (F.sum("l_quantity").cast("long") % 7).alias("g"),
        )
        .withColumn("grp", F.when(F.col("g") == 6, F.lit(None)).when(F.col("g") == 5, F.lit("")).otherwise(F.concat(F.lit("I"), F.col("g").cast("string"))))
        .drop("g")
    )


def trade_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(trade_cells(spark, sf_dir))


#: The same panel in DuckDB SQL, as leading common table expressions.
PANEL_SQL = r"""
cells as (
  select cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1 as integer) as trade_date, 'S' || lpad(l_suppkey::varchar, 6, '0') as ts_code,
    sum(l_quantity) filter (where l_returnflag = 'R') / 97 as x,
    round(sum(l_extendedprice) filter (where l_returnflag = 'A'), 2) / 99991 as y,
    round(sum(l_extendedprice * l_discount) filter (where l_linenumber <= 3), 4) / 9973 as z,
    count(*) as w, sum(l_quantity)::bigint % 7 as g
  from lineitem group by 1, 2),
named as (
  select trade_date, ts_code, x, y, z, w, case when g = 6 then null when g = 5 then '' else 'I' || g end as grp from cells),
panel as (
  select d.trade_date, c.ts_code, n.x, n.y, n.z, n.w, n.grp, n.ts_code is not null as present
  from (select distinct trade_date from named) d cross join (select distinct ts_code from named) c
  left join named n on n.trade_date = d.trade_date and n.ts_code = c.ts_code)
"""
