"""Numbering the rows of a table in order, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import settle


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0; rows that tie there are numbered in any order.

    Rows are dealt by ranges and numbered within each; a range's first place comes from the sizes of
    those before it, one row each.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = dealt.withColumn("_k", within).join(F.broadcast(bases), "_part")  # one row for each range
    return placed.withColumn(name, F.col("_base") + F.col("_k")).drop("_part", "_k", "_base")
