"""Cutting a plan whose result is used more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import shared_base, work_path


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder where one is named: lost executors
    take nothing of it with them, and its size is known to the planner. A local session without that
    folder caches it instead."""
    spark = df.sparkSession
    if not shared_base(spark):
        return df.persist()
    path = work_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``table``, which is settled, marked to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


#: Rows of a task that sorts: few enough to be sorted in memory.
TASK_ROWS = 200_000


def tasks_for(table: DataFrame) -> int:
    """As many tasks as give each about TASK_ROWS rows of ``table``, or one a core if that is more. The rows
    are counted, which for views over Parquet tables reads their footers alone."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))
