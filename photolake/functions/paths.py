"""Where tables and files that a job passes on are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str | None:
    """The folder that ``spark.checkpoint.dir`` names; None in a local session without one. A cluster
    must have one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, or in a temporary folder of a local session without one."""
    base = shared_base(spark) or tempfile.mkdtemp(prefix="spark-work-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
