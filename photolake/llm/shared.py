"""The folder that driver and executors share, and tables cut out of a plan into it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only a local session may have none; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        base = _own.setdefault(key, tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base.rstrip('/')}/photolake/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage
    that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """The path that ``open`` takes for a shared folder mounted in the file system."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped model files need a mounted shared folder, not {path}")
    return path


def fresh(columns: Iterable[str], *stems: str) -> str | tuple[str, ...]:
    """Names for working columns that none of ``columns`` has (whatever the case)."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out[0] if len(out) == 1 else tuple(out)


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one struct ``row``, so that no working column can meet one of theirs."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
