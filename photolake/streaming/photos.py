"""Photos that keep arriving. Every stage is stateless: each file is sniffed, read and, if wanted,
placed on its own, so a slow file never holds back the rest and there is no state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.heads import sniff_format
from ..operators import geo
from ..operators.containers import read_tags
from ..sources.files import _named

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_photos(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return _named(raw)


def stream_inventory(photos: DataFrame) -> DataFrame:
    """Narrow rows for the photos table: no bytes."""
    return photos.select("photo_id", "name", "mime", "bytes", sniff_format(F.col("content")).alias("format"))


def append_library(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends inventory and tags of new files below ``path`` to ``out`` until what is there is done.

    No bytes are kept between the two writes: each reads the batch's files. A batch that is run again
    writes into its own folder anew, so nothing is there twice.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        stream_inventory(batch).write.mode("overwrite").parquet(f"{out}/photos/batch={batch_id}")
        read_tags(batch).write.mode("overwrite").parquet(f"{out}/tags/batch={batch_id}")

    return stream_photos(spark, path).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_located(points: DataFrame, index: geo.Boundaries, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the points (point_id, set_id, lon, lat) of a stream, located, to ``out`` until what is
    there is done: each batch meets the boundaries' tables, which were made once and are broadcast
    while they are small. It goes on from ``checkpoint`` when it is started again, and a batch that
    is run again writes into its own folder anew, so no point is there twice."""

    def save(batch: DataFrame, batch_id: int) -> None:
        geo.locate(batch, index).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return points.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
