"""Edit recipes with their picture, one JSON line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

APP, VERSION = "photolake", 1
SCHEMA = (
    "app string, version double, createdAt string, fileName string, fileType string, image string, "
    "target struct<width:double,height:double,aspectLocked:boolean,quality:double,format:string,allowTransparency:boolean>, "
    "crop struct<x:double,y:double,width:double,height:double>, redactBoxes array<struct<x:double,y:double,width:double,height:double,fill:string>>"
)


def parse_backups(lines: DataFrame) -> DataFrame:
    """Lines (value) to recipes with ``content`` and a ``reason`` (null: good). Each way of being bad
    has its own: no JSON, another app or no picture, a newer version, a damaged picture."""
    is_json = F.try_parse_json("value").isNotNull()
    rows = lines.withColumn("b", F.from_json("value", SCHEMA)).withColumn("content", F.try_to_binary("b.image", F.lit("base64")))
    reason = (
        F.when(~is_json, F.lit("not JSON"))
        .when(F.coalesce(F.col("b.app") != APP, F.lit(True)) | F.col("b.image").isNull(), F.lit("not a backup"))
        .when(F.col("b.version") > VERSION, F.lit("newer version"))
        .when(F.col("content").isNull(), F.lit("damaged picture"))
    )
    return rows.withColumn("reason", reason)


def read_backups(spark: SparkSession, path: str) -> DataFrame:
    return parse_backups(spark.read.text(path))


def backup_json(name: Column, mime: Column, content: Column, target: Column, crop: Column, boxes: Column) -> Column:
    fields = F.struct(
        F.lit(APP).alias("app"), F.lit(VERSION).alias("version"), name.alias("fileName"), F.coalesce(F.nullif(mime, F.lit("")), F.lit("image/png")).alias("fileType"),
        F.base64(content).alias("image"), target.alias("target"), crop.alias("crop"), boxes.alias("redactBoxes"),
    )
    return F.to_json(fields)


def write_backups(photos: DataFrame, edits: DataFrame, path: str) -> None:
    """One line a photo: its bytes, target, crop and boxes. ``edits``: photo_id, target, crop,
    boxes; bytes join last."""
    both = edits.join(photos.select("photo_id", "name", "mime", "content"), "photo_id")
    line = backup_json(*[F.col(c) for c in ("name", "mime", "content", "target", "crop", "boxes")])
    both.select(line.alias("value")).write.mode("overwrite").text(path)
