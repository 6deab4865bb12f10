"""The state of edits: last write wins, removal and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import sent, settle


def latest_edits(log: DataFrame, photos: DataFrame, defaults: dict) -> DataFrame:
    """One state for each photo: its last entry by (ts, seq), or the defaults.

    ``max_by`` aggregates before the shuffle, so a photo with a long log is no hot spot.
    """
    fields = [c for c in log.columns if c not in ("photo_id", "ts", "seq")]
    last = log.groupBy("photo_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "seq")).alias("last"))
    state = photos.select("photo_id").join(last, "photo_id", "left")
    return state.select("photo_id", *[F.coalesce(F.col(f"last.{c}"), F.lit(defaults.get(c))).alias(c) for c in fields], F.col("last").isNotNull().alias("edited"))


def remove_photos(removed: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Each table without the rows of the removed photos."""
    gone = removed.select("photo_id").distinct()
    return tuple(t.join(gone, "photo_id", "left_anti") for t in tables)


def replace_content(photos: DataFrame, updates: DataFrame) -> DataFrame:
    """Some photos' bytes swapped, ids and order kept; an update without bytes changes nothing.

    Photos without an update pass by with their bytes where the updates' ids are few enough to be
    broadcast; of the others the old bytes are not even read.
    """
    new = updates.filter("content is not null").select("photo_id", F.col("content").alias("_new"))
    ids = sent(settle(new.select("photo_id").distinct()))
    kept = photos.join(ids, "photo_id", "left_anti")
    others = [c for c in photos.columns if c != "content"]
    changed = photos.select(*others).join(ids, "photo_id", "left_semi").join(new, "photo_id").withColumnRenamed("_new", "content")
    return kept.unionByName(changed.select(*photos.columns)).withColumn("bytes", F.octet_length("content").cast("long"))
