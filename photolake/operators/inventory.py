"""What came in: images, quarantine, names and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.numbers import rnd


def classify_files(files: DataFrame) -> DataFrame:
    """``files`` with is_image and a quarantine reason (null: good).

    If no file of a batch looks like an image, all are errors; else those that do not are dropped
    without a word (reason 'dropped') and empty images are errors.
    """
    image = names.looks_like_image(F.col("mime"), F.col("name"))
    told = files.withColumn("is_image", image)
    batches = told.groupBy(F.col("batch_id").alias("_batch")).agg(F.bool_or("is_image").alias("_any"))
    reason = (
        F.when(~F.col("_any"), F.lit("Not an image file"))
        .when(~F.col("is_image"), F.lit("dropped"))
        .when(F.col("bytes") == 0, F.lit("The file is empty"))
    )
    return told.join(batches, F.col("batch_id").eqNullSafe(F.col("_batch"))).withColumn("reason", reason).drop("_batch", "_any")


def split_quarantine(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of classify_files."""
    told = classify_files(files)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null and reason <> 'dropped'")


def tidy_reason(files: DataFrame) -> DataFrame:
    """An error text without its file's name, blanks squeezed and dashes trimmed."""
    bare = F.regexp_replace(F.replace(F.col("error"), F.col("name"), F.lit("")), r"\s+", " ")
    trimmed = F.trim(F.regexp_replace(bare, r"^[\s\u2014\u2013-]+|[\s\u2014\u2013-]+$", ""))
    return files.withColumn("error", F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("Could not be decoded")).otherwise(trimmed))


def rename_cascade(photos: DataFrame, renames: DataFrame) -> DataFrame:
    """``photos`` (photo_id, name, derived) under the new names of ``renames`` (photo_id, new_name).

    New names are sanitised; empty and unchanged ones are ignored. The stem changes, extensions stay.
    """
    wanted = renames.select("photo_id", names.sanitise_filename(F.col("new_name")).alias("_new"))
    stem = names.stem_of(F.col("_new"))
    applies = F.col("_new").isNotNull() & (F.col("_new") != "") & (stem != names.stem_of(F.col("name")))
    return (
        photos.join(wanted, "photo_id", "left")
        .withColumn("derived", F.when(applies, names.renamed(F.col("name"), F.col("derived"), stem)).otherwise(F.col("derived")))
        .withColumn("name", F.when(applies, F.concat(stem, names.extension_with_dot(F.col("name")))).otherwise(F.col("name")))
        .drop("_new")
    )


def savings_words(before, after):
    """n% smaller, n% bigger, or about the same size."""
    percent = rnd((1 - after / before.cast("double")) * 100)
    return (
        F.when(percent > 0, F.concat(percent.cast("string"), F.lit("% smaller")))
        .when(percent < 0, F.concat((-percent).cast("string"), F.lit("% bigger")))
        .otherwise(F.lit("about the same size"))
    )


def savings_report(exports: DataFrame, *keys: str) -> DataFrame:
    """Bytes before and after, summed per keys, and what that is in words."""
    totals = exports.groupBy(*keys).agg(F.count(F.lit(1)).alias("photos"), F.sum("bytes_before").alias("before"), F.sum("bytes_after").alias("after"))
    return totals.withColumn("savings", savings_words(F.col("before"), F.col("after")))
