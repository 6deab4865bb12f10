"""What a photo's tags say, which of it identifies someone, and how much of that a library holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags shown as fields of their own, in order: tag, label, identifying.
FIELDS = [
    ("DateTimeOriginal", "Date taken", True),
    ("CreateDate", "Date created", True),
    ("ModifyDate", "Date modified", True),
    ("LensModel", "Lens", False),
    ("SerialNumber", "Camera serial number", True),
    ("BodySerialNumber", "Camera serial number", True),
    ("LensSerialNumber", "Lens serial number", True),
    ("Software", "Software", True),
    ("HostComputer", "Computer", True),
    ("Artist", "Artist", True),
    ("Copyright", "Copyright", True),
    ("OwnerName", "Owner", True),
    ("CameraOwnerName", "Camera owner", True),
    ("creator", "Creator (XMP)", True),
    ("byline", "By-line (IPTC)", True),
    ("credit", "Credit (IPTC)", True),
    ("city", "City (IPTC)", True),
    ("country", "Country (IPTC)", True),
    ("Author", "Author", True),
    ("ImageDescription", "Description", False),
    ("Description", "Description", False),
    ("UserComment", "Comment", False),
    ("Comment", "Comment", False),
    ("Orientation", "Orientation", False),
]
#: Keys that an image header gives even where there is no metadata.
STRUCTURAL = ["ImageWidth", "ImageHeight", "BitDepth", "ColorType", "Compression", "Filter", "Interlace", "ColorComponents", "Precision"]
#: Where the preview that is kept in a file begins, and its bytes: told apart, not as tags.
THUMBNAIL = ["ThumbnailOffset", "ThumbnailLength"]
LONGEST = 180
#: Registers of a distinct-count sketch, as a power of two; its standard error is 1.04 / sqrt(2 ** 12), 1.6 %.
SKETCH_BITS, SKETCH_ERROR = 12, 1.04 / 64


def to_text(value: Column) -> Column:
    """Trimmed; blank is null; after 180 code points an ellipsis."""
    trimmed = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return F.when(F.length(trimmed) > LONGEST, F.concat(F.left(trimmed, F.lit(LONGEST)), F.lit("…"))).when(trimmed != "", trimmed)


def list_to_text(values: Column) -> Column:
    """The parts of an array that have a text, joined."""
    parts = F.filter(F.transform(values, to_text), lambda t: t.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))


def tag_maps(tags: DataFrame) -> DataFrame:
    """One row a photo: tags as a map of texts and of numbers; of a repeated tag the least text. The only
    shuffle of a report."""
    some = tags.withColumn("text", to_text(F.col("value"))).filter("text is not null")
    entry = F.struct("tag", F.struct("text", F.col("value").try_cast("double").alias("num")).alias("told"))
    each = some.groupBy("photo_id").agg(F.array_sort(F.collect_set(entry)).alias("all"))
    first = F.filter("all", lambda e, k: (k == 0) | (e["tag"] != F.get("all", k - 1)["tag"]))
    return each.select("photo_id", F.map_from_entries(first).alias("tags"))


def _text(tag: str) -> Column:
    return F.col("tags")[tag]["text"]


def _gps() -> Column:
    lat, lon = F.col("tags")["latitude"]["num"], F.col("tags")["longitude"]["num"]
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def camera_field(make: Column, model: Column) -> Column:
    """The model alone if it starts with the make, else what there is of both."""
    both = F.concat_ws(" ", make, model)
    return F.when(make.isNotNull() & model.isNotNull() & model.startswith(make), model).when(both != "", both)


def report_columns(maps: DataFrame) -> DataFrame:
    """photo_id, gps, camera, fields (key, label, value, identifying), other_count, has_thumbnail.

    Column expressions over the map: the first spec of a label that has a value gives its field.
    """
    rows = []
    for label in dict.fromkeys(f[1] for f in FIELDS):
        specs = [f for f in FIELDS if f[1] == label]
        first = F.coalesce(*[F.when(_text(t).isNotNull(), F.struct(F.lit(t).alias("key"), _text(t).alias("value"))) for t, _, _ in specs])
        rows.append(F.struct(first["key"].alias("key"), F.lit(label).alias("label"), first["value"].alias("value"), F.lit(specs[0][2]).alias("identifying")))
    gps, camera = _gps(), camera_field(_text("Make"), _text("Model"))
    degrees = F.format_string("%.6f, %.6f", gps["lat"], gps["lon"])
    head = [
        F.struct(F.lit("gps").alias("key"), F.lit("Location").alias("label"), degrees.alias("value"), F.lit(True).alias("identifying")),
        F.struct(F.lit("camera").alias("key"), F.lit("Camera").alias("label"), camera.alias("value"), F.lit(False).alias("identifying")),
    ]
    head[0] = F.when(gps.isNotNull(), head[0])
    fields = F.filter(F.array(*head, *rows), lambda f: f.isNotNull() & f["value"].isNotNull())
    ignored = F.array(*[F.lit(t) for t in ["latitude", "longitude", "Make", "Model", *STRUCTURAL, *THUMBNAIL, *(f[0] for f in FIELDS)]])
    other = F.size(F.filter(F.map_keys("tags"), lambda t: ~F.array_contains(ignored, t)))
    thumbnail = F.coalesce(F.col("tags")["ThumbnailLength"]["num"] > 0, F.lit(False))
    return maps.select("photo_id", gps.alias("gps"), camera.alias("camera"), fields.alias("fields"), other.alias("other_count"), thumbnail.alias("has_thumbnail"))


def metadata_report(photos: DataFrame, tags: DataFrame) -> DataFrame:
    """One row for each photo; a photo without anything to report has nulls and has_any false."""
    told = report_columns(tag_maps(tags))
    told = told.withColumn("identifying_count", F.size(F.filter("fields", lambda f: f["identifying"])))
    found = photos.select("photo_id").join(told, "photo_id", "left")
    none = F.lit(False)
    any_ = (F.coalesce(F.size("fields"), F.lit(0)) > 0) | (F.coalesce("other_count", F.lit(0)) > 0) | F.coalesce("has_thumbnail", none)
    return found.withColumns({"has_any": any_, "has_thumbnail": F.coalesce("has_thumbnail", none)})


def privacy_audit(report: DataFrame, *keys: str) -> DataFrame:
    """Photos, geotagged photos, photos and fields that could identify someone, photos that carry a
    preview of themselves, per rolled-up keys."""
    return report.rollup(*keys).agg(
        F.count(F.lit(1)).alias("photos"),
        F.count_if(F.col("gps").isNotNull()).alias("geotagged"),
        F.count_if(F.coalesce("identifying_count", F.lit(0)) > 0).alias("identifying_photos"),
        F.sum(F.coalesce("identifying_count", F.lit(0))).alias("identifying_fields"),
        F.count_if("has_thumbnail").alias("thumbnails"),
    )


def field_sketches(report: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, sketch): the photos that carry each field, or a thumbnail, as sketches of distinct
    counts that can be stored and merged with those of other days, however photos overlap."""
    thumbnail = F.when(F.col("has_thumbnail"), F.array(F.lit("Thumbnail"))).otherwise(F.array().cast("array<string>"))
    labels = F.concat(F.coalesce(F.transform("fields", lambda f: f["label"]), F.array().cast("array<string>")), thumbnail)
    each = report.select("photo_id", *keys, F.explode(labels).alias("label"))
    return each.groupBy(*keys, "label").agg(F.hll_sketch_agg("photo_id", F.lit(SKETCH_BITS)).alias("sketch"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of the same keys and label made one, with their estimate of distinct photos."""
    rows = reduce(DataFrame.unionByName, parts)
    keys = [c for c in rows.columns if c != "sketch"]
    return rows.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("photos", F.hll_sketch_estimate("sketch"))


def field_audit(report: DataFrame) -> DataFrame:
    """How many photos carry each field."""
    each = report.select("photo_id", F.explode("fields").alias("f"))
    return each.groupBy("f.label", "f.identifying").agg(F.count(F.lit(1)).alias("photos"))
