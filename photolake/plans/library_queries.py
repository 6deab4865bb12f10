"""Inventory, metadata and privacy queries over the photos and tags of the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import heads, names
from ..functions.cut import settle
from ..functions.numbers import format_bytes
from ..operators import inventory, metadata
from . import fixtures as fx
from .geo_queries import _LOCATED, located
from .registry import query

_PHOTOS = f"photos AS ({fx.PHOTOS})"
_IMAGE = r"(starts_with(mime, 'image/') OR regexp_matches(name, '(?i)\.(jpe?g|png|webp|gif|bmp|tiff?|avif|heic|heif|svg)$'))"


def photos(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.PHOTOS)


@query("p1_looks_like_image", f"WITH {_PHOTOS} SELECT photo_id, {_IMAGE} AS is_image FROM photos")
def p1(spark, sf_dir):
    return photos(spark, sf_dir).select("photo_id", names.looks_like_image(F.col("mime"), F.col("name")).alias("is_image"))


#: File heads derived from photos: each kind by photo_id, with the photo's own length in it.
_KIND = "CAST(photo_id % 8 AS INT)"
_HEADS = {0: "FFD8FFE0", 1: "89504E470D0A1A0A", 2: "52494646AABBCCDD57454250", 3: "00000018" + b"ftypheic".hex() + "00000000" + b"mif1heic".hex(),
          4: "0000001C" + b"ftypmif1".hex() + "00000000" + b"mif1avif".hex(), 5: "00000018" + b"ftypmp42".hex() + "00000000", 6: "00000018" + b"ftyph".hex(), 7: ""}
_HEAD_CASE = f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN unhex('{h}')" for k, h in _HEADS.items()) + " END"
_FORMAT_CASE = f"CASE {_KIND} WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'heic' END"


@query("p2_p3_sniff_format", f"WITH {_PHOTOS} SELECT photo_id, {_FORMAT_CASE} AS format, {_KIND} = 3 AS heic_bytes FROM photos")
def p2(spark, sf_dir):
    rows = photos(spark, sf_dir).withColumn("head", F.concat(F.expr(_HEAD_CASE), F.when(F.col("photo_id") % 8 < 6, F.hex("bytes").cast("binary")).otherwise(F.lit(b""))))
    return rows.select("photo_id", heads.sniff_format(F.col("head")).alias("format"), heads.heic_from_bytes(F.col("head")).alias("heic_bytes"))


@query(
    "p4_is_heic",
    rf"""WITH {_PHOTOS} SELECT photo_id, lower(mime) IN ('image/heic','image/heif','image/heic-sequence','image/heif-sequence') OR regexp_matches(name, '(?i)\.(heic|heif)$') OR {_KIND} = 3 AS is_heic FROM photos""",
)
def p4(spark, sf_dir):
    return photos(spark, sf_dir).select("photo_id", heads.is_heic(F.col("mime"), F.col("name"), F.expr(_HEAD_CASE)).alias("is_heic"))


@query(
    "p5_split_quarantine",
    f"""WITH {_PHOTOS}, f AS (SELECT photo_id, batch_id, {_IMAGE} AS is_image, CASE WHEN photo_id % 11 = 0 THEN 0 ELSE bytes END AS bytes FROM photos WHERE batch_id <> 6 OR NOT {_IMAGE}),
 g AS (SELECT *, bool_or(is_image) OVER (PARTITION BY batch_id) AS any_image FROM f)
 SELECT photo_id, CASE WHEN NOT any_image THEN 'Not an image file' WHEN NOT is_image THEN 'dropped' WHEN bytes = 0 THEN 'The file is empty' END AS reason FROM g""",
)
def p5(spark, sf_dir):
    image = names.looks_like_image(F.col("mime"), F.col("name"))
    files = photos(spark, sf_dir).filter((F.col("batch_id") != 6) | ~image).withColumn("bytes", F.when(F.col("photo_id") % 11 == 0, 0).otherwise(F.col("bytes")))
    return inventory.classify_files(files).select("photo_id", "reason")


_EXT = "CASE WHEN format = 'image/png' THEN 'png' WHEN format = 'image/webp' THEN 'webp' ELSE 'jpg' END"


@query(
    "p6_p7_export_names",
    rf"""WITH {_PHOTOS}, f AS (SELECT *, CASE WHEN mime IN ('image/png','image/webp') THEN mime ELSE 'image/jpeg' END AS format FROM photos)
 SELECT photo_id, format, concat(regexp_replace(name, '\.[^.]*$', ''), '_', width, 'x', height, '.', {_EXT}) AS file_name FROM f""",
)
def p7(spark, sf_dir):
    rows = photos(spark, sf_dir).withColumn("format", names.default_format(F.col("mime")))
    return rows.select("photo_id", "format", names.format_filename(F.col("name"), F.col("width"), F.col("height"), F.col("format")).alias("file_name"))


_ODD = "concat('  ', text, '/\\:*?\"<>|.', source, '.', lang)"


@query(
    "p8_p9_safe_names",
    rf"""WITH d AS (SELECT doc_id AS photo_id, {_ODD} AS name FROM documents)
 SELECT photo_id, left(trim(regexp_replace(name, '[\\/:*?"<>|\x00-\x1F]', '', 'g')), 120) AS clean,
  coalesce(nullif(trim(regexp_replace(lower(regexp_replace(name, '(?s)\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'image') AS slug,
  coalesce(nullif(left(trim(regexp_replace(name, '[\\/\x00-\x1F]', '', 'g')), 200), ''), 'image') AS safe FROM d""",
)
def p8(spark, sf_dir):
    """Names of the whole texts; only the operators cut them."""
    odd = F.concat(F.lit("  "), F.col("text"), F.lit('/\\:*?"<>|.'), F.col("source"), F.lit("."), F.col("lang"))
    name = F.col("name")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("photo_id"), odd.alias("name"))
    return rows.select("photo_id", names.sanitise_filename(name).alias("clean"), names.safe_stem(name).alias("slug"), names.safe_file_name(name).alias("safe"))


_STEM = r"regexp_replace(name, '^(.+)\.[^.]*$', '\1')"


@query(
    "p10_derived_names",
    rf"""WITH {_PHOTOS} SELECT photo_id, concat({_STEM}, '-nobg.png') AS nobg, concat({_STEM}, '-blurred.png') AS blurred,
  CASE WHEN regexp_matches(name, '(?i)\.(heic|heif)$') THEN regexp_replace(name, '(?i)\.(heic|heif)$', '.jpg') ELSE concat(name, '.jpg') END AS heic,
  CASE WHEN regexp_matches(name, '(?i)\.svg$') THEN regexp_replace(name, '(?i)\.svg$', '.png') ELSE concat(name, '.png') END AS svg FROM photos""",
)
def p10(spark, sf_dir):
    return photos(spark, sf_dir).select("photo_id", *[names.derive_name(F.col("name"), k).alias(k) for k in ("nobg", "blurred", "heic", "svg")])


@query(
    "p11_rename_cascade",
    rf"""WITH {_PHOTOS}, r AS (SELECT photo_id, name, concat({_STEM}, '-nobg.png') AS derived, {_STEM} AS stem, regexp_extract(name, '(.)(\.[^.]*)$', 2) AS ext,
  CASE WHEN photo_id % 4 = 0 THEN concat('trip ', photo_id) WHEN photo_id % 4 = 1 THEN ' /// ' WHEN photo_id % 4 = 2 THEN name END AS new_name FROM photos),
 n AS (SELECT *, left(trim(regexp_replace(new_name, '[\\/:*?"<>|\x00-\x1F]', '', 'g')), 120) AS clean FROM r),
 s AS (SELECT *, CASE WHEN clean = '' OR clean IS NULL THEN NULL ELSE regexp_replace(clean, '^(.+)\.[^.]*$', '\1') END AS ns FROM n)
 SELECT photo_id, CASE WHEN ns IS NULL OR ns = stem THEN name ELSE concat(ns, ext) END AS name, CASE WHEN ns IS NULL OR ns = stem THEN derived ELSE concat(ns, '-nobg.png') END AS derived FROM s""",
)
def p11(spark, sf_dir):
    rows = photos(spark, sf_dir).select("photo_id", "name", names.derive_name(F.col("name"), "nobg").alias("derived"))
    k = F.col("photo_id") % 4
    asked = rows.select("photo_id", F.when(k == 0, F.concat(F.lit("trip "), "photo_id")).when(k == 1, F.lit(" /// ")).when(k == 2, F.col("name")).alias("new_name"))
    return inventory.rename_cascade(rows, asked)


_KB = "CAST(floor(bytes/1024.0*10+0.5) AS BIGINT)"
_MB = "CAST(floor(bytes/1048576.0*100+0.5) AS BIGINT)"


@query(
    "p12_format_bytes",
    f"""WITH p AS (SELECT photo_id, bytes*bytes // 400000 AS bytes FROM ({fx.PHOTOS}) x) SELECT photo_id, CASE WHEN bytes < 1024 THEN concat(bytes, ' B')
  WHEN bytes < 1048576 THEN concat({_KB} // 10, '.', {_KB} % 10, ' KB') ELSE concat({_MB} // 100, '.', lpad(CAST({_MB} % 100 AS VARCHAR), 2, '0'), ' MB') END AS size FROM p""",
)
def p12(spark, sf_dir):
    rows = photos(spark, sf_dir).select("photo_id", F.expr("bytes*bytes div 400000").alias("bytes"))
    return rows.select("photo_id", format_bytes(F.col("bytes")).alias("size"))


@query(
    "p13_savings",
    f"""WITH {_PHOTOS}, e AS (SELECT CASE WHEN mime IN ('image/png','image/webp') THEN mime ELSE 'image/jpeg' END AS format, bytes AS b, bytes * (photo_id % 3 + 1) // 2 AS a FROM photos),
 t AS (SELECT format, count(*) AS photos, sum(b) AS before, sum(a) AS after FROM e GROUP BY format), u AS (SELECT *, CAST(floor((1 - after/CAST(before AS DOUBLE))*100+0.5) AS BIGINT) AS pc FROM t)
 SELECT format, photos, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CASE WHEN pc > 0 THEN concat(pc, '% smaller') WHEN pc < 0 THEN concat(-pc, '% bigger') ELSE 'about the same size' END AS savings FROM u""",
)
def p13(spark, sf_dir):
    rows = photos(spark, sf_dir).select(names.default_format(F.col("mime")).alias("format"), F.col("bytes").alias("bytes_before"), F.expr("bytes * (photo_id % 3 + 1) div 2").alias("bytes_after"))
    return inventory.savings_report(rows, "format")


_TEXTED = f"""t0 AS ({fx.TAGS}), t AS (SELECT photo_id, tag, trim(value, E' \\t\\n\\r') AS v FROM t0 WHERE trim(value, E' \\t\\n\\r') <> ''),
 tags AS (SELECT photo_id, tag, CASE WHEN length(v) > 180 THEN concat(left(v, 180), '…') ELSE v END AS text FROM t)"""


@query("m2_tag_texts", f"WITH {_TEXTED} SELECT photo_id, tag, text FROM tags")
def m2(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.TAGS).select("photo_id", "tag", metadata.to_text(F.col("value")).alias("text")).filter("text is not null")


_SPECS = ", ".join(f"({k}, '{t}', '{label}', {str(i).upper()})" for k, (t, label, i) in enumerate(metadata.FIELDS))
_IGNORED = ", ".join(f"'{t}'" for t in ["latitude", "longitude", "Make", "Model", *metadata.STRUCTURAL, *metadata.THUMBNAIL, *(f[0] for f in metadata.FIELDS)])
_WIDE = f"""{_TEXTED}, specs AS (SELECT * FROM (VALUES {_SPECS}) s(ord, tag, label, identifying)),
 named AS (SELECT photo_id, label, min_by(tag, ord) AS key, min_by(text, ord) AS value, bool_or(identifying) AS identifying FROM tags JOIN specs USING (tag) GROUP BY photo_id, label),
 pv AS (SELECT photo_id, max(CASE WHEN tag = 'Make' THEN text END) AS make, max(CASE WHEN tag = 'Model' THEN text END) AS model,
  max(CASE WHEN tag = 'latitude' THEN TRY_CAST(text AS DOUBLE) END) AS lat, max(CASE WHEN tag = 'longitude' THEN TRY_CAST(text AS DOUBLE) END) AS lon,
  count(*) FILTER (tag NOT IN ({_IGNORED})) AS other_count, coalesce(max(CASE WHEN tag = 'ThumbnailLength' THEN TRY_CAST(text AS DOUBLE) END) > 0, false) AS has_thumbnail FROM tags GROUP BY photo_id),
 cam AS (SELECT *, CASE WHEN starts_with(model, make) THEN model ELSE nullif(concat_ws(' ', make, model), '') END AS camera FROM pv),
 fields AS (SELECT photo_id, key, label, value, identifying FROM named
  UNION ALL SELECT photo_id, 'gps', 'Location', printf('%.6f, %.6f', lat, lon), TRUE FROM cam WHERE lat IS NOT NULL AND lon IS NOT NULL
  UNION ALL SELECT photo_id, 'camera', 'Camera', camera, FALSE FROM cam WHERE camera IS NOT NULL)"""


def reports(spark, sf_dir):
    return metadata.metadata_report(photos(spark, sf_dir), fx.view(spark, sf_dir, fx.TAGS))


@query("m3_report_fields", f"WITH {_WIDE} SELECT photo_id, key, label, value, identifying FROM fields")
def m3(spark, sf_dir):
    return reports(spark, sf_dir).select("photo_id", F.explode("fields").alias("f")).select("photo_id", "f.key", "f.label", "f.value", "f.identifying")


@query("m4_gps_field", f"WITH {_WIDE} SELECT photo_id, lat, lon FROM cam WHERE lat IS NOT NULL AND lon IS NOT NULL")
def m4(spark, sf_dir):
    return metadata.report_columns(metadata.tag_maps(fx.view(spark, sf_dir, fx.TAGS))).filter("gps is not null").select("photo_id", "gps.lat", "gps.lon")


@query("m5_camera_field", f"WITH {_WIDE} SELECT photo_id, camera FROM cam")
def m5(spark, sf_dir):
    return metadata.report_columns(metadata.tag_maps(fx.view(spark, sf_dir, fx.TAGS))).select("photo_id", "camera")


@query("m6_other_tags", f"WITH {_WIDE} SELECT photo_id, other_count FROM cam")
def m6(spark, sf_dir):
    return metadata.report_columns(metadata.tag_maps(fx.view(spark, sf_dir, fx.TAGS))).select("photo_id", "other_count")


_REPORT = f"""{_WIDE}, {_PHOTOS}, fc AS (SELECT photo_id, count(*) AS n, count(*) FILTER (identifying) AS identifying_count FROM fields GROUP BY photo_id),
 report AS (SELECT p.photo_id, c.camera, c.lat, c.lon, c.other_count, coalesce(c.has_thumbnail, false) AS has_thumbnail, f.identifying_count, f.n FROM photos p LEFT JOIN cam c ON c.photo_id = p.photo_id LEFT JOIN fc f ON f.photo_id = p.photo_id)"""


@query("m7_metadata_report", f"WITH {_REPORT} SELECT photo_id, other_count, identifying_count, coalesce(n, 0) AS n_fields, has_thumbnail, coalesce(n, 0) > 0 OR coalesce(other_count, 0) > 0 OR has_thumbnail AS has_any FROM report")
def m7(spark, sf_dir):
    return reports(spark, sf_dir).select("photo_id", "other_count", "identifying_count", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"), "has_thumbnail", "has_any")


_AUDIT = "count(*) AS photos, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS geotagged, count(*) FILTER (coalesce(identifying_count, 0) > 0) AS identifying_photos, sum(coalesce(identifying_count, 0))::BIGINT AS identifying_fields, count(*) FILTER (has_thumbnail) AS thumbnails"


@query(
    "m8_privacy_audit",
    f"WITH {_REPORT}, {_LOCATED}, r AS (SELECT report.*, l.country FROM report LEFT JOIN located l ON l.point_id = report.photo_id) SELECT country, camera, {_AUDIT} FROM r GROUP BY ROLLUP (country, camera)",
)
def m8(spark, sf_dir):
    """The flagship: reports and places of all photos, rolled up by country and camera."""
    where = located(spark, sf_dir).select(F.col("point_id").alias("photo_id"), "country")
    return metadata.privacy_audit(reports(spark, sf_dir).join(where, "photo_id", "left"), "country", "camera")


@query(
    "m8_merged_sketches",
    f"""WITH {_REPORT}, {_LOCATED}, labels AS (SELECT photo_id, label FROM fields UNION ALL SELECT photo_id, 'Thumbnail' FROM report WHERE has_thumbnail)
 SELECT l.country, report.camera, label, count(*) AS photos, TRUE AS close FROM labels JOIN report USING (photo_id) LEFT JOIN located l ON l.point_id = labels.photo_id GROUP BY ALL""",
)
def m8_sketches(spark, sf_dir):
    """Photos by country, camera and field from the stored sketches of two days that share photos: each
    estimate is within five standard errors of the exact count beside it."""
    where = located(spark, sf_dir).select(F.col("point_id").alias("photo_id"), "country")
    told = settle(reports(spark, sf_dir).join(where, "photo_id", "left"))
    keys = ["country", "camera"]
    days = [settle(metadata.field_sketches(told.filter(f"photo_id % 3 <> {k}"), *keys)) for k in (0, 1)]
    merged = metadata.merge_sketches(*days).withColumnRenamed("photos", "estimate")
    labels = F.concat(F.transform("fields", lambda f: f["label"]), F.when(F.col("has_thumbnail"), F.array(F.lit("Thumbnail"))).otherwise(F.array().cast("array<string>")))
    exact = told.select(*keys, F.explode(labels).alias("label")).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("photos"))
    same = exact["country"].eqNullSafe(merged["country"]) & exact["camera"].eqNullSafe(merged["camera"]) & (exact["label"] == merged["label"])
    close = F.abs(F.col("photos") - F.col("estimate")) <= F.greatest(F.lit(1.0), F.col("photos") * (5 * metadata.SKETCH_ERROR))
    return exact.join(merged, same, "left").select(exact["country"], exact["camera"], exact["label"], "photos", F.coalesce(close, F.lit(False)).alias("close"))


@query("m8_field_audit", f"WITH {_WIDE} SELECT label, identifying, count(*) AS photos FROM fields GROUP BY label, identifying")
def m8_fields(spark, sf_dir):
    return metadata.field_audit(reports(spark, sf_dir))
