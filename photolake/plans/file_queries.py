"""Container, backup and pixel queries over data that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cut import settle
from ..functions.paths import work_path
from ..operators import containers, pixels, planning
from ..sources import backups, files
from . import fixtures as fx
from .registry import query


def _sized(body, extra: int = 2):
    """A JPEG segment's length and body."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body) + extra), 4, "0")), body)


def _hex(text: str):
    return F.unhex(F.lit(text))


#: The most bytes that a segment's two bytes of length leave for its body.
_MOST = 65533


def jpegs(docs):
    """A JPEG around each document: kept and dropped segments, padding, a scan; all of the text's bytes in as
    many APP1 segments as they need, one at least; every ninth is cut."""
    text, lang = F.coalesce("text", F.lit("")).cast("binary"), F.col("lang").cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(text) - 1, F.lit(0)), F.lit(_MOST))
    parts = F.transform(starts, lambda k: F.hex(F.concat(_hex("FFE1"), _sized(F.substring(text, k + 1, F.lit(_MOST))))))
    whole = F.concat(
        _hex("FFD8FFE000044A46"), F.unhex(F.array_join(parts, "")), _hex("FFFFED"), _sized(lang), _hex("FFDB00040102"), _hex("FFFE"), _sized(lang), _hex("FFDA"), lang, _hex("FFD9")
    )
    return docs.select(F.col("doc_id").alias("photo_id"), F.lit("").alias("mime"), F.when(F.col("doc_id") % 9 == 4, F.substring(whole, 1, 11)).otherwise(whole).alias("content"))


_WHOLE = f"d AS (SELECT *, strlen(coalesce(text, '')) AS t, greatest(1, (strlen(coalesce(text, '')) + {_MOST} - 1) // {_MOST}) AS n, strlen(lang) AS l FROM documents)"


@query(
    "m10_m14_scrub_jpeg",
    f"""WITH {_WHOLE} SELECT doc_id AS photo_id, CASE WHEN doc_id % 9 = 4 THEN 'unsupported' ELSE 'lossless' END AS mode, CASE WHEN doc_id % 9 = 4 THEN 0 ELSE 4*n + t + 5 + l + 4 + l END AS removed_bytes,
  CASE WHEN doc_id % 9 <> 4 THEN md5(unhex('FFD8FFE000044A46FFDB00040102FFDA') || encode(lang) || unhex('FFD9')) END AS digest FROM d""",
)
def m14(spark, sf_dir):
    done = containers.scrub(jpegs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("photo_id", "mode", "removed_bytes", F.when(F.col("mode") == "lossless", F.md5("content")).alias("digest"))


@query(
    "m9_segments",
    f"""WITH {_WHOLE}, s AS (SELECT *, unnest(range(0, n + 6)) AS seq FROM d WHERE doc_id % 9 <> 4), k AS (SELECT *, CASE WHEN seq < 2 THEN seq WHEN seq < n + 2 THEN 2 ELSE seq - n + 1 END AS k FROM s)
 SELECT doc_id AS photo_id, CAST(seq AS INT) AS seq, ['SOI','E0','E1','ED','DB','FE','SCAN'][k + 1] AS kind, [2, 6, 4 + least({_MOST}, t - (seq - 2)*{_MOST}), 5+l, 6, 4+l, 4+l][k + 1] AS len, [true,true,false,false,true,false,true][k + 1] AS keep FROM k""",
)
def m9(spark, sf_dir):
    found = containers.container_segments(jpegs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("photo_id", "seq", "kind", (F.col("end") - F.col("start")).alias("len"), "keep")


def webps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang, source = F.col("lang").cast("binary"), F.col("source").cast("binary")

    def chunk(kind: str, body):
        n = F.octet_length(body)
        size = F.unhex(F.concat(F.lpad(F.hex(n), 2, "0"), F.lit("000000")))
        return F.concat(F.lit(kind.encode()), size, body, F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))

    body = F.concat(chunk("VP8X", F.unhex(F.lit("2C000000000000000000"))), chunk("VP8L", source), F.when(F.col("doc_id") % 3 > 0, F.concat(chunk("EXIF", source), chunk("XMP ", lang))).otherwise(F.unhex(F.lit(""))))
    size = F.unhex(F.concat(F.lpad(F.hex(F.octet_length(body) + 4), 2, "0"), F.lit("000000")))
    return docs.select(F.col("doc_id").alias("photo_id"), F.lit("image/webp").alias("mime"), F.concat(F.lit(b"RIFF"), size, F.lit(b"WEBP"), body).alias("content"))


_PAD = "(strlen({0}) + strlen({0}) % 2)"
_S, _L = _PAD.format("source"), _PAD.format("lang")


@query(
    "m12_scrub_webp",
    f"""SELECT doc_id AS photo_id, CASE WHEN doc_id % 3 > 0 THEN 16 + {_S} + {_L} ELSE 0 END AS removed_bytes,
  md5(encode('RIFF') || unhex(concat(lpad(hex(4 + 18 + 8 + {_S}), 2, '0'), '000000')) || encode('WEBPVP8X') || unhex(concat('0A000000', CASE WHEN doc_id % 3 > 0 THEN '20' ELSE '2C' END, '000000000000000000'))
   || encode('VP8L') || unhex(concat(lpad(hex(strlen(source)), 2, '0'), '000000')) || encode(source) || unhex(CASE WHEN strlen(source) % 2 = 1 THEN '00' ELSE '' END)) AS digest FROM documents""",
)
def m12(spark, sf_dir):
    return containers.scrub(webps(spark, sf_dir)).select("photo_id", "removed_bytes", F.md5("content").alias("digest"))


@query(
    "m1_read_tags",
    """SELECT doc_id AS photo_id, 'Make' AS tag, upper(lang) AS value FROM documents UNION ALL SELECT doc_id, 'Orientation', CAST(1 + doc_id % 8 AS VARCHAR) FROM documents
 UNION ALL SELECT doc_id, 'latitude', CAST(-CAST(doc_id % 90 AS DOUBLE) AS VARCHAR) FROM documents UNION ALL SELECT doc_id, 'longitude', CAST(CAST(doc_id % 180 AS DOUBLE) AS VARCHAR) FROM documents""",
)
def m1(spark, sf_dir):
    """TIFF blocks with make, orientation and a place, in JPEG files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    le = lambda n, width: F.unhex(F.concat(F.lpad(F.hex(n), 2, "0"), F.lit("00" * (width - 1))))
    degrees = lambda n: F.concat(le(n, 4), F.unhex(F.lit("01000000" + "0000000001000000" * 2)))
    gps_at = 8 + 2 + 3 * 12 + 4
    tiff = F.concat(
        F.unhex(F.lit("49492A0008000000" + "0300" + "0F01020003000000")), F.upper("lang").cast("binary"), F.unhex(F.lit("0000")),
        F.unhex(F.lit("1201030001000000")), le(1 + F.col("doc_id") % 8, 4), F.unhex(F.lit("2588040001000000" + f"{gps_at:02X}000000" + "00000000")),
        F.unhex(F.lit("0400" + "0100020002000000" + "53000000" + "0200050003000000" + f"{gps_at + 54:02X}000000" + "0300020002000000" + "45000000" + "0400050003000000" + f"{gps_at + 78:02X}000000" + "00000000")),
        degrees(F.col("doc_id") % 90), degrees(F.col("doc_id") % 180),
    )
    content = F.concat(_hex("FFD8FFE1"), _sized(F.concat(F.lit(b"Exif\0\0"), tiff)), _hex("FFD9"))
    return containers.read_tags(docs.select(F.col("doc_id").alias("photo_id"), content.alias("content")))


_KIND = "CAST(doc_id % 6 AS INT)"


@query(
    "s6_s7_backups",
    f"SELECT doc_id AS photo_id, CASE {_KIND} WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not a backup' WHEN 3 THEN 'newer version' WHEN 4 THEN 'damaged picture' END AS reason, CASE WHEN {_KIND} IN (0, 5) THEN md5(text) END AS digest, CASE WHEN {_KIND} IN (0, 3, 4, 5) THEN 640.0 END AS width FROM documents",
)
def s6(spark, sf_dir):
    """Backups written as JSON lines, some then broken in each known way, and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.col("text").cast("binary").alias("content"))
    target = F.struct(F.lit(640.0).alias("width"), F.lit(480.0).alias("height"), F.lit("image/png").alias("format"))
    none = F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")
    line = backups.backup_json(F.col("lang"), F.lit(""), F.col("content"), target, none, F.array().cast("array<struct<x:double,y:double,width:double,height:double,fill:string>>"))
    kind = F.col("doc_id") % 6
    broken = (
        F.when(kind == 1, F.concat(F.lit("{"), line))
        .when(kind == 2, F.lit('{"app":"other","image":"AAAA"}'))
        .when(kind == 3, F.replace(line, F.lit('"version":1'), F.lit('"version":2')))
        .when(kind == 4, F.regexp_replace(line, '"image":"[^"]*"', '"image":"***"'))
        .otherwise(line)
    )
    told = backups.parse_backups(docs.select("doc_id", broken.alias("value")))
    good = F.col("reason").isNull()
    return told.select(F.col("doc_id").alias("photo_id"), "reason", F.when(good, F.md5("content")).alias("digest"), F.when(kind.isin(0, 3, 4, 5), F.col("b.target.width")).alias("width"))


@query(
    "r13_validate_recipe",
    """WITH d AS (SELECT doc_id, CAST(doc_id*997 % 40000 - 100 AS DOUBLE)/2 AS w, CAST(doc_id % 30 - 10 AS DOUBLE)/10 AS q FROM documents)
 SELECT doc_id AS photo_id, CASE WHEN w >= 1 THEN least(16384, CAST(floor(w+0.5) AS BIGINT)) ELSE 77 END AS width, least(1.0, greatest(0.0, q)) AS quality,
  CASE WHEN doc_id % 5 = 0 THEN 'image/jpeg' ELSE 'image/webp' END AS format, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 4 AS DOUBLE) END AS crop_w,
  CASE WHEN doc_id % 4 > 0 THEN least(500, doc_id % 700) ELSE 0 END AS boxes, CASE WHEN doc_id % 4 > 0 AND doc_id % 700 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN '#aBcDeF' ELSE '#000000' END END AS fill FROM d""",
)
def r13(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rect = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), (F.col("doc_id") % 4).cast("double").alias("width"), F.lit(2.0).alias("height"))
    box = F.struct(rect["x"].alias("x"), rect["y"].alias("y"), rect["width"].alias("width"), rect["height"].alias("height"), F.when(F.col("doc_id") % 2 == 0, "#aBcDeF").otherwise("red").alias("fill"))
    rows = docs.select(
        "doc_id", (F.expr("double(doc_id*997 % 40000 - 100)") / 2).alias("width"), F.lit(5.0).alias("height"), (F.expr("double(doc_id % 30 - 10)") / 10).alias("quality"),
        F.when(F.col("doc_id") % 5 == 0, "image/tiff").otherwise("image/webp").alias("format"), rect.alias("crop"),
        F.array_repeat(box, (F.col("doc_id") % 700).cast("int")).alias("boxes"), F.lit(77).alias("fallback_w"), F.lit(78).alias("fallback_h"),
    )
    safe = planning.validate_recipe(rows)
    return safe.select(F.col("doc_id").alias("photo_id"), "width", "quality", "format", F.col("crop.width").alias("crop_w"), F.size("boxes").cast("long").alias("boxes"), F.get("boxes", F.lit(0))["fill"].alias("fill"))


def pictures(spark, sf_dir):
    """Pixels of 8 x 8 grey pictures; every third has its left half transparent."""
    alpha = F.when((F.col("image_id") % 3 == 0) & (F.col("x") < 4), 0).otherwise(255).alias("a")
    side = F.lit(8)
    return fx.view(spark, sf_dir, fx.PIXELS_SPARK).select("image_id", side.alias("width"), side.alias("height"), "x", "y", "r", F.col("r").alias("g"), F.col("r").alias("b"), alpha)


@query(
    "i1_i5_raster_analysis",
    f"""WITH px AS ({fx.PIXELS_DUCK}), edge AS (SELECT image_id, r FROM px WHERE y = 0 UNION ALL SELECT image_id, r FROM px WHERE y = 7 UNION ALL SELECT image_id, r FROM px WHERE x = 0 UNION ALL SELECT image_id, r FROM px WHERE x = 7),
 bg AS (SELECT image_id, list_sort(list(r))[17] AS bg FROM edge GROUP BY image_id),
 c AS (SELECT px.image_id, x, y, bg, CASE WHEN px.image_id % 3 = 0 THEN x >= 4 ELSE abs(r - bg) > 24 END AS content FROM px JOIN bg USING (image_id))
 SELECT image_id, image_id % 3 = 0 AS has_alpha, bg AS bg_r, count(*) FILTER (content) AS content, min(x) FILTER (content) AS box_x, min(y) FILTER (content) AS box_y,
  max(x) FILTER (content) - min(x) FILTER (content) + 1 AS box_w, max(y) FILTER (content) - min(y) FILTER (content) + 1 AS box_h FROM c GROUP BY image_id, bg""",
)
def i5(spark, sf_dir):
    return pixels.analyse(pictures(spark, sf_dir)).select("image_id", "has_alpha", "bg_r", "content", "box_x", "box_y", "box_w", "box_h")


def picture_files(spark, sf_dir):
    """The pictures written as PNG files, read by the image source and made pixels again."""
    path = work_path(spark, "pictures")
    coded = pixels.to_png(pictures(spark, sf_dir))
    files.write_files(coded.select(F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "content"), path)
    read = files.read_rasters(spark, path)
    return pixels.from_rasters(read.withColumn("image_id", F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long")))


@query(
    "s2_i11_picture_files",
    f"SELECT image_id, 8 AS width, 8 AS height, x, y, r, r AS g, r AS b, CASE WHEN image_id % 3 = 0 AND x < 4 THEN 0 ELSE 255 END AS a FROM ({fx.PIXELS_DUCK}) px",
)
def s2(spark, sf_dir):
    return picture_files(spark, sf_dir).select("image_id", "width", "height", "x", "y", *"rgba")


@query(
    "s2_i5_scan_copies",
    f"""WITH px AS (SELECT image_id, x // 2 AS x, y // 2 AS y, floor(avg(r) + 0.5) AS r FROM ({fx.PIXELS_DUCK}) z GROUP BY ALL),
 edge AS (SELECT image_id, r FROM px WHERE y = 0 UNION ALL SELECT image_id, r FROM px WHERE y = 3 UNION ALL SELECT image_id, r FROM px WHERE x = 0 UNION ALL SELECT image_id, r FROM px WHERE x = 3),
 bg AS (SELECT image_id, list_sort(list(r))[9] AS bg FROM edge GROUP BY image_id),
 c AS (SELECT px.image_id, x, y, bg, CASE WHEN px.image_id % 3 = 0 THEN x >= 2 ELSE abs(r - bg) > 24 END AS content FROM px JOIN bg USING (image_id))
 SELECT image_id, image_id % 3 = 0 AS has_alpha, CAST(bg AS INT) AS bg_r, count(*) FILTER (content) AS content, 2 * min(x) FILTER (content) AS box_x, 2 * min(y) FILTER (content) AS box_y,
  2 * (max(x) FILTER (content) - min(x) FILTER (content) + 1) AS box_w, 2 * (max(y) FILTER (content) - min(y) FILTER (content) + 1) AS box_h FROM c GROUP BY image_id, bg""",
)
def s2_i5(spark, sf_dir):
    """Content boxes of picture files, found in copies of half their size. The files are opened once."""
    found = pixels.analyse(settle(picture_files(spark, sf_dir)), longest=4, alpha_longest=8)
    return found.select("image_id", "has_alpha", "bg_r", "content", "box_x", "box_y", "box_w", "box_h")


@query(
    "i4_part_labels",
    f"""WITH RECURSIVE px AS ({fx.PIXELS_DUCK}), edge AS (SELECT image_id, r FROM px WHERE y = 0 UNION ALL SELECT image_id, r FROM px WHERE y = 7 UNION ALL SELECT image_id, r FROM px WHERE x = 0 UNION ALL SELECT image_id, r FROM px WHERE x = 7),
 bg AS (SELECT image_id, list_sort(list(r))[17] AS bg FROM edge GROUP BY image_id),
 c AS (SELECT px.image_id, x, y, y * 8 + x AS k FROM px JOIN bg USING (image_id) WHERE CASE WHEN px.image_id % 3 = 0 THEN x >= 4 ELSE abs(r - bg) > 24 END),
 link AS (SELECT a.image_id, a.k, b.k AS other FROM c a JOIN c b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
 reach AS (SELECT image_id, k, k AS label FROM c UNION SELECT link.image_id, link.other, reach.label FROM reach JOIN link ON link.image_id = reach.image_id AND link.k = reach.k),
 own AS (SELECT image_id, k, min(label) AS label FROM reach GROUP BY ALL)
 SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM own JOIN c USING (image_id, k) GROUP BY image_id, label""",
)
def i4_parts(spark, sf_dir):
    """Every component's box and size, labelled in tiles of 3 pixels a side and put together."""
    return pixels.content_blobs(pixels.content_mask(pictures(spark, sf_dir)), tile=3).select("image_id", "x0", "y0", "x1", "y1", "n")


@query("i4_content_blobs")
def i4(spark, sf_dir):
    """Numbers of 8-connected components; tested against a flood fill."""
    return pixels.analyse(pictures(spark, sf_dir)).select("image_id", "blobs")


_GREY = f"px AS (SELECT *, CASE WHEN image_id % 3 = 0 AND x < 4 THEN 0 ELSE 255 END AS a FROM ({fx.PIXELS_DUCK}))"


@query(
    "i6_i11_process",
    f"""WITH {_GREY}, p AS (SELECT image_id, CASE WHEN image_id % 4 = 1 THEN x ELSE x // 2 END AS x, y // 2 AS y, floor(avg(r) + 0.5) AS r, floor(avg(a) + 0.5) AS a FROM px WHERE image_id % 2 = 1 OR x < 4 GROUP BY ALL),
 k AS (SELECT *, CASE WHEN image_id % 3 = 1 AND y = 1 AND x < 2 THEN 2 WHEN y = 1 AND x IN (1, 2) THEN 1 ELSE 0 END AS box FROM p),
 c AS (SELECT image_id, x, y, box, CASE WHEN box > 0 THEN 255 ELSE a END AS a, [r, 255, 10][box + 1] AS r, [r, 0, 11][box + 1] AS g, [r, 0, 12][box + 1] AS b FROM k),
 f AS (SELECT *, image_id % 3 = 0 AND a = 0 AS clear FROM c)
 SELECT image_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(CASE WHEN clear THEN 255 ELSE r END AS INT) AS r, CAST(CASE WHEN clear THEN 255 ELSE g END AS INT) AS g, CAST(CASE WHEN clear THEN 255 ELSE b END AS INT) AS b,
  CAST(CASE WHEN image_id % 3 = 0 THEN 255 ELSE a END AS INT) AS a FROM f""",
)
def i11(spark, sf_dir):
    """Crops, sizes, boxes (the second over the first) and grounds that differ from picture to picture."""
    of = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"))
    kind = F.col("image_id") % 4
    half = F.struct(F.lit(0).alias("cx"), F.lit(0).alias("cy"), F.lit(4).alias("cw"), F.lit(8).alias("ch"))
    plan = of.select(
        "image_id", F.when(kind % 2 == 0, half).alias("crop"), F.when(kind % 2 == 0, 2).when(kind == 1, 8).otherwise(4).alias("out_w"), F.lit(4).alias("out_h"),
        F.when(F.col("image_id") % 3 == 0, "#ffffff").alias("fill"),
    )

    def box(ord_, x, fill):
        return F.struct(F.lit(ord_).alias("ord"), F.lit(x).alias("bx"), F.lit(1).alias("by"), F.lit(2).alias("bw"), F.lit(1).alias("bh"), F.lit(fill).alias("fill"))

    both = F.array(box(1, 1, "#ff0000"), box(2, 0, "#0a0b0c"))
    boxes = of.select("image_id", F.explode(F.when(F.col("image_id") % 3 == 1, both).otherwise(F.slice(both, 1, 1))).alias("k")).select("image_id", "k.*")
    return pixels.process(pictures(spark, sf_dir), plan, boxes).select("image_id", "x", "y", "r", "g", "b", "a")


@query(
    "i9_redact_faces",
    f"""WITH {_GREY}, m AS (SELECT image_id, x // 2 AS bx, y // 4 AS by_, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(a) + 0.5) AS INT) AS a FROM px WHERE x < 4 GROUP BY ALL)
 SELECT px.image_id, x, y, CASE WHEN x < 4 AND (x + y) % 2 = 0 THEN m.r ELSE px.r END AS r, CASE WHEN x < 4 AND (x + y) % 2 = 0 THEN m.a ELSE px.a END AS a FROM px LEFT JOIN m ON m.image_id = px.image_id AND x // 2 = bx AND y // 4 = by_""",
)
def i9(spark, sf_dir):
    """Faces of 4 x 8 pixels in 2 x 2 blocks, shown through a chequered stencil."""
    whole = pictures(spark, sf_dir)
    n = lambda v, name: F.lit(v).alias(name)
    faces = whole.select("image_id").distinct().select("image_id", n(0, "face_no"), n(0, "bx"), n(0, "by"), n(4, "bw"), n(8, "bh"), n(2, "tw"), n(2, "th"))
    stencil = whole.filter((F.col("x") + F.col("y")) % 2 == 0).select("image_id", "x", "y")
    return pixels.redact_faces(whole, faces, "pixels", stencil).select("image_id", "x", "y", "r", "a")


@query(
    "i10_draw_collages",
    f"""WITH {_GREY}, h AS (SELECT image_id, x, y, CASE WHEN x IN (2, 3) AND y IN (2, 3) THEN 0 ELSE r END AS r, CASE WHEN x IN (2, 3) AND y IN (2, 3) THEN 255 ELSE a END AS a FROM px),
 d AS (SELECT image_id, x // 2 AS x, y // 2 AS y, floor(avg(r) + 0.5) AS r, floor(avg(a) + 0.5) AS a FROM h GROUP BY ALL),
 ink AS (SELECT image_id // 2 AS collage_id, (image_id % 2)*5 - 1 + x AS x, y, CASE WHEN a = 0 THEN 255 ELSE r END AS r FROM d WHERE x > 0),
 grid AS (SELECT DISTINCT image_id // 2 AS collage_id, gx.x, gy.y FROM px, range(9) gx(x), range(4) gy(y))
 SELECT collage_id, g.x, g.y, CAST(coalesce(r, 255) AS INT) AS r FROM grid g LEFT JOIN ink USING (collage_id, x, y)""",
)
def i10(spark, sf_dir):
    """Two pictures side by side, each drawn a pixel to the left of its space, with a hidden corner."""
    whole = pictures(spark, sf_dir)
    left = ((F.col("image_id") % 2) * 5).cast("int")
    n = lambda v, name: F.lit(v).alias(name)
    each = whole.select("image_id").distinct()
    placed = each.select(
        F.floor(F.col("image_id") / 2).alias("collage_id"), (F.col("image_id") % 2).alias("slot_no"), "image_id", n(9, "canvas_w"), n(4, "canvas_h"), left.alias("x"), n(0, "y"), n(4, "w"), n(4, "h"),
        (left - 1).alias("draw_x"), n(0, "draw_y"), n(4, "draw_w"), n(4, "draw_h"),
    )
    boxes = each.select("image_id", n(0, "ord"), n(2, "bx"), n(2, "by"), n(2, "bw"), n(2, "bh"), n("#000000", "fill"))
    return pixels.draw_collages(whole, placed, boxes).select(F.col("image_id").alias("collage_id"), "x", "y", "r")


@query(
    "s1_photo_files",
    "SELECT concat('IMG ', CAST(doc_id AS VARCHAR), '.', CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'JPG' WHEN 1 THEN 'heic' ELSE 'txt' END) AS name, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/heic' ELSE '' END AS mime, strlen(text) AS bytes, md5(text) AS digest FROM documents",
)
def s1(spark, sf_dir):
    """Every text as a file, and all files read as photos."""
    path, docs = work_path(spark, "photos"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    ending = F.when(F.col("doc_id") % 3 == 0, "JPG").when(F.col("doc_id") % 3 == 1, "heic").otherwise("txt")
    files.write_files(docs.select(F.concat(F.lit("IMG "), F.col("doc_id").cast("string"), F.lit("."), ending).alias("name"), F.col("text").cast("binary").alias("content")), path)
    return files.read_photos(spark, path).select("name", "mime", "bytes", F.md5("content").alias("digest"))
