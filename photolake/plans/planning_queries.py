"""Sizes, crops, redactions, collages, edits and articles over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import work_path
from ..operators import articles, collage, edits, gazetteer, planning, redaction
from ..sources import boundaries
from . import fixtures as fx
from .registry import query

_PHOTOS = f"photos AS ({fx.PHOTOS})"
_RND = "CAST(floor({} + 0.5) AS BIGINT)"


def photos(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.PHOTOS)


_EDGES = f"""{_PHOTOS}, e0 AS (SELECT *, greatest(width, height) AS lg, CASE WHEN mime IN ('image/png','image/webp') THEN mime ELSE 'image/jpeg' END AS format FROM photos),
 e1 AS (SELECT *, greatest(1920, lg) AS l, least(1920, lg) AS m0 FROM e0), e2 AS (SELECT *, least(800, greatest(1, m0 // 2)) AS s0, CASE WHEN m0 >= l THEN greatest(1, CAST(floor(l/1.5) AS INT)) ELSE m0 END AS m FROM e1),
 e3 AS (SELECT *, CASE WHEN s0 >= m THEN greatest(1, m // 2) ELSE s0 END AS s FROM e2),
 sz AS (SELECT photo_id, width, height, format, p.preset, p.edge FROM e3, LATERAL (SELECT unnest(['S','M','L']) AS preset, unnest([s, m, l]) AS edge) p),
 sized AS (SELECT photo_id, format, preset, CASE WHEN width >= height THEN edge ELSE greatest(1, {_RND.format('edge*(width/CAST(height AS DOUBLE))')}) END AS out_w,
  CASE WHEN width >= height THEN greatest(1, {_RND.format('edge/(width/CAST(height AS DOUBLE))')}) ELSE edge END AS out_h FROM sz)"""


@query("r1_size_presets", f"WITH {_EDGES} SELECT photo_id, preset, out_w, out_h FROM sized")
def r1(spark, sf_dir):
    return planning.size_presets(photos(spark, sf_dir))


_LADDER = f"""{_EDGES}, rungs AS (SELECT * FROM (VALUES ('image/png',0,'M',0.85),('image/png',1,'S',0.85),('other',0,'M',0.85),('other',1,'M',0.75),('other',2,'S',0.75)) r(kind, rung, preset, quality)),
 ladder AS (SELECT photo_id, format, rung, out_w, out_h, CAST(quality AS DOUBLE) AS quality FROM sized JOIN rungs USING (preset) WHERE kind = CASE WHEN format = 'image/png' THEN format ELSE 'other' END)"""


@query("r2_opening_ladder", f"WITH {_LADDER} SELECT * FROM ladder")
def r2(spark, sf_dir):
    return planning.opening_ladder(photos(spark, sf_dir))


@query(
    "r3_opening_rung",
    f"""WITH {_LADDER}, est AS (SELECT l.*, l.out_w*l.out_h*(2 + l.photo_id % 7) // 10 AS encoded, p.bytes FROM ladder l JOIN photos p USING (photo_id) WHERE l.photo_id % 5 <> 0)
 SELECT photo_id, coalesce(min(CASE WHEN encoded < bytes THEN rung END), max(rung)) AS rung, CAST(NULL AS BIGINT) AS x FROM est GROUP BY photo_id""".replace(", CAST(NULL AS BIGINT) AS x", ""),
)
def r3(spark, sf_dir):
    rows = photos(spark, sf_dir)
    ladder = planning.opening_ladder(rows)
    est = ladder.join(rows.select("photo_id", F.col("bytes").alias("source_bytes")), "photo_id").select(
        "photo_id", "rung", F.expr("out_w*out_h*(2 + photo_id % 7) div 10").alias("encoded"), "source_bytes", (F.col("photo_id") % 5 == 0).alias("touched")
    )
    return planning.pick_opening_rung(ladder, est).select("photo_id", "rung")


@query("r4_default_target", f"WITH {_EDGES} SELECT photo_id, out_w AS width, out_h AS height, TRUE AS aspect_locked, CAST(0.85 AS DOUBLE) AS quality, format, TRUE AS allow_transparency FROM sized WHERE preset = 'M'")
def r4(spark, sf_dir):
    return planning.default_target(photos(spark, sf_dir))


_PRESETS = ", ".join(f"({k}, '{p[0]}', '{p[2]}', {p[3]}, {p[4]})" for k, p in enumerate(planning.PRESETS))
_COVER = f"""c0 AS (SELECT *, width/(pw/CAST(ph AS DOUBLE)) > height AS tall, pw/CAST(ph AS DOUBLE) AS a FROM pairs),
 c1 AS (SELECT *, greatest(1, {_RND.format('CASE WHEN tall THEN height*a ELSE CAST(width AS DOUBLE) END')}) AS crop_w, greatest(1, {_RND.format('CASE WHEN tall THEN CAST(height AS DOUBLE) ELSE width/a END')}) AS crop_h FROM c0),
 cover AS (SELECT *, greatest(0, {_RND.format('(width-crop_w)/2.0')}) AS crop_x, greatest(0, {_RND.format('(height-crop_h)/2.0')}) AS crop_y FROM c1)"""


@query("r5_r6_social_plan", f"WITH {_PHOTOS}, presets AS (SELECT * FROM (VALUES {_PRESETS}) p(ord, preset_id, platform, pw, ph)), pairs AS (SELECT * FROM photos CROSS JOIN presets), {_COVER} SELECT photo_id, preset_id, pw AS out_w, ph AS out_h, crop_x, crop_y, crop_w, crop_h FROM cover")
def r6(spark, sf_dir):
    return planning.social_plan(photos(spark, sf_dir), planning.presets(spark))


@query("r7_platform_exports", f"WITH {_PHOTOS}, presets AS (SELECT * FROM (VALUES {_PRESETS}) p(ord, preset_id, platform, pw, ph)) SELECT platform, min(ord) AS first, string_agg(preset_id, ',' ORDER BY ord) AS items, (SELECT count(*) FROM photos) * count(*) AS exports FROM presets GROUP BY platform")
def r7(spark, sf_dir):
    table = planning.presets(spark)
    made = planning.social_plan(photos(spark, sf_dir), table).groupBy("preset_id").agg(F.count(F.lit(1)).alias("n"))
    per = table.join(made, "preset_id").groupBy("platform").agg(F.sum("n").alias("exports"))
    return planning.grouped_presets(table).join(per, "platform").select("platform", "first", F.array_join("items", ",").alias("items"), "exports")


_RECT = "photo_id, width, height, (photo_id*37 % 5000 - 300)/2.0 AS x, (photo_id*53 % 4000 - 200)/2.0 AS y, (photo_id*71 % 6000)/2.0 AS w, (photo_id*91 % 3000)/2.0 AS h"
_CLAMP = f"""k0 AS (SELECT *, greatest(1, least({_RND.format('w')}, width)) AS cw, greatest(1, least({_RND.format('h')}, height)) AS ch FROM rect),
 clamped AS (SELECT *, greatest(0, least({_RND.format('x')}, width - cw)) AS cx, greatest(0, least({_RND.format('y')}, height - ch)) AS cy FROM k0)"""


def rects(spark, sf_dir):
    return photos(spark, sf_dir).selectExpr("photo_id", "width", "height", "(photo_id*37 % 5000 - 300)/2.0D AS x", "(photo_id*53 % 4000 - 200)/2.0D AS y", "(photo_id*71 % 6000)/2.0D AS w", "(photo_id*91 % 3000)/2.0D AS h")


def _flat(crop: str = "crop"):
    return [F.col(f"{crop}.{a}").cast("long").alias(b) for a, b in (("x", "cx"), ("y", "cy"), ("width", "cw"), ("height", "ch"))]


@query("r8_clamp_crop", f"WITH {_PHOTOS}, rect AS (SELECT {_RECT} FROM photos), {_CLAMP} SELECT photo_id, cx, cy, cw, ch FROM clamped")
def r8(spark, sf_dir):
    return rects(spark, sf_dir).withColumn("crop", planning.clamp_crop(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])).select("photo_id", *_flat())


@query("r9_centred_crop", f"WITH {_PHOTOS}, s AS (SELECT photo_id, width, height, {_RND.format('width*CAST(0.6 AS DOUBLE)')} AS w, {_RND.format('height*CAST(0.6 AS DOUBLE)')} AS h FROM photos), rect AS (SELECT *, (width-w)/2.0 AS x, (height-h)/2.0 AS y FROM s), {_CLAMP} SELECT photo_id, CASE WHEN photo_id % 4 = 0 THEN 1 ELSE cx END AS cx, CASE WHEN photo_id % 4 = 0 THEN 2 ELSE cy END AS cy, CASE WHEN photo_id % 4 = 0 THEN 3 ELSE cw END AS cw, CASE WHEN photo_id % 4 = 0 THEN 4 ELSE ch END AS ch FROM clamped")
def r9(spark, sf_dir):
    own = F.expr("CASE WHEN photo_id % 4 = 0 THEN named_struct('x', 1L, 'y', 2L, 'width', 3L, 'height', 4L) END")
    return planning.centred_crop(photos(spark, sf_dir).withColumn("crop", own)).select("photo_id", *_flat())


_AUTO = f"""{_PHOTOS}, b AS (SELECT *, x + w/2 AS mx, y + h/2 AS my, width/CAST(height AS DOUBLE) AS a FROM (SELECT photo_id, width, height, CAST(photo_id*37 % width AS DOUBLE) AS x, CAST(photo_id*53 % height AS DOUBLE) AS y, CAST(1 + photo_id*71 % width AS DOUBLE) AS w, CAST(1 + photo_id*91 % height AS DOUBLE) AS h FROM photos) z),
 modes AS (SELECT photo_id, width, height, 'max' AS mode, w, h, mx, my FROM b UNION ALL SELECT photo_id, width, height, 'square', least(greatest(w, h), width, height), least(greatest(w, h), width, height), mx, my FROM b
  UNION ALL SELECT photo_id, width, height, 'ratio', least(width, CASE WHEN w/h > a THEN w ELSE h*a END), least(height, CASE WHEN w/h > a THEN w/a ELSE h END), mx, my FROM b),
 rect AS (SELECT *, mx - w/2 AS x, my - h/2 AS y FROM modes), {_CLAMP}"""


def autocrops(spark, sf_dir):
    boxes = photos(spark, sf_dir).selectExpr("photo_id", "width", "height", "double(photo_id*37 % width) AS box_x", "double(photo_id*53 % height) AS box_y", "double(1 + photo_id*71 % width) AS box_w", "double(1 + photo_id*91 % height) AS box_h")
    parts = [planning.autocrop_rect(boxes, m).withColumn("mode", F.lit(m)) for m in ("max", "square", "ratio")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("r10_autocrop", f"WITH {_AUTO} SELECT photo_id, mode, cx, cy, cw, ch FROM clamped")
def r10(spark, sf_dir):
    return autocrops(spark, sf_dir).select("photo_id", "mode", *_flat())


@query("r11_autocrop_changes", f"WITH {_AUTO} SELECT photo_id, mode FROM clamped WHERE NOT (CASE WHEN photo_id % 3 = 0 THEN TRUE ELSE abs(cx) <= 2 AND abs(cy) <= 2 AND abs(cw - width) <= 2 AND abs(ch - height) <= 2 END)")
def r11(spark, sf_dir):
    pairs = autocrops(spark, sf_dir).withColumn("new", F.col("crop")).withColumn("old", F.when(F.col("photo_id") % 3 == 0, F.col("crop")))
    return planning.autocrop_changes(pairs).select("photo_id", "mode")


_TARGET = {"width": 1200, "height": 627, "locked": True, "social": False, "format": "image/webp", "fill": "#ffffff"}


def plans(spark, sf_dir, **changes):
    own = photos(spark, sf_dir).select("photo_id", F.expr("named_struct('x', 1L, 'y', 2L, 'width', 30L, 'height', 40L)").alias("crop")).filter("photo_id % 7 = 3")
    return planning.batch_plan(photos(spark, sf_dir), own, _TARGET | changes, chosen=3)


_NAME = r"concat(regexp_replace(name, '\.[^.]*$', ''), '_', out_w, 'x', out_h, '.webp')"


@query(
    "r12_batch_plan_locked",
    rf"""WITH {_PHOTOS}, k AS (SELECT *, least(1.0, 1200/CAST(greatest(width, height) AS DOUBLE)) AS k FROM photos),
 o AS (SELECT *, CASE WHEN photo_id = 3 THEN 1200 ELSE greatest(1, {_RND.format('width*k')}) END AS out_w, CASE WHEN photo_id = 3 THEN 627 ELSE greatest(1, {_RND.format('height*k')}) END AS out_h FROM k)
 SELECT photo_id, out_w, out_h, CASE WHEN photo_id = 3 THEN 30 END AS crop_w, CASE WHEN photo_id = 3 THEN '#ffffff' END AS fill, {_NAME} AS file_name FROM o""",
)
def r12(spark, sf_dir):
    return plans(spark, sf_dir).select("photo_id", "out_w", "out_h", F.col("crop.width").alias("crop_w"), "fill", "file_name")


@query(
    "r12_batch_plan_social",
    rf"""WITH {_PHOTOS}, pairs AS (SELECT *, 1200 AS pw, 627 AS ph FROM photos), {_COVER} SELECT photo_id, 1200 AS out_w, 627 AS out_h, CASE WHEN photo_id = 3 THEN 1 ELSE crop_x END AS crop_x, CASE WHEN photo_id = 3 THEN 40 ELSE crop_h END AS crop_h FROM cover""",
)
def r12_social(spark, sf_dir):
    return plans(spark, sf_dir, social=True).select("photo_id", "out_w", "out_h", F.col("crop.x").alias("crop_x"), F.col("crop.height").alias("crop_h"))


@query(
    "s9_export_manifest",
    rf"""WITH {_PHOTOS}, o AS (SELECT *, 64 AS out_w, 64 AS out_h FROM photos), n AS (SELECT photo_id, {_NAME} AS file_name FROM o) SELECT file_name, max(photo_id) AS photo_id, count(*) AS collisions FROM n GROUP BY file_name""",
)
def s9(spark, sf_dir):
    exact = plans(spark, sf_dir, width=64, height=64, locked=False)
    return planning.export_manifest(exact.withColumn("ord", F.col("photo_id")))


_FRAMES = f"frames AS ({fx.FRAMES}), boxes AS ({fx.BOXES})"
_CLAMPED = f"""{_FRAMES}, s AS (SELECT b.*, f.width AS fw, f.height AS fh, greatest(1, least(f.width, b.width)) AS w, greatest(1, least(f.height, b.height)) AS h FROM boxes b JOIN frames f USING (photo_id)),
 clamped AS (SELECT photo_id, ord, box_id, greatest(0, least(fw - w, x)) AS x, greatest(0, least(fh - h, y)) AS y, w AS width, h AS height, fill, fw, fh FROM s WHERE w >= 4 AND h >= 4)"""


def boxes(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.BOXES)


def frames(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.FRAMES)


@query("x1_clamp_boxes", f"WITH {_CLAMPED} SELECT photo_id, ord, x, y, width, height FROM clamped")
def x1(spark, sf_dir):
    return redaction.clamp_boxes(boxes(spark, sf_dir), frames(spark, sf_dir)).select("photo_id", "ord", "x", "y", "width", "height")


@query(
    "x2_output_boxes",
    f"""WITH {_CLAMPED}, o AS (SELECT photo_id, ord, greatest(0, CAST(floor((x-10)*(300/CAST(fw AS DOUBLE))) AS BIGINT)) AS x0, least(300, CAST(ceil((x+width-10)*(300/CAST(fw AS DOUBLE))) AS BIGINT)) AS x1,
  greatest(0, CAST(floor((y-5)*(200/CAST(fh AS DOUBLE))) AS BIGINT)) AS y0, least(200, CAST(ceil((y+height-5)*(200/CAST(fh AS DOUBLE))) AS BIGINT)) AS y1 FROM clamped)
 SELECT photo_id, ord, x0 AS x, y0 AS y, x1-x0 AS width, y1-y0 AS height FROM o WHERE x1 > x0 AND y1 > y0""",
)
def x2(spark, sf_dir):
    cut = redaction.clamp_boxes(boxes(spark, sf_dir), frames(spark, sf_dir))
    plan = frames(spark, sf_dir).select("photo_id", F.lit(10).alias("crop_x"), F.lit(5).alias("crop_y"), F.col("width").alias("crop_w"), F.col("height").alias("crop_h"), F.lit(300).alias("out_w"), F.lit(200).alias("out_h"))
    return redaction.output_boxes(cut, plan).select("photo_id", "ord", "x", "y", "width", "height")


@query("x3_scale_boxes", f"WITH {_FRAMES} SELECT photo_id, ord, round(b.x*(500/CAST(f.width AS DOUBLE)), 6) AS x, round(b.height*(400/CAST(f.height AS DOUBLE)), 6) AS height FROM boxes b JOIN frames f USING (photo_id)")
def x3(spark, sf_dir):
    sizes = frames(spark, sf_dir).select("photo_id", F.col("width").alias("from_w"), F.col("height").alias("from_h"), F.lit(500).alias("to_w"), F.lit(400).alias("to_h"))
    return redaction.scale_boxes(boxes(spark, sf_dir), sizes).select("photo_id", "ord", F.round("x", 6).alias("x"), F.round("height", 6).alias("height"))


_ONE = "concat(box_id, ':', " + ", ',', ".join(_RND.format(c) for c in ("x", "y", "width", "height")) + ", ',', fill)"


@query("x4_signatures", f"WITH boxes AS ({fx.BOXES}) SELECT photo_id, string_agg({_ONE}, '|' ORDER BY ord, {_ONE}) AS signature FROM boxes GROUP BY photo_id")
def x4(spark, sf_dir):
    return redaction.redaction_signature(boxes(spark, sf_dir))


@query("x5_redactions_for", f"WITH boxes AS ({fx.BOXES}), p AS (SELECT o_orderkey*2 AS photo_id FROM orders) SELECT p.photo_id, count(b.ord) AS boxes, coalesce(sum(b.x), 0) AS sum_x FROM p LEFT JOIN boxes b USING (photo_id) GROUP BY p.photo_id")
def x5(spark, sf_dir):
    asked = frames(spark, sf_dir).select((F.col("photo_id") * 2).alias("photo_id"))
    told = redaction.redactions_for(asked, boxes(spark, sf_dir))
    return told.select("photo_id", F.size("boxes").cast("long").alias("boxes"), F.aggregate("boxes.x", F.lit(0.0), lambda a, b: a + b).alias("sum_x"))


_FACES = f"""{_FRAMES}, c AS (SELECT b.photo_id, b.ord, b.enabled, f.width AS fw, f.height AS fh, greatest(0, least(f.width-1, b.x)) AS x, greatest(0, least(f.height-1, b.y)) AS y, b.width AS bw0, b.height AS bh0 FROM boxes b JOIN frames f USING (photo_id)),
 d AS (SELECT *, greatest(1, least(fw-x, bw0)) AS w, greatest(1, least(fh-y, bh0)) AS h FROM c), faces AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY y, x, w, h, ord) - 1 AS face_no FROM d)"""


def faces(spark, sf_dir):
    return redaction.number_faces(boxes(spark, sf_dir).withColumn("det_id", F.col("ord")), frames(spark, sf_dir))


@query("x6_number_faces", f"WITH {_FACES} SELECT photo_id, concat('face-', face_no) AS face_id, x, y, w AS width, h AS height FROM faces")
def x6(spark, sf_dir):
    return faces(spark, sf_dir).select("photo_id", "face_id", "x", "y", "width", "height")


@query(
    "x7_face_regions",
    f"""WITH {_FACES}, r AS (SELECT photo_id, concat('face-', face_no) AS face_id, greatest(0, CAST(floor(x-0.18::DOUBLE*w) AS BIGINT)) AS bx, greatest(0, CAST(floor(y-0.22::DOUBLE*h) AS BIGINT)) AS by_, w, h, fw, fh FROM faces),
 p AS (SELECT *, least(fw-bx, CAST(ceil(w+0.36::DOUBLE*w) AS BIGINT)) AS bw, least(fh-by_, CAST(ceil(h+0.44::DOUBLE*h) AS BIGINT)) AS bh FROM r)
 SELECT photo_id, face_id, bx, by_ AS by, bw, bh, 11 AS tw, greatest(1, {_RND.format('11*bh/CAST(bw AS DOUBLE)')}) AS th FROM p WHERE bw >= 1 AND bh >= 1""",
)
def x7(spark, sf_dir):
    return redaction.face_regions(faces(spark, sf_dir), frames(spark, sf_dir), strength=60)


_COLLAGES = "SELECT o_orderkey AS collage_id, o_orderkey % 11 AS k, CAST(o_orderkey % 7 AS INT) AS shape_no, 400 + o_orderkey % 3000 AS long_edge, CAST(o_orderkey % 5 AS DOUBLE)/100 AS gap_frac FROM orders"
_SHAPE_NAMES = ["fit", *collage.SHAPES]


def collages(spark, sf_dir):
    layouts, shapes = (F.array(*[F.lit(x) for x in names]) for names in (collage.LAYOUTS, _SHAPE_NAMES))
    rows = fx.view(spark, sf_dir, _COLLAGES)
    return rows.withColumns({"layout_id": F.get(layouts, F.col("k").cast("int")), "shape": F.get(shapes, F.col("shape_no"))})


# a grid's areas and gaps, told without the tree: all spaces and gaps tile the canvas
@query(
    "c2_collage_canvas",
    f"""WITH c AS ({_COLLAGES}), r AS (SELECT *, [1.0::DOUBLE, 1.0, 4/5.0::DOUBLE, 9/16.0::DOUBLE, 16/9.0::DOUBLE, 3/2.0::DOUBLE, 2/3.0::DOUBLE][shape_no+1] AS ratio, [2,2,3,3,3,3,4,4,4,6,9][k+1] AS slots FROM c WHERE shape_no <> 0 OR k > 3)
 SELECT collage_id, {_RND.format('CASE WHEN ratio >= 1 THEN long_edge::DOUBLE ELSE long_edge*ratio END')} AS canvas_w, {_RND.format('CASE WHEN ratio >= 1 THEN long_edge/ratio ELSE long_edge::DOUBLE END')} AS canvas_h, slots FROM r""",
)
def c2(spark, sf_dir):
    spaces = collage.collage_grid(collages(spark, sf_dir), collage.layout_catalog(spark))
    return spaces.groupBy("collage_id").agg(F.max("canvas_w").alias("canvas_w"), F.max("canvas_h").alias("canvas_h"), F.count(F.lit(1)).alias("slots"))


@query(
    "c2_collage_grid4",
    f"""WITH c AS ({_COLLAGES}), r AS (SELECT *, [1.0::DOUBLE, 1.0, 4/5.0::DOUBLE, 9/16.0::DOUBLE, 16/9.0::DOUBLE, 3/2.0::DOUBLE, 2/3.0::DOUBLE][shape_no+1] AS ratio, gap_frac*long_edge AS g FROM c),
 s AS (SELECT *, {_RND.format('CASE WHEN ratio >= 1 THEN long_edge::DOUBLE ELSE long_edge*ratio END')} AS cw, {_RND.format('CASE WHEN ratio >= 1 THEN long_edge/ratio ELSE long_edge::DOUBLE END')} AS ch FROM r)
 SELECT collage_id, n AS slot_no, round(g + (n % 2)*((cw-3*g)/2 + g), 6) AS x, round(g + (n // 2)*((ch-3*g)/2 + g), 6) AS y, round((cw-3*g)/2, 6) AS w, round((ch-3*g)/2, 6) AS h FROM s CROSS JOIN (SELECT unnest([0,1,2,3]) AS n) t""",
)
def c2_grid4(spark, sf_dir):
    spaces = collage.collage_grid(collages(spark, sf_dir).withColumn("layout_id", F.lit("grid4")), collage.layout_catalog(spark))
    return spaces.select("collage_id", "slot_no", *[F.round(c, 6).alias(c) for c in "xywh"])


# one side of a space, told without the tree: it starts at a of the room (the canvas without c gaps) and b gaps past the first, and takes p of the room
_SIDES = "('1',0,1,0,1,2),('2a',0,2,0,1,3),('2b',1,2,1,1,3),('3a',0,3,0,1,4),('3b',1,3,1,1,4),('3c',2,3,2,1,4),('La',0,3,0,2,3),('Lb',2,3,1,1,3)"
_SPACES = [
    [("2a", "1"), ("2b", "1")], [("1", "2a"), ("1", "2b")], [("3a", "1"), ("3b", "1"), ("3c", "1")], [("1", "3a"), ("1", "3b"), ("1", "3c")],
    [("La", "1"), ("Lb", "2a"), ("Lb", "2b")], [("1", "La"), ("2a", "Lb"), ("2b", "Lb")], [("2a", "2a"), ("2b", "2a"), ("2a", "2b"), ("2b", "2b")],
    [("La", "1"), ("Lb", "3a"), ("Lb", "3b"), ("Lb", "3c")], [("1", "La"), ("3a", "Lb"), ("3b", "Lb"), ("3c", "Lb")],
    [("3a", "2a"), ("3b", "2a"), ("3c", "2a"), ("3a", "2b"), ("3b", "2b"), ("3c", "2b")],
    [("3a", "3a"), ("3b", "3a"), ("3c", "3a"), ("3a", "3b"), ("3b", "3b"), ("3c", "3b"), ("3a", "3c"), ("3b", "3c"), ("3c", "3c")],
]
_SPACE_ROWS = ", ".join(f"({k}, {n}, '{x}', '{y}')" for k, spaces in enumerate(_SPACES) for n, (x, y) in enumerate(spaces))


@query(
    "c2_collage_spaces",
    f"""WITH c AS ({_COLLAGES}), r AS (SELECT *, [1.0::DOUBLE, 1.0, 4/5.0::DOUBLE, 9/16.0::DOUBLE, 16/9.0::DOUBLE, 3/2.0::DOUBLE, 2/3.0::DOUBLE][shape_no+1] AS ratio, gap_frac*long_edge AS g FROM c WHERE shape_no <> 0 OR k > 3),
 s AS (SELECT *, {_RND.format('CASE WHEN ratio >= 1 THEN long_edge::DOUBLE ELSE long_edge*ratio END')} AS cw, {_RND.format('CASE WHEN ratio >= 1 THEN long_edge/ratio ELSE long_edge::DOUBLE END')} AS ch FROM r),
 sides AS (SELECT side, a, d, b, p, c FROM (VALUES {_SIDES}) v(side, a, d, b, p, c)), spaces AS (SELECT k, slot_no, xs, ys FROM (VALUES {_SPACE_ROWS}) v(k, slot_no, xs, ys))
 SELECT collage_id, slot_no, cw AS canvas_w, ch AS canvas_h, round(g + (cw-h.c*g)*h.a/h.d + h.b*g, 6) AS x, round(g + (ch-v.c*g)*v.a/v.d + v.b*g, 6) AS y, round((cw-h.c*g)*h.p/h.d, 6) AS w, round((ch-v.c*g)*v.p/v.d, 6) AS h
 FROM s JOIN spaces USING (k) JOIN sides h ON h.side = xs JOIN sides v ON v.side = ys""",
)
def c2_spaces(spark, sf_dir):
    """The spaces of all collages and layouts but strips that fit their photos (c3_collage_strip)."""
    spaces = collage.collage_grid(collages(spark, sf_dir), collage.layout_catalog(spark))
    return spaces.select("collage_id", "slot_no", "canvas_w", "canvas_h", *[F.round(c, 6).alias(c) for c in "xywh"])


_STRIP = f"""c AS ({_COLLAGES}), sl AS (SELECT collage_id, n AS slot_no, k IN (0, 2) AS is_row, long_edge::DOUBLE AS l, gap_frac*long_edge AS g, CASE WHEN (collage_id + n) % 9 = 0 THEN 1.0::DOUBLE ELSE (1 + (collage_id*7 + n*13) % 20)/10.0::DOUBLE END AS a
  FROM c CROSS JOIN (SELECT unnest([0,1,2]) AS n) t WHERE k < 4 AND n < CASE WHEN k < 2 THEN 2 ELSE 3 END)"""


def strips(spark, sf_dir):
    rows = collages(spark, sf_dir).filter("k < 4").withColumn("slot_no", F.explode(F.when(F.col("k") < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))))
    aspect = F.when((F.col("collage_id") + F.col("slot_no")) % 9 == 0, F.when(F.col("slot_no") == 0, F.lit(float("nan")))).otherwise((1 + (F.col("collage_id") * 7 + F.col("slot_no") * 13) % 20) / 10)
    return rows.select("collage_id", "slot_no", F.when(F.col("k").isin(0, 2), "row").otherwise("col").alias("strip"), aspect.alias("aspect"), "long_edge", "gap_frac")


@query(
    "c3_collage_strip",
    f"""WITH {_STRIP}, s1 AS (SELECT *, CASE WHEN is_row THEN a ELSE 1/a END AS sh FROM sl), s2 AS (SELECT *, sum(sh) OVER w AS total, count(*) OVER w AS n, coalesce(sum(sh) OVER (PARTITION BY collage_id ORDER BY slot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM s1 WINDOW w AS (PARTITION BY collage_id)),
 s3 AS (SELECT *, (l-(n+1)*g)/total AS i0 FROM s2), s4 AS (SELECT *, i0 + 2*g > l AS thick, CASE WHEN i0 + 2*g > l THEN l - 2*g ELSE i0 END AS i FROM s3)
 SELECT collage_id, slot_no, {_RND.format('CASE WHEN is_row THEN (CASE WHEN thick THEN i*total+(n+1)*g ELSE l END) ELSE (CASE WHEN thick THEN l ELSE i+2*g END) END')} AS canvas_w,
  round(CASE WHEN is_row THEN i*pre+(slot_no+1)*g ELSE g END, 6) AS x, round(CASE WHEN is_row THEN g ELSE i*pre+(slot_no+1)*g END, 6) AS y, round(CASE WHEN is_row THEN i*sh ELSE i END, 6) AS w, round(CASE WHEN is_row THEN i ELSE i*sh END, 6) AS h FROM s4""",
)
def c3(spark, sf_dir):
    return collage.collage_fit_strip(strips(spark, sf_dir)).select("collage_id", "slot_no", "canvas_w", *[F.round(c, 6).alias(c) for c in "xywh"])


_SLOTS = "SELECT o_custkey AS collage_id, CAST(o_orderkey % 9 AS INT) AS slot_no, min(o_orderkey) AS photo_id FROM orders WHERE o_orderkey % 9 < 6 GROUP BY o_custkey, CAST(o_orderkey % 9 AS INT)"
_OPEN = "SELECT o_custkey AS collage_id, o_orderkey AS photo_id, o_orderkey*7919 % 10007 AS ord FROM orders WHERE o_orderkey % 4 <> 0"


@query(
    "c4_fill_slots",
    f"""WITH s AS ({_SLOTS}), p AS (SELECT *, row_number() OVER (PARTITION BY collage_id, ord ORDER BY photo_id) AS d FROM ({_OPEN}) z), live AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM p WHERE p.collage_id = s.collage_id AND p.photo_id = s.photo_id)),
 blank AS (SELECT collage_id, slot_no, row_number() OVER (PARTITION BY collage_id ORDER BY slot_no) AS r FROM s WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.collage_id = s.collage_id AND l.slot_no = s.slot_no)),
 spare AS (SELECT collage_id, photo_id, row_number() OVER (PARTITION BY collage_id ORDER BY ord, photo_id) AS r FROM p WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.collage_id = p.collage_id AND l.photo_id = p.photo_id))
 SELECT collage_id, slot_no, photo_id FROM live UNION ALL SELECT b.collage_id, b.slot_no, sp.photo_id FROM blank b LEFT JOIN spare sp ON sp.collage_id = b.collage_id AND sp.r = b.r""",
)
def c4(spark, sf_dir):
    opened = fx.view(spark, sf_dir, _OPEN)
    return collage.fill_slots(fx.view(spark, sf_dir, _SLOTS), opened.withColumn("ord", F.struct("ord", "photo_id")))


@query(
    "c5_cover_placement",
    f"""WITH b AS (SELECT *, greatest(w/iw, h/ih)*greatest(1.0, zoom) AS s FROM (SELECT photo_id, ord, x, y, width + 10 AS w, height + 10 AS h, 640.0::DOUBLE AS iw, 480.0::DOUBLE AS ih, (ord % 5)/2.0::DOUBLE AS zoom, (ord % 4)/2.0::DOUBLE - 0.5 AS ox, (ord % 3)/2.0::DOUBLE AS oy FROM ({fx.BOXES}) z) q)
 SELECT photo_id, ord, round(iw*s, 6) + 0.0 AS draw_w, round(x+(w-iw*s)*least(1.0, greatest(0.0, ox)), 6) + 0.0 AS draw_x, round(y+(h-ih*s)*least(1.0, greatest(0.0, oy)), 6) + 0.0 AS draw_y FROM b""",
)
def c5(spark, sf_dir):
    rows = boxes(spark, sf_dir).selectExpr("photo_id", "ord", "x", "y", "width + 10 AS w", "height + 10 AS h", "640.0D AS iw", "480.0D AS ih", "(ord % 5)/2.0D AS zoom", "(ord % 4)/2.0D - 0.5D AS ox", "(ord % 3)/2.0D AS oy")
    return collage.cover_placement(rows).select("photo_id", "ord", *[(F.round(c, 6) + 0.0).alias(c) for c in ("draw_w", "draw_x", "draw_y")])


_PEOPLE = "SELECT c_custkey AS photo_id FROM customer"


@query(
    "e1_latest_edits",
    f"""WITH log AS ({fx.EDIT_LOG}), l AS (SELECT photo_id, max_by({{'w': target_w, 'h': target_h, 'f': format}}, (ts, seq)) AS s FROM log GROUP BY photo_id)
 SELECT p.photo_id, coalesce(s.w, 1920) AS target_w, coalesce(s.h, 1080) AS target_h, coalesce(s.f, 'image/jpeg') AS format, s IS NOT NULL AS edited FROM ({_PEOPLE}) p LEFT JOIN l USING (photo_id)""",
)
def e1(spark, sf_dir):
    return edits.latest_edits(fx.view(spark, sf_dir, fx.EDIT_LOG), fx.view(spark, sf_dir, _PEOPLE), {"target_w": 1920, "target_h": 1080, "format": "image/jpeg"})


@query("e2_remove_photos", f"WITH p AS ({fx.FRAMES}), b AS ({fx.BOXES}) SELECT (SELECT count(*) FROM p WHERE photo_id % 6 <> 0) AS photos, (SELECT count(*) FROM b WHERE photo_id NOT IN (SELECT photo_id FROM p WHERE photo_id % 6 = 0)) AS boxes")
def e2(spark, sf_dir):
    gone = frames(spark, sf_dir).filter("photo_id % 6 = 0")
    left, own = edits.remove_photos(gone, frames(spark, sf_dir), boxes(spark, sf_dir))
    return left.agg(F.count(F.lit(1)).alias("photos")).withColumn("k", F.lit(1)).join(own.agg(F.count(F.lit(1)).alias("boxes")).withColumn("k", F.lit(1)), "k").drop("k")


@query("e3_replace_content", "SELECT doc_id AS photo_id, CASE WHEN doc_id % 4 = 1 THEN strlen(lang) ELSE strlen(text) END AS bytes, md5(CASE WHEN doc_id % 4 = 1 THEN lang ELSE text END) AS digest FROM documents")
def e3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("photo_id"), F.col("text").cast("binary").alias("content"))
    updates = docs.filter("doc_id % 4 = 1").select(F.col("doc_id").alias("photo_id"), F.col("lang").cast("binary").alias("content"))
    return edits.replace_content(rows, updates).select("photo_id", "bytes", F.md5("content").alias("digest"))


_ARTICLES = f"articles AS ({fx.ARTICLES})"


def article_rows(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.ARTICLES)


@query("k1_articles_for_language", f"WITH {_ARTICLES}, w AS (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN 'de' WHEN n_nationkey % 3 = 1 THEN 'xx' ELSE 'fr' END AS wanted FROM nation), s AS (SELECT wanted, CASE WHEN EXISTS (SELECT 1 FROM articles a WHERE a.lang = wanted) THEN wanted ELSE 'en' END AS lang FROM w) SELECT wanted, article_id FROM s JOIN articles USING (lang)")
def k1(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("CASE WHEN n_nationkey % 3 = 0 THEN 'de' WHEN n_nationkey % 3 = 1 THEN 'xx' ELSE 'fr' END AS lang")
    return articles.articles_for_language(article_rows(spark, sf_dir), asked).select("wanted", "article_id")


@query("k2_attach_sources", f"WITH {_ARTICLES}, s AS (SELECT l_orderkey % 500 AS article_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord, concat('u', l_partkey) AS url FROM lineitem), t AS (SELECT article_id, count(*) AS n, min(url) AS first_url FROM s GROUP BY article_id) SELECT a.article_id, coalesce(n, 0) AS sources, first_url FROM articles a LEFT JOIN t USING (article_id)")
def k2(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sources = lines.select((F.col("l_orderkey") % 500).alias("article_id"), F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("ord"), F.concat(F.lit("u"), "l_partkey").alias("url"))
    told = articles.attach_sources(article_rows(spark, sf_dir), sources)
    return told.select("article_id", F.size("sources").cast("long").alias("sources"), F.array_min("sources").alias("first_url"))


@query(
    "k2_attach_all_sources",
    f"""WITH {_ARTICLES}, n AS (SELECT count(*) AS n FROM articles), s AS (SELECT l_orderkey % n AS article_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord, concat('u', l_partkey) AS url FROM lineitem CROSS JOIN n),
 t AS (SELECT article_id, count(*) AS n, string_agg(url, ' ' ORDER BY ord) AS urls FROM s GROUP BY article_id) SELECT a.article_id, coalesce(n, 0) AS sources, md5(coalesce(urls, '')) AS digest FROM articles a LEFT JOIN t USING (article_id)""",
)
def k2_all(spark, sf_dir):
    """Every row of lineitem is a source of one of the articles (their ids run from 0), in order."""
    rows = article_rows(spark, sf_dir)
    count = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").crossJoin(count)
    sources = lines.select((F.col("l_orderkey") % F.col("n")).alias("article_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.concat(F.lit("u"), "l_partkey").alias("url"))
    told = articles.attach_sources(rows, sources)
    return told.select("article_id", F.size("sources").cast("long").alias("sources"), F.md5(F.array_join("sources", " ").cast("binary")).alias("digest"))


@query("k3_fold_text", "SELECT doc_id AS article_id, md5(replace(lower(strip_accents(text)), 'ı', 'i')) AS folded FROM documents")
def k3(spark, sf_dir):
    return article_rows(spark, sf_dir).select("article_id", F.md5(articles.fold_text(F.col("body")).cast("binary")).alias("folded"))


_ASKED = [(0, ""), (1, "  The   AND "), (2, "élle"), (3, "Über der"), (4, "nowhere to be found"), (5, "reaux los")]
_FOLD = "replace(lower(strip_accents({})), 'ı', 'i')"
_WORDS = ", ".join(f"({k}, '{q}')" for k, q in _ASKED)


@query(
    "k4_search_all_words",
    f"""WITH {_ARTICLES}, q AS (SELECT query_id, list_filter(string_split_regex({_FOLD.format('t')}, '\\s+'), lambda w: w <> '') AS words FROM (VALUES {_WORDS}) v(query_id, t)),
 h AS (SELECT article_id, {_FOLD.format("concat_ws(' ', title, summary, grp, body)")} AS hay FROM articles)
 SELECT query_id, article_id FROM q CROSS JOIN h WHERE len(list_filter(words, lambda w: NOT contains(hay, w))) = 0""",
)
def k4(spark, sf_dir):
    return articles.search_all_words(article_rows(spark, sf_dir), spark.createDataFrame(_ASKED, "query_id int, text string"))


#: Pieces of parts' names, one or two a query; every fiftieth asks for nothing.
_PART_QUERIES = """SELECT p_partkey AS query_id, CASE WHEN p_partkey % 50 = 7 THEN ' ' WHEN p_partkey % 3 = 0 THEN substr(p_name, CAST(1 + p_partkey % 4 AS INT), CAST(2 + p_partkey % 4 AS INT))
 ELSE concat(substr(p_name, 1, CAST(2 + p_partkey % 3 AS INT)), ' ', upper(substr(p_name, CAST(4 + p_partkey % 5 AS INT), 3))) END AS text FROM part"""


@query(
    "k4_search_part_names",
    f"""WITH {_ARTICLES}, q AS (SELECT query_id, list_filter(string_split_regex({_FOLD.format('text')}, '\\s+'), lambda w: w <> '') AS words FROM ({_PART_QUERIES}) p),
 h AS (SELECT article_id, {_FOLD.format("concat_ws(' ', title, summary, grp, body)")} AS hay FROM articles),
 s AS (SELECT words, article_id FROM (SELECT DISTINCT words FROM q) d CROSS JOIN h WHERE len(list_filter(words, lambda w: NOT contains(hay, w))) = 0)
 SELECT query_id, count(*) AS articles, sum(article_id) AS id_sum, sum(article_id * article_id % 10007) AS id_mix FROM q JOIN s USING (words) GROUP BY query_id""",
)
def k4_parts(spark, sf_dir):
    """As many queries as there are parts, over all articles. Equal ones are searched for and counted once."""
    asked = fx.view(spark, sf_dir, _PART_QUERIES).select("query_id", articles.asked_words(F.col("text")).alias("asked"))
    found = articles.search_asked(article_rows(spark, sf_dir), asked.select("asked"))
    mix = F.sum(F.col("article_id") * F.col("article_id") % 10007)
    told = found.groupBy("asked").agg(F.count(F.lit(1)).alias("articles"), F.sum("article_id").alias("id_sum"), mix.alias("id_mix"))
    return asked.join(told, "asked").select("query_id", "articles", "id_sum", "id_mix")


@query("k5_group_runs", f"WITH {_ARTICLES}, m AS (SELECT *, CASE WHEN lag(grp) OVER w IS NOT DISTINCT FROM grp AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM articles WINDOW w AS (PARTITION BY lang ORDER BY ord)), r AS (SELECT *, sum(st) OVER (PARTITION BY lang ORDER BY ord) AS run FROM m) SELECT lang, CAST(run AS BIGINT) AS run, min(grp) AS grp, min(ord) AS first, count(*) AS n FROM r GROUP BY lang, run")
def k5(spark, sf_dir):
    return articles.group_runs(article_rows(spark, sf_dir))


_BRIDGE = f"""admin0 AS ({fx.ADMIN0}), bridge AS (SELECT a2, coalesce(max_by(a3, ord) FILTER (type <> 'Dependency'), min_by(a3, ord)) AS a3 FROM admin0 WHERE a2 IS NOT NULL AND a2 <> '' AND a2 <> '-99' GROUP BY a2)"""
_CLEAN = f"""{_BRIDGE}, gaz AS ({fx.GAZETTEER}), num AS (SELECT ord, name, a2, CASE WHEN trim(lat) = '' THEN 0 ELSE TRY_CAST(trim(lat) AS DOUBLE) END AS lat, CASE WHEN trim(lon) = '' THEN 0 ELSE TRY_CAST(trim(lon) AS DOUBLE) END AS lon FROM gaz),
 clean AS (SELECT a3 AS code, ord, name, lat, lon FROM num JOIN bridge USING (a2) WHERE name <> '' AND lat IS NOT NULL AND lon IS NOT NULL)"""
_REGIONS = f"admin1 AS ({fx.ADMIN1}), regions AS (SELECT adm0_a3 AS code, ord, coalesce(nullif(name, ''), nullif(name_en, '')) AS name FROM admin1 WHERE adm0_a3 <> '' AND coalesce(nullif(name, ''), nullif(name_en, '')) IS NOT NULL)"


def bridge(spark, sf_dir):
    return gazetteer.bridge_alpha2(fx.view(spark, sf_dir, fx.ADMIN0))


def towns(spark, sf_dir):
    return gazetteer.clean_places(fx.view(spark, sf_dir, fx.GAZETTEER), bridge(spark, sf_dir))


def named_regions(spark, sf_dir):
    return gazetteer.named_regions(fx.view(spark, sf_dir, fx.ADMIN1))


@query("b1_bridge_alpha2", f"WITH {_BRIDGE} SELECT * FROM bridge")
def b1(spark, sf_dir):
    return bridge(spark, sf_dir)


@query("b2_clean_places", f"WITH {_CLEAN} SELECT * FROM clean")
def b2(spark, sf_dir):
    return towns(spark, sf_dir)


@query("b3_regions_by_country", f"WITH {_REGIONS} SELECT code, string_agg(name, '|' ORDER BY ord) AS names FROM regions GROUP BY code")
def b3(spark, sf_dir):
    return gazetteer.regions_by_country(named_regions(spark, sf_dir)).select("code", F.array_join("names", "|").alias("names"))


@query("b4_unmatched_regions", f"WITH {_REGIONS}, {_BRIDGE} SELECT code, count(*) AS regions FROM regions WHERE code NOT IN (SELECT a3 FROM bridge) GROUP BY code")
def b4(spark, sf_dir):
    return gazetteer.unmatched_regions(named_regions(spark, sf_dir), bridge(spark, sf_dir).withColumnRenamed("a3", "code"))


@query("b5_multi_region", f"WITH {_REGIONS} SELECT code, ord, name FROM regions WHERE code IN (SELECT code FROM regions GROUP BY code HAVING count(*) >= 2)")
def b5(spark, sf_dir):
    return gazetteer.keep_multi_region(named_regions(spark, sf_dir))


@query("b6_flatten_polygons", f"WITH vert AS ({fx.VERTICES}) SELECT name_id AS ord, name, CAST(poly_id % 10 AS INT) AS part, min(x)*0.01-180 AS w, min(y)*0.01-90 AS s, max(x)*0.01-180 AS e, max(y)*0.01-90 AS n FROM vert WHERE ring = 0 AND name_id <> 5 AND poly_id <> 243 GROUP BY name_id, name, poly_id")
def b6(spark, sf_dir):
    """Features put together from the polygons' vertices, and taken apart again."""
    return flat_boxes(spark, sf_dir).drop("name_id")


def flat_boxes(spark, sf_dir):
    rows = fx.view(spark, sf_dir, fx.VERTICES).filter("poly_id <> 243")
    points = rows.groupBy("name_id", "name", "poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("v", F.array(F.col("x") * 0.01 - 180, F.col("y") * 0.01 - 90).alias("p")))).alias("p"))
    parts = points.groupBy("name_id", "name", "poly_id").agg(F.array_sort(F.collect_list(F.struct("ring", F.col("p.p").alias("p")))).alias("r"))
    features = parts.groupBy("name_id", "name").agg(F.array_sort(F.collect_list(F.struct("poly_id", F.col("r.p").alias("c")))).alias("f"))
    typed = features.select(F.col("name_id").alias("ord"), "name", F.when(F.col("name_id") == 5, "Point").otherwise("MultiPolygon").alias("type"), F.col("f.c").alias("coordinates"))
    return gazetteer.polygon_boxes(gazetteer.flatten_polygons(typed))


@query("b7_quantise_places", f"WITH {_CLEAN}, t AS (SELECT DISTINCT a3 AS code, length(a3)*0.01::DOUBLE AS scale_x, substr(a3, 3, 1)::INT*0.007::DOUBLE + 0.001 AS scale_y, -180.0::DOUBLE AS tx, -90.0::DOUBLE AS ty FROM bridge) SELECT code, ord, name, CAST(floor((lon-tx)/scale_x+0.5) AS BIGINT) AS qx, CAST(floor((lat-ty)/scale_y+0.5) AS BIGINT) AS qy FROM clean JOIN t USING (code)")
def b7(spark, sf_dir):
    up = F.substring("a3", 3, 1).cast("int") * 0.007 + 0.001
    grid = bridge(spark, sf_dir).select(F.col("a3").alias("code"), (F.length("a3") * 0.01).alias("scale_x"), up.alias("scale_y"), F.lit(-180.0).alias("tx"), F.lit(-90.0).alias("ty")).distinct()
    return gazetteer.quantise_places(towns(spark, sf_dir), grid)


@query("b8_country_codes", f"WITH admin0 AS ({fx.ADMIN0}) SELECT n_name AS name, (SELECT max_by(a3, ord) FROM admin0 WHERE name = CASE WHEN n_name = 'CHINA' THEN 'JAPAN' ELSE n_name END) AS code FROM nation WHERE n_name <> 'BRAZIL'")
def b8(spark, sf_dir):
    world = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))
    return gazetteer.country_codes(world, fx.view(spark, sf_dir, fx.ADMIN0), {"CHINA": "JAPAN"}, dropped=("BRAZIL",))


@query("b9_placeless", f"WITH {_CLEAN}, {_REGIONS} SELECT DISTINCT code FROM regions WHERE code NOT IN (SELECT code FROM clean)")
def b9(spark, sf_dir):
    return gazetteer.placeless_audit(named_regions(spark, sf_dir), towns(spark, sf_dir))


@query("b10_build_totals", f"WITH {_CLEAN}, {_REGIONS} SELECT count(DISTINCT code) AS countries, count(*) AS regions, (SELECT count(*) FROM clean) AS places FROM regions")
def b10(spark, sf_dir):
    return gazetteer.build_totals(named_regions(spark, sf_dir), towns(spark, sf_dir))


@query(
    "b6_name_ids",
    f"WITH vert AS ({fx.VERTICES}), kept AS (SELECT DISTINCT name_id FROM vert WHERE name_id <> 5) SELECT name_id AS ord, CAST(poly_id % 10 AS INT) AS part, (SELECT count(*) FROM kept k WHERE k.name_id < vert.name_id) AS name_id, round(max(x)*0.01-180, 6) AS e FROM vert WHERE ring = 0 AND name_id <> 5 AND poly_id <> 243 GROUP BY name_id, poly_id",
)
def b6_ids(spark, sf_dir):
    """The place of each polygon's feature among those that are kept; one is dropped for its type."""
    return flat_boxes(spark, sf_dir).select("ord", "part", "name_id", F.round("e", 6).alias("e"))


@query("b9_placeless_check", f"WITH {_CLEAN}, {_REGIONS} SELECT count(DISTINCT code) AS placeless, count(DISTINCT code) <= 2 AS sound FROM regions WHERE code NOT IN (SELECT code FROM clean)")
def b9_check(spark, sf_dir):
    return gazetteer.placeless_check(named_regions(spark, sf_dir), towns(spark, sf_dir))


@query(
    "b10_written_totals",
    f"""WITH {_CLEAN}, {_REGIONS}, r AS (SELECT code, sum(octet_length(encode(name)) + 3) - 1 AS names FROM regions GROUP BY code),
 q AS (SELECT code, count(*) AS places, sum(octet_length(encode(name)) + length(CAST(CAST(floor((lon+180)/0.03+0.5) AS BIGINT) AS VARCHAR)) + length(CAST(CAST(floor((lat+90)/0.03+0.5) AS BIGINT) AS VARCHAR)) + 23 + 1) - 1 AS b FROM clean GROUP BY code)
 SELECT count(*) AS countries, CAST(coalesce(sum(places), 0) AS BIGINT) AS places, CAST(sum(length(code) + names + coalesce(b, 0) + 34) AS BIGINT) AS bytes FROM r LEFT JOIN q USING (code)""",
)
def b10_written(spark, sf_dir):
    """Countries, places and bytes of one JSON document a country. The SQL adds up the characters."""
    grid = bridge(spark, sf_dir).select(F.col("a3").alias("code"), F.lit(0.03).alias("scale_x"), F.lit(0.03).alias("scale_y"), F.lit(-180.0).alias("tx"), F.lit(-90.0).alias("ty")).distinct()
    placed = gazetteer.quantise_places(towns(spark, sf_dir), grid)
    return gazetteer.written_totals(gazetteer.country_documents(named_regions(spark, sf_dir), placed))


@query("s4_gazetteer_files", f"SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, name, lat, lon, a2 FROM ({fx.GAZETTEER}) g")
def s4(spark, sf_dir):
    """The gazetteer as tab-separated files, each of a range of its lines, numbered through all of them."""
    path, blank = work_path(spark, "gazetteer"), F.lit("")
    lines = fx.view(spark, sf_dir, fx.GAZETTEER).repartitionByRange(5, "ord").sortWithinPartitions("ord")
    cells = ["ord", "name", blank, blank, "lat", "lon", blank, blank, "a2"]
    lines.select(F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cells])).write.text(path)
    return boundaries.read_gazetteer(spark, path)


@query("s8_regions_written", f"WITH {_REGIONS}, {_CLEAN} SELECT code, 'region' AS kind, count(*) AS n, min(name) AS first FROM regions GROUP BY code UNION ALL SELECT code, 'place', count(*), min(name) FROM clean GROUP BY code")
def s8(spark, sf_dir):
    """Regions and places written by country over an older build, and read back from their folders."""
    path = work_path(spark, "regions")
    rows, places = named_regions(spark, sf_dir), towns(spark, sf_dir)
    boundaries.write_regions_by_country(rows.withColumn("code", F.lit("OLD")), places.withColumn("code", F.lit("OLD")), path)
    boundaries.write_regions_by_country(rows, places, path)
    counted = lambda name, kind: spark.read.parquet(f"{path}/{name}").groupBy("code").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    return counted("regions", "region").unionByName(counted("places", "place"))
