"""Sizes, crops and batch exports, planned as columns over narrow photo rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import default_format, format_filename
from ..functions.numbers import rnd

#: Size presets of social platforms.
PRESETS = [
    ("ig-square", "Square post", "Instagram", 1080, 1080),
    ("ig-portrait", "Portrait post", "Instagram", 1080, 1350),
    ("ig-story", "Story / Reel", "Instagram", 1080, 1920),
    ("x-post", "Post image", "X / Twitter", 1600, 900),
    ("x-header", "Header", "X / Twitter", 1500, 500),
    ("li-post", "Post image", "LinkedIn", 1200, 627),
    ("li-banner", "Profile banner", "LinkedIn", 1584, 396),
    ("yt-thumb", "Thumbnail", "YouTube", 1280, 720),
    ("yt-banner", "Channel banner", "YouTube", 2560, 1440),
    ("fb-post", "Post image", "Facebook", 1200, 630),
    ("fb-cover", "Cover photo", "Facebook", 851, 315),
]
LONG_S, LONG_M = 800, 1920
CROP = "struct<x:double,y:double,width:double,height:double>"


def presets(spark: SparkSession) -> DataFrame:
    """The preset table: eleven rows, so it is always broadcast."""
    rows = [(k, *p) for k, p in enumerate(PRESETS)]
    return spark.createDataFrame(rows, "preset_ord int, preset_id string, label string, platform string, preset_w int, preset_h int")


def _long_edges() -> dict[str, Column]:
    """S before M is pushed down by L; each edge is then kept below the next larger one."""
    long_ = F.greatest("width", "height")
    large = F.greatest(F.lit(LONG_M), long_)
    medium = F.least(F.lit(LONG_M), long_)
    small = F.least(F.lit(LONG_S), F.greatest(F.lit(1), F.floor(medium / 2)))
    medium = F.when(medium >= large, F.greatest(F.lit(1), F.floor(large / 1.5))).otherwise(medium)
    small = F.when(small >= medium, F.greatest(F.lit(1), F.floor(medium / 2))).otherwise(small)
    return {"S": small, "M": medium, "L": large}


def from_long_edge(edge: Column) -> Column:
    """struct<width, height> with the photo's shape, one pixel at least."""
    aspect = F.col("width") / F.col("height").cast("double")
    edge = rnd(edge.cast("double"))
    short = lambda x: F.greatest(F.lit(1).cast("long"), rnd(x))
    wide = F.struct(edge.alias("width"), short(edge / aspect).alias("height"))
    tall = F.struct(short(edge * aspect).alias("width"), edge.alias("height"))
    return F.when(F.col("width") >= F.col("height"), wide).otherwise(tall)


def size_presets(photos: DataFrame) -> DataFrame:
    """Three rows a photo: photo_id, preset, out_w, out_h."""
    sizes = F.array(*[F.struct(F.lit(k).alias("preset"), from_long_edge(e).alias("size")) for k, e in _long_edges().items()])
    return photos.select("photo_id", F.explode(sizes).alias("p")).select(
        "photo_id", "p.preset", F.col("p.size.width").alias("out_w"), F.col("p.size.height").alias("out_h")
    )


def opening_ladder(photos: DataFrame) -> DataFrame:
    """The sizes and qualities that a new photo is tried at, in order (rung from 0)."""
    sizes = {k: from_long_edge(e) for k, e in _long_edges().items()}

    def rungs(*steps: tuple[str, float]) -> Column:
        return F.array(*[F.struct(sizes[k].alias("size"), F.lit(q).alias("quality")) for k, q in steps])

    ladder = F.when(F.col("format") == "image/png", rungs(("M", 0.85), ("S", 0.85))).otherwise(rungs(("M", 0.85), ("M", 0.75), ("S", 0.75)))
    return (
        photos.withColumn("format", default_format(F.col("mime")))
        .select("photo_id", "format", F.posexplode(ladder).alias("rung", "r"))
        .select("photo_id", "format", "rung", F.col("r.size.width").alias("out_w"), F.col("r.size.height").alias("out_h"), "r.quality")
    )


def pick_opening_rung(ladder: DataFrame, estimates: DataFrame) -> DataFrame:
    """Of untouched photos the first rung that encodes smaller than the source, else the last.

    ``estimates``: photo_id, rung, encoded, source_bytes, touched.
    """
    rung = F.struct("rung", "out_w", "out_h", "quality")
    met = ladder.join(estimates.filter(~F.col("touched")), ["photo_id", "rung"])
    fits = F.col("encoded") < F.col("source_bytes")
    best = met.groupBy("photo_id").agg(F.min(F.when(fits, rung)).alias("first"), F.max(rung).alias("last"))
    return best.select("photo_id", F.coalesce("first", "last").alias("r")).select("photo_id", "r.*")


def default_target(photos: DataFrame) -> DataFrame:
    """The first rung as a target, aspect locked, transparency allowed."""
    size = from_long_edge(_long_edges()["M"])
    return photos.select(
        "photo_id",
        size["width"].alias("width"),
        size["height"].alias("height"),
        F.lit(True).alias("aspect_locked"),
        F.lit(0.85).alias("quality"),
        default_format(F.col("mime")).alias("format"),
        F.lit(True).alias("allow_transparency"),
    )


def cover_crop(src_w: Column, src_h: Column, target_w: Column, target_h: Column) -> Column:
    """The largest centred rectangle of the target's shape: struct<x, y, width, height>."""
    W, H = src_w.cast("double"), src_h.cast("double")
    aspect = target_w.cast("double") / target_h.cast("double")
    tall = W / aspect > H
    one = F.lit(1).cast("long")
    w = F.greatest(one, rnd(F.when(tall, H * aspect).otherwise(W)))
    h = F.greatest(one, rnd(F.when(tall, H).otherwise(W / aspect)))
    zero = F.lit(0).cast("long")
    x, y = F.greatest(zero, rnd((W - w) / 2)), F.greatest(zero, rnd((H - h) / 2))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def social_plan(photos: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every photo at every chosen preset; ``chosen`` is a part of the eleven presets, and more rows are
    an error. The presets travel as one array column, so no join is planned at all."""
    rows = chosen.orderBy("preset_ord").limit(12).collect()
    if len(rows) > 11:
        raise ValueError("there are eleven presets")
    table = F.array(*[F.struct(F.lit(r.preset_id).alias("preset_id"), F.lit(r.preset_w).alias("w"), F.lit(r.preset_h).alias("h")) for r in rows])
    each = photos.select("photo_id", "width", "height", F.explode(table).alias("p"))
    crop = cover_crop(F.col("width"), F.col("height"), F.col("p.w"), F.col("p.h"))
    return each.select("photo_id", "p.preset_id", F.col("p.w").alias("out_w"), F.col("p.h").alias("out_h"), crop.alias("c")).select(
        "photo_id", "preset_id", "out_w", "out_h", F.col("c.x").alias("crop_x"), F.col("c.y").alias("crop_y"), F.col("c.width").alias("crop_w"), F.col("c.height").alias("crop_h")
    )


def grouped_presets(table: DataFrame) -> DataFrame:
    """Presets by platform in order of first sight."""
    item = F.struct("preset_ord", "preset_id")
    return table.groupBy("platform").agg(F.min("preset_ord").alias("first"), F.array_sort(F.collect_list(item)).alias("items")).select(
        "platform", "first", F.col("items.preset_id").alias("items")
    )


def clamp_crop(x: Column, y: Column, w: Column, h: Column, src_w: Column, src_h: Column) -> Column:
    """Rounded and inside the picture, one pixel at least."""
    x, y, w, h = (rnd(c.cast("double")) for c in (x, y, w, h))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    w, h = F.greatest(one, F.least(w, src_w)), F.greatest(one, F.least(h, src_h))
    x, y = F.greatest(zero, F.least(x, src_w - w)), F.greatest(zero, F.least(y, src_h - h))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def centred_crop(photos: DataFrame, share: float = 0.6) -> DataFrame:
    """A centred crop where none is set."""
    w, h = rnd(F.col("width") * F.lit(share)), rnd(F.col("height") * F.lit(share))
    own = clamp_crop((F.col("width") - w) / 2, (F.col("height") - h) / 2, w, h, F.col("width"), F.col("height"))
    return photos.withColumn("crop", F.coalesce(F.col("crop"), own))


def autocrop_rect(photos: DataFrame, mode: str) -> DataFrame:
    """A crop around a content box (box_x, box_y, box_w, box_h): ``max`` is the box, ``square`` and
    ``ratio`` are centred on it, all kept inside the photo."""
    W, H, bw, bh = (F.col(c).cast("double") for c in ("width", "height", "box_w", "box_h"))
    cx, cy = F.col("box_x") + bw / 2, F.col("box_y") + bh / 2
    if mode == "max":
        w, h = bw, bh
    elif mode == "square":
        w = h = F.least(F.greatest(bw, bh), W, H)
    else:
        aspect = W / H
        wide = bw / bh > aspect
        w = F.least(W, F.when(wide, bw).otherwise(bh * aspect))
        h = F.least(H, F.when(wide, bw / aspect).otherwise(bh))
    return photos.withColumn("crop", clamp_crop(cx - w / 2, cy - h / 2, w, h, F.col("width"), F.col("height")))


def autocrop_changes(pairs: DataFrame, tolerance: int = 2) -> DataFrame:
    """Rows whose new crop differs by more than ``tolerance`` pixels somewhere from the old one, or
    from the whole photo where there is none."""
    whole = {"x": F.lit(0), "y": F.lit(0), "width": F.col("width"), "height": F.col("height")}
    same = F.lit(True)
    for f, full in whole.items():
        same = same & (F.abs(F.col(f"new.{f}") - F.coalesce(F.col(f"old.{f}"), full)) <= tolerance)
    return pairs.filter(~same)


def batch_plan(photos: DataFrame, edits: DataFrame, target: dict, chosen: int) -> DataFrame:
    """One export row a photo under the batch ``target`` (width, height, locked, social, format, fill).

    ``edits`` has at most one row a photo, with a hand-placed crop or null. Under a social target
    every photo gets its own cover crop, but the chosen one keeps its own; otherwise a crop cuts only
    the chosen photo, which then meets the target exactly. A locked target bounds the long edge of
    the others and never enlarges. The fill is for the chosen photo.
    """
    tw, th = F.lit(target["width"]), F.lit(target["height"])
    rows = photos.join(edits, "photo_id", "left")
    is_chosen = F.col("photo_id") == chosen
    kind = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
    hand = F.when(is_chosen, F.col("crop").cast(kind))
    social = bool(target["social"])
    crop = F.coalesce(hand, cover_crop(F.col("width"), F.col("height"), tw, th).cast(kind)) if social else hand
    k = F.least(F.lit(1.0), F.greatest(tw, th) / F.greatest("width", "height").cast("double"))
    fits = F.lit(bool(target["locked"]) and not social) & crop.isNull()
    one = F.lit(1).cast("long")
    planned = rows.select(
        "photo_id",
        "name",
        crop.alias("crop"),
        F.when(fits, F.greatest(one, rnd(F.col("width") * k))).otherwise(tw.cast("long")).alias("out_w"),
        F.when(fits, F.greatest(one, rnd(F.col("height") * k))).otherwise(th.cast("long")).alias("out_h"),
        F.when(is_chosen, F.lit(target["fill"])).alias("fill"),
    )
    return planned.withColumn("file_name", format_filename(F.col("name"), F.col("out_w"), F.col("out_h"), F.lit(target["format"])))


def export_manifest(exports: DataFrame) -> DataFrame:
    """One row for each file name: the last export of that name wins, with how many met."""
    return exports.groupBy("file_name").agg(F.max_by("photo_id", "ord").alias("photo_id"), F.count(F.lit(1)).alias("collisions"))


def validate_recipe(rows: DataFrame) -> DataFrame:
    """Edit recipes made safe: edges of 1 or more up to 16384 else the fallback's, quality cut to 0 to 1, a known format,
    a crop of finite numbers from 0 that is 1 wide at least, 500 boxes at most, bad boxes dropped and
    bad fills black.

    Needs width, height, quality, format, crop, boxes and fallback_w, fallback_h.
    """

    def edge(c: str) -> Column:
        ok = ~F.isnan(F.col(c)) & (F.col(c) >= 1) & (F.col(c) < float("inf"))
        return F.when(ok, F.least(F.lit(16384).cast("long"), rnd(F.least(F.col(c), F.lit(20000.0))))).otherwise(F.col(f"fallback_{'w' if c == 'width' else 'h'}").cast("long"))

    def sound(r: Column) -> Column:
        finite = F.lit(True)
        for f in ("x", "y", "width", "height"):
            finite = finite & r[f].isNotNull() & ~F.isnan(r[f]) & (F.abs(r[f]) < float("inf"))
        return finite & (r["x"] >= 0) & (r["y"] >= 0) & (r["width"] >= 1) & (r["height"] >= 1)

    black = F.lit("#000000")
    fill = lambda b: F.when(b["fill"].rlike("^#[0-9a-fA-F]{6}$"), b["fill"]).otherwise(black)
    boxes = F.transform(
        F.filter(F.slice(F.coalesce("boxes", F.array()), 1, 500), sound),
        lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"), b["height"].alias("height"), fill(b).alias("fill")),
    )
    quality = F.when(~F.isnan("quality") & (F.abs("quality") < float("inf")), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("quality")))).otherwise(F.lit(0.85))
    known = F.col("format").isin("image/jpeg", "image/png", "image/webp", "image/avif")
    return rows.withColumns(
        {
            "width": edge("width"),
            "height": edge("height"),
            "quality": quality,
            "format": F.when(known, F.col("format")).otherwise("image/jpeg"),
            "crop": F.when(sound(F.col("crop")), F.col("crop")),
            "boxes": boxes,
        }
    )
