"""Collages: layouts as tables, spaces by arithmetic and running sums, photos by rank."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp01, rnd

#: The layouts, each a nested (direction, parts, weights); a part is a slot or a nest.
SLOT = "slot"
LAYOUTS: dict[str, tuple] = {
    "row2": ("row", [SLOT] * 2, None),
    "col2": ("col", [SLOT] * 2, None),
    "row3": ("row", [SLOT] * 3, None),
    "col3": ("col", [SLOT] * 3, None),
    "bigL3": ("row", [SLOT, ("col", [SLOT] * 2, None)], [2, 1]),
    "bigT3": ("col", [SLOT, ("row", [SLOT] * 2, None)], [2, 1]),
    "grid4": ("col", [("row", [SLOT] * 2, None)] * 2, None),
    "bigL4": ("row", [SLOT, ("col", [SLOT] * 3, None)], [2, 1]),
    "bigT4": ("col", [SLOT, ("row", [SLOT] * 3, None)], [2, 1]),
    "grid6": ("col", [("row", [SLOT] * 3, None)] * 2, None),
    "grid9": ("col", [("row", [SLOT] * 3, None)] * 3, None),
}
STRIPS = {"row2": "row", "row3": "row", "col2": "col", "col3": "col"}
SHAPES = {"1:1": (1, 1), "4:5": (4, 5), "9:16": (9, 16), "16:9": (16, 9), "3:2": (3, 2), "2:3": (2, 3)}
_CATALOG = "layout_id string, strip string, slot_no int, fx double, gx double, fw double, gw double, fy double, gy double, fh double, gh double"


@cache
def _leaves(layout_id: str) -> tuple[tuple[float, ...], ...]:
    """Each slot's x, width, y and height as a share of the canvas side plus a multiple of the gap.

    Every side of a space is linear in side and gap, so a nest is walked once, on coefficients.
    """
    found: list[tuple[float, ...]] = []

    def split(nest, x, w, y, h):
        way, parts, weights = nest
        weights = weights or [1] * len(parts)
        at, length = (x, w) if way == "row" else (y, h)
        room = (length[0], length[1] - (len(parts) - 1))
        for part, weight in zip(parts, weights, strict=True):
            size = tuple(c * weight / sum(weights) for c in room)
            box = (at, size, y, h) if way == "row" else (x, w, at, size)
            if part == SLOT:
                found.append(tuple(c for pair in box for c in pair))
            else:
                split(part, *box)
            at = (at[0] + size[0], at[1] + size[1] + 1)

    split(LAYOUTS[layout_id], (0.0, 1.0), (1.0, -2.0), (0.0, 1.0), (1.0, -2.0))
    return tuple(found)


def layout_catalog(spark: SparkSession) -> DataFrame:
    """One row for each slot of each layout; under fifty rows, so it is always broadcast."""
    rows = [(k, STRIPS.get(k), n, *leaf) for k in LAYOUTS for n, leaf in enumerate(_leaves(k))]
    return spark.createDataFrame(rows, _CATALOG)


def _ratio(shape: Column) -> Column:
    out = F.lit(1.0)
    for name, (w, h) in SHAPES.items():
        out = F.when(shape == name, F.lit(w / h)).otherwise(out)
    return out


def collage_grid(collages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Spaces of collages (collage_id, layout_id, shape, long_edge, gap_frac) of a fixed shape.

    The gap is the same everywhere. 'fit' on a layout that is no strip is square; strips that fit
    their photos are left to collage_fit_strip.
    """
    both = collages.join(F.broadcast(catalog), "layout_id").filter((F.col("shape") != "fit") | F.col("strip").isNull())
    edge = F.greatest(F.lit(1).cast("long"), rnd(F.col("long_edge").cast("double")))
    both = both.withColumns({"L": edge, "ratio": _ratio(F.col("shape"))}).withColumn("g", F.greatest(F.lit(0.0), F.col("gap_frac")) * F.col("L"))
    both = both.withColumns(
        {
            "canvas_w": rnd(F.when(F.col("ratio") >= 1, F.col("L").cast("double")).otherwise(F.col("L") * F.col("ratio"))),
            "canvas_h": rnd(F.when(F.col("ratio") >= 1, F.col("L") / F.col("ratio")).otherwise(F.col("L").cast("double"))),
        }
    )
    part = lambda f, g, side: F.col(side) * F.col(f) + F.col("g") * F.col(g)
    return both.select(
        "collage_id", "slot_no", "canvas_w", "canvas_h",
        part("fx", "gx", "canvas_w").alias("x"), part("fy", "gy", "canvas_h").alias("y"),
        part("fw", "gw", "canvas_w").alias("w"), part("fh", "gh", "canvas_h").alias("h"),
    )


def collage_fit_strip(slots: DataFrame) -> DataFrame:
    """Spaces of strips that fit their photos.

    ``slots``: collage_id, slot_no, strip (row or col), aspect, long_edge, gap_frac. A missing or bad
    aspect is 1. The long edge is the strip's length, or its thickness where that is longer.
    """
    good = F.col("aspect").isNotNull() & ~F.isnan("aspect") & (F.col("aspect") > 0) & (F.col("aspect") < float("inf"))
    a = F.when(good, F.col("aspect")).otherwise(F.lit(1.0))
    row = F.col("strip") == "row"
    L = F.greatest(F.lit(1).cast("long"), rnd(F.col("long_edge").cast("double"))).cast("double")
    each = slots.withColumns({"L": L, "share": F.when(row, a).otherwise(1 / a)}).withColumn("g", F.greatest(F.lit(0.0), F.col("gap_frac")) * F.col("L"))
    whole = Window.partitionBy("collage_id")
    before = whole.orderBy("slot_no").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns(
        {
            "sum": F.sum("share").over(whole),
            "n": F.count(F.lit(1)).over(whole),
            "before": F.coalesce(F.sum("share").over(before), F.lit(0.0)),
            "k": F.count(F.lit(1)).over(before),
        }
    )
    inner = (F.col("L") - (F.col("n") + 1) * F.col("g")) / F.col("sum")
    thick = inner + 2 * F.col("g") > F.col("L")
    each = each.withColumn("inner", F.when(thick, F.col("L") - 2 * F.col("g")).otherwise(inner))
    along = F.when(thick, F.col("inner") * F.col("sum") + (F.col("n") + 1) * F.col("g")).otherwise(F.col("L"))
    across = F.when(thick, F.col("L")).otherwise(F.col("inner") + 2 * F.col("g"))
    at, length = F.col("inner") * F.col("before") + (F.col("k") + 1) * F.col("g"), F.col("inner") * F.col("share")
    pick = lambda x, y: F.when(row, x).otherwise(y)
    return each.select(
        "collage_id", "slot_no", rnd(pick(along, across)).alias("canvas_w"), rnd(pick(across, along)).alias("canvas_h"),
        pick(at, F.col("g")).alias("x"), pick(F.col("g"), at).alias("y"), pick(length, F.col("inner")).alias("w"), pick(F.col("inner"), length).alias("h"),
    )


def fill_slots(slots: DataFrame, photos: DataFrame) -> DataFrame:
    """Placements that still have their photo stay; blanks take photos not yet in the collage.

    ``slots``: collage_id, slot_no, photo_id (null or vanished: blank). ``photos``: collage_id,
    photo_id, ord (open order). Blanks and spare photos of a collage meet by rank.
    """
    live = slots.join(photos.select("collage_id", "photo_id"), ["collage_id", "photo_id"], "left_semi")
    blank = slots.join(live, ["collage_id", "slot_no"], "left_anti").select("collage_id", "slot_no")
    spare = photos.join(live, ["collage_id", "photo_id"], "left_anti")
    rank = lambda order: F.row_number().over(Window.partitionBy("collage_id").orderBy(order))
    filled = blank.withColumn("rank", rank("slot_no")).join(spare.withColumn("rank", rank("ord")).select("collage_id", "rank", "photo_id"), ["collage_id", "rank"], "left")
    return live.select("collage_id", "slot_no", "photo_id").unionByName(filled.select("collage_id", "slot_no", "photo_id"))


def cover_placement(rows: DataFrame) -> DataFrame:
    """Where the photo (iw, ih) is drawn to cover its space (x, y, w, h) under zoom, ox and oy."""
    s = F.greatest(F.col("w") / F.col("iw"), F.col("h") / F.col("ih")) * F.greatest(F.lit(1.0), F.col("zoom"))
    rows = rows.withColumns({"draw_w": F.col("iw") * s, "draw_h": F.col("ih") * s})
    return rows.withColumns(
        {
            "draw_x": F.col("x") + (F.col("w") - F.col("draw_w")) * clamp01(F.col("ox")),
            "draw_y": F.col("y") + (F.col("h") - F.col("draw_h")) * clamp01(F.col("oy")),
        }
    )
