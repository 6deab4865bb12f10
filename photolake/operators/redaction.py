"""Redaction boxes and faces. Boxes of a photo keep their order: later ones paint over earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import tasks_for
from ..functions.numbers import clamp01, rnd

MIN_BOX = 4  # pixels a side


def _inside(rows: DataFrame, least_left: float) -> DataFrame:
    """x, y, width, height moved and, if too large, shrunk into 0, 0, _w, _h."""
    one = F.lit(1.0)
    if least_left:  # the corner itself stays inside, and the size gives way
        x = F.greatest(F.lit(0.0), F.least(F.col("_w") - one, F.col("x")))
        y = F.greatest(F.lit(0.0), F.least(F.col("_h") - one, F.col("y")))
        w, h = F.greatest(one, F.least(F.col("_w") - x, F.col("width"))), F.greatest(one, F.least(F.col("_h") - y, F.col("height")))
    else:  # the size stays, and the corner gives way
        w, h = F.greatest(one, F.least(F.col("_w").cast("double"), F.col("width"))), F.greatest(one, F.least(F.col("_h").cast("double"), F.col("height")))
        x = F.greatest(F.lit(0.0), F.least(F.col("_w") - w, F.col("x")))
        y = F.greatest(F.lit(0.0), F.least(F.col("_h") - h, F.col("y")))
    return rows.withColumns({"_x": x, "_y": y, "_bw": w, "_bh": h}).withColumns(
        {"x": F.col("_x"), "y": F.col("_y"), "width": F.col("_bw"), "height": F.col("_bh")}
    ).drop("_x", "_y", "_bw", "_bh")


def _with_size(rows: DataFrame, photos: DataFrame) -> DataFrame:
    return rows.join(photos.select("photo_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "photo_id")


def clamp_boxes(boxes: DataFrame, photos: DataFrame) -> DataFrame:
    """Boxes moved into their photo, shrunk only if larger; those under MIN_BOX on a side go."""
    return _inside(_with_size(boxes, photos), 0).filter((F.col("width") >= MIN_BOX) & (F.col("height") >= MIN_BOX)).drop("_w", "_h")


def output_boxes(boxes: DataFrame, plan: DataFrame) -> DataFrame:
    """Boxes in the pixels of the export: rounded outward, so that nothing shows at an edge.

    ``plan``: photo_id, crop_x, crop_y, crop_w, crop_h, out_w, out_h.
    """
    both = boxes.join(plan, "photo_id")

    def edges(at: str, size: str, axis: str) -> tuple[Column, Column]:
        k = F.col(f"out_{size[0]}") / F.col(f"crop_{size[0]}").cast("double")
        low = F.floor((F.col(at) - F.col(f"crop_{axis}")) * k)
        high = F.ceil((F.col(at) + F.col(size) - F.col(f"crop_{axis}")) * k)
        return F.greatest(F.lit(0).cast("long"), low), F.least(F.col(f"out_{size[0]}").cast("long"), high)

    (x0, x1), (y0, y1) = edges("x", "width", "x"), edges("y", "height", "y")
    keep = [c for c in boxes.columns if c not in ("x", "y", "width", "height")]
    mapped = both.select(*keep, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return mapped.filter("x1 > x0 and y1 > y0").select(*keep, F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


def scale_boxes(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes when their picture changes size (from_w, from_h to to_w, to_h). None is dropped."""
    both = boxes.join(sizes, "photo_id")
    kx, ky = F.col("to_w") / F.col("from_w").cast("double"), F.col("to_h") / F.col("from_h").cast("double")
    return both.withColumns({"x": F.col("x") * kx, "y": F.col("y") * ky, "width": F.col("width") * kx, "height": F.col("height") * ky}).drop(
        "from_w", "from_h", "to_w", "to_h"
    )


def redaction_signature(boxes: DataFrame) -> DataFrame:
    """photo_id, signature: id:x,y,w,h,fill of its boxes in order, joined by bars (whole pixels)."""
    numbers = [rnd(F.col(c)).cast("string") for c in ("x", "y", "width", "height")]
    one = F.concat(F.col("box_id"), F.lit(":"), F.concat_ws(",", *numbers, F.col("fill")))
    listed = boxes.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("text")))).alias("all"))
    return listed.select("photo_id", F.array_join("all.text", "|").alias("signature"))


def redactions_for(photos: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every photo with its own boxes in order; none gives an empty list, never a missing photo."""
    fields = ["ord", *[c for c in boxes.columns if c not in ("photo_id", "ord")]]
    listed = boxes.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("boxes"))
    return photos.join(listed, "photo_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(listed.schema["boxes"].dataType)))


def number_faces(detections: DataFrame, photos: DataFrame) -> DataFrame:
    """Detected faces in reading order (y, then x) as face-0, face-1, ..., cut to the photo.

    The join and the window sort a task's faces one after the other; photos are dealt over as many tasks as
    there are faces for, whatever the number of shuffle partitions is.
    """
    tasks = tasks_for(detections)
    dealt = (rows.repartition(tasks, "photo_id") for rows in (detections, photos.select("photo_id", "width", "height")))
    cut = _inside(_with_size(*dealt), 1)
    order = Window.partitionBy("photo_id").orderBy("y", "x", "width", "height", "det_id")
    return cut.withColumn("face_no", F.row_number().over(order) - 1).select(
        "photo_id", F.concat(F.lit("face-"), F.col("face_no")).alias("face_id"), "face_no", "x", "y", "width", "height", F.lit(True).alias("enabled")
    )


def face_regions(faces: DataFrame, photos: DataFrame, strength: float) -> DataFrame:
    """What is blurred: enabled faces, padded and clipped, with the cells they are reduced to."""
    both = _with_size(faces.filter("enabled"), photos)
    zero = F.lit(0).cast("long")
    bx = F.greatest(zero, F.floor(F.col("x") - 0.18 * F.col("width")))
    by = F.greatest(zero, F.floor(F.col("y") - 0.22 * F.col("height")))
    cells = F.greatest(F.lit(2).cast("long"), rnd(24 - 22 * clamp01(F.lit(strength / 100.0))))
    padded = both.withColumns({"bx": bx, "by": by}).withColumns(
        {
            "bw": F.least(F.col("_w") - F.col("bx"), F.ceil(F.col("width") + 0.36 * F.col("width"))),
            "bh": F.least(F.col("_h") - F.col("by"), F.ceil(F.col("height") + 0.44 * F.col("height"))),
            "cells": cells,
        }
    )
    high = F.greatest(F.lit(1).cast("long"), rnd(F.col("cells") * F.col("bh") / F.col("bw").cast("double")))
    return padded.filter("bw >= 1 and bh >= 1").select("photo_id", "face_id", "bx", "by", "bw", "bh", F.col("cells").alias("tw"), high.alias("th"))
