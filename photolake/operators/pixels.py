"""Pixels as rows: analysis and rendering of pictures as joins and aggregations.

A picture is its rows (image_id, width, height, x, y, r, g, b, a), one for each pixel, so that a large
one is spread over many tasks. Plans (crops, sizes, boxes, faces, slots) are narrow tables with a row
for each picture or box. Resampling is defined here: box means while halving, bilinear for the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import sent, settle
from ..functions.numbers import rnd

ALPHA_CONTENT, ALPHA_OPAQUE, TOLERANCE = 64, 250, 24
SPECK_EXTENT, SPECK_MASS = 0.005, 0.005
_RGB, _RGBA = ("r", "g", "b"), ("r", "g", "b", "a")
_SIZE = ["image_id", "width", "height"]
SCAN, ALPHA_SCAN = 1400, 256  # longest side of the copies that content and alpha are looked for in
TILE = 64


def from_rasters(rasters: DataFrame) -> DataFrame:
    """Decoded pictures (image_id, width, height, channels 1, 3 or 4, data as the image source gives it:
    rows of blue, green, red, alpha) to pixels. A picture becomes its rows first, so that no pixel
    carries more than a row's bytes."""
    line = F.col("width") * F.col("channels")
    rows = rasters.select(*_SIZE, "channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = rows.select(*_SIZE, "channels", "y", F.hex(F.substring("data", F.col("y") * line + 1, line)).alias("line"))
    each = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    grey = F.col("channels") == 1

    def channel(k: int, name: str) -> Column:
        at = (F.col("x") * F.col("channels") + F.when(grey, 0).otherwise(k)) * 2 + 1
        return F.conv(F.substring("line", at, F.lit(2)), 16, 10).cast("int").alias(name)

    alpha = F.when(F.col("channels") == 4, channel(3, "a")).otherwise(255).alias("a")
    return each.select(*_SIZE, "x", "y", channel(2, "r"), channel(1, "g"), channel(0, "b"), alpha)


def to_png(pixels: DataFrame) -> DataFrame:
    """(image_id, content): each picture as the bytes of a PNG file, eight bits for red, green, blue and
    alpha. A file is one row, so its picture's rows meet in one."""
    octet = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")
    dots = pixels.groupBy(*_SIZE, "y").agg(F.array_sort(F.collect_list(F.struct("x", F.concat(*map(octet, _RGBA)).alias("h")))).alias("p"))
    lines = dots.select(*_SIZE, "y", F.unhex(F.concat(F.lit("00"), F.array_join("p.h", ""))).alias("line"))
    # few bytes may be many files: they stay dealt over all tasks, however small the partitions are
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = lines.repartition(parts, *_SIZE).groupBy(*_SIZE).agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("p"))

    @F.pandas_udf("binary")
    def png(width: pd.Series, height: pd.Series, lines: pd.Series) -> pd.Series:
        def chunk(kind: bytes, data: bytes) -> bytes:
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        def one(w: int, h: int, lines) -> bytes:
            head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0))
            return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")

        return pd.Series([one(*x) for x in zip(width, height, lines, strict=True)])

    return whole.select("image_id", png("width", "height", F.col("p.line")).alias("content"))


def scan_copy(pixels: DataFrame, longest: int) -> DataFrame:
    """Pictures whose longer side is more than ``longest`` at that size, all others as they are."""
    longer = F.greatest("width", "height")
    large = pixels.filter(longer > longest)
    side = lambda c: F.greatest(F.lit(1).cast("long"), rnd(F.col(c) * (F.lit(longest) / longer))).alias(f"out_{c[0]}")
    sizes = settle(large.select(*_SIZE).distinct().select("image_id", side("width"), side("height")))
    whole = pixels.filter(longer <= longest)
    if not sizes.limit(1).count():
        return whole
    typed = [F.col(c).cast(dict(pixels.dtypes)[c]).alias(c) for c in pixels.columns]
    return whole.unionByName(resize(large, sizes).select(*typed))


def has_alpha(pixels: DataFrame) -> DataFrame:
    """(image_id, has_alpha)."""
    return pixels.groupBy("image_id").agg(F.bool_or(F.col("a") < ALPHA_OPAQUE).alias("has_alpha"))


def background_colour(pixels: DataFrame) -> DataFrame:
    """(image_id, bg_r, bg_g, bg_b): each channel's upper median over the border, corners twice."""
    sides = (F.col("x") == 0, F.col("x") == F.col("width") - 1, F.col("y") == 0, F.col("y") == F.col("height") - 1)
    times = reduce(lambda a, b: a + b, (s.cast("int") for s in sides))
    # a channel has 256 values, so a picture's border is at most that many rows a channel
    channel = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in _RGB])).alias("p")
    counts = pixels.filter(times > 0).select("image_id", times.alias("n"), channel).groupBy("image_id", "p.c", "p.v").agg(F.sum("n").alias("n"))
    key = Window.partitionBy("image_id", "c")
    upto = counts.withColumns({"upto": F.sum("n").over(key.orderBy("v")), "total": F.sum("n").over(key)})
    median = upto.filter(F.col("upto") > F.floor(F.col("total") / 2))
    least = lambda c: F.min(F.when(F.col("c") == c, F.col("v"))).alias(f"bg_{c}")
    return median.groupBy("image_id").agg(*[least(c) for c in _RGB])


def _about(pixels: DataFrame) -> DataFrame:
    """(image_id, by_alpha, bg_r, bg_g, bg_b), a row a picture: whether over a fiftieth of it is
    transparent, and its background."""
    clear = F.sum((F.col("a") < ALPHA_CONTENT).cast("long")) > F.count(F.lit(1)) / 50
    return pixels.groupBy("image_id").agg(clear.alias("by_alpha")).join(background_colour(pixels), "image_id")


def content_mask(pixels: DataFrame, tolerance: int = TOLERANCE, about: DataFrame | None = None) -> DataFrame:
    """(image_id, width, height, x, y) of content: by alpha if over a fiftieth of the picture is
    transparent, else by distance from the background too."""
    about = sent(settle(_about(pixels))) if about is None else about
    away = reduce(lambda a, b: a + b, ((F.col(c) - F.col(f"bg_{c}")) * (F.col(c) - F.col(f"bg_{c}")) for c in _RGB))
    content = (F.col("a") >= ALPHA_CONTENT) & (F.col("by_alpha") | (away > 3 * tolerance * tolerance))
    return pixels.join(about, "image_id").filter(content).select(*_SIZE, "x", "y")


_PARTS = "long, y0 long, x1 long, y1 long, n long, rim array<struct<x long, y long>>"


def _tile_parts(keys: np.ndarray, x: np.ndarray, y: np.ndarray, tile: int) -> tuple[np.ndarray, ...]:
    """(first pixel of each part, its box and pixels; part of each pixel) of the 8-connected parts of
    tiles, given by their content's ``keys`` (equal in a tile), x and y, in that order and by y and x."""
    last = np.diff(x, append=x[-1:] - 2) != 1
    last |= (np.diff(y, append=-1) != 0) | (np.diff(keys, append=-1) != 0)
    ends = np.flatnonzero(last)
    run = np.concatenate(([0], np.cumsum(last)[:-1]))  # of each pixel
    begin = np.concatenate(([0], ends[:-1] + 1))
    key, row, left, right = keys[begin], y[begin], x[begin], x[ends]
    # a run touches those of the row above whose ends are in reach: a stretch of runs, in order
    line = key * (2 * tile + 2) + row % tile  # lines of a tile are neighbours, others are apart
    wide = np.int64(tile + 3)
    a = np.searchsorted(line * wide + right % tile + 1, (line - 1) * wide + left % tile, "left")
    b = np.searchsorted(line * wide + left % tile + 1, (line - 1) * wide + right % tile + 2, "right")
    many = np.maximum(b - a, 0)
    one = np.repeat(np.arange(len(begin)), many)
    two = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    label = np.arange(len(begin))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        for side in (one, two):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    heads, part = np.unique(label, return_inverse=True)
    n = len(heads)
    x0, x1, y1 = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.full(n, -1)
    np.minimum.at(x0, part, left)
    np.maximum.at(x1, part, right)
    np.maximum.at(y1, part, row)
    size = np.bincount(part, right - left + 1, n).astype(np.int64)
    return begin[heads], x0, row[heads], x1, y1, size, part[run]


def content_blobs(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, width, height, x0, y0, x1, y1, n) of the 8-connected components.

    Tiles of ``tile`` pixels a side are labelled on their own, all of a batch at once; then the least
    part spreads over the links between pixels on both sides of tiles' borders, until nothing
    changes. Pictures of one tile have no such links.
    """
    parts = settle(_tiles(mask, tile))
    # a settled table of labels takes a fraction of its rows' memory on disk: no join here may be
    # broadcast because its file is small
    apart = lambda rows: rows.hint("merge")
    rims = parts.select("image_id", "node", F.explode("rim").alias("p")).select("image_id", "node", "p.x", "p.y")
    ahead = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (1, 1), (0, 1), (-1, 1))]))
    asked = rims.withColumn("d", ahead).select("image_id", F.col("node").alias("other"), (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    links = rims.join(apart(asked), ["image_id", "x", "y"]).filter("node <> other").select("image_id", "node", "other").distinct()
    links = settle(links.unionByName(links.select("image_id", F.col("other").alias("node"), F.col("node").alias("other"))))
    merge = lambda rows, *keys: rows.groupBy(*_SIZE, *keys).agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"), (F.sum, "n"))])
    if not links.limit(1).count():
        return parts.select(*_SIZE, "x0", "y0", "x1", "y1", "n")
    labels = links.select("image_id", "node", F.col("node").alias("label")).distinct()
    while True:
        told = links.join(apart(labels.select("image_id", F.col("node").alias("other"), "label")), ["image_id", "other"]).groupBy("image_id", "node").agg(F.min("label").alias("near"))
        new = labels.join(apart(told), ["image_id", "node"]).withColumn("new", F.least("label", "near"))
        jump = new.select(F.col("image_id").alias("jump_image"), F.col("node").alias("at"), F.col("new").alias("beyond"))
        hop = (F.col("image_id") == F.col("jump_image")) & (F.col("new") == F.col("at"))
        new = settle(new.join(apart(jump), hop).select("image_id", "node", "label", F.least("new", "beyond").alias("new")))
        moved = new.filter("new <> label").limit(1).count()
        labels = new.select("image_id", "node", F.col("new").alias("label"))
        if not moved:
            break
    return merge(parts.join(apart(labels), ["image_id", "node"], "left").withColumn("label", F.coalesce("label", "node")), "label").drop("label")


def _tiles(mask: DataFrame, tile: int) -> DataFrame:
    """(image_id, width, height, node, x0, y0, x1, y1, n, rim): the parts within tiles. node is a part's
    first pixel; rim has its pixels that lie at another tile."""
    kind = dict(mask.dtypes)["image_id"]
    cell = lambda c: F.floor(F.col(c) / tile)
    dealt = mask.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("width", "height", "x", "y")]).withColumns({"ty": cell("y"), "tx": cell("x")})
    order = ["image_id", "ty", "tx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            keys = _tile_keys(table)
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last tile may go on
            if cut:
                yield parts(table.slice(0, cut), keys[:cut])
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield parts(held, _tile_keys(held))

    def parts(table: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
        x, y, w, h = (table[c].to_numpy() for c in ("x", "y", "width", "height"))
        first, x0, y0, x1, y1, n, part = _tile_parts(keys, x, y, tile)
        edge = ((x % tile == 0) & (x > 0)) | ((x % tile == tile - 1) & (x < w - 1)) | ((y % tile == 0) & (y > 0)) | ((y % tile == tile - 1) & (y < h - 1))
        at = np.flatnonzero(edge)
        at = at[np.argsort(part[at], kind="stable")]
        ends = np.concatenate(([0], np.cumsum(np.bincount(part[at], minlength=len(first))))).astype(np.int32)
        rim = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x[at]), pa.array(y[at])], ["x", "y"]))
        whose = table.take(pa.array(first)).combine_chunks()
        node = pa.array(y[first] << 31 | x[first])
        flat = [whose[c].combine_chunks() for c in _SIZE]
        return pa.RecordBatch.from_arrays([*flat, node, *map(pa.array, (x0, y0, x1, y1, n)), rim], [*_SIZE, "node", "x0", "y0", "x1", "y1", "n", "rim"])

    return dealt.repartition(*order).sortWithinPartitions(*order, "y", "x").mapInArrow(run, f"image_id {kind}, width long, height long, node long, x0 {_PARTS}")


def _tile_keys(table: pa.Table) -> np.ndarray:
    """Numbers from 0 up, one for each tile, of rows that are in order of tiles."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    codes = [table[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("image_id", "ty", "tx")]
    return np.cumsum(reduce(np.logical_or, (np.diff(c, prepend=c[0]) != 0 for c in codes))).astype(np.int64)


def content_bounds(blobs: DataFrame, sources: DataFrame | None = None, longest: int = SCAN) -> DataFrame:
    """(image_id, content, blobs, box_x, box_y, box_w, box_h): the box of all blobs but specks, or of
    all if all are specks. Pictures without content have no row.

    ``sources`` (image_id, source_w, source_h): the pictures that the blobs' ones are scan copies of;
    boxes are brought outward to their pixels.
    """
    mass = blobs.groupBy("image_id").agg(F.sum("n").alias("content"))
    extent = F.greatest(F.lit(2).cast("long"), rnd(SPECK_EXTENT * F.greatest("width", "height")))
    speck = (F.col("x1") - F.col("x0") < extent) & (F.col("y1") - F.col("y0") < extent) & (F.col("n") <= F.col("content") * SPECK_MASS)
    told = blobs.join(mass, "image_id").withColumn("speck", speck)

    def edge(f, c: str) -> Column:
        return F.coalesce(f(F.when(~F.col("speck"), F.col(c))), f(c))

    boxes = told.groupBy("image_id", "content").agg(
        F.count(F.lit(1)).alias("blobs"), edge(F.min, "x0").alias("x0"), edge(F.min, "y0").alias("y0"), (edge(F.max, "x1") + 1).alias("x1"), (edge(F.max, "y1") + 1).alias("y1"),
    )
    if sources is not None:
        back = F.lit(1.0) / F.least(F.lit(1.0), F.lit(longest) / F.greatest("source_w", "source_h"))
        low = lambda c: F.floor(F.col(c) * back)
        high = lambda c, side: F.least(F.ceil(F.col(c) * back), F.col(side).cast("long"))
        boxes = boxes.join(sources, "image_id").withColumns({"x0": low("x0"), "y0": low("y0"), "x1": high("x1", "source_w"), "y1": high("y1", "source_h")}).drop("source_w", "source_h")
    at_least = lambda c: F.greatest(F.lit(1).cast("long"), c)
    named = {"box_x": F.col("x0").cast("long"), "box_y": F.col("y0").cast("long"), "box_w": at_least(F.col("x1") - F.col("x0")), "box_h": at_least(F.col("y1") - F.col("y0"))}
    return boxes.withColumns(named).drop("x0", "y0", "x1", "y1")


def analyse(pixels: DataFrame, tolerance: int = TOLERANCE, longest: int = SCAN, alpha_longest: int = ALPHA_SCAN) -> DataFrame:
    """One row a picture: has_alpha, background, content (pixels of the scan copy), blobs and the
    content box in the picture's own pixels; no content is 0 pixels, 0 blobs and no box.

    Content is looked for in a copy of at most ``longest`` pixels a side, alpha in one of
    ``alpha_longest``.
    """
    copy = scan_copy(pixels, longest)
    about = sent(settle(_about(copy)))
    sources = pixels.select("image_id", F.col("width").alias("source_w"), F.col("height").alias("source_h")).distinct()
    bounds = content_bounds(content_blobs(content_mask(copy, tolerance, about)), sources, longest)
    told = has_alpha(scan_copy(pixels, alpha_longest)).join(about.drop("by_alpha"), "image_id").join(bounds, "image_id", "left")
    zero = F.lit(0).cast("long")
    return told.withColumns({"content": F.coalesce("content", zero), "blobs": F.coalesce("blobs", zero)})


def crop(pixels: DataFrame, crops: DataFrame) -> DataFrame:
    """The part inside (image_id, cx, cy, cw, ch); pictures without a crop stay whole."""
    both = pixels.join(crops, "image_id", "left")
    inside = F.col("cx").isNull() | (F.col("x").between(F.col("cx"), F.col("cx") + F.col("cw") - 1) & F.col("y").between(F.col("cy"), F.col("cy") + F.col("ch") - 1))
    zero = F.lit(0)
    return both.filter(inside).select(
        "image_id", F.coalesce("cw", "width").alias("width"), F.coalesce("ch", "height").alias("height"),
        (F.col("x") - F.coalesce("cx", zero)).alias("x"), (F.col("y") - F.coalesce("cy", zero)).alias("y"), *_RGBA,
    )


def _halved(n: Column, steps: Column) -> Column:
    """A side after so many halvings, an odd last pixel standing alone in each."""
    return F.aggregate(F.sequence(F.lit(0), steps), n, lambda m, k: F.when(k == 0, m).otherwise(F.floor((m + 1) / 2)))


def _share(at: Column, n: Column, steps: Column) -> Column:
    """What part of its halved pixel a pixel makes: a half a step, but all where it stands alone."""
    begin = F.struct(F.lit(1.0).alias("s"), at.alias("at"), n.alias("n"))

    def step(m: Column, k: Column) -> Column:
        alone = (m["at"] == m["n"] - 1) & (m["n"] % 2 == 1)
        halved = F.struct((m["s"] * F.when(alone, 1.0).otherwise(0.5)).alias("s"), F.floor(m["at"] / 2).alias("at"), F.floor((m["n"] + 1) / 2).alias("n"))
        return F.when(k == 0, m).otherwise(halved)

    return F.aggregate(F.sequence(F.lit(0), steps), begin, step, lambda m: m["s"])


def _steps(plan: DataFrame) -> DataFrame:
    """``plan`` with how often each picture is halved: while both sides are twice the size asked."""
    begin = F.struct(F.col("width").alias("w"), F.col("height").alias("h"), F.lit(0).alias("k"))

    def step(m: Column, _: Column) -> Column:
        halved = F.struct(F.floor((m["w"] + 1) / 2).alias("w"), F.floor((m["h"] + 1) / 2).alias("h"), (m["k"] + 1).alias("k"))
        return F.when((m["w"] >= 2 * F.col("out_w")) & (m["h"] >= 2 * F.col("out_h")), halved).otherwise(m)

    most = F.sequence(F.lit(0), F.floor(F.log2(F.greatest("width", "height"))).cast("int"))
    return plan.withColumn("steps", F.aggregate(most, begin, step, lambda m: m["k"]))


def _taps(n: str, m: str, name: str) -> Column:
    """Array of (o, s, f) for an axis of n pixels drawn as m: pixel o takes f of pixel s."""
    at = lambda o: F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, (o + 0.5) * F.col(n) / F.col(m) - 0.5))

    def two(o: Column) -> Column:
        low = F.floor(at(o))
        tap = lambda s, f: F.struct(o.alias(f"o{name}"), s.alias(f"s{name}"), f.alias(f"f{name}"))
        return F.array(tap(low, 1.0 - (at(o) - low)), tap(low + 1, at(o) - low))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col(m) - 1), two)), lambda t: t[f"f{name}"] > 0)


def resize(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pictures at (image_id, out_w, out_h): halved while both sides are at least twice the size asked,
    then drawn bilinearly. Every step is a weighted sum by (picture, pixel)."""
    size = lambda c: F.col(c).cast("long").alias(c)
    rows = pixels.select("image_id", size("width"), size("height"), size("x"), size("y"), *_RGBA)
    asked = sizes.select("image_id", size("out_w"), size("out_h"))
    plan = _steps(rows.select(*_SIZE).distinct().join(asked, "image_id"))
    plan = settle(plan.withColumns({"hw": _halved(F.col("width"), F.col("steps")), "hh": _halved(F.col("height"), F.col("steps"))}))
    each = rows.join(plan.select("image_id", "steps"), "image_id")
    each = each.withColumn("part", _share(F.col("x"), F.col("width"), F.col("steps")) * _share(F.col("y"), F.col("height"), F.col("steps")))
    lower = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("steps")))
    small = each.groupBy("image_id", lower("x").alias("sx"), lower("y").alias("sy")).agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in _RGBA])
    across = plan.select("image_id", F.explode(_taps("hw", "out_w", "x")).alias("t")).select("image_id", "t.*")
    down = plan.select("image_id", F.explode(_taps("hh", "out_h", "y")).alias("t")).select("image_id", "t.*")
    total = lambda df, key, f: df.groupBy(*key).agg(*[F.sum(F.col(c) * F.col(f)).alias(c) for c in _RGBA])
    wide = total(small.join(across, ["image_id", "sx"]), ["image_id", "ox", "sy"], "fx")
    drawn = total(wide.join(down, ["image_id", "sy"]), ["image_id", "ox", "oy"], "fy")
    # a sum that should be a half must not fall short of it by its last bits
    byte = lambda c: F.least(F.lit(255).cast("long"), rnd(F.round(c, 6))).cast("int").alias(c)
    return drawn.join(asked, "image_id").select("image_id", F.col("out_w").alias("width"), F.col("out_h").alias("height"), F.col("ox").alias("x"), F.col("oy").alias("y"), *[byte(c) for c in _RGBA])


def _byte_of(fill: str, k: int) -> Column:
    """Channel k of a text such as #0a0b0c."""
    return F.conv(F.substring(fill, 2 * k + 2, 2), 16, 10).cast("int")


def flatten(pixels: DataFrame, fills: DataFrame, white: Column | None = None) -> DataFrame:
    """Pictures on their ground: the fill of (image_id, fill), or white where there is none and
    ``white`` (JPEG, or transparency off) holds, or else as they are."""
    both = pixels.join(fills.select("image_id", "fill"), "image_id", "left")
    forced = F.lit(False) if white is None else white
    ground = F.when(F.col("fill").isNotNull(), F.col("fill")).when(forced, F.lit("#ffffff"))
    both = both.withColumn("fill", ground)
    share = F.col("a") / 255.0
    on = lambda k, c: F.when(F.col("fill").isNull(), F.col(c)).otherwise(rnd(F.round(F.col(c) * share + _byte_of("fill", k) * (1 - share), 6)).cast("int")).alias(c)
    return both.select(*_SIZE, "x", "y", *[on(k, c) for k, c in enumerate(_RGB)], F.when(F.col("fill").isNull(), F.col("a")).otherwise(255).alias("a"))


def _spans(boxes: DataFrame, *fields: str) -> DataFrame:
    """(image_id, y, spans): for each row of pixels the boxes (image_id, bx, by, bw, bh, fields) that
    cross it, in order of ``fields``. Settled, and broadcast while there are few."""
    rows = boxes.filter("bw > 0 and bh > 0").withColumn("y", F.explode(F.sequence(F.col("by"), F.col("by") + F.col("bh") - 1)))
    return sent(settle(rows.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct(*fields, "bx", "by", "bw", "bh"))).alias("spans"))))


def _covering() -> Column:
    """Those of a row's ``spans`` that cover x, in order; null where the row has none."""
    return F.filter("spans", lambda s: F.col("x").between(s["bx"], s["bx"] + s["bw"] - 1))


def paint_boxes(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Solid rectangles (image_id, ord, bx, by, bw, bh, fill) in output pixels; the last that covers a
    pixel shows. Pixels meet the boxes of their row and are painted where they are."""
    each = pixels.join(_spans(boxes, "ord", "fill"), ["image_id", "y"], "left")
    each = each.withColumn("fill", F.get(F.reverse(_covering()), F.lit(0))["fill"])
    paint = lambda k, c: F.when(F.col("fill").isNull(), F.col(c)).otherwise(_byte_of("fill", k)).cast("int").alias(c)
    return each.select(*_SIZE, "x", "y", *[paint(k, c) for k, c in enumerate(_RGB)], F.when(F.col("fill").isNull(), F.col("a")).otherwise(255).cast("int").alias("a"))


def redact_faces(pixels: DataFrame, regions: DataFrame, style: str = "blur", stencil: DataFrame | None = None) -> DataFrame:
    """Regions (image_id, face_no, bx, by, bw, bh, tw, th) reduced to tw x th and drawn back, blurred or
    in blocks ("pixels"); where they overlap the last shows. ``stencil``: the (image_id, x, y) that may
    change, or None for all. Pixels that no region covers pass by."""
    key = F.struct("image_id", "face_no")
    met = pixels.join(_spans(regions, "face_no"), ["image_id", "y"], "left").withColumn("faces", F.coalesce(_covering(), F.array())).drop("spans")
    covered = met.filter(F.size("faces") > 0)
    parts = covered.withColumn("f", F.explode("faces")).select(
        F.struct("image_id", F.col("f.face_no").alias("face_no")).alias("image_id"), F.col("f.bw").alias("width"), F.col("f.bh").alias("height"),
        (F.col("x") - F.col("f.bx")).alias("x"), (F.col("y") - F.col("f.by")).alias("y"), *_RGBA,
    )
    small = resize(parts, regions.select(key.alias("image_id"), F.col("tw").alias("out_w"), F.col("th").alias("out_h")))
    if style == "blur":
        back = resize(small, regions.select(key.alias("image_id"), F.col("bw").alias("out_w"), F.col("bh").alias("out_h")))
    else:
        cells = regions.select(key.alias("image_id"), "bw", "bh", "tw", "th", F.explode(F.sequence(F.lit(0), F.col("bh") - 1)).alias("oy"))
        cells = cells.withColumn("ox", F.explode(F.sequence(F.lit(0), F.col("bw") - 1)))
        cells = cells.select("image_id", "ox", "oy", F.floor(F.col("ox") * F.col("tw") / F.col("bw")).alias("x"), F.floor(F.col("oy") * F.col("th") / F.col("bh")).alias("y"))
        back = small.join(cells, ["image_id", "x", "y"]).select("image_id", F.col("ox").alias("x"), F.col("oy").alias("y"), *_RGBA)
    placed = back.join(regions.select(key.alias("image_id"), "bx", "by"), "image_id")
    drawn = placed.groupBy(F.col("image_id.image_id").alias("image_id"), (F.col("x") + F.col("bx")).alias("x"), (F.col("y") + F.col("by")).alias("y")).agg(
        F.max_by(F.struct(*_RGBA), "image_id.face_no").alias("new")
    )
    if stencil is not None:
        drawn = drawn.join(stencil, ["image_id", "x", "y"], "left_semi")
    done = covered.drop("faces").join(drawn, ["image_id", "x", "y"], "left")
    done = done.select(*_SIZE, "x", "y", *[F.coalesce(f"new.{c}", c).alias(c) for c in _RGBA])
    return done.unionByName(met.filter(F.size("faces") == 0).select(*done.columns))


def process(pixels: DataFrame, plan: DataFrame, boxes: DataFrame) -> DataFrame:
    """The export path: crop, resize, redact, flatten. ``plan``: image_id, crop (struct cx, cy, cw, ch or
    null), out_w, out_h, fill (or null); ``boxes`` as for paint_boxes."""
    crops = plan.filter("crop is not null").select("image_id", "crop.*")
    return flatten(paint_boxes(resize(crop(pixels, crops), plan.select("image_id", "out_w", "out_h")), boxes), plan)


def draw_collages(pixels: DataFrame, placed: DataFrame, boxes: DataFrame) -> DataFrame:
    """Collages on white from rows (collage_id, slot_no, image_id, canvas_w, canvas_h, x, y, w, h, draw_x,
    draw_y, draw_w, draw_h), whole numbers: each picture is redacted by ``boxes`` (in its own pixels),
    drawn at its size and cut to its space. Gives pixel rows with the collage as image_id."""
    slot = F.struct("collage_id", "slot_no").alias("image_id")
    own = placed.select(F.col("image_id").alias("photo"), slot, F.col("draw_w").alias("out_w"), F.col("draw_h").alias("out_h"))
    hidden = paint_boxes(pixels, boxes).withColumnRenamed("image_id", "photo")
    drawn = resize(hidden.join(own.select("photo", "image_id"), "photo").drop("photo"), own)
    spaces = placed.select(slot, *[F.col(c).alias(f"s_{c}") for c in ("x", "y", "w", "h", "draw_x", "draw_y")])
    at = drawn.join(spaces, "image_id").withColumns({"x": F.col("x") + F.col("s_draw_x"), "y": F.col("y") + F.col("s_draw_y")})
    cut = F.col("x").between(F.col("s_x"), F.col("s_x") + F.col("s_w") - 1) & F.col("y").between(F.col("s_y"), F.col("s_y") + F.col("s_h") - 1)
    ink = at.filter(cut).groupBy(F.col("image_id.collage_id").alias("image_id"), "x", "y").agg(F.max_by(F.struct(*_RGBA), "image_id.slot_no").alias("p"))
    canvas = placed.select(F.col("collage_id").alias("image_id"), F.col("canvas_w").cast("long").alias("width"), F.col("canvas_h").cast("long").alias("height")).distinct()
    long = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    grid = canvas.withColumn("x", F.explode(long("width"))).withColumn("y", F.explode(long("height")))
    share = F.coalesce("p.a", F.lit(0)) / 255.0
    on_white = lambda c: rnd(F.round(F.coalesce(f"p.{c}", F.lit(0)) * share + 255 * (1 - share), 6)).cast("int").alias(c)
    return grid.join(ink, ["image_id", "x", "y"], "left").select(*_SIZE, "x", "y", *[on_white(c) for c in _RGB], F.lit(255).alias("a"))
