"""Pixel operators against picture-at-a-time versions in NumPy."""

import numpy as np
import pytest

from photolake.functions import cut
from photolake.operators import pixels

SCHEMA = "image_id long, width int, height int, x int, y int, r int, g int, b int, a int"


def table(spark, pictures):
    rows = [(k, p.shape[1], p.shape[0], x, y, *map(int, p[y, x])) for k, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, np.full((r.height, r.width, 4), -1))[r.y, r.x] = (r.r, r.g, r.b, r.a)
    assert all((p >= 0).all() for p in out.values())
    return out


def flood(mask):
    left, found = {tuple(map(int, p)) for p in np.argwhere(mask)}, []
    while left:
        todo = [left.pop()]
        blob = []
        while todo:
            y, x = todo.pop()
            blob.append((x, y))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        xs, ys = zip(*blob, strict=True)
        found.append((min(xs), min(ys), max(xs), max(ys), len(blob)))
    return sorted(found)


def small(p, wide, high):
    """Halved while possible, the last odd row or column alone; then bilinear."""
    p = p.astype(float)
    while p.shape[1] >= 2 * wide and p.shape[0] >= 2 * high:
        p = np.array([[p[y : y + 2, x : x + 2].mean((0, 1)) for x in range(0, p.shape[1], 2)] for y in range(0, p.shape[0], 2)])
    out = np.zeros((high, wide, 4))
    for oy in range(high):
        for ox in range(wide):
            y, x = (min(max((o + 0.5) * n / m - 0.5, 0), n - 1) for o, n, m in ((oy, p.shape[0], high), (ox, p.shape[1], wide)))
            for sy in {int(y), min(int(y) + 1, p.shape[0] - 1)}:
                for sx in {int(x), min(int(x) + 1, p.shape[1] - 1)}:
                    out[oy, ox] += p[sy, sx] * (1 - abs(y - sy)) * (1 - abs(x - sx))
    return np.floor(np.round(out, 6) + 0.5).astype(int)


@pytest.mark.parametrize("tile", [1, 2, 3, 7, 64])
def test_blobs_equal_flood_fill(spark, tile):
    rng = np.random.default_rng(4)
    masks = {k: rng.random((rng.integers(1, 20), rng.integers(1, 20))) < share for k, share in enumerate((0.1, 0.3, 0.5, 0.7) * 5)}
    spiral = np.zeros((9, 9), bool)
    spiral[[0, 8]] = spiral[2:, 0] = spiral[:, 8] = spiral[2, :7] = spiral[2:7, 6] = spiral[6, 2:7] = True
    masks |= {90: spiral, 91: np.zeros((3, 3), bool)}
    rows = [(k, m.shape[1], m.shape[0], int(x), int(y)) for k, m in masks.items() for y, x in np.argwhere(m)]
    got = {k: [] for k in masks}
    for r in pixels.content_blobs(spark.createDataFrame(rows, "image_id long, width int, height int, x int, y int"), tile).collect():
        got[r.image_id].append((r.x0, r.y0, r.x1, r.y1, r.n))
    assert {k: sorted(v) for k, v in got.items()} == {k: flood(m) for k, m in masks.items()}


def test_bounds_leave_specks_out(spark):
    spot = np.full((40, 40, 4), 255)
    spot[10:20, 5:30, :3] = 0
    speck = spot.copy()
    speck[38, 38, :3] = 0
    lone = np.full((40, 40, 4), 255)
    lone[3, 4, :3] = 0
    rows = {r.image_id: r for r in pixels.analyse(table(spark, {1: spot, 2: np.full((9, 9, 4), 7), 3: speck, 4: lone})).collect()}
    box = lambda k: (rows[k].box_x, rows[k].box_y, rows[k].box_w, rows[k].box_h)
    assert box(1) == box(3) == (5, 10, 25, 10) and box(4) == (4, 3, 1, 1)
    assert (rows[3].content, rows[3].blobs) == (251, 2) and box(2) == (None,) * 4 and (rows[2].content, rows[2].blobs) == (0, 0)
    assert rows[2].has_alpha and not rows[1].has_alpha and rows[1].bg_r == 255


@pytest.mark.parametrize("wide, high", [(4, 4), (3, 2), (1, 1), (20, 9)])
def test_resize(spark, wide, high):
    rng = np.random.default_rng(wide)
    pictures = {k: rng.integers(0, 256, (h, w, 4)) for k, (h, w) in enumerate(((8, 8), (13, 7), (9, 17), (1, 5)))}
    sizes = spark.createDataFrame([(k, wide, high) for k in pictures], "image_id long, out_w int, out_h int")
    got = arrays(pixels.resize(table(spark, pictures), sizes))
    for k, p in pictures.items():
        assert (got[k] == small(p, wide, high)).all()


def test_crop_paint_and_flatten(spark):
    p = np.zeros((6, 8, 4), int)
    p[..., 0], p[..., 3] = np.arange(8)[None] * 10, 51
    whole = table(spark, {1: p, 2: p})
    cut = arrays(pixels.crop(whole, spark.createDataFrame([(1, 2, 1, 3, 4)], "image_id long, cx int, cy int, cw int, ch int")))
    assert (cut[1] == p[1:5, 2:5]).all() and (cut[2] == p).all()
    boxes = spark.createDataFrame(
        [(1, 1, 1, 1, 3, 2, "#0a0b0c"), (1, 2, 2, 2, 9, 9, "#ffffff"), (1, 3, 0, 0, 0, 2, "#123456")], "image_id long, ord int, bx int, by int, bw int, bh int, fill string"
    )
    want = p.copy()
    want[1:3, 1:4] = (10, 11, 12, 255)
    want[2:, 2:] = 255
    painted = arrays(pixels.paint_boxes(whole, boxes))
    assert (painted[1] == want).all() and (painted[2] == p).all()
    from pyspark.sql import functions as F

    fills = spark.createDataFrame([(1, "#0000ff"), (2, None)], "image_id long, fill string")
    flat = arrays(pixels.flatten(whole, fills))
    assert (flat[1][0, 4] == (8, 0, 204, 255)).all() and (flat[2] == p).all()
    assert (arrays(pixels.flatten(whole, fills, F.lit(True)))[2][0, 4] == (212, 204, 204, 255)).all()


@pytest.mark.parametrize("style", ["blur", "pixels"])
def test_faces(spark, style):
    p = np.random.default_rng(1).integers(0, 256, (12, 10, 4))
    regions = [(1, 0, 1, 2, 6, 7, 2, 3), (1, 1, 4, 5, 6, 6, 3, 3)]
    want = p.copy()
    for _, _, bx, by, bw, bh, tw, th in regions:
        cell = small(p[by : by + bh, bx : bx + bw], tw, th)
        back = small(cell, bw, bh) if style == "blur" else cell[np.arange(bh) * th // bh][:, np.arange(bw) * tw // bw]
        want[by : by + bh, bx : bx + bw] = back
    asked = spark.createDataFrame(regions, "image_id long, face_no int, bx int, by int, bw int, bh int, tw int, th int")
    got = arrays(pixels.redact_faces(table(spark, {1: p, 2: p}), asked, style))
    assert (got[1] == want).all() and (got[2] == p).all()


def test_no_pictures(spark):
    none = table(spark, {1: np.zeros((1, 1, 4), int)}).limit(0)
    assert pixels.analyse(none).count() == 0
    assert pixels.resize(none, spark.createDataFrame([(1, 2, 2)], "image_id long, out_w int, out_h int")).count() == 0


def test_files_and_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from photolake.sources import files

    rng = np.random.default_rng(8)
    made = {k: rng.integers(0, 256, (rng.integers(1, 9), rng.integers(1, 9), 4)) for k in range(5)}
    coded = pixels.to_png(table(spark, made)).withColumn("name", F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    files.write_files(coded, str(tmp_path))
    read = files.read_rasters(spark, str(tmp_path)).withColumn("image_id", F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long"))
    got = arrays(pixels.from_rasters(read))
    assert set(got) == set(made) and all((got[k] == made[k]).all() for k in made)
    grey = spark.createDataFrame([(1, 3, 2, 1, bytearray([0, 9, 255, 128, 1, 2]))], "image_id long, width int, height int, channels int, data binary")
    assert arrays(pixels.from_rasters(grey))[1][:, :, 0].tolist() == [[0, 9, 255], [128, 1, 2]]


def test_scan_copies_and_boxes_outward(spark):
    """Content boxes of large pictures come from a copy and never lose a pixel to it."""
    rng = np.random.default_rng(3)
    made = {}
    for k, (h, w) in enumerate([(37, 61), (64, 20), (30, 30), (10, 9)]):
        p = np.full((h, w, 4), 255)
        y, x = rng.integers(1, h // 2), rng.integers(1, w // 2)
        p[y : y + h // 3, x : x + w // 3, :3] = 0
        made[k] = p
    rows = {r.image_id: r for r in pixels.analyse(table(spark, made), longest=30).collect()}
    for k, p in made.items():
        h, w = p.shape[:2]
        scale = min(1, 30 / max(h, w))
        copy = p if scale == 1 else small(p, max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)))
        ys, xs = np.nonzero(((copy[:, :, :3] - 255) ** 2).sum(2) > 3 * 24 * 24)
        left, top = int(xs.min() / scale), int(ys.min() / scale)
        right, bottom = min(w, -int(-(xs.max() + 1) * (1 / scale) // 1)), min(h, -int(-(ys.max() + 1) * (1 / scale) // 1))
        assert (rows[k].box_x, rows[k].box_y, rows[k].box_w, rows[k].box_h) == (left, top, right - left, bottom - top)
        dark = np.argwhere(p[:, :, 0] == 0)
        assert left <= dark[:, 1].min() and right > dark[:, 1].max() and top <= dark[:, 0].min() and bottom > dark[:, 0].max()


def test_pixels_outside_all_regions_pass_by(spark):
    """No join on the picture alone: regions meet the pixels of their rows."""
    made = {1: np.full((6, 6, 4), 100)}
    faces = spark.createDataFrame([(1, 0, 1, 1, 2, 2, 1, 1)], "image_id long, face_no int, bx int, by int, bw int, bh int, tw int, th int")
    out = pixels.redact_faces(table(spark, made), faces)
    assert (arrays(out)[1] == 100).all()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "face_image" not in plan


def test_labels_are_not_broadcast(spark, monkeypatch):
    """Links and labels grow with the pictures, so however small their files are no join sends them to the driver."""
    plans = []
    monkeypatch.setattr(pixels, "settle", lambda df: plans.append(df) or cut.settle(df))
    mask = spark.range(400).selectExpr("id div 100 image_id", "10 width", "10 height", "cast(id % 10 as int) x", "cast(id % 100 div 10 as int) y")
    found = pixels.content_blobs(mask, tile=3)
    assert {r.n for r in found.collect()} == {100} and found.count() == 4
    told = [df._jdf.queryExecution().executedPlan().toString() for df in [*plans, found]]
    assert len(told) > 3 and not any("Broadcast" in t for t in told)
