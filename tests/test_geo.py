"""Golden points on shapes of our own: hole and enclave, shared border, seam, pole, shore; and every
index against a plain computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from photolake.operators import geo

# a square with a hole, an enclave that fills the hole, a neighbour that shares a border, a far strip
SHAPES = {
    1: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]],
    2: [[(4, 4), (6, 4), (6, 6), (4, 6)]],
    3: [[(10, 0), (20, 0), (20, 10), (10, 10)]],
    4: [[(179.9, 0), (180, 0), (180, 5), (179.9, 5)]],
}
GRID = ("s", 1.0, 1.0, 0.0, 0.0)
TRANSFORM = "set_id string, scale_x double, scale_y double, tx double, ty double"


def index(spark, shapes, grids=(GRID,), cell=5.0, near=25.0):
    """Shapes in degrees; all are in every set."""
    rows = []
    for name, sx, sy, tx, ty in grids:
        rows += [(name, p, k, v, (x - tx) / sx, (y - ty) / sy) for p, rings in shapes.items() for k, ring in enumerate(rings) for v, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "set_id string, poly_id int, ring int, v int, x double, y double")
    return geo.index_boundaries(vertices, spark.createDataFrame(list(grids), TRANSFORM), cell, near)


def asked(spark, points, name="s"):
    return spark.createDataFrame([(k, name, float(x), float(y)) for k, (x, y) in enumerate(points)], "point_id long, set_id string, lon double, lat double")


def found(spark, boundaries, points, name="s"):
    return {r.point_id: r for r in geo.locate(asked(spark, points, name), boundaries).collect()}


@pytest.fixture(scope="module")
def boundaries(spark):
    return index(spark, SHAPES)


def test_holes_enclaves_borders_and_shores(spark, boundaries):
    got = found(spark, boundaries, [(5, 2), (5, 5), (9.99, 5), (10.01, 5), (-0.1, 5), (-0.5, 5), (30, -40), (-179.95, 2)])
    assert [got[k].poly_id for k in range(8)] == [1, 2, 1, 3, 1, None, None, None]
    assert got[4].approximate and got[4].offshore_km == pytest.approx(11.09, abs=0.01)
    assert not got[0].approximate and got[6].offshore_km is None


def test_negative_controls(spark):
    """Without its holes the first square swallows its enclave; with a smaller margin the shore is lost."""
    filled = index(spark, {k: v[:1] for k, v in SHAPES.items()})
    assert found(spark, filled, [(5, 5)])[0].poly_id == 1
    assert found(spark, index(spark, SHAPES, near=5.0), [(-0.1, 5)])[0].poly_id is None


def crossings(ring, x, y):
    odd = False
    for (xj, yj), (xi, yi) in zip([ring[-1], *ring[:-1]], ring, strict=True):
        odd ^= (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi
    return odd


def distance(ring, lon, lat):
    cos, best = math.cos(math.radians(lat)), math.inf
    for (xj, yj), (xi, yi) in zip([ring[-1], *ring[:-1]], ring, strict=True):
        ax, bx = (((x - lon + 180) % 360 - 180) * cos * 111.32 for x in (xi, xj))
        ay, by = (yi - lat) * 111.32, (yj - lat) * 111.32
        vx, vy = bx - ax, by - ay
        t = min(1, max(0, -(ax * vx + ay * vy) / (vx * vx + vy * vy))) if vx or vy else 0
        best = min(best, math.hypot(ax + t * vx, ay + t * vy))
    return best


def brute(shapes, points, near):
    out = []
    for lon, lat in points:
        inside = [p for p, (outer, *holes) in sorted(shapes.items()) if crossings(outer, lon, lat) and not any(crossings(h, lon, lat) for h in holes)]
        span = near / 111.32
        wide = span / max(0.02, math.cos(math.radians(lat)))
        boxed = [p for p, ([*outer], *_) in shapes.items() if min(x for x, _ in outer) - wide <= lon <= max(x for x, _ in outer) + wide and min(y for _, y in outer) - span <= lat <= max(y for _, y in outer) + span]
        close = sorted((km, p) for p in boxed for km in [min(distance(r, lon, lat) for r in shapes[p])] if km < near)
        out.append((inside[0], None) if inside else (close[0][1], close[0][0]) if close else (None, None))
    return out


def star(rng, x, y, size, corners):
    """A ring without crossings, so jagged that cells are cut in every way."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + size * r * math.cos(t), y + size * r * math.sin(t)) for t in turns for r in [rng.uniform(0.3, 1)]]


@pytest.mark.parametrize("cell", [0.31, 1.0, 7.0, 400.0])
def test_cells_do_not_change_the_answer(spark, cell):
    rng = random.Random(3)
    shapes = {k: [star(rng, rng.uniform(-20, 20), rng.uniform(40, 70), rng.uniform(1, 8), 40)] for k in range(8)}
    shapes[0].append([(x * 0.2 + shapes[0][0][0][0] * 0.8, y * 0.2 + shapes[0][0][0][1] * 0.8) for x, y in shapes[1][0]])
    # level and upright edges, some on the rims of cells, and a hole of that kind
    shapes[8] = [[(-24, 35), (-3.5, 35), (-3.5, 41.3), (-9, 41.3), (-9, 50.4), (-24, 50.4)], [(-20, 37), (-13, 37), (-13, 42), (-20, 42)]]
    points = [(rng.uniform(-28, 28), rng.uniform(30, 80)) for _ in range(400)] + [(x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.2, 0.2)) for r in shapes.values() for x, y in r[0][::2]]
    points += [(rng.uniform(-25, -2), y + rng.uniform(-0.3, 0.3)) for y in (35, 37, 41.3, 42, 50.4) for _ in range(20)]
    grids = (GRID, ("wide", 0.01, 0.1, -33.0, 7.0), ("tall", 0.5, 0.004, 5.0, -90.0))
    boundaries, want = index(spark, shapes, grids, cell), brute(shapes, points, 25.0)
    assert sum(w[1] is not None for w in want) > 50 and len({w[0] for w in want}) > 6
    for name in ("s", "wide", "tall"):
        got = found(spark, boundaries, points, name)
        assert [got[k].poly_id for k in range(len(points))] == [w[0] for w in want]
        assert all(w[1] is None or got[k].offshore_km == pytest.approx(w[1], abs=1e-6) for k, w in enumerate(want))


def test_the_seam_and_the_poles(spark):
    """Distances fold at 180 degrees where a polygon's box reaches both sides; near a pole longitudes
    are close together."""
    shapes = {1: [[(-180, 10), (-179, 10), (-179, 12), (-180, 12)]], 2: [[(-180, -50), (180, -50), (180, -49), (0, -48.9), (-180, -49)]], 3: [[(10, 89.9), (100, 89.9), (100, 89.95), (10, 89.95)]]}
    points = [(179.95, 11), (-180.0, 11), (179.99, -48.95), (-179.99, -48.8), (60, 89.85), (100.5, 89.92), (101, 89.5), (9.9, 88.86)]
    got = found(spark, index(spark, shapes), points)
    # the first polygon's box does not wrap, so the point across the seam is not its own
    assert [got[k].poly_id for k in range(8)] == [None, 1, 2, 2, 3, 3, None, None]
    for k in (2, 3, 4, 5):
        want = brute({p: shapes[p] for p in (got[k].poly_id,)}, [points[k]], 25.0)[0][1]
        assert got[k].offshore_km == pytest.approx(want, abs=1e-6)


def test_a_ring_of_many_vertices_stays_in_parts(spark):
    """No row of the index holds a ring, and a point meets a small part of it."""
    n = 100_000
    turn = F.col("v") * (2 * math.pi / n)
    ring = spark.range(n).select(F.lit("s").alias("set_id"), F.lit(1).alias("poly_id"), F.lit(0).alias("ring"), F.col("id").alias("v"))
    ring = ring.withColumns({"x": 30 * F.cos(turn) * (1 + 0.01 * F.sin(turn * 999)), "y": 30 * F.sin(turn) * (1 + 0.01 * F.sin(turn * 999))})
    boundaries = geo.index_boundaries(ring, spark.createDataFrame([GRID], TRANSFORM), 1.0, 25.0)
    rng = random.Random(1)
    points = [(rng.uniform(-32, 32), rng.uniform(-32, 32)) for _ in range(300)] + [(0, 0), (29.5, 0.1)]
    got = found(spark, boundaries, points)
    rim = lambda x, y: 30 * (1 + 0.01 * math.sin(999 * (math.atan2(y, x) % (2 * math.pi))))
    sure = [(k, p) for k, p in enumerate(points) if abs(math.hypot(*p) - 30) > 0.31]
    assert all((got[k].poly_id == 1 and not got[k].approximate) == (math.hypot(*p) < rim(*p)) for k, p in sure)
    assert all(dict(t.dtypes).get("edges") is None for t in (boundaries.cells, boundaries.slabs, boundaries.borders))
    widest = boundaries.slabs.groupBy("cy").count().agg(F.max("count")).head()[0]
    assert widest < n / 10


def test_no_boundaries_no_points(spark, boundaries):
    assert found(spark, boundaries, []) == {}
    empty = index(spark, {})
    assert found(spark, empty, [(1, 1)])[0].is_world
    assert found(spark, boundaries, [(5, 2)], "no such set")[0].poly_id is None


@pytest.mark.parametrize("most", [1, 4, 64])
def test_nearest_place_is_exact_at_any_leaf_size(spark, most):
    rng = random.Random(7)
    grids = {"a": (0.01, 0.1, -50.0, 30.0), "b": (0.2, 0.02, 0.0, -10.0)}
    places = []
    for code, name in ((1, "a"), (2, "b")):
        for k in range(300):
            near = rng.random() < 0.6  # most towns in one small cluster
            lon, lat = (rng.uniform(10, 11), rng.uniform(40, 41)) if near else (rng.uniform(-40, 40), rng.uniform(30, 85))
            sx, sy, tx, ty = grids[name]
            places.append((name, code, k, f"t{k}", round((lon - tx) / sx), round((lat - ty) / sy)))
    places += [("a", 1, 900 + k, f"same{k}", 100, 100) for k in range(50)]
    transforms = spark.createDataFrame([(n, *g) for n, g in grids.items()], TRANSFORM)
    towns = geo.index_towns(spark.createDataFrame(places, "set_id string, code int, ord int, name string, qx int, qy int"), transforms, most)
    assert towns.leaves.groupBy("code", "level", "cx", "cy").count().agg(F.max("count")).head()[0] <= most
    points = [(k, rng.choice([1, 2, 3]), rng.uniform(-60, 60), rng.uniform(20, 89)) for k in range(300)] + [(900, 1, -49.0, 40.0)]
    got = {r.point_id: r for r in geo.nearest_place(spark.createDataFrame(points, "point_id int, code int, lon double, lat double"), towns).collect()}
    assert got[900].place == "same0"
    for k, code, lon, lat in points:
        scale = max(0.02, math.cos(math.radians(lat)))
        own = [(((qy * grids[n][1] + grids[n][3]) - lat) ** 2 + (((qx * grids[n][0] + grids[n][2]) - lon) * scale) ** 2, o, name) for n, c, o, name, qx, qy in places if c == code]
        assert (k in got) == bool(own)
        if own:
            sq, _, name = min(own)
            assert got[k].place == name and got[k].place_km == pytest.approx(math.sqrt(sq) * 111.32, abs=1e-6)


def test_gazetteer_lines_keep_their_order_over_files_and_splits(spark, tmp_path):
    from photolake.sources.boundaries import read_gazetteer

    n = 0
    for name in ("a.txt", "b.txt", "c.txt"):
        with open(tmp_path / name, "w") as f:
            for _ in range(700):
                f.write("\t".join(["id", f"town {n}", "", "", "1.5", "2.5", "", "", "XX"]) + "\n")
                n += 1
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        lines = read_gazetteer(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        assert sorted((r.ord, r.name) for r in lines.collect()) == [(k, f"town {k}") for k in range(n)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_points_are_not_grouped_on_their_way_to_towns(spark):
    """Lists of nodes by point and rows by town had to be sorted; only the nearest towns of few leaves meet."""
    grid = spark.createDataFrame([("c1", 0.01, 0.01, 0.0, 0.0)], "set_id string, scale_x double, scale_y double, tx double, ty double")
    places = spark.range(900).selectExpr("'c1' set_id", "1 code", "id ord", "concat('t', id) name", "int(id % 30) * 7 qx", "int(id div 30) * 5 qy")
    towns = geo.index_towns(places, grid, 4)
    most, whole = towns.leaves.agg(F.max(F.size("towns")), F.sum(F.size("towns"))).head()
    assert most <= 4 and whole == 900 and towns.levels >= 2
    points = spark.range(300).selectExpr("id point_id", "1 code", "id % 17 * 0.13 lon", "id % 23 * 0.07 lat")
    found = geo.nearest_place(points, towns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and found.count() == 300
