"""Offline reverse geocoding: points against quantised polygons, borders and towns.

Every boundary set has a grid of its own, with a scale for each axis, as a row of a table. Polygons are
never met as a whole: cells tell where one is filled, rows of cells lead to its edges, and a grid as
fine as the margin leads to borders. What is broadcast is counted first. Every "first wins" rule has
an ordinal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import sent, settle

KM_PER_DEGREE = 111.32
COUNTRY_NEAR_KM, REGION_NEAR_KM = 25.0, 3.0


def decode_arcs(raw: DataFrame) -> DataFrame:
    """(set_id, arc, deltas array of [dx, dy]) to absolute points: (set_id, arc, points)."""
    place = Window.partitionBy("set_id", "arc").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    each = raw.select("set_id", "arc", F.posexplode("deltas").alias("v", "d"))
    points = each.select("set_id", "arc", "v", F.sum(F.col("d")[0]).over(place).alias("x"), F.sum(F.col("d")[1]).over(place).alias("y"))
    return points.groupBy("set_id", "arc").agg(F.array_sort(F.collect_list(F.struct("v", "x", "y"))).alias("p")).select(
        "set_id", "arc", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")
    )


def stitch_rings(rings: DataFrame, arcs: DataFrame) -> DataFrame:
    """(set_id, poly_id, ring, refs) to (set_id, poly_id, ring, points).

    A negative ref ``~i`` is arc i backwards; each arc after the first drops the point it shares.
    """
    refs = rings.select("set_id", "poly_id", "ring", F.posexplode("refs").alias("k", "ref"))
    refs = refs.withColumn("arc", F.when(F.col("ref") < 0, -F.col("ref") - 1).otherwise(F.col("ref")))
    ordered = F.when(F.col("ref") < 0, F.reverse("points")).otherwise(F.col("points"))
    parts = refs.join(arcs, ["set_id", "arc"]).withColumn("part", F.when(F.col("k") == 0, ordered).otherwise(F.slice(ordered, 2, F.greatest(F.size("points") - 1, F.lit(0)))))
    return parts.groupBy("set_id", "poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p")).select(
        "set_id", "poly_id", "ring", F.flatten("p.part").alias("points")
    )


def ring_vertices(rings: DataFrame) -> DataFrame:
    """(set_id, poly_id, ring, points), as ``stitch_rings`` gives them, to vertices (.., v, x, y) without
    the point that closes a ring."""
    open_ring = F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0)))
    return rings.select("set_id", "poly_id", "ring", F.posexplode(open_ring).alias("v", "q")).select(
        "set_id", "poly_id", "ring", "v", F.col("q.x").cast("double").alias("x"), F.col("q.y").cast("double").alias("y")
    )


def polygon_bounds(vertices: DataFrame) -> DataFrame:
    """(set_id, poly_id, minx, miny, maxx, maxy) of the outer rings."""
    outer = vertices.filter("ring = 0").groupBy("set_id", "poly_id")
    return outer.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def ring_edges(vertices: DataFrame) -> DataFrame:
    """(set_id, poly_id, ring, xj, yj, xi, yi): every ring's edges, one a row, each from the vertex
    before to the vertex itself, the first from the last."""
    ring = Window.partitionBy("set_id", "poly_id", "ring").orderBy("v")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.lag(c).over(ring), F.last(c).over(whole))
    return vertices.select("set_id", "poly_id", "ring", before("x").alias("xj"), before("y").alias("yj"), F.col("x").alias("xi"), F.col("y").alias("yi"))


def quantise(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Degrees (set_id, lon, lat) to the grid of each point's set, without rounding; the columns of the
    set's transform stay. Points of a set that has none go."""
    return points.join(transforms, "set_id").withColumns({"x": (F.col("lon") - F.col("tx")) / F.col("scale_x"), "y": (F.col("lat") - F.col("ty")) / F.col("scale_y")})


def dequantise(x: Column, scale: Column, translate: Column) -> Column:
    return x * scale + translate


@dataclass(frozen=True)
class Boundaries:
    """Polygons of any number of sets, ready to be asked by points. Every table is settled.

    transforms: set_id, scale_x, scale_y, tx, ty, cell_x, cell_y; polygons: set_id, poly_id, minx, miny,
    maxx, maxy; cells: the grid cells that a polygon fills (``within``) or that its edges may touch;
    slabs: edges by polygon and row of cells; borders: edges by cells of ``near_km``'s width, with
    their polygon's box. Tables up to a bound of rows are broadcast, larger ones shuffle.
    """

    transforms: DataFrame
    polygons: DataFrame
    cells: DataFrame
    slabs: DataFrame
    borders: DataFrame
    near_km: float


def index_boundaries(vertices: DataFrame, transforms: DataFrame, cell_deg: float, near_km: float) -> Boundaries:
    """``vertices``: set_id, poly_id, ring (0 is the outer one), v, x, y on the grid of their set;
    ``transforms``: set_id, scale_x, scale_y, tx, ty, one row a set."""
    grids = transforms.select("set_id", "scale_x", "scale_y", "tx", "ty", (F.lit(cell_deg) / F.col("scale_x")).alias("cell_x"), (F.lit(cell_deg) / F.col("scale_y")).alias("cell_y"))
    grids = sent(settle(grids))
    polygons = settle(polygon_bounds(vertices))
    edges = settle(ring_edges(vertices).join(grids, "set_id"))
    return Boundaries(grids, sent(polygons), sent(settle(_cells(edges))), sent(settle(_slabs(edges))), sent(settle(_borders(edges, polygons, near_km))), near_km)


def _rows_between(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long"))


def _crossing(y: Column) -> tuple[Column, Column]:
    """Whether an edge spans ``y``, and where it meets it."""
    spans = (F.col("yi") > y) != (F.col("yj") > y)
    return spans, (F.col("xj") - F.col("xi")) * (y - F.col("yi")) / F.nullif(F.col("yj") - F.col("yi"), F.lit(0.0)) + F.col("xi")


def _share(at: Column, i: Column, j: Column, level: float) -> Column:
    """How much of the way from ``i`` to ``j`` lies before ``at``, from 0 to 1; ``level`` if they are one."""
    return F.when(i == j, F.lit(level)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - i) / F.nullif(j - i, F.lit(0.0)))))


def _slabs(edges: DataFrame) -> DataFrame:
    """(set_id, poly_id, cy, ring, xj, yj, xi, yi): edges in each row of cells that they span. Level
    edges never cross a ray."""
    cy = _rows_between(F.least("yi", "yj") / F.col("cell_y"), F.greatest("yi", "yj") / F.col("cell_y"))
    return edges.filter("yi <> yj").select("set_id", "poly_id", F.explode(cy).alias("cy"), "ring", "xj", "yj", "xi", "yi")


def _cells(edges: DataFrame) -> DataFrame:
    """(set_id, cx, cy, poly_id, within): cells that edges touch, and cells that lie in the outer ring
    and in no hole. A cell is in a ring if its middle is; what no edge touches is in it as a whole."""
    tiny = 1e-9
    y, x = (lambda k: F.col(f"y{k}")), (lambda k: F.col(f"x{k}"))
    rows = edges.withColumn("cy", F.explode(_rows_between(F.least(y("i"), y("j")) / F.col("cell_y") - tiny, F.greatest(y("i"), y("j")) / F.col("cell_y") + tiny)))
    # the part of an edge within the row, by its share of the way from i to j
    at = lambda edge, level: x("i") + (x("j") - x("i")) * _share(edge * F.col("cell_y"), y("i"), y("j"), level)
    ends = at(F.col("cy"), 0.0), at(F.col("cy") + 1, 1.0)
    touched = rows.select("set_id", "poly_id", "cy", F.explode(_rows_between(F.least(*ends) / F.col("cell_x") - tiny, F.greatest(*ends) / F.col("cell_x") + tiny)).alias("cx")).distinct()

    middle = (F.col("cy") + 0.5) * F.col("cell_y")
    spans, meets = _crossing(middle)
    cut = edges.withColumn("cy", F.explode(_rows_between(F.least("yi", "yj") / F.col("cell_y"), F.greatest("yi", "yj") / F.col("cell_y")))).filter(spans)
    cuts = cut.groupBy("set_id", "poly_id", "ring", "cy").agg(F.array_sort(F.collect_list(meets / F.col("cell_x"))).alias("c"))
    # in a ring from each odd cut to the next: cells whose middle lies there
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2) - 1), lambda k: F.struct(F.ceil(F.get("c", (2 * k).cast("int")) - 0.5).alias("a"), (F.ceil(F.get("c", (2 * k + 1).cast("int")) - 0.5) - 1).alias("b")))
    runs = cuts.filter("size(c) > 1").select("set_id", "poly_id", "ring", "cy", F.explode(pairs).alias("p")).filter("p.b >= p.a")
    filled = runs.select("set_id", "poly_id", "ring", "cy", F.explode(F.sequence("p.a", "p.b")).alias("cx"))
    keys = ["set_id", "poly_id", "cx", "cy"]
    whole = filled.filter("ring = 0").join(touched.unionByName(filled.filter("ring > 0").select(touched.columns)), keys, "left_anti")
    columns = ["set_id", "cx", "cy", "poly_id"]
    return whole.select(*columns, F.lit(True).alias("within")).unionByName(touched.select(*columns, F.lit(False).alias("within")))


def _near_cell(lat_row: Column, near_km: float) -> Column:
    """Degrees of longitude that ``near_km`` spans at most in a row of latitudes of that height; null
    where rows are so near a pole that one cell holds all longitudes."""
    span = near_km / KM_PER_DEGREE
    far = F.least(F.lit(90.0), F.greatest(F.abs(lat_row * span), F.abs((lat_row + 1) * span)))
    cos = F.cos(far * (math.pi / 180))
    return F.when(cos > 0.02, F.lit(span * (1 + 1e-9)) / cos)


def _borders(edges: DataFrame, polygons: DataFrame, near_km: float) -> DataFrame:
    """Edges in degrees, in every cell whose points may be within ``near_km`` of them: rows are as high
    as that, cells as wide as that is at their row. Edges near 180 degrees are seen from both sides."""
    span = near_km / KM_PER_DEGREE
    deg = edges.join(polygons, ["set_id", "poly_id"]).select(
        "set_id", "poly_id", "minx", "miny", "maxx", "maxy",
        *[dequantise(F.col(f"{c}{k}"), F.col(f"scale_{c}"), F.col(f"t{c}")).alias(f"{n}_{k}") for c, n in (("x", "lon"), ("y", "lat")) for k in "ij"],
    )
    low, high = F.least("lat_i", "lat_j"), F.greatest("lat_i", "lat_j")
    rows = deg.withColumn("row", F.explode(_rows_between(low / span - (1 + 1e-9), high / span + (1 + 1e-9)))).withColumn("width", _near_cell(F.col("row"), near_km))
    # the part of an edge that points of the row can be near
    lon = lambda lat, level: F.col("lon_i") + (F.col("lon_j") - F.col("lon_i")) * _share(lat, F.col("lat_i"), F.col("lat_j"), level)
    ends = lon((F.col("row") - 1 - 1e-9) * span, 0.0), lon((F.col("row") + 2 + 1e-9) * span, 1.0)
    rows = rows.withColumns({"low": F.least(*ends), "high": F.greatest(*ends)})
    seen = lambda turn: (F.col("low") + turn - F.col("width") <= 180) & (F.col("high") + turn + F.col("width") >= -180)
    turned = rows.withColumn("turn", F.explode(F.when(F.col("width").isNull(), F.array(F.lit(0.0))).otherwise(F.filter(F.array(*map(F.lit, (0.0, 360.0, -360.0))), seen))))
    side = lambda c, way: (F.col(c) + F.col("turn")) / F.col("width") + way * (1 + 1e-9)
    cols = F.when(F.col("width").isNull(), F.array(F.lit(0).cast("long"))).otherwise(_rows_between(side("low", -1), side("high", 1)))
    return turned.select("set_id", "row", F.explode(cols).alias("col"), "poly_id", "lon_i", "lat_i", "lon_j", "lat_j", "minx", "miny", "maxx", "maxy")


def placed(points: DataFrame, index: Boundaries) -> DataFrame:
    """``points`` (point_id, set_id, lon, lat) on their set's grid, dealt by point_id, so that all that
    follows while tables are broadcast stays in its task."""
    at = quantise(points.repartition("point_id"), index.transforms)
    return at.withColumns({"cx": F.floor(F.col("x") / F.col("cell_x")).cast("long"), "cy": F.floor(F.col("y") / F.col("cell_y")).cast("long")})


def join_points_polygons(at: DataFrame, index: Boundaries) -> DataFrame:
    """(point_id, poly_id) of the first polygon, by poly_id, that contains each point of ``at`` (from
    ``placed``): in its outer ring and in none of its holes, by even-odd ray casting.

    In cells that a polygon fills nothing is cast; elsewhere a ray meets the edges of its row alone.
    """
    met = at.select("point_id", "set_id", "x", "y", "cx", "cy").join(index.cells, ["set_id", "cx", "cy"])
    asked = met.withColumn("asked_id", F.when(~F.col("within"), F.col("poly_id")))
    rows = index.slabs.withColumnRenamed("poly_id", "asked_id")
    spans, meets = _crossing(F.col("y"))
    crossed = F.coalesce(F.sum(F.when(spans & (F.col("x") < meets), 1)), F.lit(0)) % 2 == 1
    rings = asked.join(rows, ["set_id", "asked_id", "cy"], "left").groupBy("point_id", "poly_id", "ring").agg(F.bool_or("within").alias("within"), crossed.alias("odd"))
    whole = rings.groupBy("point_id", "poly_id").agg(F.bool_or(F.col("within") | (F.col("odd") & (F.col("ring") == 0))).alias("inside"), F.coalesce(F.bool_or(F.col("odd") & (F.col("ring") > 0)), F.lit(False)).alias("hole"))
    return whole.filter("inside and not hole").groupBy("point_id").agg(F.min("poly_id").alias("poly_id"))


def with_segment_km(pairs: DataFrame, ceiling: float) -> DataFrame:
    """``pairs`` of points (lon, lat) and edges (lon_i, lat_i, lon_j, lat_j) with km, their distance in a
    flat frame at the point; null for edges outside the ceiling's box and from the ceiling on.
    Differences of longitude fold at 180 degrees."""
    lon, lat, lon_i, lat_i, lon_j, lat_j = (F.col(c) for c in ("lon", "lat", "lon_i", "lat_i", "lon_j", "lat_j"))
    span_lat = ceiling / KM_PER_DEGREE
    span_lon = F.lit(span_lat) / F.greatest(F.lit(0.02), F.col("_cos"))

    def px(q: Column) -> Column:
        d = q - lon
        return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d) * F.col("_cos") * KM_PER_DEGREE

    close = F.abs(lon_i - lon) < 180
    skip = (
        (F.least(lat_i, lat_j) - lat > span_lat)
        | (lat - F.greatest(lat_i, lat_j) > span_lat)
        | ((F.least(lon_i, lon_j) - lon > span_lon) & close)
        | ((lon - F.greatest(lon_i, lon_j) > span_lon) & close)
    )
    ax, ay, vx, vy, length = (F.col(c) for c in ("_ax", "_ay", "_vx", "_vy", "_length"))
    # each step's columns are used more than once by the next
    steps = pairs.withColumn("_cos", F.cos(lat * F.lit(math.pi) / F.lit(180.0)))
    steps = steps.withColumns({"_skip": skip, "_ax": px(lon_i), "_bx": px(lon_j), "_ay": (lat_i - lat) * KM_PER_DEGREE, "_by": (lat_j - lat) * KM_PER_DEGREE})
    steps = steps.withColumns({"_vx": F.col("_bx") - ax, "_vy": F.col("_by") - ay}).withColumn("_length", vx * vx + vy * vy)
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * vx + ay * vy) / F.nullif(length, F.lit(0.0)))))
    steps = steps.withColumn("_t", t).withColumns({"_dx": ax + F.col("_t") * vx, "_dy": ay + F.col("_t") * vy})
    steps = steps.withColumn("_km", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    return steps.withColumn("km", F.when(~F.col("_skip") & (F.col("_km") < ceiling), F.col("_km"))).select(*pairs.columns, "km")


def join_points_nearest_border(at: DataFrame, index: Boundaries) -> DataFrame:
    """(point_id, poly_id, km) of the nearest polygon strictly within the index's ``near_km`` of points
    that are in none; the first by poly_id on a tie.

    A point meets the edges of one cell of the border grid. Boxes do not wrap at the date line,
    distances do; an edge on the far side of the world, which the flat frame would draw right across
    it, is not met.
    """
    km, span = index.near_km, index.near_km / KM_PER_DEGREE
    asked = at.withColumn("row", F.floor(F.col("lat") / span).cast("long"))
    asked = asked.withColumn("col", F.coalesce(F.floor(F.col("lon") / _near_cell(F.col("row"), km)), F.lit(0)).cast("long"))
    met = asked.join(index.borders, ["set_id", "row", "col"])
    margin_y = F.lit(span) / F.col("scale_y")
    margin_x = F.lit(span) / F.col("scale_x") / F.greatest(F.lit(0.02), F.cos(F.col("lat") * math.pi / 180))
    close = F.col("x").between(F.col("minx") - margin_x, F.col("maxx") + margin_x) & F.col("y").between(F.col("miny") - margin_y, F.col("maxy") + margin_y)
    near = with_segment_km(met.filter(close), km)
    best = near.groupBy("point_id").agg(F.min(F.when(F.col("km").isNotNull(), F.struct("km", "poly_id"))).alias("b"))
    return best.filter("b is not null").select("point_id", "b.poly_id", "b.km")


def locate(points: DataFrame, index: Boundaries) -> DataFrame:
    """Every point with poly_id, approximate, offshore_km and is_world: inside first, then near; a
    point that no polygon is near has no poly_id and stands for the whole world.

    ``points``: point_id, set_id (which set to ask; none is found in a set that is not there), lon, lat.
    """
    at = placed(points, index)
    inside = settle(join_points_polygons(at, index)).withColumn("km", F.lit(None).cast("double"))
    missed = at.join(inside.select("point_id"), "point_id", "left_anti")
    found = inside.unionByName(join_points_nearest_border(missed, index))
    return points.join(found, "point_id", "left").withColumns(
        {"approximate": F.col("km").isNotNull(), "offshore_km": F.col("km"), "is_world": F.col("poly_id").isNull()}
    ).drop("km")


def country_code(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``asked`` (with country) and the code that the first of ``names`` (ord, name, code) of that name
    has; null where there is none."""
    first = names.groupBy(F.col("name").alias("country")).agg(F.min_by(F.struct("code"), "ord").alias("first"))
    return asked.join(first.select("country", F.col("first.code").alias("code")), "country", "left")


@dataclass(frozen=True)
class Towns:
    """Towns as a quadtree for each code: nodes (code, level, cx, cy, kids: level, cx, cy, is_leaf, and the
    box w, s, e, n of their towns), the first node of each code (a kid as ``node``), and the leaves (code,
    level, cx, cy, towns: ord, name, lon, lat), at most ``most`` to a leaf."""

    nodes: DataFrame
    roots: DataFrame
    leaves: DataFrame
    levels: int


def index_towns(places: DataFrame, transforms: DataFrame, most: int = 64) -> Towns:
    """``places``: set_id, code, ord, name, qx, qy on the grid of their set. Of towns at one spot only
    the first can be anyone's nearest, and stays; so every leaf can be made small enough.

    A node is split into 16 while it has more than ``most`` towns.
    """
    spots = places.groupBy("set_id", "code", "qx", "qy").agg(F.min_by(F.struct("ord", "name"), "ord").alias("t")).join(transforms, "set_id")
    spots = settle(spots.select("code", "t.ord", "t.name", dequantise(F.col("qx"), F.col("scale_x"), F.col("tx")).alias("lon"), dequantise(F.col("qy"), F.col("scale_y"), F.col("ty")).alias("lat")))
    finest = transforms.agg(F.min(F.least("scale_x", "scale_y"))).head()[0] or 1.0
    deepest = max(2, math.ceil(math.log2(720 / finest))) + 2 & ~1
    size = F.lit(720.0) / F.pow(F.lit(2.0), F.col("level"))
    each = spots.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest), F.lit(2))))
    each = each.withColumns({"cx": F.floor((F.col("lon") + 360) / size).cast("long"), "cy": F.floor((F.col("lat") + 360) / size).cast("long")})
    keys = ["code", "level", "cx", "cy"]
    nodes = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("towns"), *[f(c).alias(a) for f, c, a in ((F.min, "lon", "w"), (F.min, "lat", "s"), (F.max, "lon", "e"), (F.max, "lat", "n"))])
    nodes = settle(nodes)
    total = nodes.filter("level = 0").groupBy("code").agg(F.sum("towns").alias("total"))
    # the deepest node that has all of a code's towns, unless a node above it is small enough
    whole = nodes.join(total, "code").filter("towns = total")
    small = F.min(F.when(F.col("towns") <= most, F.col("level")))
    first = whole.groupBy("code").agg(F.coalesce(small, F.max("level")).alias("first"))
    wide = total.join(first, "code", "left").select("code", F.coalesce("first", F.lit(0)).alias("first"))
    up = nodes.select("code", (F.col("level") + 2).alias("level"), F.col("cx").alias("up_x"), F.col("cy").alias("up_y"), F.col("towns").alias("above"))
    split = nodes.withColumns({"up_x": F.floor(F.col("cx") / 4), "up_y": F.floor(F.col("cy") / 4)}).join(up, ["code", "level", "up_x", "up_y"], "left").join(wide, "code")
    kept = split.filter((F.col("level") == F.col("first")) | ((F.col("level") > F.col("first")) & (F.col("above") > most)))
    kept = settle(kept.select(*keys, "up_x", "up_y", "w", "s", "e", "n", (F.col("towns") <= most).alias("is_leaf"), (F.col("level") == F.col("first")).alias("is_root")))
    kid = F.struct("level", "cx", "cy", "is_leaf", "w", "s", "e", "n")
    inner = kept.filter("not is_root").groupBy("code", (F.col("level") - 2).alias("level"), F.col("up_x").alias("cx"), F.col("up_y").alias("cy")).agg(F.collect_list(kid).alias("kids"))
    filled = each.join(kept.filter("is_leaf").select(*keys), keys).groupBy(*keys).agg(F.collect_list(F.struct("ord", "name", "lon", "lat")).alias("towns"))
    depth = kept.groupBy("code").agg((F.max("level") - F.min("level")).alias("d")).agg(F.max("d")).head()[0] or 0
    few = 1_000_000 // most  # rows hold up to so many towns
    return Towns(sent(settle(inner), few), sent(settle(kept.filter("is_root").select("code", kid.alias("node")))), sent(settle(filled), few), depth)


def nearest_place(located: DataFrame, towns: Towns) -> DataFrame:
    """(point_id, place, place_km): the nearest town of the point's code by scaled squared degrees; the
    first by ord on a tie. Longitudes do not wrap. ``located``: point_id, code, lon, lat.

    Each point first goes down its code's tree by the nearest box alone. The nearest town of the leaf it
    comes to is a bound, with which it goes down again by every box that may hold a nearer one, or one
    as near. A row is a point and one node, so nothing is grouped before the last step, which has a row
    for each leaf met.
    """
    k = F.greatest(F.lit(0.02), F.cos(F.col("lat") * math.pi / 180))
    points = located.repartition("point_id").select("point_id", "code", "lon", "lat", k.alias("k"))
    own = ["point_id", "code", "lon", "lat", "k"]
    at = points.join(towns.roots, "code")
    for _ in range(0, towns.levels, 2):
        closest = F.array_min(F.transform("kids", lambda n: F.struct(_near(n).alias("near"), n.alias("node"))))["node"]
        at = _under(at, towns.nodes, own).select(*own, F.when(F.col("kids").isNull(), F.col("node")).otherwise(closest).alias("node"))
    at = _at_leaves(at, towns.leaves, own).select(*own, _best()["sq"].alias("bound")).join(towns.roots, "code")
    own = [*own, "bound"]
    for _ in range(0, towns.levels, 2):
        within = F.filter("kids", lambda n: _near(n) <= F.col("bound"))
        at = _under(at, towns.nodes, own).select(*own, F.explode(F.when(F.col("kids").isNull(), F.array("node")).otherwise(within)).alias("node"))
    met = _at_leaves(at, towns.leaves, own).select("point_id", _best().alias("b"))
    best = met.groupBy("point_id").agg(F.min("b").alias("b"))
    return best.select("point_id", F.col("b.name").alias("place"), (F.sqrt("b.sq") * KM_PER_DEGREE).alias("place_km"))


def _under(at: DataFrame, nodes: DataFrame, own: list[str]) -> DataFrame:
    """Rows of points at a ``node`` with its ``kids``; leaves have none."""
    keyed = at.select(*own, "node", "node.level", "node.cx", "node.cy")
    return keyed.join(nodes, ["code", "level", "cx", "cy"], "left")


def _at_leaves(at: DataFrame, leaves: DataFrame, own: list[str]) -> DataFrame:
    """Rows of points at a leaf ``node`` with its ``towns``."""
    return at.select(*own, "node.level", "node.cx", "node.cy").join(leaves, ["code", "level", "cx", "cy"])


def _best() -> Column:
    """(sq, ord, name) of the nearest of a row's ``towns``."""

    def one(t: Column) -> Column:
        dlat, dlon = t["lat"] - F.col("lat"), (t["lon"] - F.col("lon")) * F.col("k")
        return F.struct((dlat * dlat + dlon * dlon).alias("sq"), t["ord"].alias("ord"), t["name"].alias("name"))

    return F.array_min(F.transform("towns", one))


def _near(node: Column) -> Column:
    """Squared distance of the point to the nearest corner or side of a node's box, as towns'."""
    dlat = F.greatest(node["s"] - F.col("lat"), F.col("lat") - node["n"], F.lit(0.0))
    dlon = F.greatest(node["w"] - F.col("lon"), F.col("lon") - node["e"], F.lit(0.0)) * F.col("k")
    return dlat * dlat + dlon * dlon


def bounds_of(index: Boundaries) -> DataFrame:
    """set_id and poly_id with its box in degrees (w, s, e, n)."""
    edge = lambda c: dequantise(F.col(f"m{c}"), F.col(f"scale_{c[-1]}"), F.col(f"t{c[-1]}"))
    boxes = index.polygons.join(index.transforms, "set_id")
    return boxes.select("set_id", "poly_id", edge("inx").alias("w"), edge("iny").alias("s"), edge("axx").alias("e"), edge("axy").alias("n"))


def view_for(rows: DataFrame, min_span: float) -> DataFrame:
    """The box w, s, e, n padded by 35 %, but no smaller than ``min_span`` degrees of latitude."""
    mid_lat, mid_lon = (F.col("s") + F.col("n")) / 2, (F.col("w") + F.col("e")) / 2
    k = F.greatest(F.lit(0.02), F.cos(mid_lat * math.pi / 180))
    half_lat = F.greatest((F.col("n") - F.col("s")) / 2 * 1.35, F.lit(min_span / 2))
    half_lon = F.greatest((F.col("e") - F.col("w")) / 2 * 1.35, F.lit(min_span / 2) / k)
    return rows.withColumns({"view_w": mid_lon - half_lon, "view_s": mid_lat - half_lat, "view_e": mid_lon + half_lon, "view_n": mid_lat + half_lat})


def located_views(located: DataFrame, index: Boundaries, min_span: float) -> DataFrame:
    """``located`` with the box w, s, e, n of each row's polygon and the padded view of it. Rows
    without a polygon have the box of all of their set, which is their view too."""
    boxes = bounds_of(index)
    whole = boxes.groupBy("set_id").agg(F.lit(None).cast("long").alias("poly_id"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))
    whole = whole.withColumns({f"view_{c}": F.col(c) for c in "wsen"})
    views = sent(settle(view_for(boxes, min_span).unionByName(whole).withColumnsRenamed({"poly_id": "box_id", "set_id": "box_set"})))
    same = (F.col("set_id") == F.col("box_set")) & F.col("poly_id").eqNullSafe(F.col("box_id"))
    return located.join(views, same, "left").drop("box_id", "box_set")


def outline_polygons(located: DataFrame, polygons: DataFrame) -> DataFrame:
    """(name_id, poly_ids): of each matched name all its polygons, found once per name. The null name
    of points that matched none has all polygons."""
    names = located.select("name_id").distinct()
    offered = polygons.select("poly_id", F.explode(F.array("name_id", F.lit(None))).alias("offered_id"))
    told = names.join(offered, F.col("name_id").eqNullSafe(F.col("offered_id")))
    return told.groupBy("name_id").agg(F.array_sort(F.collect_set("poly_id")).alias("poly_ids"))


def context_polygons(views: DataFrame, boxes: DataFrame, cell_deg: float, keys: list[str] | None = None) -> DataFrame:
    """(view_id, poly_id) of other names' polygons (of the same keys) whose box meets the view, by
    shared grid cells. A view without a name meets polygons of every name.

    ``views``: view_id, name_id, view_w..view_n, distinct; ``boxes``: poly_id, name_id, w, s, e, n.
    """
    keys = keys or []

    def cells(rows: DataFrame, w: str, s: str, e: str, n: str) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell_deg).cast("long"), F.floor(F.col(b) / cell_deg).cast("long"))
        return rows.withColumn("cx", F.explode(span(w, e))).withColumn("cy", F.explode(span(s, n)))

    met = cells(views, "view_w", "view_s", "view_e", "view_n").join(cells(boxes.withColumnRenamed("name_id", "other_id"), "w", "s", "e", "n"), [*keys, "cx", "cy"])
    meets = (F.col("w") <= F.col("view_e")) & (F.col("e") >= F.col("view_w")) & (F.col("s") <= F.col("view_n")) & (F.col("n") >= F.col("view_s"))
    return met.filter(meets & ~F.col("other_id").eqNullSafe(F.col("name_id"))).select("view_id", "poly_id").distinct()


def region_context(views: DataFrame, regions: DataFrame, world: DataFrame, cell_deg: float) -> DataFrame:
    """(view_id, seq, layer, poly_id): what surrounds a region's view, in drawing order. Layer 0 is the
    other regions of its country, layer 1 the land of other countries; each in order of poly_id.

    ``views``: view_id, code, name_id, view_w..view_n; ``regions``: code, poly_id, name_id, w, s, e, n;
    ``world``: poly_id, name_id (the country's code), w, s, e, n.
    """
    near = context_polygons(views, regions, cell_deg, ["code"]).withColumn("layer", F.lit(0))
    far = context_polygons(views.withColumn("name_id", F.col("code")), world, cell_deg).withColumn("layer", F.lit(1))
    # a view meets no more than the polygons of both sets
    order = Window.partitionBy("view_id").orderBy("layer", "poly_id")
    return near.unionByName(far).select("view_id", (F.row_number().over(order) - 1).alias("seq"), "layer", "poly_id")


def place_label(place: Column, km: Column, region: Column, country: Column) -> Column:
    """Town (with its distance beyond 2 km), region and country, whichever there are."""
    from ..functions.numbers import fixed

    town = F.when(km <= 2, place).otherwise(F.concat(fixed(km, 1), F.lit(" km from "), place))
    return F.concat_ws(", ", F.when(place.isNotNull(), town), region, country)


def location_caption(label: Column, country: Column, offshore_km: Column) -> Column:
    from ..functions.numbers import rnd

    return (
        F.when(country.isNull(), F.lit("Not inside any country"))
        .when(offshore_km >= 5, F.concat(F.lit("About "), rnd(offshore_km).cast("string"), F.lit(" km off the coast of "), country))
        .otherwise(label)
    )
