"""Geocoding queries over the points, polygons and towns of the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cut import settle
from ..functions.paths import work_path
from ..operators import geo
from ..sources import boundaries as files
from ..streaming.photos import append_located
from . import fixtures as fx
from .registry import query

CELL_DEG = 1.0
MOST_TOWNS = 16


def _inside(q: str, edges: str, boxes: str, match: str, name: str) -> str:
    """The first polygon around each point, by plain joins: edges crossed, odd outside and not in holes."""
    return f"""
{name}hit AS (SELECT q.point_id, e.poly_id, e.ring,
  sum(CASE WHEN (e.yi > q.y) <> (e.yj > q.y) AND q.x < (e.xj-e.xi)*(q.y-e.yi)/(CASE WHEN e.yj = e.yi THEN NULL ELSE e.yj-e.yi END)+e.xi THEN 1 ELSE 0 END) % 2 AS odd
  FROM {q} q JOIN {boxes} b ON {match} AND q.x BETWEEN b.x0 AND b.x1 AND q.y BETWEEN b.y0 AND b.y1 JOIN {edges} e ON e.set_id = b.set_id AND e.poly_id = b.poly_id
  GROUP BY q.point_id, e.poly_id, e.ring),
{name}inside AS (SELECT point_id, min(poly_id) AS poly_id FROM (SELECT point_id, poly_id FROM {name}hit GROUP BY point_id, poly_id
  HAVING max(CASE WHEN ring = 0 THEN odd END) = 1 AND max(CASE WHEN ring > 0 THEN odd ELSE 0 END) = 0) z GROUP BY point_id)"""


def _edges(vertices: str, transforms: str, name: str) -> str:
    """Edges in grid units and degrees, and boxes, of each set."""
    return f"""
{name}vert AS ({vertices}), {name}tf AS ({transforms}),
{name}edge AS (SELECT e.*, xi*scale_x+tx AS lon_i, yi*scale_y+ty AS lat_i, xj*scale_x+tx AS lon_j, yj*scale_y+ty AS lat_j FROM (SELECT set_id, poly_id, ring, x AS xi, y AS yi,
  coalesce(lag(x) OVER w, last_value(x) OVER full_w) AS xj, coalesce(lag(y) OVER w, last_value(y) OVER full_w) AS yj
  FROM {name}vert WINDOW w AS (PARTITION BY set_id, poly_id, ring ORDER BY v),
  full_w AS (PARTITION BY set_id, poly_id, ring ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) e JOIN {name}tf USING (set_id)),
{name}box AS (SELECT set_id, poly_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {name}vert WHERE ring = 0 GROUP BY set_id, poly_id)"""


def _near(points: str, edges: str, boxes: str, km: float, match: str) -> str:
    """Least distances of ``points`` to polygons under ``km``, by plain joins."""
    mx, my = f"({km}/111.32/p.scale_x)/greatest(0.02,cos(p.lat*pi()/180))", f"({km}/111.32/p.scale_y)"
    fold = lambda c: f"(CASE WHEN {c}-p.lon > 180 THEN {c}-p.lon-360 WHEN {c}-p.lon < -180 THEN {c}-p.lon+360 ELSE {c}-p.lon END)*cos(p.lat*pi()/180)*111.32"
    return f"""
 SELECT point_id, min_by(poly_id, (km, poly_id)) AS poly_id, min(km) AS km FROM (
  SELECT point_id, poly_id, min(sqrt(power(ax+t*(bx-ax),2)+power(ay+t*(by_-ay),2))) AS km FROM (
   SELECT *, CASE WHEN power(bx-ax,2)+power(by_-ay,2) = 0 THEN 0 ELSE greatest(0.0, least(1.0, -(ax*(bx-ax)+ay*(by_-ay))/(power(bx-ax,2)+power(by_-ay,2)))) END AS t FROM (
    SELECT p.point_id, e.poly_id, (e.lat_i-p.lat)*111.32 AS ay, (e.lat_j-p.lat)*111.32 AS by_, {fold("e.lon_i")} AS ax, {fold("e.lon_j")} AS bx
    FROM {points} p JOIN {boxes} b ON {match} AND p.x BETWEEN b.x0-{mx} AND b.x1+{mx}
     AND p.y BETWEEN b.y0-{my} AND b.y1+{my} JOIN {edges} e ON e.set_id = b.set_id AND e.poly_id = b.poly_id) a) c GROUP BY point_id, poly_id) d
 WHERE km < {km} GROUP BY point_id"""


# the oracle's own computation, from vertices
_BASE = f"""
pts AS ({fx.POINTS}), {_edges(fx.WORLD_VERTICES, fx.WORLD_TRANSFORM, '')},
q AS (SELECT pts.*, tf.*, (lon-tx)/scale_x AS x, (lat-ty)/scale_y AS y FROM pts, tf), {_inside('q', 'edge', 'box', 'TRUE', '')}"""

_LOCATED = f"""{_BASE},
missed AS (SELECT * FROM q WHERE point_id NOT IN (SELECT point_id FROM inside)),
near AS ({_near('missed', 'edge', 'box', 25.0, 'TRUE')}),
found AS (SELECT point_id, poly_id, CAST(NULL AS DOUBLE) AS km FROM inside UNION ALL SELECT point_id, poly_id, km FROM near),
who AS (SELECT DISTINCT poly_id, name_id, name FROM vert),
located AS (SELECT q.point_id, q.lon, q.lat, f.poly_id, f.km AS offshore_km, w.name_id AS code, w.name AS country
  FROM q LEFT JOIN found f ON q.point_id = f.point_id LEFT JOIN who w ON f.poly_id = w.poly_id)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, fx.POINTS).withColumn("set_id", F.lit("world"))


def world_index(spark: SparkSession, sf_dir: str) -> geo.Boundaries:
    return geo.index_boundaries(fx.view(spark, sf_dir, fx.WORLD_VERTICES), fx.view(spark, sf_dir, fx.WORLD_TRANSFORM), CELL_DEG, geo.COUNTRY_NEAR_KM)


def region_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, fx.REGION_TRANSFORMS).drop("ax", "ay", "code")


def region_index(spark: SparkSession, sf_dir: str) -> geo.Boundaries:
    return geo.index_boundaries(fx.view(spark, sf_dir, fx.REGION_VERTICES), region_grids(spark, sf_dir), CELL_DEG, geo.REGION_NEAR_KM)


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, fx.WORLD_VERTICES).select("poly_id", "name_id", "name").distinct()


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, fx.REGION_VERTICES).select("poly_id", "code", "name").distinct()


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with country, code, approximate and offshore_km."""
    found = geo.locate(points(spark, sf_dir), world_index(spark, sf_dir))
    return found.join(countries(spark, sf_dir).select("poly_id", F.col("name_id").alias("code"), F.col("name").alias("country")), "poly_id", "left")


def regioned(at: DataFrame, regions: geo.Boundaries, names: DataFrame) -> DataFrame:
    """The points of ``at`` (settled; with code) that lie in or at a region of the country found first:
    point_id, lon, lat, code, region. ``names``: poly_id and name of regions."""
    asked = at.filter("code is not null").select("point_id", "lon", "lat", "code", F.concat(F.lit("c"), "code").alias("set_id"))
    hit = geo.locate(asked, regions).filter("poly_id is not null")
    return hit.join(names.select("poly_id", F.col("name").alias("region")), "poly_id").select("point_id", "lon", "lat", "code", "region")


def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """located() with the region of the country found first, and the nearest town where there is one."""
    at = settle(located(spark, sf_dir))
    hit = settle(regioned(at, region_index(spark, sf_dir), region_names(spark, sf_dir)))
    towns = geo.index_towns(fx.view(spark, sf_dir, fx.PLACES), region_grids(spark, sf_dir), MOST_TOWNS)
    told = hit.select("point_id", "region").join(geo.nearest_place(hit, towns), "point_id", "left")
    return at.join(told, "point_id", "left")


@query("g6_points_in_polygons", f"WITH {_BASE} SELECT point_id, poly_id FROM inside")
def g6(spark, sf_dir):
    index = world_index(spark, sf_dir)
    return geo.join_points_polygons(geo.placed(points(spark, sf_dir), index), index)


@query("g8_nearest_border", f"WITH {_LOCATED} SELECT point_id, poly_id, round(km, 6) AS km FROM near")
def g8(spark, sf_dir):
    index = world_index(spark, sf_dir)
    at = settle(geo.placed(points(spark, sf_dir), index))
    missed = at.join(geo.join_points_polygons(at, index), "point_id", "left_anti")
    return geo.join_points_nearest_border(missed, index).select("point_id", "poly_id", F.round("km", 6).alias("km"))


@query("g9_locate_country", f"WITH {_LOCATED} SELECT point_id, country, code, offshore_km IS NOT NULL AS approximate, round(offshore_km, 6) AS offshore_km FROM located")
def g9(spark, sf_dir):
    return located(spark, sf_dir).select("point_id", "country", "code", "approximate", F.round("offshore_km", 6).alias("offshore_km"))


@query("g9_points_by_country", f"WITH {_LOCATED} SELECT country, count(*) AS points, count(offshore_km) AS near_border FROM located GROUP BY country")
def g9_counts(spark, sf_dir):
    return located(spark, sf_dir).groupBy("country").agg(F.count(F.lit(1)).alias("points"), F.count("offshore_km").alias("near_border"))


_REFINED = f"""{_LOCATED}, {_edges(fx.REGION_VERTICES, fx.REGION_TRANSFORMS, 'r')},
asked AS (SELECT l.*, rtf.* EXCLUDE (code), (l.lon-tx)/scale_x AS x, (l.lat-ty)/scale_y AS y FROM located l JOIN rtf USING (code)),
{_inside('asked', 'redge', 'rbox', 'q.set_id = b.set_id', 'r')},
rmissed AS (SELECT * FROM asked WHERE point_id NOT IN (SELECT point_id FROM rinside)),
rnear AS ({_near('rmissed', 'redge', 'rbox', 3.0, 'p.set_id = b.set_id')}),
rfound AS (SELECT point_id, poly_id FROM rinside UNION ALL SELECT point_id, poly_id FROM rnear),
regioned AS (SELECT a.*, w.name AS region FROM asked a JOIN rfound f ON a.point_id = f.point_id JOIN (SELECT DISTINCT poly_id, name FROM rvert) w ON w.poly_id = f.poly_id),
places AS (SELECT code, ord, name, qx*scale_x+tx AS lon, qy*scale_y+ty AS lat FROM ({fx.PLACES}) p JOIN rtf USING (code)),
town AS (SELECT point_id, min_by(name, (sq, ord)) AS place, sqrt(min(sq))*111.32 AS place_km FROM (
  SELECT r.point_id, p.name, p.ord, power(p.lat-r.lat, 2) + power((p.lon-r.lon)*greatest(0.02, cos(r.lat*pi()/180)), 2) AS sq
  FROM regioned r JOIN places p ON p.code = r.code) s GROUP BY point_id),
refined AS (SELECT l.*, r.region, t.place, t.place_km FROM located l LEFT JOIN regioned r ON l.point_id = r.point_id LEFT JOIN town t ON t.point_id = l.point_id)"""


@query("g11_refine_region", f"WITH {_REFINED} SELECT point_id, country, region FROM refined")
def g11(spark, sf_dir):
    at = settle(located(spark, sf_dir))
    hit = regioned(at, region_index(spark, sf_dir), region_names(spark, sf_dir))
    return at.join(hit.select("point_id", "region"), "point_id", "left").select("point_id", "country", "region")


@query("g12_nearest_place", f"WITH {_REFINED} SELECT point_id, place, round(place_km, 6) AS place_km FROM refined WHERE region IS NOT NULL")
def g12(spark, sf_dir):
    hit = settle(regioned(settle(located(spark, sf_dir)), region_index(spark, sf_dir), region_names(spark, sf_dir)))
    towns = geo.index_towns(fx.view(spark, sf_dir, fx.PLACES), region_grids(spark, sf_dir), MOST_TOWNS)
    return hit.select("point_id").join(geo.nearest_place(hit, towns), "point_id", "left").select("point_id", "place", F.round("place_km", 6).alias("place_km"))


_FIX1 = "concat(CAST(CAST(floor(floor(place_km*10+0.5)/10) AS BIGINT) AS VARCHAR), '.', CAST(CAST(floor(place_km*10+0.5) AS BIGINT) % 10 AS VARCHAR))"
_LABEL = f"concat_ws(', ', CASE WHEN place IS NULL THEN NULL WHEN place_km <= 2 THEN place ELSE concat({_FIX1}, ' km from ', place) END, region, country)"


@query(
    "g17_g18_labels",
    f"""WITH {_REFINED} SELECT point_id, {_LABEL} AS label,
 CASE WHEN country IS NULL THEN 'Not inside any country' WHEN offshore_km >= 5 THEN concat('About ', CAST(CAST(floor(offshore_km+0.5) AS BIGINT) AS VARCHAR), ' km off the coast of ', country) ELSE {_LABEL} END AS caption FROM refined""",
)
def g17(spark, sf_dir):
    label = geo.place_label(F.col("place"), F.col("place_km"), F.col("region"), F.col("country"))
    return refined(spark, sf_dir).select("point_id", label.alias("label"), geo.location_caption(label, F.col("country"), F.col("offshore_km")).alias("caption"))


def _view(name: str, half: float) -> str:
    return f"""SELECT poly_id, w, s, e, n, (w+e)/2 - hl AS view_w, (s+n)/2 - hv AS view_s, (w+e)/2 + hl AS view_e, (s+n)/2 + hv AS view_n FROM (
 SELECT *, greatest((n-s)/2*1.35, {half}) AS hv, greatest((e-w)/2*1.35, {half}/greatest(0.02, cos((s+n)/2*pi()/180))) AS hl FROM (
 SELECT poly_id, min(lon_i) AS w, min(lat_i) AS s, max(lon_i) AS e, max(lat_i) AS n FROM {name}edge WHERE ring = 0 GROUP BY poly_id) b) c"""


_VIEW, _WORLD = _view("", 2.5), _edges(fx.WORLD_VERTICES, fx.WORLD_TRANSFORM, "")


@query("g13_g14_bounds_views", f"WITH {_WORLD}, v AS ({_VIEW}) SELECT poly_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('w', 's', 'e', 'n', 'view_w', 'view_s', 'view_e', 'view_n'))} FROM v")
def g13(spark, sf_dir):
    rows = geo.view_for(geo.bounds_of(world_index(spark, sf_dir)), 5.0)
    return rows.select("poly_id", *[F.round(c, 6).alias(c) for c in ("w", "s", "e", "n", "view_w", "view_s", "view_e", "view_n")])


@query("g15_outlines", f"WITH {_LOCATED} SELECT code AS name_id, count(DISTINCT v.poly_id) AS polygons, min(v.poly_id) AS first_id FROM (SELECT DISTINCT code FROM located WHERE code IS NOT NULL) l JOIN vert v ON v.name_id = l.code GROUP BY code")
def g15(spark, sf_dir):
    found = geo.outline_polygons(located(spark, sf_dir).filter("code is not null").withColumnRenamed("code", "name_id"), countries(spark, sf_dir))
    return found.select("name_id", F.size("poly_ids").cast("long").alias("polygons"), F.col("poly_ids")[0].alias("first_id"))


@query(
    "g16_context",
    f"""WITH {_WORLD}, v AS ({_VIEW}), who AS (SELECT DISTINCT poly_id, name_id FROM vert)
 SELECT a.poly_id AS view_id, b.poly_id FROM v a JOIN who x ON x.poly_id = a.poly_id JOIN v b ON a.view_w <= b.e AND a.view_e >= b.w AND a.view_s <= b.n AND a.view_n >= b.s
 JOIN who y ON y.poly_id = b.poly_id WHERE x.name_id <> y.name_id""",
)
def g16(spark, sf_dir):
    boxes = geo.view_for(geo.bounds_of(world_index(spark, sf_dir)), 5.0).join(countries(spark, sf_dir).select("poly_id", "name_id"), "poly_id")
    views = boxes.select(F.col("poly_id").alias("view_id"), "name_id", "view_w", "view_s", "view_e", "view_n")
    return geo.context_polygons(views, boxes.select("poly_id", "name_id", "w", "s", "e", "n"), 10.0)


_BOX_COLUMNS = ("w", "s", "e", "n", "view_w", "view_s", "view_e", "view_n")


@query(
    "g9_g13_world_views",
    f"""WITH {_LOCATED}, v AS ({_VIEW}), whole AS (SELECT min(w) AS w, min(s) AS s, max(e) AS e, max(n) AS n FROM v)
 SELECT point_id, l.poly_id IS NULL AS is_world, {', '.join(f'round(coalesce(v.{c}, whole.{c[-1]}), 6) AS {c}' for c in _BOX_COLUMNS)} FROM located l LEFT JOIN v ON v.poly_id = l.poly_id, whole""",
)
def g13_world(spark, sf_dir):
    """The box and view of every point; those of the whole world for points far from any land."""
    seen = geo.located_views(located(spark, sf_dir), world_index(spark, sf_dir), 5.0)
    return seen.select("point_id", "is_world", *[F.round(c, 6).alias(c) for c in _BOX_COLUMNS])


@query(
    "g15_world_outlines",
    f"""WITH {_LOCATED}, asked AS (SELECT DISTINCT code FROM located), p AS (SELECT DISTINCT poly_id, name_id FROM vert)
 SELECT code AS name_id, string_agg(CAST(poly_id AS VARCHAR), ',' ORDER BY poly_id) AS polygons FROM asked JOIN p ON code = name_id OR code IS NULL GROUP BY code""",
)
def g15_world(spark, sf_dir):
    """The polygons that outline each matched country, and all of them for points that match none."""
    found = geo.outline_polygons(located(spark, sf_dir).withColumnRenamed("code", "name_id"), countries(spark, sf_dir))
    return found.select("name_id", F.array_join(F.col("poly_ids").cast("array<string>"), ",").alias("polygons"))


@query(
    "g16_region_context",
    f"""WITH {_WORLD}, {_edges(fx.REGION_VERTICES, fx.REGION_TRANSFORMS, 'r')}, v AS ({_VIEW}), r AS ({_view('r', 0.225)}),
 rwho AS (SELECT DISTINCT poly_id, code, name FROM rvert), who AS (SELECT DISTINCT poly_id, name_id FROM vert),
 a AS (SELECT r.*, code, name FROM r JOIN rwho USING (poly_id)),
 met AS (SELECT a.poly_id AS view_id, 0 AS layer, b.poly_id FROM a JOIN a b ON a.code = b.code AND a.name <> b.name AND a.view_w <= b.e AND a.view_e >= b.w AND a.view_s <= b.n AND a.view_n >= b.s
  UNION ALL SELECT a.poly_id, 1, v.poly_id FROM a JOIN v ON a.view_w <= v.e AND a.view_e >= v.w AND a.view_s <= v.n AND a.view_n >= v.s JOIN who ON who.poly_id = v.poly_id WHERE who.name_id <> a.code)
 SELECT view_id, CAST(row_number() OVER (PARTITION BY view_id ORDER BY layer, poly_id) - 1 AS INT) AS seq, layer, poly_id FROM met""",
)
def g16_regions(spark, sf_dir):
    """Sibling regions, then other countries' land, around every region's polygon."""
    names = region_names(spark, sf_dir).select("poly_id", "code", F.col("name").alias("name_id"))
    boxes = geo.view_for(geo.bounds_of(region_index(spark, sf_dir)), 0.45).join(names, "poly_id")
    views = boxes.select(F.col("poly_id").alias("view_id"), "code", "name_id", *[f"view_{c}" for c in "wsen"])
    lands = geo.bounds_of(world_index(spark, sf_dir)).join(countries(spark, sf_dir).select("poly_id", "name_id"), "poly_id")
    return geo.region_context(views, boxes.select("code", "poly_id", "name_id", "w", "s", "e", "n"), lands, 10.0)


@query(
    "g1_g2_arcs_to_rings",
    f"WITH vert AS ({fx.VERTICES}) SELECT poly_id, ring, count(*)+1 AS points, sum(x) + max(CASE WHEN v = 0 THEN x END) AS sum_x, sum(y) + max(CASE WHEN v = 0 THEN y END) AS sum_y FROM vert GROUP BY poly_id, ring",
)
def g1(spark, sf_dir):
    """Each ring cut into two arcs of deltas, the second stored backwards, and put together again."""
    whole = fx.view(spark, sf_dir, fx.VERTICES).groupBy("poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("v", "x", "y"))).alias("p"))
    whole = whole.withColumn("loop", F.concat("p", F.slice("p", 1, 1))).withColumn("set_id", F.lit(0))
    first, second = F.slice("loop", 1, 3), F.reverse(F.slice("loop", 3, F.size("loop") - 2))
    number = (F.col("poly_id") * 10 + F.col("ring")) * 2

    def deltas(points):
        return F.transform(points, lambda q, k: F.when(k == 0, F.array(q["x"], q["y"])).otherwise(F.array(q["x"] - F.get(points, k - 1)["x"], q["y"] - F.get(points, k - 1)["y"])))

    raw = whole.select("set_id", number.alias("arc"), deltas(first).alias("deltas")).unionByName(whole.select("set_id", (number + 1).alias("arc"), deltas(second).alias("deltas")))
    refs = whole.select("set_id", "poly_id", "ring", F.array(number, -(number + 1) - 1).alias("refs"))
    rings = geo.stitch_rings(refs, geo.decode_arcs(raw))
    total = lambda c: F.aggregate(f"points.{c}", F.lit(0.0), lambda a, b: a + b)
    return rings.select("poly_id", "ring", F.size("points").cast("long").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


_ASKED = "SELECT s_suppkey AS point_id, CASE WHEN s_suppkey % 7 = 0 THEN 'Nowhere' ELSE n_name END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_NAMES = "SELECT c_custkey AS ord, n_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(substr(n_name, 1, 2), CAST(c_custkey AS STRING)) END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(
    "g10_country_codes",
    f"WITH asked AS ({_ASKED}), names AS ({_NAMES}), first AS (SELECT name, code FROM names QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1) SELECT point_id, country, code FROM asked LEFT JOIN first ON country = name",
)
def g10(spark, sf_dir):
    """The code of each supplier's country, from a set of names in which every name comes many times."""
    return geo.country_code(fx.view(spark, sf_dir, _ASKED), fx.view(spark, sf_dir, _NAMES)).select("point_id", "country", "code")


def _coded(vertices: DataFrame, transforms: DataFrame, keys: DataFrame) -> DataFrame:
    """Boundary sets as files hold them: every ring as two arcs of deltas, the second backwards.

    ``vertices``: set_id, poly_id, ring, v, x, y; ``keys``: set_id, poly_id, name, code. Polygons are
    numbered by poly_id within their set, names by their first polygon.
    """
    whole = vertices.groupBy("set_id", "poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("v", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")))).alias("p"))
    whole = whole.withColumn("loop", F.concat("p", F.slice("p", 1, 1)))

    def deltas(points):
        step = lambda q, k, c: F.when(k == 0, q[c]).otherwise(q[c] - F.get(points, k - 1)[c])
        return F.transform(points, lambda q, k: F.array(step(q, k, "x"), step(q, k, "y")))

    arcs = F.array(deltas(F.slice("loop", 1, 3)), deltas(F.reverse(F.slice("loop", 3, F.size("loop") - 2))))
    first = F.row_number().over(Window.partitionBy("set_id").orderBy("poly_id", "ring")) - 1
    rings = whole.select("set_id", "poly_id", "ring", (first * 2).alias("arc"), arcs.alias("arcs"))
    sets = rings.groupBy("set_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("arc", "arcs"))), lambda r: r["arcs"])).alias("arcs"))
    refs = F.array(F.col("arc"), -F.col("arc") - 2)
    polys = rings.groupBy("set_id", "poly_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", refs.alias("refs")))), lambda r: r["refs"]).alias("r"))
    names = keys.groupBy("set_id", "name", "code").agg(F.min("poly_id").alias("first"))
    names = names.withColumn("c", (F.row_number().over(Window.partitionBy("set_id").orderBy("first")) - 1).cast("int"))
    polys = polys.join(keys, ["set_id", "poly_id"]).join(names.drop("first"), ["set_id", "name", "code"])
    polys = polys.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("poly_id", "c", "r"))), lambda p: F.struct(p["c"].alias("c"), p["r"].alias("r"))).alias("polys"))
    listed = names.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("c", "name", "code"))).alias("n"))
    grid = F.struct(F.array("scale_x", "scale_y").alias("scale"), F.array("tx", "ty").alias("translate")).alias("transform")
    return transforms.join(sets, "set_id").join(polys, "set_id").join(listed, "set_id").select("set_id", grid, "arcs", F.col("n.name").alias("names"), F.col("n.code").alias("codes"), "polys")


def written_sets(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The world and the regions of all countries, written as boundary files and read back."""
    world = fx.view(spark, sf_dir, fx.WORLD_VERTICES)
    lands = world.select("set_id", "poly_id", "name", F.col("name_id").cast("string").alias("code")).distinct()
    areas = fx.view(spark, sf_dir, fx.REGION_VERTICES)
    parts = areas.select("set_id", "poly_id", "name", F.col("code").cast("string").alias("code")).distinct()
    towns = fx.view(spark, sf_dir, fx.PLACES).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "qx", "qy"))).alias("t"))
    spots = F.transform("t", lambda t: F.array(t["name"], t["qx"].cast("string"), t["qy"].cast("string"))).alias("places")
    path = work_path(spark, "boundaries")
    files.write_boundaries(_coded(world, fx.view(spark, sf_dir, fx.WORLD_TRANSFORM), lands), f"{path}/world")
    files.write_boundaries(_coded(areas, region_grids(spark, sf_dir), parts).join(towns.select("set_id", spots), "set_id", "left"), f"{path}/regions")
    return files.read_boundaries(spark, f"{path}/world"), files.read_boundaries(spark, f"{path}/regions")


def indexed(sets: dict[str, DataFrame], near_km: float) -> geo.Boundaries:
    """Files' arcs to rings to polygons that points can ask."""
    rings = geo.stitch_rings(sets["rings"], geo.decode_arcs(sets["arcs"]))
    return geo.index_boundaries(geo.ring_vertices(rings), sets["transforms"], CELL_DEG, near_km)


@query(
    "s3_g12_from_files",
    f"WITH {_REFINED} SELECT point_id, country, offshore_km IS NOT NULL AS approximate, round(offshore_km, 6) AS offshore_km, region, place, round(place_km, 6) AS place_km FROM refined",
)
def g_files(spark, sf_dir):
    """Every event's country, region and town, with all boundaries and towns read from boundary files."""
    world, areas = written_sets(spark, sf_dir)
    found = geo.locate(points(spark, sf_dir), indexed(world, geo.COUNTRY_NEAR_KM))
    named = world["polygons"].select("poly_id", F.col("code").cast("int").alias("code"), F.col("name").alias("country"))
    at = settle(found.join(named, "poly_id", "left"))
    regions = indexed(areas, geo.REGION_NEAR_KM)
    places = areas["places"].withColumn("code", F.substring("set_id", 2, 9).cast("int"))
    # polygons are numbered within their file
    names = areas["polygons"].select("set_id", "poly_id", "name")
    asked = at.filter("code is not null").select("point_id", "lon", "lat", "code", F.concat(F.lit("c"), "code").alias("set_id"))
    hit = geo.locate(asked, regions).join(names, ["set_id", "poly_id"]).select("point_id", "lon", "lat", "code", F.col("name").alias("region"))
    hit = settle(hit)
    towns = geo.nearest_place(hit, geo.index_towns(places, areas["transforms"], MOST_TOWNS))
    told = at.join(hit.select("point_id", "region").join(towns, "point_id", "left"), "point_id", "left")
    return told.select("point_id", "country", "approximate", F.round("offshore_km", 6).alias("offshore_km"), "region", "place", F.round("place_km", 6).alias("place_km"))


@query(
    "s3_g2_ring_points",
    f"""WITH vert AS ({fx.WORLD_VERTICES}), p AS (SELECT DISTINCT poly_id, dense_rank() OVER (ORDER BY poly_id) - 1 AS k FROM vert)
 SELECT k AS poly_id, ring, v, x, y FROM vert JOIN p USING (poly_id) UNION ALL SELECT k, ring, count(*) OVER (PARTITION BY poly_id, ring), x, y FROM vert JOIN p USING (poly_id) QUALIFY v = 0""",
)
def g2_files(spark, sf_dir):
    """Rings read from boundary files, point by point in their order, with the point that closes them."""
    world, _ = written_sets(spark, sf_dir)
    rings = geo.stitch_rings(world["rings"], geo.decode_arcs(world["arcs"]))
    each = rings.select("poly_id", "ring", F.posexplode("points").alias("v", "q"))
    return each.select(F.col("poly_id").cast("long").alias("poly_id"), "ring", F.col("v").cast("long").alias("v"), F.col("q.x").cast("double").alias("x"), F.col("q.y").cast("double").alias("y"))


@query("s10_located_stream", f"WITH {_LOCATED} SELECT point_id, country, round(offshore_km, 6) AS offshore_km FROM located")
def s10(spark, sf_dir):
    """Events that arrive as files in two lots: the stream stops after the first and is started again."""
    world, path = world_index(spark, sf_dir), work_path(spark, "stream")
    rows = points(spark, sf_dir)
    for lot in (0, 1):
        rows.filter(F.col("point_id") % 2 == lot).repartition(3).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        append_located(arriving, world, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    names = countries(spark, sf_dir).select("poly_id", F.col("name").alias("country"))
    found = spark.read.parquet(f"{path}/out").join(names, "poly_id", "left")
    return found.select("point_id", "country", F.round("offshore_km", 6).alias("offshore_km"))
