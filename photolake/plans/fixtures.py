"""Photo-library tables as views over the driver's tables.

Each view is one SQL text that Spark and DuckDB both run, so that a query and its oracle see the same
rows; where the engines' dialects part, a view has a text for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = """SELECT event_id AS point_id,
 (CAST((event_id*7919) % 36000 AS DOUBLE)+0.5)/100 - 180 AS lon,
 (CAST((event_id*104729) % 18000 AS DOUBLE)+0.5)/100 - 90 AS lat FROM events"""

_TEMPLATE = """SELECT * FROM (VALUES
 (0,0,0,600,400),(0,0,1,5000,400),(0,0,2,5000,1800),(0,0,3,3000,1800),(0,0,4,3000,3200),(0,0,5,600,3200),
 (0,1,0,1000,800),(0,1,1,2000,800),(0,1,2,2000,1600),(0,1,3,1000,1600),
 (1,0,0,5600,2400),(1,0,1,6600,2400),(1,0,2,6600,3000),(1,0,3,5600,3000),
 (2,0,0,7000,2400),(2,0,1,7200,2400),(2,0,2,7200,3000),(2,0,3,7000,3000)) AS t(part,ring,v,dx,dy)"""

_REGION_TEMPLATE = """SELECT * FROM (VALUES
 (0,0,0,600,400),(0,0,1,5000,400),(0,0,2,5000,1800),(0,0,3,600,1800),
 (0,1,0,1000,800),(0,1,1,2000,800),(0,1,2,2000,1600),(0,1,3,1000,1600),
 (1,0,0,600,1800),(1,0,1,3000,1800),(1,0,2,3000,3200),(1,0,3,600,3200),
 (2,0,0,5600,2400),(2,0,1,6600,2400),(2,0,2,6600,3000),(2,0,3,5600,3000)) AS t(part,ring,v,dx,dy)"""

VERTICES = f"""SELECT n_nationkey*10+part AS poly_id, n_nationkey AS name_id, n_name AS name, ring, v,
 CAST((n_nationkey % 5)*7200 + dx AS DOUBLE) AS x,
 CAST(CAST(floor(n_nationkey/5) AS INT)*3600 + dy AS DOUBLE) AS y
FROM nation CROSS JOIN ({_TEMPLATE}) r
WHERE (part < 2 OR n_nationkey = 4) AND (ring = 0 OR n_nationkey % 5 = 0)
UNION ALL
SELECT 243, 24, n_name, 0, v, CAST(dx AS DOUBLE), CAST(dy AS DOUBLE) FROM nation CROSS JOIN ({_TEMPLATE}) r
WHERE n_nationkey = 24 AND part = 0 AND ring = 1"""

#: The world's grid: twice as coarse up as across.
WORLD_TRANSFORM = """SELECT 'world' AS set_id, CAST(0.01 AS DOUBLE) AS scale_x, CAST(0.02 AS DOUBLE) AS scale_y,
 CAST(-180 AS DOUBLE) AS tx, CAST(-90 AS DOUBLE) AS ty"""
WORLD_VERTICES = f"SELECT 'world' AS set_id, poly_id, name_id, name, ring, v, x, y/2 AS y FROM ({VERTICES}) whole"

#: Each country's regions and towns have a grid of their own, of four shapes: square, and ten times as
#: coarse on one axis as on the other.
REGION_TRANSFORMS = """SELECT concat('c', CAST(n_nationkey AS VARCHAR(9))) AS set_id, n_nationkey AS code, ax, ay,
 CAST(ax AS DOUBLE)/1000 AS scale_x, CAST(ay AS DOUBLE)/1000 AS scale_y,
 CAST((n_nationkey % 5)*72 - 180 AS DOUBLE) AS tx, CAST(CAST(floor(n_nationkey/5) AS INT)*36 - 90 AS DOUBLE) AS ty
FROM nation JOIN (VALUES (0,10,10),(1,100,10),(2,20,200),(3,1,10)) AS k(shape,ax,ay) ON n_nationkey % 4 = k.shape"""

REGION_VERTICES = f"""SELECT set_id, n_nationkey AS code, n_nationkey*10+part AS poly_id, concat(n_name, ' R', CAST(part AS VARCHAR(9))) AS name, ring, v,
 CAST(dx*10/ax AS DOUBLE) AS x, CAST(dy*10/ay AS DOUBLE) AS y
FROM nation JOIN ({REGION_TRANSFORMS}) g ON g.code = n_nationkey CROSS JOIN ({_REGION_TEMPLATE}) r
WHERE (ring = 0 OR n_nationkey % 5 = 0) AND (n_nationkey NOT IN (11, 17) OR part = 0)"""

PLACES = f"""SELECT set_id, c_nationkey AS code, c_custkey AS ord, c_name AS name,
 CAST(floor((600 + (c_custkey*7919) % 6000)*10/ax) AS INT) AS qx, CAST(floor((400 + (c_custkey*104729) % 2800)*10/ay) AS INT) AS qy
FROM customer JOIN ({REGION_TRANSFORMS}) g ON g.code = c_nationkey WHERE c_nationkey <> 7"""

PHOTOS = """SELECT doc_id AS photo_id,
 concat('IMG_', CAST(doc_id % 40 AS VARCHAR(20)), CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG'
  WHEN 2 THEN '.png' WHEN 3 THEN '.webp' WHEN 4 THEN '.heic' WHEN 5 THEN '.svg' WHEN 6 THEN '.txt'
  WHEN 7 THEN '.tar.avif' ELSE '' END) AS name,
 CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp'
  WHEN 3 THEN 'IMAGE/HEIC' WHEN 4 THEN 'application/octet-stream' ELSE '' END AS mime,
 CAST(64 + (doc_id*7919) % 4961 AS INT) AS width,
 CAST(64 + (doc_id*104729) % 4961 AS INT) AS height,
 n_chars*37 + 1000 AS bytes, doc_id % 50 AS batch_id
FROM documents"""

TAGS = """SELECT photo_id, tag, value FROM (
 SELECT doc_id AS photo_id, 'Make' AS tag, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE upper(lang) END AS value FROM documents
 UNION ALL SELECT doc_id, 'Model', CASE WHEN doc_id % 3 = 0 THEN concat(upper(lang), ' ', source) ELSE source END FROM documents
 UNION ALL SELECT doc_id, 'latitude', CAST(CAST((doc_id*7919) % 18000 AS DOUBLE)/100 - 90 AS VARCHAR(30)) FROM documents WHERE doc_id % 3 = 1
 UNION ALL SELECT doc_id, 'longitude', CAST(CAST((doc_id*104729) % 36000 AS DOUBLE)/100 - 180 AS VARCHAR(30)) FROM documents WHERE doc_id % 6 <> 4
 UNION ALL SELECT doc_id, 'SerialNumber', '  ' FROM documents WHERE doc_id % 5 = 0
 UNION ALL SELECT doc_id, 'BodySerialNumber', concat('SN', CAST(doc_id AS VARCHAR(20))) FROM documents WHERE doc_id % 5 < 2
 UNION ALL SELECT doc_id, 'ImageDescription', text FROM documents WHERE doc_id % 2 = 0
 UNION ALL SELECT doc_id, 'Software', source FROM documents WHERE doc_id % 7 = 0
 UNION ALL SELECT doc_id, 'ImageWidth', '64' FROM documents
 UNION ALL SELECT doc_id, 'ThumbnailLength', CAST((doc_id % 4)*100 AS VARCHAR(20)) FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, 'ISO', CAST(n_chars AS VARCHAR(20)) FROM documents WHERE doc_id % 8 = 3) t"""

BOXES = """SELECT l_orderkey AS photo_id, CAST(l_linenumber AS BIGINT)*100000000 + l_partkey*1000 + l_suppkey % 1000 AS ord,
 concat('b', CAST(l_linenumber AS VARCHAR(9))) AS box_id,
 CAST(l_partkey % 3000 AS DOUBLE) - 50 AS x, CAST(l_suppkey*13 % 3000 AS DOUBLE) AS y,
 CAST(l_quantity*5 - 3 AS DOUBLE) AS width, CAST(l_quantity*3 - 2 AS DOUBLE) AS height,
 CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN '#000000' WHEN 1 THEN '#ffffff' WHEN 2 THEN '#64748b' ELSE 'red' END AS fill,
 l_returnflag <> 'R' AS enabled
FROM lineitem"""

EDIT_LOG = """SELECT o_custkey AS photo_id, o_orderdate AS ts, o_orderkey AS seq,
 CAST(1 + o_orderkey % 4000 AS INT) AS target_w, CAST(1 + (o_orderkey*31) % 4000 AS INT) AS target_h,
 CASE WHEN o_orderstatus='F' THEN 'image/png' WHEN o_orderstatus='O' THEN 'image/jpeg' ELSE 'image/webp' END AS format
FROM orders"""

#: Photos that the boxes and the edit log know: one per order.
FRAMES = """SELECT o_orderkey AS photo_id, CAST(64 + (o_orderkey*7919) % 4961 AS INT) AS width,
 CAST(64 + (o_orderkey*104729) % 4961 AS INT) AS height FROM orders"""

ADMIN0 = """SELECT n_nationkey*10 AS ord, concat(chr(CAST(65+floor(n_nationkey/5) AS INT)), chr(CAST(65+n_nationkey%5 AS INT))) AS a2,
  concat('N', lpad(CAST(n_nationkey AS VARCHAR(9)), 2, '0')) AS a3, CASE WHEN n_nationkey = 9 THEN 'Dependency' ELSE 'Country' END AS type, n_name AS name FROM nation
 UNION ALL SELECT n_nationkey*10 - 5, concat(chr(CAST(65+floor(n_nationkey/5) AS INT)), chr(CAST(65+n_nationkey%5 AS INT))),
  concat('D', lpad(CAST(n_nationkey AS VARCHAR(9)), 2, '0')), 'Dependency', concat(n_name, ' ISLES') FROM nation WHERE n_nationkey % 3 = 0
 UNION ALL SELECT n_nationkey*10 + 5, concat(chr(CAST(65+floor(n_nationkey/5) AS INT)), chr(CAST(65+n_nationkey%5 AS INT))),
  concat('X', lpad(CAST(n_nationkey AS VARCHAR(9)), 2, '0')), CASE WHEN n_nationkey % 2 = 0 THEN 'Sovereign' ELSE 'Dependency' END, concat(n_name, ' TWO') FROM nation WHERE n_nationkey % 4 = 1
 UNION ALL SELECT 1000 + r_regionkey, CASE WHEN r_regionkey = 0 THEN NULL ELSE '-99' END, concat('R', CAST(r_regionkey AS VARCHAR(9))), 'Country', r_name FROM region"""

GAZETTEER = """SELECT c_custkey AS ord, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS name,
 CASE WHEN c_custkey % 40 = 1 THEN 'abc' WHEN c_custkey % 40 = 2 THEN '' ELSE CAST(CAST((c_custkey*7919) % 18000 AS DOUBLE)/100 - 90 AS VARCHAR(30)) END AS lat,
 CAST(CAST((c_custkey*104729) % 36000 AS DOUBLE)/100 - 180 AS VARCHAR(30)) AS lon,
 concat(chr(CAST(65+floor(c_nationkey/5) AS INT)), chr(CAST(65+(c_nationkey + CASE WHEN c_custkey % 60 = 0 THEN 9 ELSE 0 END)%12 AS INT))) AS a2
FROM customer"""

ADMIN1 = """SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 17 = 0 THEN 'ZZZ' ELSE concat('N', lpad(CAST(s_nationkey AS VARCHAR(9)), 2, '0')) END AS adm0_a3,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE concat(s_name, ' EN') END AS name_en FROM supplier"""

ARTICLES = """SELECT doc_id AS article_id, lang, doc_id AS ord, substr(text, 1, 40) AS title, '' AS summary,
 CAST(CAST(floor(doc_id/7) AS INT) % 5 AS VARCHAR(9)) AS grp, text AS body FROM documents"""

PIXELS = """SELECT vec_id AS image_id, CAST(p % 8 AS INT) AS x, CAST(floor(p / 8) AS INT) AS y,
 CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE)+0.6)*220))) AS INT) AS r FROM {source}"""
PIXELS_SPARK = PIXELS.format(source="(SELECT vec_id, p, v FROM embeddings LATERAL VIEW posexplode(embedding) e AS p, v)")
PIXELS_DUCK = PIXELS.format(source="(SELECT vec_id, unnest(embedding) v, generate_subscripts(embedding,1)-1 p FROM embeddings)")

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's rows. Only the tables that it names are opened."""
    import re

    used = [t for t in _TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    named = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], sql)
    return spark.sql(named, **frames)
