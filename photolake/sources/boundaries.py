"""Boundary sets, gazetteers and admin features from their files, and regions back to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cut import settle

_SET = (
    "struct<transform:struct<scale:array<double>,translate:array<double>>,arcs:array<array<array<int>>>,names:array<string>,"
    "codes:array<string>,polys:array<struct<c:int,b:array<int>,r:array<array<int>>>>,places:array<array<string>>>"
)
_FEATURES = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def read_boundaries(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The boundary files of a folder as tables, keyed by set_id: the file's stem, or the folder
    ``set_id=...`` that ``write_boundaries`` puts it in.

    transforms (scale_x, scale_y, tx, ty), arcs (arc, deltas), rings (poly_id, ring, refs),
    polygons (poly_id, name_id, name, code), places (ord, name, qx, qy).
    """
    text = spark.read.option("wholetext", "true").text(path, recursiveFileLookup=True)
    folder, stem = (F.regexp_extract("_metadata.file_path", pattern, 1) for pattern in (r"/set_id=([^/]+)/", r"([^/]+?)\.[^/.]*$"))
    sets = text.select(F.coalesce(F.nullif(folder, F.lit("")), stem).alias("set_id"), F.from_json("value", _SET).alias("s"))
    t = "s.transform"
    polys = sets.select("set_id", "s.names", "s.codes", F.posexplode("s.polys").alias("poly_id", "p"))
    return {
        "transforms": sets.select("set_id", *[F.col(f"{t}.{f}")[k].alias(n) for f, k, n in (("scale", 0, "scale_x"), ("scale", 1, "scale_y"), ("translate", 0, "tx"), ("translate", 1, "ty"))]),
        "arcs": sets.select("set_id", F.posexplode("s.arcs").alias("arc", "deltas")),
        "rings": polys.select("set_id", "poly_id", F.posexplode("p.r").alias("ring", "refs")),
        "polygons": polys.select("set_id", "poly_id", F.col("p.c").alias("name_id"), F.get("names", F.col("p.c")).alias("name"), F.get("codes", F.col("p.c")).alias("code")),
        "places": sets.select("set_id", F.posexplode("s.places").alias("ord", "q")).select(
            "set_id", "ord", F.col("q")[0].alias("name"), F.col("q")[1].try_cast("int").alias("qx"), F.col("q")[2].try_cast("int").alias("qy")
        ),
    }


def write_boundaries(sets: DataFrame, path: str) -> None:
    """One JSON file for each row (set_id, transform, arcs, names, codes, polys, places), in a folder of
    its set_id."""
    body = F.to_json(F.struct(*[c for c in sets.columns if c != "set_id"])).alias("value")
    sets.select("set_id", body).write.partitionBy("set_id").text(path)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lines without a header: ord, name, lat, lon (texts, as they come), a2.

    ord counts lines from 0 through the files by path and through each in its order, however the files
    are split: lines are numbered within their split, and splits by where they begin.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = settle(lines)
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    f = F.split("value", "\t", -1)
    part = lambda k: F.get(f, F.lit(k))
    # one row for each split of the files
    at = lines.join(F.broadcast(shifts), ["file", "start"])
    return at.select((F.col("at") + F.col("shift")).alias("ord"), part(1).alias("name"), part(4).alias("lat"), part(5).alias("lon"), part(8).alias("a2"))


def read_admin_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: ord (file order), properties, type, polygons of rings of
    [lon, lat]. Coordinates are parsed by geometry type; other types have null polygons."""
    text = spark.read.option("wholetext", "true").text(path)
    each = text.select(F.from_json("value", _FEATURES).alias("c")).select(F.posexplode("c.features").alias("ord", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(raw, "array<array<array<double>>>"))
    many = F.from_json(raw, "array<array<array<array<double>>>>")
    return each.select("ord", F.col("f.properties").alias("properties"), kind.alias("type"), F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).alias("coordinates"))


def write_regions_by_country(regions: DataFrame, places: DataFrame, path: str) -> None:
    """One partition a country for regions and for places, both written over whatever was there, so
    that no country of an older build stays. Rows are dealt by country and a salt."""
    for table, name in ((regions, "regions"), (places, "places")):
        salt = F.pmod(F.xxhash64(*[c for c in table.columns if c != "code"]), F.lit(8))
        table.repartition("code", salt).write.mode("overwrite").partitionBy("code").parquet(f"{path}/{name}")
