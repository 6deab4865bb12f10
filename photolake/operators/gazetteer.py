"""Building regions and places tables from raw feature and gazetteer files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import sent, settle
from ..functions.numbers import rnd
from ..functions.places import number_rows


def bridge_alpha2(admin0: DataFrame) -> DataFrame:
    """(a2, a3) from rows (ord, a2, a3, type): of several claimants of a code the last that is no
    dependency, or the first if all are. Missing and '-99' codes are dropped."""
    dependency = F.coalesce(F.col("type") == "Dependency", F.lit(False))
    known = admin0.filter(F.col("a2").isNotNull() & (F.col("a2") != "") & (F.col("a2") != "-99"))
    return known.groupBy("a2").agg(
        F.coalesce(F.max_by(F.when(~dependency, F.col("a3")), F.when(~dependency, F.col("ord"))), F.min_by("a3", "ord")).alias("a3")
    )


def clean_places(gazetteer: DataFrame, bridge: DataFrame) -> DataFrame:
    """Named places with finite coordinates and a country; blank coordinates count as 0."""
    number = lambda c: F.when(F.trim(c) == "", F.lit(0.0)).otherwise(F.trim(F.col(c)).try_cast("double"))
    rows = gazetteer.select("ord", "name", number("lat").alias("lat"), number("lon").alias("lon"), "a2")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = rows.filter(F.col("name").isNotNull() & (F.col("name") != "") & finite("lat") & finite("lon"))
    return sound.join(sent(settle(bridge)), "a2").select(F.col("a3").alias("code"), "ord", "name", "lat", "lon")


def named_regions(admin1: DataFrame) -> DataFrame:
    """(code, ord, name): the local name or else the English one; rows without code or name go."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("name_en", F.lit("")))
    return admin1.select(F.col("adm0_a3").alias("code"), "ord", name.alias("name")).filter("code is not null and code <> '' and name is not null")


def regions_by_country(regions: DataFrame) -> DataFrame:
    """(code, names in file order)."""
    return regions.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("r")).select("code", F.col("r.name").alias("names"))


def unmatched_regions(regions: DataFrame, countries: DataFrame) -> DataFrame:
    """(code, regions) of codes that no country has."""
    return regions.join(countries.select("code").distinct(), "code", "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("regions"))


def keep_multi_region(regions: DataFrame) -> DataFrame:
    """Regions of countries with two or more. Counted apart, so a large country is no hot window."""
    many = regions.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("code")
    return regions.join(many, "code", "left_semi")


def flatten_polygons(features: DataFrame) -> DataFrame:
    """(name_id, name, part, ring, v, lon, lat) of features (ord, name, type, coordinates).

    coordinates: array of polygons of rings of [lon, lat]; a Polygon has one. Other geometry types
    and unnamed features are dropped; name_id is the feature's place among those kept by ``ord``.
    """
    kept = features.filter(F.col("type").isin("Polygon", "MultiPolygon") & F.col("name").isNotNull() & (F.col("name") != ""))
    named = kept.join(number_rows(kept.select("ord"), ["ord"], "name_id"), "ord")
    parts = named.select("ord", "name_id", "name", F.posexplode("coordinates").alias("part", "rings"))
    rings = parts.select("ord", "name_id", "name", "part", F.posexplode("rings").alias("ring", "points"))
    return rings.select("ord", "name_id", "name", "part", "ring", F.posexplode("points").alias("v", "p")).select(
        "ord", "name_id", "name", "part", "ring", "v", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")
    )


def polygon_boxes(vertices: DataFrame) -> DataFrame:
    """Bounding boxes of outer rings."""
    outer = vertices.filter("ring = 0")
    return outer.groupBy("ord", "name_id", "name", "part").agg(*[f(c).alias(a) for f, c, a in ((F.min, "lon", "w"), (F.min, "lat", "s"), (F.max, "lon", "e"), (F.max, "lat", "n"))])


def quantise_places(places: DataFrame, transforms: DataFrame) -> DataFrame:
    """Places on their country's grid, rounded. ``transforms``: code, scale_x, scale_y, tx, ty."""
    at = places.join(transforms, "code")
    return at.select("code", "ord", "name", rnd((F.col("lon") - F.col("tx")) / F.col("scale_x")).alias("qx"), rnd((F.col("lat") - F.col("ty")) / F.col("scale_y")).alias("qy"))


def country_codes(world: DataFrame, admin0: DataFrame, aliases: dict[str, str], dropped: tuple[str, ...] = ("Antarctica",)) -> DataFrame:
    """(name, code) for every name of ``world``: the last admin-0 row of that name, or of its alias.
    Fails on a name that stays unresolved."""
    kept = world.filter(~F.col("name").isin(*dropped))
    asked = F.col("name")
    for name, alias in aliases.items():
        asked = F.when(F.col("name") == name, F.lit(alias)).otherwise(asked)
    codes = admin0.groupBy(F.col("name").alias("asked")).agg(F.max_by("a3", "ord").alias("code"))
    told = kept.withColumn("asked", asked).join(codes, "asked", "left")
    sure = F.when(F.col("code").isNotNull(), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("no code for "), F.col("name"))).cast("string"))
    return told.select("name", sure.alias("code"))


def placeless_audit(regions: DataFrame, places: DataFrame) -> DataFrame:
    """Countries that have regions and no places."""
    return regions.select("code").distinct().join(places.select("code").distinct(), "code", "left_anti")


def placeless_check(regions: DataFrame, places: DataFrame, most: int = 2) -> DataFrame:
    """One row: countries that have regions and no places, and whether these are no more than ``most``.
    More means that codes failed to bridge."""
    n = placeless_audit(regions, places).agg(F.count(F.lit(1)).alias("placeless"))
    return n.withColumn("sound", F.col("placeless") <= most)


def country_documents(regions: DataFrame, places: DataFrame) -> DataFrame:
    """(code, places, json) of each country that has regions: its region names and its quantised places
    (name, qx, qy), both in order; a country without places has none."""
    towns = places.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "qx", "qy"))).alias("t"))
    rows = regions_by_country(regions).join(towns, "code", "left")
    spots = F.coalesce(F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["qx"].alias("qx"), t["qy"].alias("qy"))), F.array())
    return rows.select("code", F.size(spots).cast("long").alias("places"), F.to_json(F.struct("code", "names", spots.alias("places"))).alias("json"))


def build_totals(regions: DataFrame, places: DataFrame) -> DataFrame:
    """One row: countries with regions, regions, places."""
    r = regions.agg(F.count_distinct("code").alias("countries"), F.count(F.lit(1)).alias("regions"))
    p = places.agg(F.count(F.lit(1)).alias("places"))
    return r.withColumn("k", F.lit(1)).join(p.withColumn("k", F.lit(1)), "k").drop("k")


def written_totals(documents: DataFrame) -> DataFrame:
    """One row: countries written, their places and the bytes of all documents."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return documents.agg(F.count(F.lit(1)).alias("countries"), total("places", "places"), total(F.octet_length("json"), "bytes"))
