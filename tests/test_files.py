"""Byte fixtures: containers, readers, writers and streams."""

import json
import struct
import zlib

from photolake.operators import containers as ct
from photolake.sources import backups, boundaries, files
from photolake.streaming import photos as arriving


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def tiff(order=">"):
    data = b"Nikon\0"
    head = struct.pack(f"{order}2sHI", b"MM" if order == ">" else b"II", 42, 8)
    ifd = struct.pack(f"{order}H", 2) + struct.pack(f"{order}HHII", 0x010F, 2, len(data), 38) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, 6, 0) + bytes(4)
    return head + ifd + data


JPEG = b"\xff\xd8" + segment(0xE0, b"JF") + segment(0xE1, b"Exif\0\0" + tiff()) + segment(0xE2, b"icc") + segment(0xED, b"iptc") + segment(0xEE, b"Adobe") + b"\xff" + segment(0xFE, b"hi") + b"\xff\xda" + b"scan\xff\xd9tail"
CLEAN = b"\xff\xd8" + segment(0xE0, b"JF") + segment(0xE2, b"icc") + segment(0xEE, b"Adobe") + b"\xff\xda" + b"scan\xff\xd9tail"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def riff(*parts):
    body = b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in parts)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def test_strip():
    assert ct.strip(JPEG) == ("image/jpeg", CLEAN)
    for broken in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\x00\x01", b"\xff\xd8\xff\xe1\xff\xff", b"\xff\xd8abcd", JPEG[:20]):
        assert ct.strip(broken) is None
    png = ct.PNG_SIGNATURE + chunk(b"IHDR", b"x" * 13) + chunk(b"tEXt", b"k\0v") + chunk(b"eXIf", tiff()) + chunk(b"IDAT", b"d") + chunk(b"IEND", b"")
    assert ct.strip(png + b"junk") == ("image/png", ct.PNG_SIGNATURE + chunk(b"IHDR", b"x" * 13) + chunk(b"IDAT", b"d") + chunk(b"IEND", b""))
    assert ct.strip(png[:-14]) is None
    webp = riff((b"VP8X", b"\x2c" + bytes(9)), (b"VP8L", b"abc"), (b"EXIF", b"Exif\0\0" + tiff("<")), (b"XMP ", b"y"))
    assert ct.strip(webp) == ("image/webp", riff((b"VP8X", b"\x20" + bytes(9)), (b"VP8L", b"abc")))
    plain = riff((b"VP8X", b"\x2c" + bytes(9)), (b"VP8L", b"abcd"))
    assert ct.strip(plain) == ("image/webp", plain)
    for data in (JPEG, png, webp):
        assert ct.read_exif(data) == {"Make": "Nikon", "Orientation": 6}
    assert ct.read_exif(JPEG[:30]) == ct.read_exif(b"") == {}


def test_photos_from_disk_and_stream(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a b+c.jpg").write_bytes(JPEG)
    rows = zlib.compress((b"\0" + bytes(12)) * 2)
    (folder / "x.png").write_bytes(ct.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b""))
    rows = {r.name: r for r in files.read_photos(spark, str(tmp_path / "in")).collect()}
    assert rows["a b+c.jpg"].mime == "image/jpeg" and rows["a b+c.jpg"].bytes == len(JPEG)
    sizes = [(r.width, r.height, r.channels) for r in files.read_rasters(spark, str(tmp_path / "in")).collect()]
    assert sizes == [(3, 2, 4)]
    for _ in range(2):
        query = arriving.append_library(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/photos")).count() == 2
    assert {r.tag for r in spark.read.parquet(str(tmp_path / "out/tags")).collect()} == {"Make", "Orientation"}


def test_boundary_files(spark, tmp_path):
    data = {
        "transform": {"scale": [0.1, 0.1], "translate": [-1, 2]}, "arcs": [[[0, 0], [4, 0], [0, 4]], [[0, 0], [0, 4], [4, 0]]], "names": ["Land"], "codes": ["LND"],
        "polys": [{"c": 0, "b": [0, 0, 4, 4], "r": [[0, -2]]}], "places": [["Town", 1, 2]],
    }
    (tmp_path / "lnd.json").write_text(json.dumps(data))
    from photolake.operators import geo

    sets = boundaries.read_boundaries(spark, str(tmp_path))
    ring = geo.stitch_rings(sets["rings"], geo.decode_arcs(sets["arcs"])).head()
    assert [(p.x, p.y) for p in ring.points] == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)] and ring.set_id == "lnd"
    assert tuple(sets["polygons"].head()) == ("lnd", 0, 0, "Land", "LND") and tuple(sets["places"].head()) == ("lnd", 0, "Town", 1, 2)


def test_gazetteer_features_and_regions(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1\tA \"q\" town\t\t\t1.5\t2.5\t\t\tFR\n2\tB\n")
    got = boundaries.read_gazetteer(spark, str(tmp_path / "g.txt")).collect()
    assert (got[0].name, got[0].lat, got[0].lon, got[0].a2) == ('A "q" town', "1.5", "2.5", "FR") and got[1].a2 is None
    feature = lambda kind, c: {"properties": {"name": kind}, "geometry": {"type": kind, "coordinates": c}}
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    (tmp_path / "f.json").write_text(json.dumps({"features": [feature("Polygon", square), feature("MultiPolygon", [square, square]), feature("Point", [0, 0])]}))
    assert [None if r.coordinates is None else len(r.coordinates) for r in boundaries.read_admin_features(spark, str(tmp_path / "f.json")).orderBy("ord").collect()] == [1, 2, None]
    regions = spark.createDataFrame([("AAA", 1, "r"), ("BBB", 2, "s")], "code string, ord long, name string")
    boundaries.write_regions_by_country(regions, regions, str(tmp_path / "out"))
    boundaries.write_regions_by_country(regions.filter("code = 'AAA'"), regions, str(tmp_path / "out"))
    assert [r.code for r in spark.read.parquet(str(tmp_path / "out/regions")).collect()] == ["AAA"]


def test_backups_and_export(spark, tmp_path):
    from pyspark.sql import functions as F

    photos = spark.createDataFrame([(1, "a.png", "", b"\x00\xff"), (2, "b.png", "image/png", b"z")], "photo_id long, name string, mime string, content binary")
    rect = F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")
    edits = photos.select("photo_id", F.struct(F.lit(1.0).alias("width")).alias("target"), rect.alias("crop"), F.array().cast("array<struct<x:double>>").alias("boxes"))
    backups.write_backups(photos, edits, str(tmp_path / "b"))
    got = backups.read_backups(spark, str(tmp_path / "b")).select("reason", "content", "b.fileType").collect()
    assert sorted((r.reason, bytes(r.content), r.fileType) for r in got) == [(None, b"\x00\xff", "image/png"), (None, b"z", "image/png")]
    exports = photos.select(F.lit("same.png").alias("file_name"), "photo_id", F.col("photo_id").alias("ord"), "content")
    files.write_export(exports, str(tmp_path / "e"))
    row = spark.read.parquet(str(tmp_path / "e")).collect()
    assert len(row) == 1 and row[0].photo_id == 2 and row[0].collisions == 2


def test_picture_files_are_opened_once(spark):
    """Every look at the pixels opened all files again."""
    from photolake.plans import file_queries

    plan = file_queries.s2_i5(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "image" in plan and "FileScan image" not in plan and "ImageFileFormat" not in plan


def test_photos_are_listed_and_opened_by_tasks(spark, tmp_path):
    """A plan that names each file passed through the driver, and empty files were left out."""
    root = tmp_path / "in put"
    names = ["a b+c.jpg", "é.png", "q#r?.jpg", "plain", "k=1/l.jpg", "deep/er/m.heic", "_k=2/n.jpg", "_hidden.jpg", ".hidden.jpg", "_under/o.jpg", ".under/p.jpg", "part._COPYING_"]
    for k, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * (k + 1))
    (root / "gone.jpg").symlink_to(root / "nowhere")
    own = files._named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}"))
    want = sorted(tuple(r) for r in own.collect())
    assert len(want) == 7
    for path in (f"{root}", f"{root}/", f"file:{root}", f"file://{root}"):
        found = files.read_photos(spark, path)
        assert found.schema == own.schema and sorted(tuple(r) for r in found.collect()) == want
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    planned = files.read_photos(spark, str(root), content=False)
    assert sorted(tuple(r) for r in planned.collect()) == [r[:-1] for r in want] and planned.columns == own.columns[:-1]
    assert [r[1] for r in files.read_photos(spark, str(root / "plain")).collect()] == ["plain"]
    (root / "empty.jpg").write_bytes(b"")
    assert {(r.name, r.bytes, bytes(r.content)) for r in files.read_photos(spark, str(root)).collect() if not r.bytes} == {("empty.jpg", 0, b"")}
    (tmp_path / "nothing").mkdir()
    assert files.read_photos(spark, str(tmp_path / "nothing")).count() == 0


def test_large_photos_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_BATCH_BYTES", 1000)
    for k in range(40):
        (tmp_path / f"{k}.jpg").write_bytes(bytes([k]) * (10 if k % 3 else 2500))
    got = {r.name: bytes(r.content) for r in files.read_photos(spark, str(tmp_path)).collect()}
    assert got == {f"{k}.jpg": bytes([k]) * (10 if k % 3 else 2500) for k in range(40)}


def test_every_text_is_a_file_in_one_of_many_folders(spark, tmp_path, monkeypatch):
    """All files were written into one folder; those of empty texts were not read."""
    import duckdb

    from photolake.plans import file_queries
    from photolake.plans.queries import ORACLE_SQL

    monkeypatch.setattr(file_queries, "work_path", lambda spark, tag: str(tmp_path / tag))
    spark.createDataFrame([(k, "é" * k) for k in range(500)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in file_queries.s1(spark, str(tmp_path)).collect()) == sorted(con.execute(ORACLE_SQL["s1_photo_files"]).fetchall())
    folders = [len([f for f in d.iterdir() if f.is_file()]) for d in (tmp_path / "photos").iterdir() if d.is_dir()]
    assert sum(folders) == 500 and max(folders) < 50
