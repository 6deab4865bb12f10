"""Photo files as rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cut import settle

#: Folders over which written files are dealt.
_FOLDERS = 256
#: Files and bytes that one task opens.
_TASK_FILES, _TASK_BYTES = 5_000, 256 << 20
#: Rows and bytes of one batch.
_BATCH_FILES, _BATCH_BYTES = 1_000, 16 << 20

_MIMES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif", "avif": "image/avif", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml"}


def _named(raw: DataFrame) -> DataFrame:
    name = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    mimes = F.create_map(*[F.lit(x) for pair in _MIMES.items() for x in pair])
    return raw.select(F.sha2("path", 256).alias("photo_id"), name.alias("name"), F.coalesce(mimes[ext], F.lit("")).alias("mime"), F.col("length").alias("bytes"), "modificationTime", *(c for c in raw.columns if c == "content"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder there; Spark's paths are not encoded, Arrow's URIs are."""
    return fs.FileSystem.from_uri(quote(path, safe=":/") if path.startswith("file:") else path)


def _is_folder(path: str) -> bool:
    """False, too, for paths of file systems that Arrow does not open."""
    try:
        store, root = _store(path)
        return store.get_file_info(root).type == fs.FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def _found_below(spark: SparkSession, path: str) -> DataFrame:
    """at, length, modified of the files below a folder, listed by tasks, one level of folders after the other.
    Files and folders that Spark's sources take for hidden are left out."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        for batch in batches:
            for folder in batch["at"].to_pylist():
                found = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.type in (fs.FileType.File, fs.FileType.Directory)]
                for k in range(0, len(found), 10_000):
                    some = found[k : k + 10_000]
                    columns = [f.path for f in some], [f.size for f in some], [f.mtime_ns and f.mtime_ns // 1_000_000 for f in some], [f.type == fs.FileType.Directory for f in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["at", "length", "modified", "is_folder"])

    name = F.regexp_extract("at", r"([^/]+)/*$", 1)
    hidden = (name.startswith("_") & ~name.contains("=")) | name.startswith(".") | name.endswith("._COPYING_")
    seen = ~hidden | name.startswith("_metadata") | name.startswith("_common_metadata")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.range(0, 1, 1, 1).select(F.lit(_store(path)[1]).alias("at")), []
    while not files or not level.isEmpty():
        found = settle(level.mapInArrow(listed, "at string, length long, modified long, is_folder boolean").filter(seen))
        files.append(found.filter("NOT is_folder").drop("is_folder"))
        level = found.filter("is_folder").select("at").repartition(tasks, "at")
    return reduce(DataFrame.unionByName, files)


def read_photos(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Every file below ``path``, empty ones too: photo_id (of its path), name, mime (of its extension), bytes,
    modificationTime, content. Jobs that only plan ask for no content, and no file is opened.

    Folders are listed and files opened by tasks of many files each; no list of the files passes through the
    driver. What is no folder, or in a file system that Arrow does not open, is left to Spark's own source,
    which lists files on the driver, opens few in a task and leaves empty ones out.
    """
    if not _is_folder(path):
        photos = _named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
        return photos if content else photos.drop("content")
    store, root = _store(path)
    before = "file:" if store.type_name == "local" else path.rstrip("/").removesuffix(root)
    found = _found_below(spark, path)
    raw = found.select("at", F.concat(F.lit(before), "at").alias("path"), "length", F.timestamp_millis("modified").alias("modificationTime"))
    if not content:
        return _named(raw)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        for batch in batches:
            start, size, contents = 0, 0, []
            for k, at in enumerate(batch["at"].to_pylist(), 1):
                with store.open_input_stream(at) as file:
                    contents.append(file.read())
                size += len(contents[-1])
                if k == len(batch) or len(contents) == _BATCH_FILES or size >= _BATCH_BYTES:
                    yield batch.slice(start, k - start).append_column("content", pa.array(contents, pa.binary()))
                    start, size, contents = k, 0, []

    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).head()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // _TASK_FILES), -(-size // _TASK_BYTES))
    return _named(raw.repartition(tasks, "at").mapInArrow(opened, "at string, path string, length long, modificationTime timestamp, content binary"))


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures: origin, width, height, channels, data. Undecodable files are left out."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return images.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def write_files(files: DataFrame, path: str) -> None:
    """One file for each row (name, content) below ``path``, any file system that Arrow opens: in folders by
    a hash of the name, so that tasks neither write nor list one folder of all files. A task that runs again
    writes the same files again."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        made = set()
        for batch in batches:
            for name, folder, content in zip(*(batch[c].to_pylist() for c in ("name", "folder", "content")), strict=True):
                if folder not in made:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{root}/{folder}/{name}") as out:
                    out.write(content)
            yield batch.select(["name"])

    folder = F.pmod(F.xxhash64("name"), F.lit(_FOLDERS)).cast("string").alias("folder")
    files.select("name", folder, "content").mapInArrow(save, "name string").write.format("noop").mode("overwrite").save()


def write_export(exports: DataFrame, path: str) -> None:
    """Exports (file_name, ord, content) as Parquet, the later one of a name alone.

    The winner is chosen on names and ordinals; bytes join last, by photo_id.
    """
    from ..operators.planning import export_manifest

    winners = export_manifest(exports.select("file_name", "photo_id", "ord"))
    exports.join(winners, ["file_name", "photo_id"]).select("file_name", "photo_id", "collisions", "content").write.mode("overwrite").parquet(path)
