"""Token ids of all documents as ORC, in ascending document order.

Each file is one range of doc_ids. ORC stores the ids and counts with its integer run-length
encoding, cuts files into stripes that readers take in parallel, keeps a row index every
``row_index_stride`` rows and a Bloom filter on ``doc_id``, so a lookup of few documents prunes
stripes and row groups by metadata alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkTable, byte_chars, text_blocks

FILE_SCHEMA = "doc_id long, file_start long, n_tokens int, tokens array<int>"
_LATIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_tables: dict[tuple[str, ...], ChunkTable] = {}


def chunk_table(path: str, markers: tuple[str, ...] = ()) -> ChunkTable:
    """The library's tokenizer behind a table of chunks; one for each worker process. ``markers`` are
    tokens of their own besides the tokenizer's; ``widths`` has each token's bytes.

    A chunk that is a Latin word is one piece of the pretokenizer's and goes to the library's model
    as it is; all others go through the whole library.
    """
    if (path, *markers) not in _tables:
        import os

        from tokenizers import AddedToken, Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.add_special_tokens([AddedToken(m, normalized=False) for m in markers])
        added = [a.content for a in tokenizer.get_added_tokens_decoder().values()]
        # an added token of letters, or a normalizer, may turn words into something else
        plain = tokenizer.normalizer is None and not any(_LATIN.search(a.encode()[:1]) for a in added)
        chars = dict(enumerate(byte_chars()))
        model = tokenizer.model

        def encode(chunks: list[bytes]) -> list[np.ndarray]:
            out: list[np.ndarray | None] = [None] * len(chunks)
            rest = []
            for k, chunk in enumerate(chunks):
                if plain and _LATIN.fullmatch(chunk):
                    out[k] = np.array([t.id for t in model.tokenize(chunk.decode("latin-1").translate(chars))], "<u4")
                else:
                    rest.append(k)
            coded = tokenizer.encode_batch_fast([chunks[k].decode() for k in rest], add_special_tokens=False)
            for k, e in zip(rest, coded, strict=True):
                out[k] = np.array(e.ids, "<u4")
            return out

        table = _tables[path, *markers] = ChunkTable(encode, added)
        sizes = {k: len(t) for t, k in tokenizer.get_vocab(with_added_tokens=False).items()}  # a character stands for a byte
        sizes |= {k: len(a.content.encode()) for k, a in tokenizer.get_added_tokens_decoder().items()}
        table.widths = np.zeros(max(sizes) + 1, np.int64)
        table.widths[list(sizes)] = list(sizes.values())
    return _tables[path, *markers]


def _ended(ids: np.ndarray, n: np.ndarray, end_id: int) -> pa.ListArray:
    """A list of ids for each text, closed by ``end_id``."""
    ends = np.cumsum(n + 1)
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = ids
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(out.view(np.int32)))


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, stripe_mb: int = 64, row_index_stride: int = 10_000
) -> None:
    """Encode (doc_id, text) and write FILE_SCHEMA rows, one ORC file per range of doc_ids.

    Null and empty texts are the end id alone. Documents without an id come first; ties go by the
    text's hash; repeated rows stay. Other columns are not read. An empty table writes no rows.
    """
    body = F.coalesce("text", F.lit("")).alias("text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select("doc_id", body)
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            table = chunk_table(tokenizer_path)
            for a, b, x, edges in text_blocks(batch["text"]):
                ids, n = table.encode_block(x, edges)
                sizes = n + 1
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(starts), pa.array(sizes.astype(np.int32)), _ended(ids, n, end_id)],
                    ["doc_id", "file_start", "n_tokens", "tokens"],
                )

    (
        ordered.mapInArrow(run, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens of a folder of files."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = spark.read.schema(FILE_SCHEMA).orc(path).withColumn("file", number)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file: a proven bound for the window and the broadcast
    bases = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "file").select(
        "doc_id", (F.col("file_start") + F.col("base")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "tokens"
    )


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of few documents; the filter reaches the files' indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).filter(F.col("doc_id").isin(*doc_ids))


def with_crc(tokens: DataFrame) -> DataFrame:
    """ids_crc32: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            ids, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
            crcs = np.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
