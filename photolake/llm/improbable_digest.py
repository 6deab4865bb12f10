"""Fingerprints of improbable features: rare byte windows in chained Bloom filters.

Every window of ``WINDOW`` bytes has a Shannon entropy; the further it is from what running text
has, the rarer the window. Among each ``SPAN`` neighbouring windows the rarest (first on a tie) gets
a vote; windows with ``VOTES`` or more are the text's features. Their hashes set five bits each in
2048-bit Bloom filters, a new filter after every ``PER_FILTER`` features. Two fingerprints are
compared filter by filter by shared bits, less those that chance shares, over those that could be.

A text shorter than a window is padded with zero bytes to one; an empty text has no features.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh
from .words import text_slices

WINDOW, SPAN, VOTES = 32, 32, 8
BITS, HASHES, PER_FILTER = 2048, 5, 160
TYPICAL_BITS = 3.7  # entropy of a window of running text
DULL_BITS = 1.0  # below, a window tells nothing

_BLOCK = 1 << 20  # bytes looked at together
_UNIT = 1 << 16
_counts = np.arange(WINDOW + 2, dtype=np.float64)
_CLOGC = np.rint(np.where(_counts > 0, _counts * np.log2(np.maximum(_counts, 1)), 0) * _UNIT).astype(np.int32)
_GAIN = np.diff(_CLOGC)  # _GAIN[c]: from c to c + 1 of a byte
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def window_sums(x: np.ndarray) -> np.ndarray:
    """Sum of c log2 c over the byte counts of each window, in 1/65536, for all window starts.

    How often a byte recurs among its next and last WINDOW - 1 neighbours gives the change of the
    sum from one window to the next; recurrence is 31 shifted comparisons of bytes.
    """
    n = len(x)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = int(_CLOGC[np.bincount(x[:WINDOW])].sum())
    change = _GAIN[behind[WINDOW:]] - _GAIN[ahead[: n - WINDOW]]
    return np.concatenate(([first], first + np.cumsum(change, dtype=np.int32))).astype(np.int32)


def rarity(sums: np.ndarray) -> np.ndarray:
    """Smaller is rarer."""
    bits_off = sums // WINDOW - int((np.log2(WINDOW) - TYPICAL_BITS) * _UNIT)
    rank = int(6 * _UNIT) - np.abs(bits_off)
    dull = sums // WINDOW > int((np.log2(WINDOW) - DULL_BITS) * _UNIT)
    return (np.where(dull, rank + 8 * _UNIT, rank) >> 6).astype(np.int64)


def _chosen(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the windows that win VOTES spans of a text x[starts[k]:starts[k] + sizes[k]]; texts
    are SPAN + WINDOW bytes apart."""
    rank = rarity(window_sums(x))
    edge = np.zeros(len(rank) + 1, np.int8)
    full = np.flatnonzero(sizes)
    np.add.at(edge, starts[full], 1)
    np.add.at(edge, starts[full] + sizes[full] - WINDOW + 1, -1)
    never = np.int64(1) << 62
    best = np.where(np.cumsum(edge[:-1]) > 0, rank << 34 | np.arange(len(rank)), never)
    best = np.concatenate((np.full(SPAN - 1, never), best, np.full(SPAN - 1, never)))
    width = 1
    while width < SPAN:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    # the first minimum of a sliding span never moves back, so its votes are run lengths
    change = np.flatnonzero(np.diff(best, prepend=-1))
    votes = np.diff(change, append=len(best))
    return best[change[(votes >= VOTES) & (best[change] < never)]] & ((1 << 34) - 1)


def _hashes(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[chosen]).view("<u8")
    h = np.zeros(len(chosen), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _MULTIPLIERS[k % 4]
        h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[0]
    return h ^ (h >> np.uint64(32))


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every window chosen, in order of place."""
    gap = SPAN + WINDOW
    sizes = np.array([max(len(t), WINDOW) if t else 0 for t in texts], np.int64)
    starts = np.cumsum(sizes + gap) - (sizes + gap)
    x = np.zeros(int((sizes + gap).sum()) + gap, np.uint8)
    for t, at in zip(texts, starts.tolist(), strict=True):
        x[at : at + len(t)] = np.frombuffer(t, np.uint8)
    chosen = _chosen(x, starts, sizes)
    return np.searchsorted(starts, chosen, "right") - 1, _hashes(x, chosen)


def _long_features(text: bytes, block: int) -> np.ndarray:
    """The features of one text of any length. A piece has the bytes that the spans of its own windows
    reach on both sides, so every window gets its votes in one piece."""
    out = []
    windows = len(text) - WINDOW + 1
    for a in range(0, windows, block):
        b, left = min(a + block, windows), max(a - SPAN + 1, 0)
        piece = np.frombuffer(text, np.uint8)[left : b + SPAN - 1 + WINDOW - 1]
        x = np.concatenate((piece, np.zeros(SPAN + 2 * WINDOW, np.uint8)))
        chosen = _chosen(x, np.array([0]), np.array([len(piece)]))
        h = _hashes(x, chosen[(chosen + left >= a) & (chosen + left < b)])
        _, first = np.unique(h, return_index=True)
        out.append(h[np.sort(first)])
    return np.concatenate(out)


def _filters(doc: np.ndarray, h: np.ndarray, texts: int) -> list[np.ndarray]:
    """Each feature once in a text, in order of its first place, in chained filters."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    keep = np.sort(order[new])
    h, doc = h[keep], doc[keep]
    per = np.bincount(doc, minlength=texts)
    place = np.arange(len(h)) - (np.cumsum(per) - per)[doc]
    filters = -(-per // PER_FILTER)
    base = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), BITS), bool)
    row = base[doc] + place // PER_FILTER
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + n] for a, n in zip(base.tolist(), filters.tolist(), strict=True)]


def fingerprints(texts: list[bytes], block: int = _BLOCK) -> list[np.ndarray]:
    """One array of filters, uint8 of shape (filters, BITS / 8), for each text. No more than about
    ``block`` bytes are looked at together; a longer text is looked at in pieces."""
    out = []
    for s in text_slices([len(t) for t in texts], block):
        some = texts[s]
        if len(some) == 1 and len(some[0]) > block:
            h = _long_features(some[0], block)
            out += _filters(np.zeros(len(h), np.int64), h, 1)
        else:
            out += _filters(*_features(some), len(some))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best partner, weighted by set bits."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a.shape == b.shape and (a == b).all():
        return 1.0
    x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    ones_x, ones_y = (np.bitwise_count(z).sum(1, dtype=np.int64).astype(float) for z in (x, y))
    total = 0.0
    for row, ones in zip(x, ones_x, strict=True):
        shared = np.bitwise_count(y & row).sum(1, dtype=np.int64)
        chance, most = ones * ones_y / BITS, np.minimum(ones, ones_y)
        total += ones * float(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / float(ones_x.sum())


def to_string(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with a column fingerprint (replaced if there is one; all other columns are kept).

    Null texts count as empty; empty texts have an empty fingerprint. Texts of any length are taken
    whole; equal texts and repeated rows have equal fingerprints. An empty table gives an empty one.
    """
    rest = docs.drop("fingerprint")
    body = fresh(rest.columns, "body")
    schema = T.StructType([*rest.schema, T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, batch.schema.names[-1]):
                prints = [to_string(p) for p in fingerprints(some.column(some.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(prints, pa.string())], [*some.schema.names[:-1], "fingerprint"])

    return rest.withColumn(body, F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about _BLOCK bytes together; a larger text stands alone."""
    for s in text_slices(pc.binary_length(batch[column]).to_pylist(), _BLOCK):
        yield batch.slice(s.start, s.stop - s.start)


NEIGHBOURS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, guard, doc_id, text) dealt so that every document is followed by the next one.

    Ids are cut into ranges of equal counts. The first document of each range also goes, as a guard
    row, to the end of the range before it (that of the first range to the last), so a task needs no
    other task's rows. Ties go by the text's hash; documents without an id come first.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = 8 * parts
    found = rows.agg(F.percentile_approx("doc_id", [k / cuts for k in range(1, cuts)], 20 * cuts).alias("q")).head()
    bounds = np.unique(np.array(found.q or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known.to_numpy()] = np.searchsorted(bounds, ids[known].to_numpy().astype(np.int64), "left")
        return pd.Series(out)

    thin = rows.select("doc_id", "h").withColumn("bucket", bucket_of("doc_id"))
    order = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "h")
    # one row for each range: at most 8 * parts, however many documents
    firsts = thin.groupBy("bucket").agg(F.min(order).alias("first")).orderBy("bucket").collect()
    guards = [(r.first.doc_id, r.first.h, firsts[k - 1].bucket) for k, r in enumerate(firsts)]
    guard = spark.createDataFrame(guards, "g_id long, g_h long, guards int")
    return (
        rows.withColumn("bucket", bucket_of("doc_id"))
        .join(F.broadcast(guard), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left")
        .withColumn(
            "at",
            F.explode(
                F.when(F.col("guards").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("guard")))).otherwise(
                    F.array(F.struct(F.col("bucket"), F.lit(False).alias("guard")), F.struct(F.col("guards").alias("bucket"), F.lit(True).alias("guard")))
                )
            ),
        )
        .select("at.bucket", "at.guard", "doc_id", "h", "text")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "guard", "doc_id", "h")
        .drop("h")
    )


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likenesses, see NEIGHBOURS.

    The edited text has the last quarter of the code points replaced by as many first ones of the
    next document. An only document is its own next one; repeated rows, and others that tie in
    doc_id, follow each other. Null texts count as empty, rows without a doc_id come first, texts of
    any length are taken whole, and other columns are not read. An empty table gives an empty one.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: tuple | None = None  # bucket, guard, doc_id, text, fingerprint of the last row
        for batch in batches:
            for some in _slices(batch, "text"):
                bodies = some["text"].to_pylist()
                rows = list(
                    zip(some["bucket"].to_pylist(), some["guard"].to_pylist(), some["doc_id"].to_pylist(), bodies, fingerprints([t.encode() for t in bodies]), strict=True)
                )
                rows = ([held] if held else []) + rows
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
                edited = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in pairs]
                coded = [t.encode() for t in edited]
                prints = fingerprints(coded)
                columns = [
                    pa.array([a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in coded], pa.string()),
                    pa.array([to_string(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([to_string(p) for p in prints], pa.string()),
                    pa.array([1.0 if a[3] == t else likeness(a[4], p) for (a, _), p, t in zip(pairs, prints, edited, strict=True)], pa.float64()),
                    pa.array([1.0 if a[3] == b[3] else likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NEIGHBOURS.split(", ")])

    return with_next(docs, parts).mapInArrow(run, NEIGHBOURS)
