"""Line dedup that can be taken back: exact reference counts, and cuckoo filters over them.

State, all Parquet in the shared folder and all dealt by the line key:

* ``refs``    (doc_id, key): which document holds which long line, once per pair.
* ``counts``  (key, n_docs, max_doc): derived from ``refs``, exact.
* ``filters`` (shard, data): cuckoo filters of the keys that reach ``min_docs``, one per shard. A lookup that misses is certain; a hit is confirmed against ``counts``.

Inserting documents adds refs and puts keys that come to ``min_docs`` into their filter; deleting
documents removes refs and takes keys that fall below it out again, which a cuckoo filter allows and
a Bloom filter does not. A line's key is the line stripped of ASCII space, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, packed, quoted

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4  # of a bucket
_KICKS = 500
_SHARD_KEYS = 200_000  # keys of a filter
_LOT_KEYS = 500_000  # keys that a task asks a filter for
_HOT = 2_000  # documents of a key from which its verdict is broadcast


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _digest(key: Column) -> Column:
    """128 bits: lines are equal when these are."""
    return F.unhex(F.md5(key.cast("binary")))


class CuckooFilter:
    """16-bit fingerprints in buckets of four, two buckets for each key (partial-key hashing)."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Buckets for a load of 0.8 at most, a power of two."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.8 * SLOTS)))) if keys else 2))

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of digests given as rows of two uint64."""
        prints = ((digests[:, 0] >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        first = (digests[:, 1] & np.uint64(self.mask)).astype(np.int64)
        return prints, first, first ^ self._hop(prints)

    def _hop(self, prints):
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        if not len(digests):
            return np.zeros(0, bool)
        prints, a, b = self._places(digests)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def insert(self, digests: np.ndarray) -> CuckooFilter:
        """All keys at once, in rounds in which each bucket takes one: into a free slot of a key's
        first bucket, then of its second, then by moving another print to that one's other bucket."""
        if not len(digests):
            return self
        prints, at, other = self._places(digests)
        moves = np.zeros(len(prints), np.int64)
        while len(prints):
            _, one = np.unique(at, return_index=True)
            free = self.table[at[one]] == 0
            some = free.any(1)
            done, stuck = one[some], one[~some]
            self.table[at[done], free[some].argmax(1)] = prints[done]
            moves[stuck] += 1
            if (moves > _KICKS).any():
                raise OverflowError("the filter is full; rebuild it from the counts")
            fresh = stuck[moves[stuck] == 1]
            at[fresh] = other[fresh]
            kick = stuck[moves[stuck] > 1]
            slot = (moves[kick] * 7 + prints[kick]) % SLOTS
            prints[kick], self.table[at[kick], slot] = self.table[at[kick], slot], prints[kick].copy()
            at[kick] ^= self._hop(prints[kick])
            left = np.ones(len(prints), bool)
            left[done] = False
            prints, at, other, moves = prints[left], at[left], other[left], moves[left]
        return self

    def delete(self, digests: np.ndarray) -> None:
        """Only of keys that were inserted."""
        if not len(digests):
            return
        prints, at, other = self._places(digests)
        second = np.zeros(len(prints), bool)
        while len(prints):
            _, one = np.unique(at, return_index=True)
            held = self.table[at[one]] == prints[one, None]
            some = held.any(1)
            self.table[at[one[some]], held[some].argmax(1)] = 0
            gone = np.zeros(len(prints), bool)
            gone[one[some]] = True
            missed = one[~some]
            gone[missed[second[missed]]] = True
            again = missed[~second[missed]]
            at[again], second[again] = other[again], True
            prints, at, other, second = prints[~gone], at[~gone], other[~gone], second[~gone]


def _rows(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def build_filter(keys: np.ndarray) -> CuckooFilter:
    """A filter of exactly these keys, doubled until all fit."""
    filter_ = CuckooFilter.sized(len(keys))
    while True:
        try:
            return filter_.insert(keys)
        except OverflowError:
            filter_ = CuckooFilter(2 * (filter_.mask + 1))


@dataclass
class LineState:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int


def line_refs(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, key) once per document and long line. Documents without an id hold none."""
    keys = F.transform(F.split(F.col("text"), "\n", -1), line_key)
    long_ = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    lines = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.transform(long_, _digest)).alias("key"))
    return lines


def _counts(refs: DataFrame) -> DataFrame:
    # a doc_id may come in several rows: pairs are made distinct first, which no hot key skews
    once = refs.select("doc_id", "key").distinct()
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


_FILTER = "shard int, data binary"


def _build_filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "data": [build_filter(_rows(pdf["key"])).dumps()]})

    return counts.filter(F.col("n_docs") >= min_docs).select(_shard(shards), "key").groupBy("shard").applyInPandas(build, _FILTER)


def build_state(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shards: int | None = None) -> LineState:
    """Count all lines of ``docs`` and fill the filters: a filter for each _SHARD_KEYS of the keys that
    reach ``min_docs``, one for each task at least, or as many as ``shards`` says."""
    refs = materialise(line_refs(docs, min_chars), "lines-refs")
    counts = materialise(_counts(refs), "lines-counts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or max(parts, -(-counts.filter(F.col("n_docs") >= min_docs).count() // _SHARD_KEYS))
    return LineState(refs, counts, materialise(_build_filters(counts, min_docs, shards), "lines-filters"), min_docs, min_chars, shards)


def _update(state: LineState, refs: DataFrame, touched: DataFrame) -> LineState:
    """Recount the touched keys, and move those that crossed ``min_docs`` in or out of a filter."""
    refs = materialise(refs, "lines-refs")
    keys = touched.select("key").distinct()
    fresh = _counts(refs.join(keys, "key", "left_semi"))
    counts = materialise(
        state.counts.join(keys, "key", "left_anti").unionByName(fresh), "lines-counts"
    )
    was, now = (c.filter(F.col("n_docs") >= state.min_docs).join(keys, "key", "left_semi").select(_shard(state.shards), "key") for c in (state.counts, counts))
    moved = now.join(was, ["shard", "key"], "left_anti").withColumn("enters", F.lit(True)).unionByName(
        was.join(now, ["shard", "key"], "left_anti").withColumn("enters", F.lit(False))
    )

    def apply(old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else moves)["shard"].iloc[0])
        filter_ = CuckooFilter.loads(old["data"].iloc[0]) if len(old) else CuckooFilter.sized(len(moves))
        filter_.delete(_rows(moves["key"][~moves["enters"]]))
        try:
            filter_.insert(_rows(moves["key"][moves["enters"]]))
        except OverflowError:
            return pd.DataFrame({"shard": [shard], "data": [None]})
        return pd.DataFrame({"shard": [shard], "data": [filter_.dumps()]})

    changed = materialise(state.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(apply, _FILTER), "lines-filters")
    full = changed.filter("data is null").select("shard")
    # at most one row per shard
    again = _build_filters(counts.join(F.broadcast(full), _shard(state.shards) == full["shard"], "left_semi"), state.min_docs, state.shards)
    filters = materialise(changed.filter("data is not null").unionByName(again), "lines-filters")
    return LineState(refs, counts, filters, state.min_docs, state.min_chars, state.shards)


def insert_documents(state: LineState, docs: DataFrame) -> LineState:
    new = materialise(line_refs(docs, state.min_chars), "lines-new")
    return _update(state, state.refs.unionByName(new), new)


def delete_documents(state: LineState, doc_ids: DataFrame) -> LineState:
    gone = doc_ids.select("doc_id").distinct()
    return _update(state, state.refs.join(gone, "doc_id", "left_anti"), state.refs.join(gone, "doc_id", "left_semi"))


def _probe(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Keys that their shard's filter may hold. One row a key, so shards are even; each is cut into
    lots of about _LOT_KEYS keys, every lot is preceded by its filter, and keys stream past it."""
    lots = max(1, -(-keys.count() // (shards * _LOT_KEYS)))
    lot = F.pmod(F.xxhash64(F.lit("lot"), "key"), F.lit(lots)).cast("int")
    asked = keys.select((_shard(shards) * lots + lot).alias("at"), F.lit(None).cast("binary").alias("data"), "key")
    held = filters.select(F.explode(F.sequence(F.col("shard") * lots, F.col("shard") * lots + lots - 1)).alias("at"), "data", F.lit(None).cast("binary").alias("key"))
    dealt = held.unionByName(asked).repartitionById(shards * lots, "at").sortWithinPartitions("at", F.col("data").asc_nulls_last())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filter_ = None, None
        for batch in batches:
            at = batch["at"].to_numpy()
            found = np.zeros(len(at), bool)
            heads = np.flatnonzero(batch["data"].is_valid().to_numpy(zero_copy_only=False)).tolist()
            edges = sorted({0, *heads, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)})
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a in heads:
                    now, filter_ = at[a], CuckooFilter.loads(batch["data"][a].as_py())
                    a += 1
                if a < b and at[a] == now:
                    found[a:b] = filter_.contains(_rows(batch["key"].slice(a, b - a).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["key"].filter(pa.array(found))], ["key"])

    return dealt.mapInArrow(look, "key binary")


def _drops(state: LineState, refs: DataFrame) -> DataFrame:
    """(doc_id, keys): the lines that each document loses."""
    asked = materialise(refs.select("key").distinct(), "lines-asked")
    hits = _probe(asked, state.filters, state.shards)
    verdicts = materialise(hits.join(state.counts.filter(F.col("n_docs") >= state.min_docs), "key"), "lines-verdicts")
    # a key with _HOT documents or more takes that many of the refs, so there are few of them:
    # at most refs / _HOT rows of 24 bytes. The others bring under _HOT rows to a task each.
    hot, cold = verdicts.filter(F.col("n_docs") >= _HOT), verdicts.filter(F.col("n_docs") < _HOT)
    lost = F.col("doc_id") != F.col("max_doc")
    rest = refs
    found = []
    n_hot = hot.count()
    if n_hot and n_hot * 64 < 64 << 20:
        few = F.broadcast(hot.select("key", "max_doc"))
        found.append(refs.join(few, "key").filter(lost).select("doc_id", "key"))
        rest = refs.join(F.broadcast(hot.select("key")), "key", "left_anti")
    elif n_hot:
        cold = verdicts
    found.append(rest.join(cold.select("key", "max_doc"), "key").filter(lost).select("doc_id", "key"))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return pairs.groupBy("doc_id").agg(F.collect_set("key").alias("lost_keys"))


def drop_lines(docs: DataFrame, state: LineState | None = None, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``docs`` with text cut, n_lines (before) and n_dropped.

    A line whose key has ``min_chars`` code points or more and is in ``min_docs`` documents or more
    stays only in the largest doc_id that holds it, there every time it occurs. Null texts count as
    one empty line and stay null; rows without a doc_id keep all lines and count for none; repeated
    doc_ids count as one document, and texts of any length are cut whole. Columns named n_lines or
    n_dropped are replaced, all others kept; an empty table gives an empty one. With a given state,
    its documents count and ``docs`` should be among them.
    """
    names = ("n_lines", "n_dropped")
    kept = [F.col(f"row.{quoted(c)}") for c in docs.columns if c.lower() not in names]
    return cut_lines(docs, state, min_docs, min_chars).select(*kept, *names)


def cut_lines(docs: DataFrame, state: LineState | None = None, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(row, n_lines, n_dropped): drop_lines() with the columns of ``docs``, whatever their names, in
    the struct ``row``, its text cut."""
    state = state or build_state(docs, min_docs, min_chars)
    drops = _drops(state, state.refs)

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < state.min_chars) | ~F.array_contains(F.col("lost_keys"), _digest(key))

    rows = packed(docs).select("row", F.col("row.doc_id").alias("doc_id")).join(drops, "doc_id", "left")
    rows = rows.withColumn("lines", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1))
    rows = rows.withColumn("kept", F.when(F.col("lost_keys").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    whole = F.col("lost_keys").isNull() | F.col("row.text").isNull()
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    n = F.size("lines").cast("long")
    return rows.select(F.col("row").withField("text", text).alias("row"), n.alias("n_lines"), (n - F.size("kept")).cast("long").alias("n_dropped"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, ord, line, translate(trim(line, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents)),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.ord, l.line, (s.key IS NOT NULL AND l.doc_id <> s.keeper) AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
