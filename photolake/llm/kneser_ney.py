"""Interpolated modified Kneser-Ney, counted in Spark and looked up in memory-mapped sorted arrays.

A bigram model: p(w | v) = (c(vw) - D(c(vw))) / c(v) + backoff(v) * p(w), where the lower order rests
on how many different words come before w,
p(w) = (n(w) - D(n(w))) / n + backoff * 1 / (V + 1), with three discounts for each order (counts
1, 2, 3 and more; Chen and Goodman, 1998). A text is a line of words and one end; the first word's
context is the end of a text.

The model is two sets of files in the shared folder, one file for each range of hashes: words with
their statistics and bigrams with their counts, each a sorted array of 64-bit hashes and arrays of
the same order. Workers map the files, so what they touch is paged in and shared by all workers of a
machine; none holds the model. That needs the shared folder to be mounted as a file system.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import local_path, materialise, shared_dir
from .words import mix, split_words, text_slices

END = np.uint64(0x1F0E3DAD99908345)
_FLUSH = 1 << 21  # tokens that a task gathers before it adds up equal bigrams
_WORD = {"hash": "<u8", "count": "<i8", "lower": "<f8", "log_back": "<f8", "total": "<i8"}
_PAIR = {"hash": "<u8", "count": "<u2"}
#: Counts from here on are in arrays of their own, in 64 bits.
_LARGE = 65535


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _lowered(texts: list[str | None]) -> list[bytes]:
    """ASCII letters in lower case; ``bytes.lower`` touches no others."""
    return [t.encode().lower() if t else b"" for t in texts]


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each text closed by END, and each text's token count."""
    w = split_words(texts)
    n = np.bincount(w.doc, minlength=len(texts)) + 1
    out = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends], out[inner] = END, w.hash
    return out, n


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0xA0761D6478BD642F) + w)


def _contexts(tokens: np.ndarray) -> np.ndarray:
    """The token before each; texts are closed by END, which also opens the next."""
    return np.concatenate((np.array([END]), tokens[:-1])) if len(tokens) else tokens


def _count_pairs(docs: DataFrame) -> DataFrame:
    """(v, w, n) of all neighbouring tokens. Equal pairs are added up within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            pairs = np.stack((_contexts(tokens), tokens), 1)
            key = pair_hash(pairs[:, 0], pairs[:, 1])
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            v, w = pairs[at].T
            return pa.RecordBatch.from_arrays([pa.array(_signed(np.ascontiguousarray(x))) for x in (v, w)] + [pa.array(n.astype(np.int64))], ["v", "w", "n"])

        for batch in _few(batches):
            texts = _lowered(batch["text"].to_pylist())
            for s in text_slices([len(t) for t in texts]):
                tokens, _ = tokens_of(texts[s])
                held.append(tokens)
                size += len(tokens)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


@dataclass
class Discounts:
    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n1: int, n2: int, n3: int, n4: int) -> Discounts:
        """Chen and Goodman's estimates, from 0 to 1, 2 and 3; without counts of 1 or 2 there are none,
        and 0.5, 0.75 and 0.9 are taken."""
        if not n1 or not n2:
            return cls(0.5, 0.75, 0.9)
        y = n1 / (n1 + 2 * n2)
        three = 3 - 4 * y * n4 / n3 if n3 else 1.5
        return cls(min(1.0, max(0.0, 1 - 2 * y * n2 / n1)), min(2.0, max(0.0, 2 - 3 * y * n3 / n2)), min(3.0, max(0.0, three)))

    def of_count(self, c: Column) -> Column:
        return F.when(c == 1, self.one).when(c == 2, self.two).otherwise(self.more)


@dataclass
class KneserNey:
    words: str
    pairs: str
    shards: int
    train_tokens: int
    vocabulary: int
    discounts: Discounts
    unknown: float  # lower-order probability of a word never seen


def _write_shards(rows: DataFrame, shards: int, columns: dict[str, str], tag: str) -> str:
    """Sorted arrays in the shared folder, one file a column and hash range. A 16-bit count is cut at
    _LARGE, and hash and count of such rows are written again, whole.

    A file is written under a task's own name and then renamed, so a task that runs again, or twice,
    leaves one whole file of the same rows.
    """
    path = local_path(shared_dir(rows.sparkSession, tag))
    os.makedirs(path, exist_ok=True)
    bits = shards.bit_length() - 1
    shard = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    names = list(columns)
    short = [c for c, t in columns.items() if t == "<u2"]
    files_of = names + [f"large_{c}" for c in ("hash", *short) if short]

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition holds whole shards, sorted by shard and unsigned hash."""
        now, rows, files = None, 0, {}

        def close() -> pd.DataFrame:
            for c, file in files.items():
                file.close()
                os.replace(file.name, f"{path}/{now:05d}.{c}")
            return pd.DataFrame({"shard": [now], "n": [rows]})

        for pdf in parts:
            for k, own in pdf.groupby("shard", sort=True):
                if now is not None and k != now:
                    yield close()
                if k != now:
                    now, rows = k, 0
                    files = {c: open(f"{path}/{k:05d}.{c}.{uuid.uuid4().hex}", "wb") for c in files_of}  # noqa: SIM115
                rows += len(own)
                for c in names:
                    values = np.ascontiguousarray(own[c].to_numpy())
                    if c in short:
                        large = values >= _LARGE
                        files["large_hash"].write(own["hash"].to_numpy()[large].astype("<i8").tobytes())
                        files[f"large_{c}"].write(values[large].astype("<i8").tobytes())
                        values = np.minimum(values, _LARGE)
                    files[c].write(values.astype("<i8" if c == "hash" else columns[c]).tobytes())
        if now is not None:
            yield close()

    dealt = rows.select("hash", *[c for c in names if c != "hash"], shard.alias("shard")).repartitionById(shards, "shard")
    # xor with the sign bit orders signed longs as unsigned ones
    dealt.sortWithinPartitions("shard", F.col("hash").bitwiseXOR(F.lit(-(2**63)))).mapInPandas(write, "shard int, n long").agg(F.sum("n")).collect()
    return path


def train(docs: DataFrame, shard_rows: int = 4_000_000) -> KneserNey:
    """Fit on the texts of ``docs`` (null: empty). ``shard_rows`` bounds what one file holds.

    Counts of all texts are kept; nothing is pruned. An empty table gives a model of V = 0 that
    scores every token 1 / (V + 1) = 1.
    """
    spark = docs.sparkSession
    pairs = materialise(_count_pairs(docs), "lm-pairs")
    c = F.col("n")
    ones = [F.count_if(c == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    pair_stats = pairs.agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), *ones).head()
    high = Discounts.of(*(pair_stats[f"n{k}"] for k in (1, 2, 3, 4)))
    as_context = pairs.groupBy("v").agg(F.sum("n").alias("total"), F.sum(high.of_count(c)).alias("held_back"))
    as_word = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("before"), F.sum("n").alias("count"))
    words = materialise(
        as_word.join(as_context, F.col("w") == F.col("v"), "full").select(
            F.coalesce("w", "v").alias("hash"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("before", "count", "total")], F.coalesce("held_back", F.lit(0.0)).alias("held_back")
        ),
        "lm-words",
    )
    b = F.col("before")
    ones = [F.count_if(b == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    word_stats = words.agg(F.count_if(F.col("count") > 0).alias("v"), F.coalesce(F.sum("before"), F.lit(0)).alias("before"), *ones).head()
    low = Discounts.of(*(word_stats[f"n{k}"] for k in (1, 2, 3, 4)))
    total = max(1, word_stats.before)
    vocabulary = word_stats.v
    held = words.agg(F.coalesce(F.sum(F.when(b > 0, F.least(low.of_count(b), b))), F.lit(0.0)).alias("h")).head().h
    unknown = (held / total if vocabulary else 1.0) / (vocabulary + 1)
    lower = F.when(b > 0, (b - F.least(low.of_count(b), b.cast("double"))) / total).otherwise(0.0) + F.lit(unknown)
    table = words.select(
        "hash", "count", lower.alias("lower"), F.when(F.col("total") > 0, F.log10(F.col("held_back") / F.col("total"))).otherwise(0.0).alias("log_back"), "total"
    )
    shards = 1 << max(0, math.ceil(math.log2(max(1, pair_stats.types / shard_rows, int(spark.conf.get("spark.sql.shuffle.partitions")) / 2))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = (batch[x].to_numpy().view(np.uint64) for x in ("v", "w"))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(pair_hash(v, w))), batch["n"]], ["hash", "count"])

    return KneserNey(
        words=_write_shards(table, shards, _WORD, "lm-word-files"),
        pairs=_write_shards(pairs.mapInArrow(hashed, "hash long, count long"), shards, _PAIR, "lm-pair-files"),
        shards=shards,
        train_tokens=int(pair_stats.tokens),
        vocabulary=int(vocabulary),
        discounts=high,
        unknown=unknown,
    )


class _Mapped:
    """Lookups in one folder of sorted arrays, mapped on first use."""

    def __init__(self, path: str, shards: int, columns: dict[str, str]):
        self.path, self.columns, self.bits = path, columns, shards.bit_length() - 1
        self.open: dict[int, dict[str, np.ndarray] | None] = {}

    def _shard(self, k: int) -> dict[str, np.ndarray] | None:
        if k not in self.open:
            names = {c: f"{self.path}/{k:05d}.{c}" for c in self.columns}
            self.open[k] = {c: np.memmap(names[c], t, "r") for c, t in self.columns.items()} if os.path.exists(names["hash"]) else None
            large = {c: f"{self.path}/{k:05d}.large_{c}" for c in ("hash", "count")}
            if self.open[k] and os.path.exists(large["hash"]) and os.path.getsize(large["hash"]):
                self.open[k] |= {"large_hash": np.memmap(large["hash"], "<u8", "r"), "large_count": np.memmap(large["count"], "<i8", "r")}
        return self.open[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each of the sorted, distinct hashes is there, and its columns (0 if not)."""
        there = np.zeros(len(hashes), bool)
        out = {c: np.zeros(len(hashes), "<i8" if t == "<u2" else t) for c, t in self.columns.items() if c != "hash"}
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (held := self._shard(int(shard[a]))) is None:
                continue
            at = np.searchsorted(held["hash"], hashes[a:b])
            at = np.minimum(at, len(held["hash"]) - 1)
            hit = held["hash"][at] == hashes[a:b]
            there[a:b] = hit
            for c in out:
                out[c][a:b][hit] = held[c][at[hit]]
            if "large_hash" in held:
                cut = a + np.flatnonzero(out["count"][a:b] == _LARGE)
                out["count"][cut] = held["large_count"][np.searchsorted(held["large_hash"], hashes[cut])]
        return there, out


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_batch(model: KneserNey, words: _Mapped, pairs: _Mapped, texts: list[bytes]) -> dict[str, np.ndarray]:
    tokens, n = tokens_of(texts)
    v = _contexts(tokens)
    kinds, which = np.unique(tokens, return_inverse=True)
    known, word = words.find(kinds)
    # contexts are tokens too, or the END that opens the batch
    context = np.searchsorted(kinds, v)
    big_n, big_v = model.train_tokens, model.vocabulary
    base = np.log10((word["count"] + 0.5) / (big_n + 0.5 * (big_v + 1)))[which]
    lower = np.where(known & (word["lower"] > 0), word["lower"], model.unknown)[which]
    total = word["total"][context].astype(np.float64)
    back = np.where(total > 0, 10.0 ** word["log_back"][context], 1.0)
    keys, at = np.unique(pair_hash(v, tokens), return_inverse=True)
    count = pairs.find(keys)[1]["count"].astype(np.float64)[at]
    d = model.discounts
    discount = np.select([count == 0, count == 1, count == 2], [0.0, d.one, d.two], d.more)
    p = np.maximum(count - discount, 0) / np.maximum(total, 1) + back * lower
    first = np.cumsum(n) - n
    return {
        "n_tokens": n,
        "n_known": np.add.reduceat((word["count"] > 0)[which].astype(np.int64), first),
        "train_tokens": np.full(len(n), big_n),
        "base_score": np.add.reduceat(base, first),
        "score": np.add.reduceat(np.log10(p), first),
    }


def score_documents(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``docs`` without text, with SCORES (replaced if there; all other columns are kept). Perplexity is
    10 ** (-score / n_tokens).

    Null and empty texts are an end alone; texts of any length are scored whole; repeated rows, and
    texts that tie, score alike. An empty table gives an empty one.
    """
    names = [c.split()[0] for c in SCORES.split(", ")]
    rest = docs.drop(*names)
    kept = [c for c in rest.columns if c != "text"]
    schema = rest.select(*kept).schema
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), SCORES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = _Mapped(model.words, model.shards, _WORD), _Mapped(model.pairs, model.shards, _PAIR)
        for batch in _few(batches):
            texts = _lowered(batch["text"].to_pylist())
            for s in text_slices([len(t) for t in texts]):
                scores = score_batch(model, words, pairs, texts[s])
                own = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*(own[c] for c in kept), *(pa.array(scores[c]) for c in names)], [*kept, *names])

    return rest.mapInArrow(run, spec)
