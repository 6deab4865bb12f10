"""Whitening of embeddings by the covariance of their distinct vectors.

Identical vectors are grouped, the fit weighs each group by one or by its count, every distinct vector
is whitened once, and the rows get their vector's result by a join. Entries are whole numbers, so
n * x - S is exact; centred vectors are that over n, and the covariance is the sum of centred matrix
products (GEMM) of blocks of distinct vectors. Only sums go through the driver: as many numbers as a
vector has entries, and their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

COMPONENTS = 16
#: Eigenvalues up to this share of the largest are no variance.
_NOTHING = 1e-13


@dataclass
class Fit:
    """Of all distinct vectors of one length: their weight, sums, and unit eigenvectors by falling
    eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact (Python's integers where 64 bits are too few)."""
        small = self.n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62
        return self.n * x - self.sums if small else self.n * x.astype(object) - self.sums.astype(object)


def distinct_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` with x, its entries c as floor(64 * c) + 1000000. Rows whose vector is null or has null
    or non-finite entries go."""
    c = F.col(vector)
    number = lambda v: v.cast("double")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(number(v)) & (F.abs(number(v)) < float("inf")))
    whole = F.transform(c, lambda v: F.floor(number(v) * 64) + 1_000_000)
    return rows.withColumn("x", F.when(c.isNotNull() & finite, whole)).filter("x is not null")


def _arrays(batch: pa.RecordBatch, column: str, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of a batch's lists, those of each length apart."""
    lists = batch[column]
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(sizes)))
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, flat[(first[at, None] + np.arange(d)).ravel()].reshape(len(at), d).astype(kind)


def _add_up(vectors: DataFrame, part, whole: str = "double") -> dict[int, np.ndarray]:
    """Sums by length of what ``part`` makes of (length, matrix, weights): added up in tasks, then by
    Spark; the driver gets one row of numbers for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch["weight"].to_numpy()
            for d, at, x in _arrays(batch, "x", float if x_is_float else np.int64):
                made = part(d, x, weight[at])
                total[d] = total[d] + made if d in total else made
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t.ravel().tolist() for t in total.values()], pa.list_(pa.float64() if whole == "double" else pa.int64()))], ["d", "sums"]
        )

    x_is_float = dict(vectors.dtypes)["x"] == "array<double>"
    parts = vectors.select("x", "weight").mapInArrow(run, f"d int, sums array<{whole}>").select("d", F.posexplode("sums").alias("k", "v"))
    rows = parts.groupBy("d", "k").agg(F.sum("v").alias("v")).orderBy("d", "k").collect()
    return {d: np.array([r.v for r in rows if r.d == d], float if whole == "double" else np.int64) for d in {r.d for r in rows}}


def fit(vectors: DataFrame) -> dict[int, Fit]:
    """One Fit for each length of the vectors of ``vectors`` (x, weight), which are distinct."""
    sums = _add_up(vectors, lambda d, x, w: np.concatenate((w @ x, [w.sum()])), "bigint")
    bare = {d: Fit(int(s[-1]), s[:-1], np.zeros(0), np.zeros(0)) for d, s in sums.items()}

    def scatter(d: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        y = bare[d].centred(x).astype(float) / bare[d].n
        return (y * w[:, None]).T @ y

    fits = {}
    for d, total in _add_up(vectors, scatter).items():
        v = total.reshape(d, d) / bare[d].n
        values, columns = np.linalg.eigh((v + v.T) / 2)
        fits[d] = Fit(bare[d].n, bare[d].sums, np.maximum(values[::-1], 0), columns[:, ::-1])
    return fits


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and
    component up to ``components``, numbered from 1 by falling eigenvalue.

    Rows whose vector is null or has null or non-finite entries go; repeated ids and vectors are rows
    like others, and other columns are not read. ``weights``: ``one`` fits over the distinct vectors,
    ``count`` weighs each by its rows. deviation is the exact sum of (n * x - S)**2; one beyond 64 bits
    is an error. Components without variance (all of them for a single vector) whiten to 0.0, explain
    0.0 and stay out of identity_error, which is 0.0 if there is no other. Vectors of different
    lengths are fitted apart, those without entries have no components, and an empty table gives an
    empty one.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be one or count")
    sound = distinct_vectors(rows, vector).filter(F.size("x") > 0).select(F.col(id), "x")
    count = F.count(F.lit(1)) if weights == "count" else F.lit(1).cast("long")
    vectors = materialise(sound.groupBy("x").agg(count.alias("weight")), "vectors")
    fits = fit(vectors)
    turns = {d: _turn(f, components) for d, f in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _arrays(batch, "x", np.int64):
                far = fits[d].centred(x)
                wide = d * int(np.abs(far).max(initial=0)) ** 2 >= 1 << 63
                deviation = ((far.astype(object) if wide else far) ** 2).sum(1)
                z = far.astype(float) / fits[d].n @ turns[d]
                flat = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch["x"].take(pa.array(at)), batch["weight"].take(pa.array(at)), pa.array(deviation.tolist(), pa.int64()), flat], ["x", "weight", "deviation", "z"])

    done = materialise(vectors.mapInArrow(run, "x array<long>, weight long, deviation long, z array<double>"), "whitened")
    error = _identity_errors(done, fits, turns)
    told = [(d, f.n, [float(e / max(f.values.sum(), 1e-300)) for e in f.values[:components]], error[d]) for d, f in sorted(fits.items())]
    lengths = rows.sparkSession.createDataFrame(told, "d int, n long, shares array<double>, identity_error double")
    # one row for each length of vectors
    own = done.join(F.broadcast(lengths), F.size("x") == F.col("d")).drop("d", "weight")
    met = sound.join(own, "x").drop("x")
    return met.select(id, "n", "deviation", "shares", "identity_error", F.posexplode("z").alias("k", "whitened")).select(
        id, (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.col("shares")[F.col("k")].alias("explained"), "identity_error"
    )


def _turn(f: Fit, components: int) -> np.ndarray:
    """The matrix from centred to whitened; columns of zeros where there is no variance."""
    e = f.values[:components]
    some = e > max(f.values[0], 0) * _NOTHING
    return f.vectors[:, :components] * np.where(some, 1 / np.sqrt(np.where(some, e, 1)), 0)


def _identity_errors(done: DataFrame, fits: dict[int, Fit], turns: dict[int, np.ndarray]) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance less the identity, for each length of vectors:
    measured on the vectors themselves, centred first."""
    by_length = lambda c: done.select(F.size("x").alias("d"), F.col("weight"), F.col("z").alias("x")).filter(F.col("d") == c)
    out = {}
    for d, f in fits.items():
        z = by_length(d).select("x", "weight")
        mean = _add_up(z, lambda k, x, w: w @ x)[turns[d].shape[1]] / f.n
        cov = _add_up(z, lambda k, x, w, mean=mean: ((x - mean) * w[:, None]).T @ (x - mean))[turns[d].shape[1]].reshape(len(mean), -1) / f.n
        some = np.flatnonzero(np.abs(turns[d]).sum(0) > 0)
        out[d] = float(np.abs(cov[np.ix_(some, some)] - np.eye(len(some))).max(initial=0.0))
    return out
