"""Whitening against NumPy, and its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from photolake.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=16, weights=None):
    x = {k: np.floor(np.float32(v).astype(float) * 64).astype(np.int64) + 1_000_000 for k, v in rows}
    fit = {tuple(v): 0 for v in x.values()}
    for v in x.values():
        fit[tuple(v)] += 1
    w = np.array([n if weights == "count" else 1 for n in fit.values()])
    m = np.array(list(fit))
    n, s = int(w.sum()), (w @ m)
    y = (n * m - s) / n
    e, u = np.linalg.eigh((y * w[:, None]).T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return {k: (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)), (n * v - s) / n @ u[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum()) for k, v in x.items()}


def table(rng, n=200, d=6):
    mixed = rng.normal(size=(n, d)) @ (np.eye(d) + 0.3 * rng.normal(size=(d, d))) * np.arange(1, d + 1)
    return [(k, v.astype(np.float32).tolist()) for k, v in enumerate(mixed)]


def collected(spark, rows, **more):
    out = {}
    for r in wh.whiten(spark.createDataFrame(rows, SCHEMA), **more).collect():
        out.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_numpy(spark, weights):
    rows = table(np.random.default_rng(4))
    rows += [(1000 + k, rows[0][1]) for k in range(100)]
    got, want = collected(spark, rows, weights=weights), brute(rows, weights=weights)
    assert set(got) == set(want)
    signs = {}
    for k, (n, deviation, z, share) in want.items():
        assert sorted(got[k]) == [1, 2, 3, 4, 5, 6]
        for c, (r,) in got[k].items():
            assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9 and math.isclose(r.explained, share[c - 1], rel_tol=1e-9)
            assert math.isclose(abs(r.whitened), abs(z[c - 1]), rel_tol=1e-7, abs_tol=1e-9)
            if abs(z[c - 1]) > 1e-3:
                signs.setdefault(c, set()).add(r.whitened * z[c - 1] > 0)
    assert all(len(s) == 1 for s in signs.values())
    if weights == "one":
        assert {r[0].n for v in got.values() for r in v.values()} == {200}


def test_components_stop_and_bad_rows_go(spark):
    rows = table(np.random.default_rng(1), 100, 20)
    bad = [(500, None), (501, [1.0, None] + [0.0] * 18), (502, [float("nan")] + [0.0] * 19), (503, [float("inf")] + [0.0] * 19), (504, [])]
    got = collected(spark, rows + bad)
    assert set(got) == {k for k, _ in rows} and all(sorted(v) == list(range(1, 17)) for v in got.values())


def test_repeated_ids_null_ids_and_lengths(spark):
    rows = table(np.random.default_rng(2), 50, 3)
    other = [(k, v) for k, v in table(np.random.default_rng(3), 40, 5)]
    got = collected(spark, rows + [rows[0], (None, rows[1][1])] + other)
    assert len(got[0][1]) == 3 and len(got[None][1]) == 1
    assert {r.n for v in got.values() for found in v.values() for r in found} == {50, 40}


def test_without_variance(spark):
    one = collected(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in (one[1][1][0], one[2][2][0])] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    flat = collected(spark, [(k, [float(k), 3.0, 2.0 * k]) for k in range(10)])
    assert all(v[c][0].whitened == 0.0 for v in flat.values() for c in (2, 3)) and math.isclose(flat[3][1][0].explained, 1.0)
    assert flat[0][1][0].identity_error < 1e-9


def test_empty_and_other_columns(spark):
    assert collected(spark, []) == {}
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5)], "a", 1.0) for k in range(35)], "vec_id long, embedding array<float>, x string, z double").withColumnRenamed("x", "weight")
    assert wh.whiten(rows).count() == 70


def test_large_numbers_stay_exact():
    n, x = 10**13, np.array([[1_000_000, 1_000_300]])
    f = wh.Fit(n, np.array([10**18, 10**18 + 7]), np.zeros(0), np.zeros(0))
    assert f.centred(x).tolist() == [[int(Fraction(n) * 1_000_000 - 10**18), n * 1_000_300 - 10**18 - 7]]
