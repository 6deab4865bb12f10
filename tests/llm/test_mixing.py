import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.llm import mixing as mx


def test_knapsack_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 5)
        lengths = rng.sample(range(1, 20), n)
        counts = [rng.randrange(0, 4) for _ in range(n)]
        budget = rng.randrange(0, 60)
        best = max(s for c in itertools.product(*(range(x + 1) for x in counts)) if (s := sum(a * b for a, b in zip(c, lengths))) <= budget)
        got = mx.knapsack(lengths, counts, budget)
        assert sum(a * b for a, b in zip(got, lengths)) == best and all(g <= c for g, c in zip(got, counts))


def test_fit_counts_meets_large_budgets_to_the_word():
    rng = random.Random(2)
    lengths = sorted(rng.sample(range(1, 5000), 900))
    counts = [rng.randrange(1, 40) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    for share in (0.0, 0.01, 0.4, 0.77, 1.0):
        budget = int(total * share)
        got = mx.fit_counts(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts)) and sum(a * b for a, b in zip(got, lengths)) == budget


@pytest.mark.parametrize(
    "lengths,counts,budget",
    [([20000, 16001, 12007], [60, 60, 60], 892_948), ([20000, 16001, 12007], [60, 60, 60], 2_217_969), ([300_007, 200_003, 99_991, 7_919], [9, 20, 30, 3], 10_000_000), ([6, 10], [1000, 900], 14_997), ([7], [50], 100)],
)
def test_few_lengths_are_fitted_as_by_plain_dynamic_programming(lengths, counts, budget):
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    for length, count in zip(lengths, counts):
        for _ in range(min(count, budget // length)):
            more = reach.copy()
            more[length:] |= reach[:-length]
            if (more == reach).all():
                break
            reach = more
    got = mx.fit_counts(lengths, counts, budget)
    assert all(0 <= g <= c for g, c in zip(got, counts)) and sum(a * b for a, b in zip(got, lengths)) == int(np.flatnonzero(reach)[-1])


def test_targets():
    assert mx.fill_targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200, 2 / 3 * 250, 1 / 3 * 250])
    assert mx.fill_targets([10, 1000], [5, 2], 1515) == pytest.approx([20, 1495])
    assert mx.fill_targets([0, 0], [5, 2], 0) == [0, 0] and mx.fill_targets([], [], 0) == []


def rows():
    rng = random.Random(3)
    out = [(k, "w " * rng.randrange(0, 300), rng.choice(["a", "a", "a", "b", "é", None, "hot"]) if k > 300 else "hot") for k in range(900)]
    return [*out, (1, out[1][1], "hot"), (2000, None, "none"), (2001, " \n ", "none"), (None, "x y", "b"), (2002, "w " * 100_000, "b")]


def test_mix_is_near_its_targets_and_repeats_itself(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in rows()], "doc_id long, text string, source string, target double")
    got = mx.plan_mix(df).collect()
    assert len(got) == len(rows())
    want = {}
    for _, t, s in rows():
        want[s] = want.get(s, 0) + len((t or "").split())
    order = sorted(want, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mx.fill_targets([want[s] for s in order], [mx.WEIGHTS[k % 3] for k in range(len(order))], 1.5 * sum(want.values()))))
    for s in order:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {want[s]} and all(r.target == pytest.approx(goals[s]) for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - goals[s]) <= max(2, 0.02 * goals[s], max(r.size for r in mine) / 2)
        assert all(0 <= r.copies <= 2 for r in mine)
    again = mx.plan_mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mx.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_lots_choose_exactly_as_many_as_planned(spark, monkeypatch):
    monkeypatch.setattr(mx, "_BUCKET", 16)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 4500, "x").otherwise("y").alias("source"))
    got = mx.plan_mix(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in got)


def test_empty(spark):
    assert mx.plan_mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
