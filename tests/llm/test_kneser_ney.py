import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from photolake.llm import kneser_ney as kn

WORD = re.compile("[^\x20\x09-\x0d]+")
END = object()


def toks(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


class Brute:
    def __init__(self, texts):
        self.pairs, self.uni = Counter(), Counter()
        for t in texts:
            before = END
            for w in toks(t):
                self.pairs[before, w] += 1
                self.uni[w] += 1
                before = w
        self.n = sum(self.uni.values())
        self.before = Counter(w for _, w in self.pairs)
        self.high = self.discounts(self.pairs.values())
        self.low = self.discounts(self.before.values())

    @staticmethod
    def discounts(counts):
        c = Counter(counts)
        d = kn.Discounts.of(c[1], c[2], c[3], c[4])
        return [0, d.one, d.two, d.more]

    def lower(self, w):
        total = len(self.pairs)
        held = sum(min(self.low[min(3, c)], c) for c in self.before.values())
        return max(0, self.before[w] - self.low[min(3, self.before[w])]) / total + held / total / (len(self.uni) + 1)

    def p(self, v, w):
        follow = {x: c for (y, x), c in self.pairs.items() if y == v}
        total = sum(follow.values())
        if not total:
            return self.lower(w)
        c = follow.get(w, 0)
        back = sum(self.high[min(3, x)] for x in follow.values()) / total
        return max(0, c - self.high[min(3, c)]) / total + back * self.lower(w)

    def score(self, text):
        before, total, base, known = END, 0.0, 0.0, 0
        for w in toks(text):
            total += math.log10(self.p(before, w))
            base += math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (len(self.uni) + 1)))
            known += self.uni[w] > 0
            before = w
        return len(toks(text)), known, self.n, base, total


def texts():
    rng = random.Random(1)
    vocabulary = ["The", "the", "é", "dog", "runs", "Fast", "a", "b", "c", "🙂"] + [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60))) for _ in range(120)]


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kn, "_FLUSH", 500)
    learn = texts()
    ask = [*learn[:20], None, "", "never seen words at all", "the " * 20_000, "dog dog\tdog\x0b"]
    model = kn.train(spark.createDataFrame([(t,) for t in learn], "text string"), shard_rows=100)
    assert model.shards > 1
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ask)], "doc_id long, text string, score string")
    brute = Brute(learn)
    got = {r.doc_id: r for r in kn.score_documents(df, model).collect()}
    cache = {}
    for k, t in enumerate(ask):
        want = cache.setdefault(t, brute.score(t) if t is None or len(t) < 9999 else None)
        if want:
            r = got[k]
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
            assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)


def test_large_counts_are_kept_whole(spark):
    counts = {5: 1, 2**63 + 7: 65534, 2**62: 65535, 3: 2**33, 2**64 - 1: 2}
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    rows = spark.createDataFrame([(signed(h), n) for h, n in counts.items()], "hash long, count long")
    path = kn._write_shards(rows, 4, kn._PAIR, "lm-test")
    asked = np.array(sorted([*counts, 17]), np.uint64)
    there, found = kn._Mapped(path, 4, kn._PAIR).find(asked)
    assert there.tolist() == [int(h) in counts for h in asked] and found["count"].tolist() == [counts.get(int(h), 0) for h in asked]


def test_probabilities_sum_to_one():
    brute = Brute(texts())
    for v in ("the", "dog", END):
        known = sum(brute.p(v, w) for w in brute.uni)
        assert known + brute.p(v, "unseen") == pytest.approx(1)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = kn.train(empty)
    assert kn.score_documents(empty, model).count() == 0
    row = kn.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).head()
    assert row.n_known == 0 and row.train_tokens == 0 and row.score == 0.0
