import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from photolake.llm import quality_mcd as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_stats_equal_brute_force():
    rng = random.Random(1)
    alphabet = ["a", "b ", "é", " ", "\n", "\t", "ab cd ef gh ij ", "x y\n", "#", "|", "🙂", "\x85", "\xa0", "\x0b"]
    texts = ["", None, " ", "\n\n", "a", "w " * 70_000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(300)]
    got = q.text_stats(pd.Series(texts))
    assert list(map(tuple, got[list(q.STATS)].to_numpy().tolist())) == [brute(t) for t in texts]
    for row, text in zip(got[list(q.SUMS)].to_numpy(), texts, strict=True):
        w = WORD.findall(text or "")
        logs = [np.log(len(x)) for x in w]
        odd = sum(bool(re.search(r"[\x00-\x7f]", re.sub("[A-Za-z]", "", x))) for x in w)
        letters = "".join(w).encode()
        pairs = sum(c * (c - 1) for c in Counter(letters).values()) / max(1, len(letters) * (len(letters) - 1))
        assert np.allclose(row, (sum(logs), sum(x * x for x in logs), odd, len(w) * pairs))


def test_chi2():
    assert q.chi2_quantile(0.975, 4) == pytest.approx(11.143, abs=1e-3)
    assert q.chi2_cdf(3.0, 2) == pytest.approx(1 - np.exp(-1.5))


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


def rows():
    rng = random.Random(2)
    good = [(k, prose(rng, rng.randrange(20, 300)), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(600)]
    junk = [(1000 + k, " ".join(w + "***" for w in prose(rng, 80).split()), "en", "hot") for k in range(60)]
    rest = [(2000, None, "en", "hot"), (2001, "", None, None), (2002, prose(rng, 50), None, None), (2003, "too short", "en", "hot"), (2003, "too short", "en", "hot"), (None, prose(rng, 40), "de", "tiny"), (2004, "same words here " * 50, "en", "hot")]
    return good, junk, rest


def test_outliers_go_and_clean_documents_stay(spark):
    good, junk, rest = rows()
    df = spark.createDataFrame([(*r, "x") for r in good + junk + rest], "doc_id long, text string, lang string, source string, kept string")
    got = q.judge_documents(df).collect()
    assert len(got) == len(good + junk + rest)
    by_id = {r.doc_id: r for r in got}
    assert sum(by_id[r[0]].kept for r in good) >= 0.99 * len(good) and not any(by_id[r[0]].kept for r in junk)
    for d in (2000, 2001, 2003, 2004):
        assert by_id[d].base_failed and not by_id[d].kept
    assert by_id[2002].kept and by_id[None].kept
    assert all(r.kept == "x" for r in q.keep_documents(df).collect())
    kept = q.keep_documents(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def brute_mcd(x, centre, target):
    """The regularised estimate of one group's distinct vectors, in plain NumPy."""
    x = np.unique(x, axis=0)
    n, weight = len(x), len(x) / (len(x) + q.PRIOR_ROWS)
    distance = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    scatter = lambda y, share: weight * q.consistency(share, x.shape[1]) * np.cov(y.T, bias=True).reshape(target.shape) + (1 - weight) * target
    median = np.sort(x, axis=0)[int(np.ceil(0.5 * n)) - 1]
    best = None
    for s in (np.diag(np.diag(target)), target):
        m, last = median, np.inf
        for _ in range(q.STEPS):
            d = distance(m, s)
            inner = x[d <= np.sort(d)[int(np.ceil(q.KEEP_SHARE * n)) - 1]]
            m, s = inner.mean(0), scatter(inner, q.KEEP_SHARE)
            now = np.linalg.slogdet(s)[1]
            if abs(last - now) <= q._RESTS:
                break
            last = now
        if best is None or now < best[0]:
            best = now, m, s
    inner = x[distance(*best[1:]) <= q.chi2_quantile(0.975, x.shape[1])]
    return weight * inner.mean(0) + (1 - weight) * centre, scatter(inner, 0.975)


def test_estimates_equal_brute_force_and_resist_contamination(spark):
    rng = np.random.default_rng(4)
    mix_ = np.array([[1, 0.9, 0, 0], [0, 0.3, 0.2, 0], [0, 0, 0.5, -0.4], [0, 0, 0, 0.2]])
    groups = {}
    for name, n, bad in (("large", 1500, 300), ("small", 30, 6), ("two", 2, 0), ("one", 1, 0)):
        clean = rng.normal(size=(n, 4)) @ mix_ + [3, 0, 1, 2]
        groups[name] = np.concatenate((clean, rng.normal(size=(bad, 4)) * 0.1 + [9, -4, 6, 0]))
    groups["copies"] = np.repeat(groups["small"][:1], 500, axis=0)
    points = spark.createDataFrame([(k, x.tolist()) for k, v in groups.items() for x in np.unique(v, axis=0)], "name string, f array<double>")
    centre, target = np.array([3.0, 0, 1, 2]), mix_.T @ mix_ + 0.1 * np.eye(4)
    targets = spark.createDataFrame([(k, centre.tolist(), target.ravel().tolist()) for k in groups], "name string, centre array<double>, target array<double>")
    got = {r["name"]: r for r in q._estimates(points, targets, q.STEPS).collect()}
    for name, x in groups.items():
        mean, scatter = brute_mcd(x, centre, target)
        assert np.allclose(got[name]["mean"], mean) and np.allclose(np.array(got[name].scatter).reshape(4, 4), scatter), name
    large = np.array(got["large"].scatter).reshape(4, 4)
    assert np.abs(large - mix_.T @ mix_).max() < 0.15 * (mix_.T @ mix_).max()  # 17 % of the rows are far off
    assert np.linalg.norm(np.cov(groups["large"].T) - mix_.T @ mix_) > 10 * np.linalg.norm(large - mix_.T @ mix_)


def test_verdicts_equal_brute_force(spark):
    good, junk, rest = rows()
    docs = good + junk + rest
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    made, sound = [], []
    for d, text, lang, source in docs:
        s = q.text_stats(pd.Series([text])).iloc[0]
        made.append((d, lang, source, s))
        sound.append(s.n_words >= 10 and s.n_repeat_words * 100 <= s.n_words * 20)
    per_word, f = {}, []
    for (_, lang, _, s), ok in zip(made, sound, strict=True):
        per_word.setdefault(lang, []).extend([s[list(q.SUMS)].to_numpy(float) / s.n_words] * bool(ok))
    median = lambda x: np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    overall = median(np.array(sum(per_word.values(), [])))
    for _, lang, _, s in made:
        weight = len(per_word[lang]) / (len(per_word[lang]) + q.PRIOR_ROWS)
        middle = weight * median(per_word[lang]) + (1 - weight) * overall
        m, sq, odd, alike = (s[list(q.SUMS)].to_numpy(float) + q.PRIOR_WORDS * middle) / (s.n_words + q.PRIOR_WORDS)
        f.append([m, *np.sqrt(np.maximum([sq - m * m, odd, alike], 0))])
    f, sound = np.array(f), np.array(sound)
    of = lambda i, *keys: np.array([made[k][1 : 1 + len(keys)] == keys for k in range(len(made))]) & sound  # noqa: E731, ARG005
    by_language = np.concatenate([np.unique(f[of(0, lang)], axis=0) for lang in {m[1] for m in made}])
    cuts = [np.sort(by_language, axis=0)[int(np.ceil(p * len(by_language))) - 1] for p in (0.25, 0.5, 0.75)]
    spread = np.diag(np.square(np.maximum((cuts[2] - cuts[0]) * 0.7413, q._TINY)))
    want = {}
    for lang, source in {(m[1], m[2]) for m in made}:
        if (here := of(0, lang, source)).any():
            mean, scatter = brute_mcd(f[here], *brute_mcd(f[of(0, lang)], cuts[1], spread))
            for k in np.flatnonzero(here):
                want[made[k][0]] = float(np.sqrt((f[k] - mean) @ np.linalg.inv(scatter) @ (f[k] - mean)))
    cut = np.sqrt(q.chi2_quantile(q.QUANTILE, 4))
    got = q.judge_documents(df).collect()
    for r in got:
        if r.base_failed:
            assert not r.kept
        else:
            assert r.distance == pytest.approx(want[r.doc_id], rel=1e-6) and r.kept == (want[r.doc_id] <= cut)
    assert len({round(r.distance, 9) for r in got if r.distance is not None}) > 500


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert q.judge_documents(df).count() == 0 and q.keep_documents(df).count() == 0
