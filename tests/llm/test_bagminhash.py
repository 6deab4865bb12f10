import random
from collections import Counter, defaultdict

import numpy as np

from photolake.llm import bagminhash as bm
from photolake.llm.words import split_words


def bag(text):
    w = (text or "").encode().split()
    n = min(5, len(w)) or 1
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a or b else 0.0


def brute(rows):
    """Classes by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    bags = {t: bag(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if similarity(bags[a], bags[b]) >= 0.8:
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for d, t in rows:
        ids[root(t or "")].append(d)
    return sorted((d, min(x for x in ids[root(t or "")] if x is not None), len(ids[root(t or "")])) for d, t in rows if d is not None)


def prose(rng, n):
    return [rng.choice("alpha beta gamma delta of the and to in a x y z".split()) + str(rng.randrange(40)) for _ in range(n)]


def corpus():
    rng = random.Random(1)
    rows, k = [], 0
    for _ in range(25):
        base = prose(rng, rng.randrange(3, 220))
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 30 + 1))):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
            rows.append((k, " ".join(w)))
            k += 1
    hot = " ".join(prose(rng, 60))
    rows += [(1000 + i, hot) for i in range(40)] + [(1100 + i, f"{hot} {' '.join(prose(rng, i))}") for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "one two"), (2004, "one  two"), (2004, "one  two"), (2005, "that " * 3000), (2006, "that " * 2900), (2007, "that " * 1000), (None, hot)]
    return rows


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(2)
    base = ["that"] * 40 + prose(rng, 150)
    for cut in (10, 60, 120):
        other = base[cut:] + prose(rng, 30)
        texts = [" ".join(base).encode(), " ".join(other).encode()]
        doc, h, n = bm.bags(split_words(texts), 2)
        a, b = bm.signatures(doc, h, n, 2, 4096)
        want = similarity(bag(texts[0].decode()), bag(texts[1].decode()))
        assert abs((a == b).mean() - want) < 0.04
        alone = bm.signatures(*bm.bags(split_words(texts[1:]), 1), 1, 4096)[0]
        assert (alone == b).all()  # batch mates do not matter


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = bm.near_duplicates(df.select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_docs) for r in got if r.doc_id is not None) == brute(rows)
    assert sum(r.kept for r in got) - len({r.class_id for r in got}) in (0, 1)  # a repeated row is kept in both its rows here
    kept = bm.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len({c for _, c, _ in brute(rows)})


def test_components(spark):
    links = [(b"a", b"b"), (b"b", b"c"), (b"x", b"y"), *[(f"{k:03}".encode(), f"{k + 1:03}".encode()) for k in range(60)]]
    got = {bytes(r.node): bytes(r.label) for r in bm.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got[b"c"] == b"a" and got[b"y"] == b"x" and got[b"060"] == b"000" and len(got) == 66


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bm.near_duplicates(df).count() == 0 and bm.keep_one_of_each(df).count() == 0


def test_text_without_words_has_no_signature():
    assert not bm.signatures(*bm.bags(split_words([b"", b" \n"]), 2), 2).any() and np.zeros(1).sum() == 0


def test_remaining_pairs_are_only_those_that_may_link(spark, monkeypatch):
    """With no pivot round everything is left to the last one."""
    monkeypatch.setattr(bm, "PIVOT_ROUNDS", 1)
    rng = random.Random(8)
    base = prose(rng, 150)
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = bm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_docs) for r in got) == brute(rows)
