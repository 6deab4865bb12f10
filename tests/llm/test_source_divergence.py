"""The divergence audit against a plain version that collapses nothing, and its edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from photolake.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in TERM.findall(text or "")]


def brute(rows, least=10, best=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = terms(text)
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        own = {s: shares(c) for (lg, s), c in groups.items() if lg == lang}
        whole = shares(sum((c for (lg, _), c in groups.items() if lg == lang), Counter()))
        for s in own:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in own if o != s]
            above = [(f(own[s][t], whole[t]), t) for t in kept if groups[lang, s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", above, best)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(order)]
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "of", "häuser", "Ärger", "été", "x", "don't", "日本", "a1b2", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(k, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 30))), rng.choice("ab"), f"s{rng.randint(0, 6)}") for k in range(150)]
    rows += [(200 + k, "one text that comes very often", "a", f"s{k % 4}") for k in range(40)] + rows[:10]
    return rows + [(300, None, "a", "s0"), (301, "", None, None), (302, "12 !", "a", "bare"), (303, "The of " * 12, None, None), (None, "the of x", "b", None), (304, "the " * 3000, "b", "s1")]


def found(spark, rows, **more):
    return sorted(tuple(r) for r in sd.audit(spark.createDataFrame(rows, SCHEMA), **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert found(spark, rows) == want and {w[2] for w in want} == {"pair", "term"}


def test_small_blocks_change_nothing(spark):
    rows = corpus(3)
    batches = list(sd.collapse(spark.createDataFrame(rows, SCHEMA)).toArrow().to_batches())

    def told():
        out = Counter()
        for b in sd._added_up(iter(batches)):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"]] += r["n"]
                out[r["lang"], "", r["term"], "docs"] += r["docs"]
        return out

    want, was = told(), (sd._BLOCK, sd._PAIRS, sd._HELD)
    try:
        sd._BLOCK, sd._HELD = 16, 5
        assert told() == want
    finally:
        sd._BLOCK, sd._PAIRS, sd._HELD = was


def test_few_pairs_at_once(spark):
    rows = corpus(4)
    want = brute(rows)
    assert found(spark, rows) == want
    groups = [("a", [(k, 5 + k, 3) for k in range(9)]), ("b", [(2, 9, 1), (7, 4, 2)]), ("a", [(1, 8, 3), (3, 2, 3), (8, 9, 3)])]
    table = spark.createDataFrame([(lang, [dict(number=n, p=p, base=b) for n, p, b in g]) for lang, g in groups], "lang string, groups array<struct<number long, p long, base long>>").toArrow()

    def told():
        out = Counter()
        for b in sd._shared_terms(iter(table.to_batches())):
            for r in b.to_pylist():
                out[r["lang"], r["a"], r["b"]] += r["value"]
        return out

    whole, was = told(), (sd._PAIRS, sd._HELD)
    try:
        sd._PAIRS, sd._HELD = 3, 4
        assert told() == whole
    finally:
        sd._PAIRS, sd._HELD = was


def test_empty_tables_few_documents_and_names(spark):
    assert found(spark, []) == []
    rows = [(1, "few words", "a", "x"), (2, "few words", "a", "y")]
    assert found(spark, rows) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
    docs = spark.createDataFrame(corpus(1), SCHEMA)
    for name in ("digest", "copies", "n", "term", "p", "q", "number"):
        docs = docs.withColumn(name, F.lit("other"))
    assert sorted(tuple(r) for r in sd.audit(docs).collect()) == brute(corpus(1))


def test_texts_are_tokenized_once(spark):
    rows = [(k, "one text in several sources", "a", f"s{k % 3}") for k in range(30)]
    assert sd.collapse(spark.createDataFrame(rows, SCHEMA)).count() == 1
