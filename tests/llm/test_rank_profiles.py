"""Rank-order profiles against a plain version, held-out accuracy, pieces of long texts, edge cases."""

import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from photolake.llm import rank_profiles as rp

SCHEMA = "doc_id long, text string, lang string"


def grams(text):
    fold = "".join(c.lower() if unicodedata.category(c)[0] in "LM" and len(c.lower()) == 1 else c if unicodedata.category(c)[0] in "LM" else " " for c in text)
    out = Counter()
    for w in fold.split():
        s = f" {w} "
        out.update([*w, *(s[k : k + 2] for k in range(len(s) - 1)), *(s[k : k + 3] for k in range(len(s) - 2))])
    return out


def code(gram):
    return sum(ord(c) << 21 * (2 - k) for k, c in enumerate(gram))


def profile(counts, most=rp.PROFILE):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def brute(rows, asked):
    learned = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            learned.setdefault(lang, Counter()).update(grams(text))
    ranks = {lang: {g: k for k, g in enumerate(profile(c))} for lang, c in learned.items() if c}
    out = []
    for text in asked:
        own = profile(grams(text or ""))
        if not any(c.isalpha() for c in text or "") or not ranks:
            out.append(("und", 0.0))
            continue
        far = {lang: sum(abs(k - r[g]) if g in r else rp.PROFILE for k, g in enumerate(own)) for lang, r in ranks.items()}
        lang = min(far, key=lambda x: (far[x], x.encode()))
        out.append((lang, 1 - far[lang] / (len(own) * rp.PROFILE)))
    return out


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = {"aa": "alpha beta gamma the of and Über".split(), "bb": "der die das und nicht wie ÉTÉ".split(), "cc": "ложь да нет это как".split()}
    return [(k, " ".join(rng.choices(words[lang], k=rng.randint(1, 40))) + rng.choice(["", ".\n", " 12"]), lang) for k, lang in enumerate(rng.choices(list(words), k=n))]


def predict(spark, rows, asked):
    profiles = rp.train(spark.createDataFrame(rows, SCHEMA))
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    return [(r.lang_pred, r.score) for r in sorted(rp.identify(docs, profiles).collect(), key=lambda r: r.doc_id)]


def test_equals_brute_force(spark):
    rows = corpus(120) + [(900, None, "aa"), (901, "no language", None), (902, "", "dd"), (903, "12 34", "ee"), (904, "tie tie", ""), (904, "tie tie", "")]
    asked = [t for _, t, _ in corpus(60, 9)] + [None, "", "  12 !?", "x", "日本語 текст", "á é", "́", "tie", "same text", "same text", "\U0001d504 \U00010400"]
    got, want = predict(spark, rows, asked), brute(rows, asked)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-12)
    assert all(0 <= g[1] <= 1 for g in got) and got[60] == ("und", 0.0) and got[62] == ("und", 0.0)


def test_profiles_equal_brute_force(spark):
    rows = corpus(80)
    got = {}
    for r in rp.train(spark.createDataFrame(rows, SCHEMA), 50).collect():
        got.setdefault(r.lang, []).append((r["rank"], r.gram))
    for lang, found in got.items():
        counts = Counter()
        for _, text, own in rows:
            if own == lang:
                counts.update(grams(text))
        assert [g for _, g in sorted(found)] == [code(g) for g in profile(counts, 50)]


def test_pieces_of_a_long_text_count_as_the_whole():
    rng = random.Random(2)
    text = "".join(rng.choices("abcé ñ.\n日本", k=5000))
    whole = {k: n for k, n in ((code(g), n) for g, n in grams(text).items())}
    for block in (7, 100, 4999, 5000, 1 << 20):
        found = Counter()
        for who, keys, n in rp.gram_counts([text, "ab"], np.array([0, 1]), block):
            for w, k, c in zip(who.tolist(), keys.tolist(), n.tolist(), strict=True):
                if w == 0:
                    found[k] += c
        assert found == whole


def test_nothing_learned_empty_tables_and_names(spark):
    assert predict(spark, [], ["text", None]) == [("und", 0.0)] * 2
    profiles = rp.train(spark.createDataFrame(corpus(20), SCHEMA))
    docs = spark.createDataFrame([("die nicht", "x", 1, "y")], "text string, lang_pred string, _best int, row string")
    out = rp.identify(docs, profiles)
    assert out.columns == ["text", "_best", "row", "lang_pred", "score"] and out.first()[:4] == ("die nicht", 1, "y", "bb")
    assert rp.identify(docs.filter("false"), profiles).count() == 0


def test_more_languages_than_one_function_takes(spark, monkeypatch):
    rows, asked = corpus(60), [t for _, t, _ in corpus(20, 3)]
    monkeypatch.setattr(rp, "LANGUAGES", 1)
    assert [g[0] for g in predict(spark, rows, asked)] == [w[0] for w in brute(rows, asked)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", rp.held_out())
    found = rp.identify(docs.filter("held_out"), rp.train(docs.filter("not held_out")))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right >= 0.99
