"""Searching for all words against a plain version, and what a library's fields add up to over days."""

import random

from pyspark.sql import functions as F

from photolake.operators import articles, metadata


def test_search_equals_brute_force(spark):
    rng = random.Random(2)
    syllables = ["ab", "ring", "él", "Über", "x", "日本", "a", "wid"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 3))), "", "g", " ".join(word() for _ in range(rng.randint(0, 20)))) for k in range(80)]
    asked = [(k, " ".join(word() for _ in range(rng.randint(1, 3)))) for k in range(150)] + [(200, ""), (201, None), (202, " \n "), (203, "x"), (204, "ab AB áb"), (205, "nowhere ring"), (206, "🙂"), (207, "r i")]
    docs = spark.createDataFrame(rows, "article_id int, title string, summary string, grp string, body string")
    queries = spark.createDataFrame(asked, "query_id int, text string")
    folded = {r.article_id: r.hay for r in docs.select("article_id", articles.fold_text(F.concat_ws(" ", "title", "summary", "grp", "body")).alias("hay")).collect()}
    words = {r.query_id: set(r.w.split()) for r in queries.select("query_id", articles.fold_text(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    want = sorted((q, a) for q, ws in words.items() for a, hay in folded.items() if all(w in hay for w in ws))
    got = sorted(map(tuple, articles.search_all_words(docs, queries).collect()))
    assert got == want and len({q for q, _ in want}) > 60
    assert articles.search_all_words(docs, queries.limit(0)).count() == 0 and articles.search_all_words(docs.limit(0), queries).count() == 0
    long = articles.search_all_words(docs, queries.filter("query_id = 0"))
    assert sorted(map(tuple, long.collect())) == [w for w in want if w[0] == 0]


def test_a_long_article_is_cut_into_runs_once(spark):
    """Time in the square of a text's length would not end here."""
    body = " ".join(f"w{k * 7919 % 100_003}" for k in range(60_000))
    docs = spark.createDataFrame([(1, "t", "", "g", body), (2, "t", "", "g", "w1")], "article_id int, title string, summary string, grp string, body string")
    asked = spark.createDataFrame([(1, "w7919 w15838"), (2, "w1")], "query_id int, text string")
    assert sorted(map(tuple, articles.search_all_words(docs, asked).collect())) == [(1, 1), (2, 1), (2, 2)]


def test_thumbnails_are_told_and_are_no_tags(spark):
    tags = spark.createDataFrame([(1, "ThumbnailLength", "400"), (1, "ThumbnailOffset", "12"), (2, "ThumbnailLength", "0"), (3, "Make", "M")], "photo_id long, tag string, value string")
    photos = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "photo_id long")
    got = {r.photo_id: r for r in metadata.metadata_report(photos, tags).collect()}
    assert [got[k].has_thumbnail for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert [got[k].has_any for k in (1, 2, 3, 4)] == [True, False, True, False] and got[1].other_count == 0
    assert metadata.privacy_audit(metadata.metadata_report(photos, tags).withColumn("k", F.lit(1)), "k").filter("k is null").head().thumbnails == 1


def test_merged_sketches_count_shared_photos_once(spark):
    fields = "array<struct<key:string,label:string,value:string,identifying:boolean>>"
    report = spark.range(30_000).select(
        F.col("id").alias("photo_id"), (F.col("id") % 3 == 0).alias("has_thumbnail"), F.when(F.col("id") % 3 == 0, "a").alias("country"),
        F.from_json(F.lit('[{"key":"k","label":"Software","value":"v","identifying":true}]'), fields).alias("fields"),
    )
    days = [metadata.field_sketches(report.filter(f"photo_id {part}"), "country") for part in ("< 20000", ">= 10000")]
    got = {(r.country, r.label): r.photos for r in metadata.merge_sketches(*days).collect()}
    assert set(got) == {("a", "Software"), ("a", "Thumbnail"), (None, "Software")}
    for key, n in ((("a", "Software"), 10_000), (("a", "Thumbnail"), 10_000), ((None, "Software"), 20_000)):
        assert abs(got[key] - n) <= 5 * metadata.SKETCH_ERROR * n


def test_equal_queries_are_searched_once(spark):
    """Queries that ask for the same share one result, and long words without a blank are looked into too."""
    docs = spark.createDataFrame([(k, "t", "", "g", f"Red BOLT n{k} " + "xy" * 60 + "zq") for k in range(40)], "article_id int, title string, summary string, grp string, body string")
    asked = spark.range(5000).selectExpr("id query_id", "array('bolt  red', ' Red bolt ', 'yxyzq', 'n1 bolt')[int(id % 4)] text")
    sets = asked.select(articles.asked_words(F.col("text")).alias("asked"))
    assert sorted(r.asked for r in sets.distinct().collect()) == ["bolt n1", "bolt red", "yxyzq"]
    found = articles.search_asked(docs, sets)
    assert {r.asked: r["count"] for r in found.groupBy("asked").count().collect()} == {"bolt n1": 11, "bolt red": 40, "yxyzq": 40}
    assert articles.search_all_words(docs, asked).count() == 1250 * (40 + 40 + 40 + 11)
