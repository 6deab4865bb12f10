"""Help articles: language fallback, sources, search and runs."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.cut import sent, settle

#: Letters with marks of the Latin blocks and what is left without them, from Unicode's own tables.
_MARKED = {chr(c): b for c in range(0xC0, 0x250) if len(b := unicodedata.normalize("NFD", chr(c))[0]) == 1 and b != chr(c)}

#: Rows of words that are broadcast together.
_SENT = 200_000


def fold_text(text):
    """Lower case without marks, dotless i as i. Covers the precomposed Latin letters; combining
    marks on their own are dropped."""
    plain = F.translate(text, "".join(_MARKED), "".join(_MARKED.values()))
    return F.translate(F.lower(F.regexp_replace(plain, r"\p{Mn}+", "")), "ı", "i")


@F.pandas_udf(StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """The same for every script, by decomposition."""
    marked = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return texts.map(lambda t: marked(t).lower().replace("ı", "i"), na_action="ignore")


def articles_for_language(articles: DataFrame, wanted: DataFrame, fallback: str = "en") -> DataFrame:
    """For each wanted language its articles, or the whole fallback set where it has none."""
    have = articles.select("lang").distinct().withColumn("have", F.lit(True))
    served = wanted.select("lang").distinct().join(have, "lang", "left").select(
        F.col("lang").alias("wanted"), F.when(F.col("have"), F.col("lang")).otherwise(F.lit(fallback)).alias("lang")
    )
    return served.join(articles, "lang")


def attach_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Each article with its sources in order; none gives an empty list."""
    listed = sources.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("s"))
    return articles.join(listed, "article_id", "left").withColumn("sources", F.coalesce(F.col("s.url"), F.array().cast("array<string>"))).drop("s")


def _runs(text: Column, *sizes: int) -> Column:
    """The distinct runs of so many characters. The characters are bound once, by the outer lambda."""

    def of(chars: Column) -> Column:
        def run(n: int) -> Column:
            return F.transform(chars, lambda c, k: F.concat(c, *[F.get(chars, k + d) for d in range(1, n)]))

        return F.array_distinct(F.filter(F.concat(*map(run, sizes)), lambda g: g.isNotNull()))

    return F.transform(F.array(F.split(text, "")), of)[0]


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _grams_of(tokens: DataFrame, lengths: list[int]) -> DataFrame:
    """(token, gram): the runs of so many characters. To cut one out takes time in proportion to where
    it lies, so long tokens are taken apart once instead."""
    short = F.char_length("token") <= 64
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.char_length("token") - (n - 1), F.lit(1)))
    cut = [tokens.filter(short & (F.char_length("token") >= n)).withColumn("k", F.explode(starts(n))).select("token", F.substring("token", F.col("k"), F.lit(n)).alias("gram")) for n in lengths]
    return reduce(DataFrame.unionByName, cut, tokens.filter(~short).select("token", F.explode(_runs(F.col("token"), *lengths)).alias("gram")))


def asked_words(text: Column) -> Column:
    """The distinct folded words of a query, in order and with blanks between them: texts that ask for
    the same are equal. A null or empty query has none."""
    return F.array_join(F.array_sort(_words(fold_text(F.coalesce(text, F.lit(""))))), " ")


def search_all_words(articles: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, article_id) where the article has every word of the query; an empty or null query has
    all. ``queries``: query_id, text. An article has a word that is part of one of its own."""
    asked = settle(queries.select("query_id", asked_words(F.col("text")).alias("asked")))
    found = search_asked(articles, asked.select("asked"))
    return found.join(sent(asked), "asked").select("query_id", "article_id")


def search_asked(articles: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, article_id) for the distinct texts of ``asked`` (from ``asked_words``), however many queries
    have them.

    A word of a query has no white space, so it lies within one of an article's own words, which are
    far fewer than its characters when all articles' are taken together. Postings of the trigrams (or
    of the word, if it is shorter) lead each word, by its rarest one, to the own words that may have
    it. A query then starts from the articles that have its rarest word, and its other words are
    looked for among those that the article has.
    """
    hay = fold_text(F.concat_ws(" ", "title", "summary", "grp", "body"))
    texts = settle(articles.select("article_id", _words(hay).alias("own")))
    owned = texts.select("article_id", F.explode("own").alias("token"))
    sets = settle(asked.select("asked").distinct().withColumn("words", _words(F.col("asked"))))
    each = sets.select("asked", F.explode("words").alias("word"))
    numbered = settle(each.select("word").distinct().withColumn("id", F.monotonically_increasing_id()))
    long = F.char_length("word") > 2
    grams = settle(numbered.select("word", "id", F.explode(F.when(long, _runs(F.col("word"), 3)).otherwise(F.array("word"))).alias("gram")))
    lengths = [3, 2, 1] if grams.filter("char_length(gram) < 3").limit(1).count() else [3]
    vocabulary = settle(owned.select("token").distinct())
    postings = settle(_grams_of(vocabulary, lengths).join(sent(settle(grams.select("gram").distinct()), _SENT), "gram", "left_semi"))
    sizes = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(sizes, "gram", "left").groupBy("word", "id").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    maybe = rarest.join(postings, "gram").filter(F.contains("token", F.col("word")))
    known = settle(maybe.groupBy("token").agg(F.collect_set("id").alias("ids")))
    hits = owned.join(sent(known, _SENT), "token").groupBy("article_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("has"))
    hits = settle(hits)

    counts = hits.select(F.explode("has").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(numbered, "word").join(counts, "id", "left").groupBy("asked").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "id"))).alias("r"))
    parts = 1 + sets.count() // _SENT
    lead = settle(ranked.select("asked", F.col("r")[0]["id"].alias("id"), F.get("r.id", F.lit(1)).alias("next"), F.slice("r.id", 3, 1_000_000).alias("rest"), F.pmod(F.xxhash64("asked"), F.lit(parts)).alias("part")))
    met = hits.select("article_id", "has", F.explode("has").alias("id"))
    has_all = (F.col("next").isNull() | F.array_contains("has", F.col("next"))) & ((F.size("rest") == 0) | F.forall("rest", lambda w: F.array_contains("has", w)))
    # broadcast in parts, so that an article's words are not copied for each of them
    found = [met.join(F.broadcast(lead.filter(F.col("part") == k)), "id").filter(has_all).select("asked", "article_id") for k in range(parts)]
    everything = sets.filter(F.size("words") == 0).select("asked").crossJoin(texts.select("article_id"))  # that is the result
    return reduce(DataFrame.unionByName, found, everything)


def group_runs(articles: DataFrame) -> DataFrame:
    """Consecutive articles of a language with equal groups form one run: lang, run, grp, first, n.

    Rows are range-dealt by (lang, ord); runs are found within each partition, and those that meet
    at an edge are joined through a table of one row for each (partition, lang).
    """
    parts = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(articles.select("lang", "ord", "grp").repartitionByRange(parts, "lang", "ord").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part", "lang").orderBy("ord")
    starts = F.when(F.lag("grp").over(order).eqNullSafe(F.col("grp")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    pieces = dealt.withColumn("starts", starts).withColumn("k", F.sum("starts").over(order))
    pieces = pieces.groupBy("part", "lang", "k").agg(F.first("grp").alias("grp"), F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
    edges = pieces.groupBy("part", "lang").agg(F.max("k").alias("runs"), F.min_by(F.struct("grp"), "k").alias("head"), F.max_by(F.struct("grp"), "k").alias("tail"))
    along = Window.partitionBy("lang").orderBy("part")
    meets = F.lag("tail").over(along).isNotNull() & F.lag("tail.grp").over(along).eqNullSafe(F.col("head.grp"))
    edges = edges.withColumn("joined", F.when(meets, 1).otherwise(0))
    edges = edges.select(F.col("part").alias("p"), F.col("lang").alias("l"), (F.sum(F.col("runs") - F.col("joined")).over(along) - F.col("runs")).alias("before"))
    placed = pieces.join(edges, (F.col("part") == F.col("p")) & F.col("lang").eqNullSafe(F.col("l")))
    runs = placed.withColumn("run", F.col("before") + F.col("k")).groupBy("lang", "run")
    return runs.agg(F.min_by("grp", "first").alias("grp"), F.min("first").alias("first"), F.sum("n").alias("n"))
