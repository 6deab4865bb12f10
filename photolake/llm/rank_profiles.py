"""Language ID by rank order: a text's most frequent n-grams against each language's, by how far out
of place they are (Cavnar and Trenkle, 1994).

A word is a run of letters and marks, in lower case, with a blank at both ends; its n-grams have one,
two or three code points, and no blank in the middle. A gram is one number, its code points in 21 bits
each, so grams never meet by chance and their order is that of their texts. A profile is the list of
the ``PROFILE`` most frequent grams, by count and then by gram. The distance of a text to a language
is the sum, over the grams of the text's profile, of how many ranks lie between the gram's places in
both, or ``PROFILE`` where the language's profile has none of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, materialise, packed, quoted

PROFILE = 400
#: Languages that one function compares with; more are dealt to several. A language has PROFILE rows.
LANGUAGES = 500
_BLOCK = 1 << 20  # code points counted at once
_TEXTS = 1 << 10  # texts counted at once, so that a text, a count and a place fit one number
_HELD = 1 << 21  # (language, gram) counts that a task holds before it hands them on
_BLANK = 32


@cache
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, or a blank where it is neither letter nor mark; and whether
    it is a letter."""
    fold, letter = np.full(0x110000, _BLANK, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    return fold, letter


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate((np.flatnonzero(np.diff(sorted_keys, prepend=~sorted_keys[:1])), [len(sorted_keys)]))


def _count(x: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, count), by owner and gram, of the folded code points x[1:-1], ``owner`` of each."""
    at = np.flatnonzero(x[1:-1] != _BLANK) + 1
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    present = np.flatnonzero(np.bincount(x))
    place = np.zeros(int(present[-1]) + 1, np.uint64)
    place[present] = np.arange(1, len(present) + 1, dtype=np.uint64)  # 0 is no character
    s, base = place[x], np.uint64(len(present) + 1)
    head = owner[at - 1].astype(np.uint64) * base
    before, here, after = s[at - 1], s[at], s[at + 1]
    pairs = ((head + before) * base + here) * base
    last = x[at + 1] == _BLANK
    one = (head + here) * base * base
    keys = np.concatenate((one, pairs, one[last] + after[last] * base, pairs + after))
    keys.sort()
    first = _runs(keys)
    n, keys = np.diff(first), keys[first[:-1]]
    codes = np.concatenate(([0], present)).astype(np.uint64)
    rest, c = np.divmod(keys, base)
    rest, b = np.divmod(rest, base)
    who, a = np.divmod(rest, base)
    return who.astype(np.int64), codes[a] << np.uint64(42) | codes[b] << np.uint64(21) | codes[c], n


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal grams added up."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    first = _runs(keys[order])
    return keys[order][first[:-1]], np.add.reduceat(n[order], first[:-1]) if len(keys) else n


def _long_text(text: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) of one text of any length: pieces overlap by one code point at both ends, and
    what is held between them is the text's distinct grams."""
    fold, _ = _fold()
    parts, held = [], 0
    for a in range(0, len(text), block):
        piece = text[max(a - 1, 0) : a + block + 1]
        piece = ("" if a else "\n") + piece + ("" if a + block < len(text) else "\n")
        x = fold[_codes(piece)]
        _, keys, n = _count(x, np.zeros(len(x) - 2, np.int64), 1)
        parts.append((keys, n))
        held += len(keys)
        if held > _HELD:
            parts = [_merged(parts)]
            held = len(parts[0][0])
    return _merged(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def gram_counts(texts: list[str], owner: np.ndarray, block: int = _BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of (owner, gram, count); ``owner`` has a number for each text. An owner of few texts may
    come in several parts, but the grams of one text always come in one."""
    fold, _ = _fold()
    sizes = np.array([len(t) for t in texts], np.int64)
    a = 0
    while a < len(texts):
        if sizes[a] > block:
            keys, n = _long_text(texts[a], block)
            yield np.full(len(keys), owner[a], np.int64), keys, n
            a += 1
            continue
        ends = np.cumsum(sizes[a : a + _TEXTS])
        b = a + max(1, int(np.searchsorted(ends, block, "right")))
        own, numbers = np.unique(owner[a:b], return_inverse=True)
        x = fold[_codes("\n" + "\n".join(texts[a:b]) + "\n")]
        who, keys, n = _count(x, np.repeat(numbers, sizes[a:b] + 1)[: len(x) - 2], len(own))
        yield own[who], keys, n
        a = b


def top_grams(who: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, rank) of the rows of each owner's ``most`` largest counts; rows are by owner and gram,
    and a part has at most _TEXTS owners unless it has one."""
    if not len(who):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if who[0] == who[-1]:
        order = np.argsort(-n, kind="stable")[:most]
        return order, np.arange(len(order))
    own, numbers = np.unique(who, return_inverse=True)
    low = np.uint64((1 << 23) - 1)
    key = numbers.astype(np.uint64) << np.uint64(46) | (low - n.astype(np.uint64)) << np.uint64(23) | np.arange(len(n), dtype=np.uint64)
    key.sort()
    owner = key >> np.uint64(46)
    rank = np.arange(len(key)) - np.searchsorted(owner, np.arange(len(own), dtype=np.uint64))[owner.astype(np.int64)]
    some = rank < most
    return (key[some] & low).astype(np.int64), rank[some]


def _lang_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), added up within a task as far as _HELD allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    size = 0
    for batch in batches:
        langs, numbers = np.unique(np.array(batch["lang"].to_pylist(), object), return_inverse=True) if batch.num_rows else ((), None)
        if not len(langs):
            continue
        for who, keys, n in gram_counts(batch["text"].to_pylist(), numbers):
            edges = np.searchsorted(who, np.arange(len(langs) + 1))
            for k in np.flatnonzero(np.diff(edges)):
                held.setdefault(langs[k], []).append((keys[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]))
            size += len(keys)
            if size > _HELD:
                for lang, parts in held.items():
                    held[lang] = [_merged(parts)]
                size = sum(len(p[0][0]) for p in held.values())
                if size > _HELD // 2:
                    yield from out()
                    size = 0
    yield from out()


def train(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(lang, rank, gram, n): the ``profile`` most frequent grams of each lang, ranks from 0.

    Learns from every row of ``docs`` (text, lang) that has both; an empty lang is one like others.
    Rows that repeat count again, texts of any length count whole, texts without letters add nothing,
    ties in count go by gram, and an empty table gives an empty one. Counts are added up within tasks
    first; the best of each lang are chosen in slices of its grams and then among those.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(_lang_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    slices = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(*order))
    best = counts.withColumn("k", slices).filter(F.col("k") <= profile)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return best.withColumn("k", rank).filter(F.col("k") <= profile).select("lang", (F.col("k") - 1).alias("rank"), "gram", "n")


def _distances(langs: list[str], grams: np.ndarray, rank: np.ndarray, lang: np.ndarray, profile: int):
    """Function of texts: least distance, its language (the first by UTF-8 on a tie), the distance of a
    text that shares nothing, and whether there is a letter."""
    order = np.argsort(grams, kind="stable")
    grams, rank, lang = grams[order], rank[order], lang[order]
    first = _runs(grams)
    distinct = grams[first[:-1]]

    def block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distances, texts by languages, and the sizes of the texts' profiles."""
        near, sizes = np.zeros((len(texts), len(langs)), np.int64), np.zeros(len(texts), np.int64)
        for who, keys, n in gram_counts(texts, np.arange(len(texts))):
            at, places = top_grams(who, n, profile)
            who, keys = who[at], keys[at]
            sizes += np.bincount(who, minlength=len(texts))
            hit = np.searchsorted(distinct, keys)
            known = np.flatnonzero(distinct[np.minimum(hit, len(distinct) - 1)] == keys)
            hit, who, places = hit[known], who[known], places[known]
            times = first[hit + 1] - first[hit]
            ends = np.cumsum(times)
            row = np.repeat(first[hit] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
            saved = profile - np.abs(np.repeat(places, times) - rank[row])
            near += np.bincount(np.repeat(who, times) * len(langs) + lang[row], saved, near.size).astype(np.int64).reshape(near.shape)
        return sizes[:, None] * profile - near, sizes

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        _, letter = _fold()
        for texts in parts:
            texts, out = texts.tolist(), []
            for a in range(0, len(texts), 256):
                some = [t or "" for t in texts[a : a + 256]]
                distance, sizes = block(some)
                best = distance.argmin(1)
                lettered = [any(letter[_codes(t[k : k + _BLOCK])].any() for k in range(0, len(t), _BLOCK)) for t in some]
                out.append(pd.DataFrame({"distance": distance[np.arange(len(some)), best], "lang": [langs[k] for k in best], "worst": sizes * profile, "lettered": lettered}))
            yield pd.concat(out) if out else pd.DataFrame({"distance": [], "lang": [], "worst": [], "lettered": []})

    return run


def identify(docs: DataFrame, profiles: DataFrame, profile: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score, from the column text alone.

    The nearest of the languages of ``profiles`` (as ``train`` gives them), the first by UTF-8 on a
    tie; score is 1 less its distance over that of a text that shares no gram: 1 for a text whose
    profile is the language's, 0 for one that has none of it. Null texts, texts without a letter and
    all texts where nothing was learned are 'und' with score 0. Texts of any length are read whole,
    rows that repeat are rows like others, columns of other names stay, and an empty table gives an
    empty one. Profiles go to the workers with the function, LANGUAGES of them to a function.
    """
    spark = docs.sparkSession
    profiles = materialise(profiles, "profiles")
    many = profiles.select("lang").distinct().count()
    blocks = -(-many // LANGUAGES)
    found = []
    for k in range(blocks):
        rows = profiles.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).select("lang", "rank", "gram").toPandas()
        langs = sorted(set(rows.lang))
        if langs:
            number = {lang: at for at, lang in enumerate(langs)}
            run = _distances(langs, rows.gram.to_numpy(np.uint64), rows["rank"].to_numpy(np.int64), rows.lang.map(number).to_numpy(np.int64), profile)
            found.append(_as_udf(run))
    best = fresh(docs.columns, "_best")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    if not found:
        return docs.select(*(quoted(c) for c in kept), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = packed(docs).withColumn(best, F.array_min(F.array(*(f(F.col("row.text")) for f in found))))
    score = F.when(F.col(f"{best}.worst") > 0, 1 - F.col(f"{best}.distance") / F.col(f"{best}.worst")).otherwise(F.lit(0.0))
    sure = F.col(f"{best}.lettered")
    return rows.select(
        *(F.col(f"row.{quoted(c)}").alias(c) for c in kept),
        F.when(sure, F.col(f"{best}.lang")).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(sure, score).otherwise(F.lit(0.0)).alias("score"),
    )


def _as_udf(run):
    def distances(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(parts)

    return F.pandas_udf(distances, "distance long, lang string, worst long, lettered boolean")


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves 1 when divided by 3; without a key it does not."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


#: CRC-32 by its table, a byte at a time; grams of the distinct words of a text, times their count.
ORACLE = r"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS l FROM bits WHERE k = 8),
docs AS (SELECT doc_id, text, lang,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a // 256, l[xor(a % 256, b) + 1])), 4294967295) % 3 = 1 AS held_out FROM documents, tab),
words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS w FROM docs) t GROUP BY ALL),
pieces AS (SELECT w, unnest(list_concat(
    list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)),
    list_transform(range(1, length(w) + 2), lambda i: substr(' ' || w || ' ', i, 2)),
    list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)))) AS gram FROM (SELECT DISTINCT w FROM words) d),
grams AS (SELECT doc_id, gram, sum(n) AS n FROM words JOIN pieces USING (w) GROUP BY ALL),
learned AS (SELECT lang, gram, sum(n) AS n FROM grams JOIN docs USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
profiles AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS r FROM learned QUALIFY r < 400),
own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS r FROM grams QUALIFY r < 400),
far AS (SELECT doc_id, l.lang, sum(coalesce(abs(own.r - p.r), 400)) AS distance, count(*) * 400 AS worst
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = own.gram GROUP BY ALL),
best AS (SELECT doc_id, arg_min(lang, (distance, lang)) AS lang, min(distance) AS distance, min(worst) AS worst FROM far GROUP BY doc_id)
SELECT doc_id, held_out, CASE WHEN sure THEN best.lang ELSE 'und' END AS lang_pred,
  CASE WHEN sure THEN 1 - distance::DOUBLE / worst::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM (SELECT *, coalesce(regexp_matches(text, '\p{L}'), false) AND doc_id IN (SELECT doc_id FROM best) AS sure FROM docs) d LEFT JOIN best USING (doc_id)
"""
