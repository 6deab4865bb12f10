"""How far the sources of a language are from each other in what words they use.

Identical texts of a language are collapsed to one, with the number of its copies from each source;
each such text is split into terms once, and its terms count as often as it has copies. Pairs of
sources are compared sparsely: a term that neither has adds the same to each pair, so all terms are
first taken as absent in both, then each group's own terms correct that against groups without them
(by how often a count comes, not by term), and only terms that two groups share are met term by term.

Divergence of a term, in whole numbers: p = 1 + floor(10**9 * (count + 2) / (N + 2 V)) and
f = floor((p - q)**2 / (p + q)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

LEAST_DOCS = 10
BEST_TERMS = 10
_BLOCK = 1 << 22  # bytes of text split at once
_PAIRS = 1 << 20  # pairs of a term's groups compared at once
_HELD = 1 << 21  # sums that a task holds before it hands them on

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20


def split_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, term) of each term in order, and the distinct terms. Every byte above 0x7F belongs to a
    character that is part of terms."""
    x = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    inside = _TERM[x]
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOW[x[inside]])]).dictionary_encode()
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    return np.searchsorted(first, start, "right") - 1, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and the sums of ``values`` over each."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    return [key[order][first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)]


def _text_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, term, count), and the distinct terms."""
    text, term, terms = split_terms(texts)
    width = max(len(terms), 1)
    key, n = np.unique(text * width + term, return_counts=True)
    return key // width, key % width, n, terms


def _long_text(text: bytes, block: int) -> tuple[np.ndarray, pa.Array]:
    """(count, terms) of one text of any length, cut where no term is."""
    held: list[pa.Table] = []
    rows = a = 0
    data = np.frombuffer(text, np.uint8)
    while a < len(text):
        b = a + block
        while b < len(text) and _TERM[data[b - 1]]:  # on to the end of the term
            gap = np.flatnonzero(~_TERM[data[b : b + 4096]])
            b += int(gap[0]) + 1 if len(gap) else 4096
        _, term, n, terms = _text_terms([text[a:b]])
        held.append(pa.table({"term": terms.take(pa.array(term)), "n": n}))
        rows += len(n)
        if rows > _HELD:
            held = [pa.concat_tables(held).group_by("term").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})]
            rows = held[0].num_rows
        a = b
    whole = pa.concat_tables(held).group_by("term").aggregate([("n", "sum")]).combine_chunks()
    return whole["n_sum"].to_numpy(), whole["term"].combine_chunks() if whole.num_rows else pa.array([], pa.large_binary())


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_weighted``, those of equal lang, source and term added up as far as _HELD allows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def merged() -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return table.select([0, 1, 2, 3, 4]).rename_columns(["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=1 << 16)

    for batch in _weighted(batches):
        held.append(batch)
        rows += batch.num_rows
        if rows > _HELD:
            held = merged()
            rows = sum(b.num_rows for b in held)
            if rows > _HELD // 2:
                yield from held
                held, rows = [], 0
    if held:
        yield from merged()


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of texts with their copies from each source, added up by block."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        lengths = np.asarray(pc.list_value_length(batch["copies"]))
        first = np.concatenate(([0], np.cumsum(lengths)))
        copies = batch["copies"].flatten()
        source, times = copies.field("source"), copies.field("n").to_numpy()
        a = 0
        while a < batch.num_rows:
            if sizes[a] > _BLOCK:
                b = a + 1
                n, terms = _long_text(batch["text"][a].as_py(), _BLOCK)
                text, term = np.zeros(len(n), np.int64), np.arange(len(n))
            else:
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), _BLOCK, "right")))
                text, term, n, terms = _text_terms(batch["text"].slice(a, b - a).to_pylist())
            # the groups of this block, and each text's copies from them
            lang = pc.take(batch["lang"], pa.array(np.repeat(np.arange(a, b), lengths[a:b])))
            groups = pa.StructArray.from_arrays([lang, source.slice(first[a], first[b] - first[a])], ["lang", "source"])
            names = list(dict.fromkeys(map(tuple, map(dict.values, groups.to_pylist()))))
            number = {g: k for k, g in enumerate(names)}
            group = np.array([number[tuple(g.values())] for g in groups.to_pylist()], np.int64)
            times_here = times[first[a] : first[b]]
            many = lengths[a:b][text]
            ends = np.cumsum(many)
            at = np.repeat((first[a:b] - first[a])[text] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            width = max(len(terms), 1)
            key, total, docs = _sums(group[at] * width + np.repeat(term, many), np.repeat(n, many) * times_here[at], times_here[at])
            who = key // width
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[k] for g in names], pa.string()).take(pa.array(who)) for k in (0, 1)] + [terms.take(pa.array(key % width)).cast(pa.large_string()).cast(pa.string()), pa.array(total), pa.array(docs)],
                ["lang", "source", "term", "n", "docs"],
            )
            a = b


def collapse(docs: DataFrame) -> DataFrame:
    """(lang, text, copies array of (source, n)): identical texts of a language once. Copies are added
    up before any shuffle, and a text is shuffled once for each task that has it."""
    body = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text"))).withColumn("digest", F.sha2("text", 256))
    copies = body.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = body.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", F.col("text").cast("binary").alias("text"), "copies")


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, counts array of (source, n)) of the terms in at least ``least_docs``
    documents of a language."""
    rows = collapse(docs).mapInArrow(_added_up, "lang string, source string, term string, n long, docs long")
    # added up within tasks already; one shuffle serves both aggregations
    by_source = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return by_term.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "counts")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p, by exact decimals; null without terms."""
    top, room = F.lit(10**9).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(19,0)")
    return 1 + _div(top, room)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): over the terms that two groups a < b share, what f is more than each side's
    own correction has it."""
    held: dict[str, list[list[np.ndarray]]] = {}
    size = 0

    def settle() -> None:
        nonlocal size
        for lang, parts in held.items():
            held[lang] = [_sums(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))]
        size = sum(len(p[0][0]) for p in held.values())

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal size
        settle()
        for lang, ((key, value),) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key >> 31), pa.array(key & (1 << 31) - 1), pa.array(value)], ["lang", "a", "b", "value"])
        held.clear()
        size = 0

    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        lang_of, langs = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        lengths = np.asarray(pc.list_value_length(batch["groups"]))
        flat = batch["groups"].flatten()
        number, p, base = (flat.field(c).to_numpy() for c in ("number", "p", "base"))
        row = np.repeat(lang_of, lengths)  # each entry's language
        later = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(row)) - 1  # partners after each entry
        ends = np.cumsum(later)
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _PAIRS, "right")))
            left = np.repeat(np.arange(a, b), later[a:b])
            right = left + 1 + np.arange(len(left)) - np.repeat(ends[a:b] - later[a:b] - (ends[a - 1] if a else 0), later[a:b])
            value = _f(p[left], p[right]) - _f(p[left], base[right]) - _f(base[left], p[right]) + _f(base[left], base[right])
            key = number[left] << 31 | number[right]
            for k in np.unique(row[left]):
                some = row[left] == k
                held.setdefault(langs[k], []).append(_sums(key[some], value[some]))
                size += len(held[langs[k]][-1][0])
            if size > _HELD:
                settle()
                if size > _HELD // 2:
                    yield from out()
            a = b
    yield from out()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best_terms: int = BEST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups (lang, source) of ``docs``.

    Part ``pair``: every other source of the lang, by f summed over all kept terms; part ``term``: the
    ``best_terms`` terms that the group has more of than its lang, by f. Null lang, source and text
    count as empty, groups without terms take part, rows that repeat count again, texts of any length
    count whole, ties in value go by the item's UTF-8, other columns are not read, and an empty table
    gives an empty one.
    """
    kept = materialise(term_counts(docs, least_docs), "terms")
    each = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    sizes = each.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    groups = groups.select("lang", "source", "number", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "terms", "lang_size")))
    groups = materialise(groups.withColumn("base", share(F.lit(0), F.col("size"), F.col("terms"))), "groups")

    told = each.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size"), F.col("terms")))
    told = materialise(told.withColumn("q", share(F.col("total"), F.col("lang_size"), F.col("terms"))).select("lang", "source", "term", "number", "base", "p", "q"), "shares")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    above = told.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    above = above.withColumn("rank", rank).filter(F.col("rank") <= best_terms)

    # pairs of sources: as many rows as the result has, and no more than added up to it
    sides = lambda end: groups.select("lang", F.col("number").alias(end), F.col("base").alias(f"base_{end}"), *(["terms"] if end == "a" else []))
    both = sides("a").join(sides("b"), "lang").filter("a <> b")
    absent = both.select("lang", "a", "b", F.coalesce(F.col("terms") * divergence(F.col("base_a"), F.col("base_b")), F.lit(0)).alias("value"))
    often = told.groupBy("lang", F.col("number").alias("a"), F.col("base").alias("base_a"), "p").agg(F.count(F.lit(1)).alias("terms"))
    more = divergence(F.col("p"), F.col("base_b")) - divergence(F.col("base_a"), F.col("base_b"))
    own = often.join(sides("b"), "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * more).alias("value"))
    own = own.unionByName(own.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    met = told.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("number", "p", "base"))).alias("groups")).select("lang", "groups")
    shared = met.mapInArrow(_shared_terms, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    shared = shared.unionByName(shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    total = absent.unionByName(own).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "number", "source")
    pairs = total.join(names.withColumnsRenamed({"number": "a"}), ["lang", "a"]).join(names.withColumnsRenamed({"number": "b", "source": "item"}), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.unionByName(above)


#: Every term of every group met with every other group, without collapse or sparseness.
ORACLE = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
tokens AS (SELECT lang, source, k, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT k) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS HUGEINT) AS p FROM full_counts WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS HUGEINT) AS p FROM whole WINDOW g AS (PARTITION BY lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
bare AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM kept)),
term AS (SELECT p.lang, p.source, 'term' AS part, term AS item, (p.p - q.p) * (p.p - q.p) // (p.p + q.p) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.p)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pair UNION ALL FROM bare UNION ALL FROM term) t QUALIFY part = 'pair' OR rank <= 10
"""
