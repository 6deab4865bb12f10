"""Near-duplicates by BagMinHash over bags of five-word shingles.

Signature. A shingle that occurs w times owns the strip of weights (0, w], cut at 1, 2, 4, 8, ...
Over each piece of a strip runs a Poisson process in time, at the rate of the piece's width, seeded
by shingle and piece, so all texts see the same points; a point's height within its piece decides if
it lies below w. Each point belongs to one of ``SIZE`` components, whose value is its earliest
point. Two texts share a component's point with the probability of their weighted Jaccard
similarity. Points are only made up to the time at which all components are filled.

Links. Components are banded. Texts in a bucket are candidates, but a bucket of n texts is not
turned into n(n-1)/2 pairs: rounds compare one pivot of each bucket with its other members, and
components of verified links grow between rounds. A last round compares what is left: in each
bucket, texts outside its largest component with those of other components, unless their known
distances to a pivot differ by more than a link allows (one less the weighted Jaccard similarity is
a metric), or their shingles, counted by class, cannot overlap enough. So every pair that shares a
bucket is compared, already joined through others, or proven too far. Every comparison is exact, on
the bags themselves.

Nodes are distinct texts (MD5), so copies cost nothing beyond their node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, packed
from .words import Words, mix, split_words, text_slices

SHINGLE = 5
ROWS, BANDS = 6, 30
SIZE = ROWS * BANDS
PIVOT_ROUNDS = 2
CLASSES = 256
_NUMERATOR, _DENOMINATOR = 4, 5  # a link: similarity of 0.8 or more
_FAR = 1 - _NUMERATOR / _DENOMINATOR
_BROADCAST_ROWS = 200_000  # of 40 bytes at most
_PER_SALT = 64
_PER_SLICE = 512  # rows of a hot key that meet its other side in one task
_NO_ID = -(2**63)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(w: Words, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of a batch, by text and shingle. A text of one to four words has one
    shingle, of all its words."""
    at, h = w.shingles(SHINGLE)
    doc = w.doc[at]
    n = np.bincount(w.doc, minlength=texts)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        first = np.searchsorted(w.doc, few)
        own = np.zeros(len(few), np.uint64)
        for k in range(SHINGLE - 1):
            inside = k < n[few]
            own[inside] = mix(own[inside] * np.uint64(0xA0761D6478BD642F) + w.hash[first[inside] + k] + np.uint64(1))
        doc, h = np.concatenate((doc, few)), np.concatenate((h, own))
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    starts = np.flatnonzero(new)
    return doc[starts], h[starts], np.diff(starts, append=len(h))


def _points(doc, key, rate, low, weight, limit, out, size):
    """Collect the points of pieces up to their texts' time ``limit``: (cell, time, point)."""
    time = np.zeros(len(key))
    step = np.array([0], np.uint64)
    while len(key):
        step = step + _STEP
        h = mix(key + step)
        # (0, 1]; a point comes after -log(u) / rate
        u = ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53
        time = time - np.log(u) / rate
        live = time <= limit[doc]
        if not live.all():
            doc, key, rate, low, weight, time, h = (a[live] for a in (doc, key, rate, low, weight, time, h))
        place = mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
        height = low + np.floor((place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate)
        below = height < weight
        cell = doc * size + ((place >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        out.append((cell[below], time[below], h[below]))


def signatures(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """uint64 of shape (texts, size); all zero for a text without shingles."""
    sig = np.zeros((texts, size), np.uint64)
    if not len(doc):
        return sig
    total = np.bincount(doc, times, minlength=texts)
    pieces = [(doc, mix(shingle), np.ones(len(doc)), np.zeros(len(doc)), times.astype(np.float64))]
    low = 1
    while True:
        more = times > low
        if not more.any():
            break
        doc, shingle, times = doc[more], shingle[more], times[more]
        n = len(doc)
        pieces.append((doc, mix(shingle + np.uint64(low)), np.full(n, float(low)), np.full(n, float(low)), times.astype(np.float64)))
        low *= 2
    pieces = [np.concatenate(x) for x in zip(*pieces, strict=True)]
    limit = np.where(total > 0, size * (np.log(size) + 2.5) / np.maximum(total, 1), 0.0)
    flat = sig.reshape(-1)
    todo = total > 0
    while todo.any():
        chosen = todo[pieces[0]]
        points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        _points(*(x[chosen] for x in pieces), limit, points, size)
        cell, time, point = (np.concatenate(x) for x in zip(*points, strict=True))
        order = np.argsort(-time, kind="stable")  # the earliest is written last
        flat[cell[order]] = point[order]
        filled = np.zeros(len(flat), bool)
        filled[cell] = True
        todo &= ~filled.reshape(texts, size).all(1)
        sig[todo] = 0
        limit = limit * 2
    return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """int64 of shape (texts, BANDS)."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (len(sig), 1))
    rows = sig.reshape(len(sig), BANDS, ROWS)
    for k in range(ROWS):
        h = mix(h * np.uint64(0xA0761D6478BD642F) + rows[:, :, k])
    return h.view(np.int64)


def _bodies(column: pa.Array) -> list[bytes]:
    return [b.as_py() or b"" for b in column]


def _node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _bands(docs: DataFrame) -> DataFrame:
    """(node, bands) once for each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bodies(batch["body"])
            for s in text_slices([len(t) for t in texts], 1 << 19):
                n = s.stop - s.start
                doc, shingle, times = bags(split_words(texts[s]), n)
                hashes = band_hashes(signatures(doc, shingle, times, n))
                some = np.bincount(doc, minlength=n) > 0
                ends = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch["node"].slice(s.start, n), lists], ["node", "bands"])

    coded = docs.select(_node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return coded.mapInArrow(run, "node binary, bands array<long>").groupBy("node").agg(F.any_value("bands").alias("bands"))


def _small(df: DataFrame, rows: int = _BROADCAST_ROWS) -> DataFrame:
    """Broadcast within a counted bound; beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _hot(counts: DataFrame, key: str) -> DataFrame | None:
    """(key, slices) of the keys with over _PER_SLICE rows, by (key, n); None if there are none.
    There is at most one for each _PER_SLICE rows."""
    hot = materialise(counts.filter(F.col("n") > _PER_SLICE).select(key, F.ceil(F.col("n") / _PER_SLICE).cast("int").alias("slices")), "near-hot")
    return _small(hot) if hot.limit(1).count() else None


def _sliced(rows: DataFrame, hot: DataFrame | None, key: str, by: str) -> DataFrame:
    """``rows`` with a slice of their key, dealt by the column ``by``."""
    if hot is None:
        return rows.withColumn("slice", F.lit(0))
    slices = F.coalesce(F.pmod(F.xxhash64(by), F.col("slices")).cast("int"), F.lit(0))
    return rows.join(hot, key, "left").withColumn("slice", slices).drop("slices")


def _fanned(rows: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """``rows`` once for each slice of their key, to join with _sliced() ones."""
    if hot is None:
        return rows.withColumn("slice", F.lit(0))
    slices = F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)
    return rows.join(hot, key, "left").withColumn("slice", F.explode(slices)).drop("slices")


def _texts(docs: DataFrame, reps: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, body) of the needed nodes, from one document of each."""
    chosen = materialise(reps.join(needed, "node", "left_semi").select("node", "_id"), "near-needed")
    rows = docs.select(_id(), _node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    found = rows.join(_small(chosen), ["_id", "node"], "left_semi")
    return materialise(found.groupBy("node").agg(F.any_value("body").alias("body")), "near-texts")


_SIMILAR = "a binary, b binary, shared long, united long"


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """_SIMILAR, with a < b: the exact overlap of distinct pairs. Of a pair, the text with more partners
    is sent once to each lot of _PER_SALT of them, so a pivot of many is spread over tasks."""
    pairs = materialise(pairs, "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    lots = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _PER_SALT)
    lots = _small(materialise(lots.select("node", F.ceil(F.col("n") / _PER_SALT).cast("int").alias("lots")), "near-lots"))
    for end in ("a", "b"):
        pairs = pairs.join(lots.select(F.col("node").alias(end), F.col("lots").alias(f"{end}_lots")), end, "left")
    # the end with more partners is ``a``
    swap = F.coalesce("b_lots", F.lit(1)) > F.coalesce("a_lots", F.lit(1))
    most = F.greatest(F.coalesce("a_lots", F.lit(1)), F.coalesce("b_lots", F.lit(1)))
    pairs = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), most.alias("lots"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int")).drop("lots")
    salted = materialise(salted, "near-salted")
    left = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "body")
    right = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "body")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            bodies = _bodies(batch["body"])
            firsts, partners = batch["a"].to_pylist(), batch["b"].to_pylist()
            out = []
            for s in text_slices([len(t) for t in bodies]):
                n = s.stop - s.start
                doc, shingle, times = bags(split_words(bodies[s]), n)
                ends = np.searchsorted(doc, np.arange(n + 1))
                for k in range(n):
                    own = shingle[ends[k] : ends[k + 1]], times[ends[k] : ends[k + 1]]
                    if partners[s.start + k] is None:
                        pivot = own
                        continue
                    _, x, y = np.intersect1d(pivot[0], own[0], assume_unique=True, return_indices=True)
                    shared = int(np.minimum(pivot[1][x], own[1][y]).sum())
                    out.append((firsts[s.start + k], partners[s.start + k], shared, int(pivot[1].sum() + own[1].sum()) - shared))
            a, b, shared, united = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(shared, pa.int64()), pa.array(united, pa.int64())], ["a", "b", "shared", "united"]
            )

    compared = dealt.select("a", "b", "body").mapInArrow(run, _SIMILAR)
    return materialise(compared.select(*_ordered(F.col("a"), F.col("b")), "shared", "united"), "near-compared")


def _linked(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("shared") * _DENOMINATOR >= F.col("united") * _NUMERATOR).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes in links (a, b): the least node that each is connected to.

    Labels are spread over links and then followed (pointer jumping) until they rest, in a number of
    rounds that grows with the logarithm of the longest path. Each round is cut into the shared
    folder.
    """
    both = materialise(links.union(links.select("b", "a")).distinct(), "cc-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    hot = _hot(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b")  # the middles of stars
    both = materialise(_sliced(both, hot, "b", "a"), "cc-sliced")
    while True:
        given = _fanned(labels.withColumnRenamed("node", "b"), hot, "b")
        spread = both.join(given, ["b", "slice"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(spread, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), "label")
        nearer = materialise(nearer, "cc-near")
        large = _hot(nearer.groupBy("next").agg(F.count(F.lit(1)).alias("n")), "next")  # the labels of large components
        jump = _fanned(nearer.select(F.col("node").alias("next"), F.col("next").alias("far")), large, "next")
        met = _sliced(nearer, large, "next", "node").join(jump, ["next", "slice"], "left")
        new = materialise(met.select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "label"), "cc-labels")
        changed = new.filter(F.col("new") != F.col("label")).limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _relabel(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    plain = members.drop("label")
    if labels is None:
        return plain.withColumn("label", F.col("node"))
    return plain.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _id(doc_id: Column | None = None) -> Column:
    """Null ids are one id below all others here."""
    return F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("long"), F.lit(_NO_ID)).alias("_id")


def near_classes(docs: DataFrame) -> DataFrame:
    """(_id, node, class_id, known_id, stays, class_docs) for each row of ``docs``: the least id of
    its class, the least that is not null, and the text that stays with the least id."""
    thin = materialise(docs.select(_id(), _node(F.col("text")).alias("node")), "near-rows")
    reps = thin.groupBy("node").agg(
        F.min("_id").alias("_id"), F.min(F.when(F.col("_id") != _NO_ID, F.col("_id"))).alias("known"), F.count(F.lit(1)).alias("n")
    )
    reps = materialise(reps, "near-nodes")
    bands = materialise(_bands(docs), "near-bands").select("node", F.explode("bands").alias("bucket"))
    shared = materialise(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    # buckets only shrink from here on, so the slices of the first count hold for all rounds
    hot = _hot(shared, "bucket")
    members = _sliced(bands, hot, "bucket", "node").join(_fanned(shared.select("bucket"), hot, "bucket"), ["bucket", "slice"])
    members = materialise(members, "near-members")
    links = done = None
    labels = None
    for k in range(PIVOT_ROUNDS + 1):
        now = materialise(_relabel(members, labels), "near-labelled")
        mixed = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("bucket")
        # buckets that are one component already ask for nothing more
        members = materialise(now.join(_fanned(mixed, hot, "bucket"), ["bucket", "slice"], "left_semi"), "near-members")
        pairs = _pivot_pairs(members, hot, k) if k < PIVOT_ROUNDS else _remaining_pairs(docs, reps, members, hot, done)
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near-asked")
        if not pairs.limit(1).count():
            if k < PIVOT_ROUNDS and members.limit(1).count():
                continue  # the same pivots as before; other pairs of these buckets are still to come
            break
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        compared = _compare(pairs, _texts(docs, reps, ends))
        done = compared if done is None else done.unionByName(compared)
        links = _linked(done)
        labels = components(links)
    nodes = _relabel(reps, labels)
    # sums per component, then back to nodes and rows
    classes = nodes.groupBy("label").agg(
        F.min(F.struct("_id", "node")).alias("least"), F.min("known").alias("known_id"), F.sum("n").alias("class_docs")
    )
    placed = nodes.select("node", "label").join(classes, "label").select(
        "node", F.col("least._id").alias("class_id"), F.col("least.node").alias("stays"), "known_id", "class_docs"
    )
    return thin.join(materialise(placed, "near-classes"), "node")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _pivot_pairs(members: DataFrame, hot: DataFrame | None, turn: int) -> DataFrame:
    """Distinct pairs of each bucket's pivot with its members of other components. Which member is
    the pivot changes with the turn."""
    pivots = members.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("p"))
    met = members.join(_fanned(pivots, hot, "bucket"), ["bucket", "slice"]).filter(F.col("label") != F.col("p.label"))
    return met.select(*_ordered(F.col("node"), F.col("p.node"))).distinct()


def _class_counts(texts: DataFrame) -> DataFrame:
    """(node, total, classes): how many shingles a text has, in all and in each of CLASSES classes
    of shingle hashes. Two texts share at most the sum of the lesser counts. Texts that have over
    32,767 in some class have no classes, and are then never ruled out by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = _bodies(batch["body"])
            for s in text_slices([len(t) for t in bodies]):
                n = s.stop - s.start
                doc, shingle, times = bags(split_words(bodies[s]), n)
                cell = doc * CLASSES + ((shingle >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int64)
                counts = np.bincount(cell, times, minlength=n * CLASSES).reshape(n, CLASSES)
                lists = [c.astype(np.int16) if c.max() <= 32767 else None for c in counts]
                total = pa.array(counts.sum(1).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch["node"].slice(s.start, n), total, pa.array(lists, pa.list_(pa.int16()))], ["node", "total", "classes"])

    return texts.mapInArrow(run, "node binary, total long, classes array<smallint>")


def _remaining_pairs(docs: DataFrame, reps: DataFrame, members: DataFrame, hot: DataFrame | None, done: DataFrame) -> DataFrame:
    """Distinct pairs in a bucket of different components, one of them not the bucket's largest, but
    for those that cannot be links.

    Each member's distance to the first turn's pivot is known if it was compared; a difference of
    more than a link allows rules a pair out. So do class counts (_class_counts) that leave too
    little to share. Both bounds are exact, and are tested before a pair becomes a row.
    """
    pivots = members.groupBy("bucket").agg(F.min_by("node", F.struct(F.xxhash64("node", F.lit(0)), "node")).alias("pivot"))
    away = done.select("a", "b", (1 - F.col("shared") / F.col("united")).alias("away"))
    told = members.join(_fanned(pivots, hot, "bucket"), ["bucket", "slice"]).withColumns({"a": F.least("node", "pivot"), "b": F.greatest("node", "pivot")})
    told = told.join(away, ["a", "b"], "left").select("bucket", "slice", "node", "label", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("away")).alias("away"))
    counts = _class_counts(_texts(docs, reps, members.select("node").distinct()))
    told = materialise(told.join(counts, "node"), "near-told")
    parts = told.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    small = told.join(_fanned(largest, hot, "bucket"), ["bucket", "slice"]).filter(F.col("label") != F.col("largest")).select(
        "bucket", F.col("node").alias("u"), F.col("label").alias("u_label"), F.col("away").alias("u_away"),
        F.col("total").alias("u_total"), F.col("classes").alias("u_classes"), "largest",
    )
    most = F.aggregate(F.zip_with("classes", "u_classes", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b.cast("int"))
    enough = most * (_DENOMINATOR + _NUMERATOR) >= (F.col("total") + F.col("u_total")) * _NUMERATOR
    possible = F.coalesce(F.abs(F.col("u_away") - F.col("away")) <= _FAR + 1e-9, F.lit(True)) & F.coalesce(enough, F.lit(True))
    once = (F.col("label") == F.col("largest")) | (F.col("u") < F.col("node"))  # two small ones meet once
    met = _fanned(small, hot, "bucket").join(told, ["bucket", "slice"]).filter((F.col("label") != F.col("u_label")) & once & possible)
    return met.select(*_ordered(F.col("u"), F.col("node"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_docs, kept), a row for each row of ``docs``.

    Equal texts are one class, and so are texts linked by a similarity of 0.8 or more, directly or
    through others; class_id is the least doc_id in it and kept is true for one doc_id of each
    class (in each of its rows, if it repeats with the same text). Null texts count as empty; texts
    without a word are only like equal ones; texts of any length are compared whole. Rows without a
    doc_id take part; a class of nothing else has a null class_id. Other columns are not read; an
    empty table gives an empty one.
    """
    null = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    found = near_classes(docs)
    stays = (F.col("_id") == F.col("class_id")) & (F.col("node") == F.col("stays"))
    return found.select(null("_id").alias("doc_id"), F.coalesce("known_id", null("class_id")).alias("class_id"), "class_docs", stays.alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns whatever their names: of each class the
    one with the least doc_id, nulls first (on a tie the least text; of rows repeated in both, one).
    Null and empty texts, long ones and empty tables go as in near_duplicates()."""
    found = near_classes(docs).filter((F.col("_id") == F.col("class_id")) & (F.col("node") == F.col("stays")))
    keyed = packed(docs).select("row", _id(F.col("row.doc_id")), _node(F.col("row.text")).alias("node"))
    kept = keyed.join(materialise(found.select("_id", "node"), "near-stays"), ["_id", "node"], "left_semi")
    return kept.dropDuplicates(["_id", "node"]).select("row.*")
