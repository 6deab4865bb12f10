"""Mixing sources to target weights by fitting a subset of documents to each source's budget.

Documents are counted by (source, exact length). What a source takes beyond whole repeats is a
budget of words; most of it goes to the lengths in proportion to their counts, and a bounded
knapsack over the counts that are left fills the rest, to the word where some subset does. Which
documents of a length are taken goes by a seeded hash, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, packed, quoted

WEIGHTS = (5.0, 2.0, 1.0)
WORD = "[^\\x20\\x09-\\x0D]+"
_BUCKET = 4096  # documents of one length that are ranked together
_BROADCAST_ROWS = 100_000  # of at most 80 bytes and a source's name


def fill_targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = 2.0) -> list[float]:
    """Share ``budget`` by weight; what passes ``most`` times a size is shared again by weight."""
    targets = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(budget)
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = left * weights[k] / total
            break
        for k in over:
            targets[k] = most * float(sizes[k])
        left -= sum(targets[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return targets


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, at most ``counts``, for the largest sum up to ``budget``.

    Reachable sums are the bits of one integer. A length is offered in lots of 1, 2, 4, ...; the lot
    that first reaches a sum is kept for it, so the way back uses no lot twice.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    mask, reach = (1 << (budget + 1)) - 1, 1
    lots: list[tuple[int, int]] = []
    first = np.full(budget + 1, -1, np.int32)
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left = min(count, budget // length) if length > 0 else 0
        lot = 1
        while left > 0 and not reach >> budget & 1:
            n = min(lot, left)
            new = (reach << (n * length)) & mask & ~reach
            if new:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little"))
                first[at] = len(lots)
                lots.append((k, n))
                reach |= new
            left -= n
            lot *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    while at:
        k, n = lots[first[at]]
        taken[k] += n
        at -= n * lengths[k]
    return taken


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int = 1 << 16, widest: int = 1 << 24) -> list[int]:
    """Documents to take of each length, within its count, for a sum near ``budget`` from below.

    All but ``window`` words go to the lengths in proportion; the knapsack fits what is left of the
    budget. Where that is not met to the word, the window grows until it is, or holds the budget, when
    the sum is the largest there is, or is ``widest``. Words are counted in the lengths' common
    divisor.
    """
    unit = math.gcd(*(a for a, b in zip(lengths, counts, strict=True) if b > 0 and a > 0)) or 1
    lengths = [a // unit for a in lengths]
    budget = max(0, min(budget // unit, sum(a * b for a, b in zip(lengths, counts, strict=True))))
    best, most = [0] * len(lengths), 0
    while most < budget:
        taken = _fit(lengths, counts, budget, window)
        met = sum(n * length for n, length in zip(taken, lengths, strict=True))
        if met > most:
            best, most = taken, met
        if window >= min(budget, widest):
            break
        window = min(8 * window, widest)
    return best


def _fit(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int) -> list[int]:
    """By proportion, long ones first, what rounding leaves being carried on; then by the knapsack."""
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    taken = [0] * len(lengths)
    spread, carry = max(0, budget - window), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if lengths[k] <= 0:
            continue
        # shares are in units of 1 / total words, so that all of this is exact
        share = counts[k] * lengths[k] * spread + carry
        taken[k] = min(counts[k], share // (lengths[k] * total))
        carry = share - taken[k] * lengths[k] * total
    left = budget - sum(n * length for n, length in zip(taken, lengths, strict=True))
    order = sorted((k for k in range(len(lengths)) if counts[k] > taken[k] and lengths[k] > 0), key=lambda k: -lengths[k])
    for k, n in zip(order, knapsack([lengths[k] for k in order], [counts[k] - taken[k] for k in order], left), strict=True):
        taken[k] += n
    return taken


def _source_key(source: Column) -> Column:
    """A key that tells null from every string."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _seeded(seed: int) -> Column:
    """63 bits that order the documents of a length."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row.doc_id", "row.text"), 1)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """(row, _key, _size, _rank) of each row."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return packed(docs).select("row", _source_key(F.col("row.source")).alias("_key"), size.alias("_size"), _seeded(seed).alias("_rank"))


_PLAN = "_key string, _size long, n long, repeats long, extra long, source_size long, target double"


def _plan(thin: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """_PLAN rows with _last: documents up to that rank are taken once more than ``repeats``."""
    spark = thin.sparkSession
    counts = materialise(thin.groupBy("_key", "_size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    # one row for each source
    totals = counts.groupBy("_key").agg(F.sum(F.col("_size") * F.col("n")).alias("size")).collect()
    totals = sorted(totals, key=lambda r: (r._key == "n", r._key))
    sizes = [r["size"] for r in totals]
    targets = fill_targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share * sum(sizes), most)
    goal = {r._key: (size, target) for r, size, target in zip(totals, sizes, targets, strict=True)}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's counts by length: as many rows as it has lengths, not documents."""
        pdf = pdf.sort_values("_size")
        size, target = goal[pdf["_key"].iloc[0]]
        repeats = int(target // size) if size else 0
        extra = fit_counts(pdf["_size"].tolist(), pdf["n"].tolist(), int(target - repeats * size + 0.5))
        return pdf.assign(repeats=repeats, extra=extra, source_size=size, target=target)

    plan = materialise(counts.groupBy("_key").applyInPandas(fit, _PLAN), "mix-plan")
    # the rank of the extra-th document of each length, by way of buckets of about _BUCKET ranks
    some = plan.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    lots = F.ceil(F.col("n") / F.lit(_BUCKET)).cast("long")
    ranked = _join_plan(thin, some.select("_key", "_size", "n", "extra")).withColumn(
        "lot", F.shiftright(F.shiftright("_rank", 32) * lots, 31)
    )
    per_lot = ranked.groupBy("_key", "_size", "extra", "lot").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("_key", "_size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        per_lot.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
        .filter((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("here")))
        .select("_key", "_size", "lot", (F.col("extra") - F.col("before")).alias("nth"))
    )
    edge = materialise(edge, "mix-edge")
    in_lot = Window.partitionBy("_key", "_size").orderBy("_rank")
    last = (
        _join_plan(ranked.select("_key", "_size", "lot", "_rank"), edge, ["_key", "_size", "lot"])
        .withColumn("at", F.row_number().over(in_lot))
        .filter(F.col("at") == F.col("nth"))
        .select("_key", "_size", F.col("_rank").alias("found"))
    )
    all_or_none = F.when(F.col("extra") >= F.col("n"), F.lit(2**63 - 1)).otherwise(F.lit(-1))
    return materialise(plan.join(last, ["_key", "_size"], "left").withColumn("_last", F.coalesce("found", all_or_none)).drop("found"), "mix-last")


def _join_plan(rows: DataFrame, plan: DataFrame, on: Sequence[str] = ("_key", "_size")) -> DataFrame:
    """Broadcast the plan if its row count, one for each source and length, is within a bound."""
    small = plan.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS
    return rows.join(F.broadcast(plan) if small else plan, list(on))


def _planned(docs: DataFrame, share: float, weights: Sequence[float], most: float, seed: int) -> DataFrame:
    """(row, size, source_size, target, copies)."""
    rest = _sized(docs, seed)
    thin = materialise(rest.select("_key", "_size", "_rank"), "mix-sizes")
    plan = _plan(thin, share, weights, most).select("_key", "_size", "repeats", "source_size", "target", "_last")
    copies = F.col("repeats") + (F.col("_rank") <= F.col("_last")).cast("long")
    return _join_plan(rest, plan).select("row", F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))


def plan_mix(
    docs: DataFrame, share: float = 1.5, weights: Sequence[float] = WEIGHTS, most: float = 2.0, seed: int = 0
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``most`` rounded up).

    Sources are taken by code point, null last, with ``weights`` over and over. Null and empty texts
    have size 0; a text of any length is counted whole. Rows that repeat in doc_id and text share
    one rank and so one decision, and so do rows whose ranks tie. Columns of docs with those four
    names are replaced, all others kept; an empty table gives an empty one.
    """
    names = ("size", "source_size", "target", "copies")
    kept = [F.col(f"row.{quoted(c)}") for c in docs.columns if c.lower() not in names]
    return _planned(docs, share, weights, most, seed).select(*kept, *names)


def mix_documents(
    docs: DataFrame, share: float = 1.5, weights: Sequence[float] = WEIGHTS, most: float = 2.0, seed: int = 0
) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns whatever their names, as often as
    plan_mix() takes it. Nulls, ties, repeats and empty tables go as there."""
    taken = _planned(docs, share, weights, most, seed).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
