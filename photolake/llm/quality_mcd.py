"""Quality rules by robust multivariate outliers.

Each text is reduced to counts, the counts to a transformed vector, and the vectors of each language
and source to a minimum-covariance-determinant estimate; a text goes if its Mahalanobis distance
passes a chi-square quantile.

Vectors. Four statistics of a text's words, none of which a single odd word can move far: the mean
and the deviation of the logarithm of their length, the share of words that hold anything but
letters, and the chance that two of their bytes are alike; shares as square roots. Before that, each text is given ``PRIOR_WORDS`` words at its language's averages (medians over
its texts, which outliers do not move), so that short texts do not stand out by chance.

Estimates. Concentration steps run as aggregations over all vectors at once: distances under the
current estimates, the h-quantile of each group, new means and scatters of the rows within it, from
two deterministic starts, until the determinants rest; the smaller determinant counts, and one
reweighting step follows. Equal vectors of a group count once, so that copies cannot make up the
scatter. The scatter is regularised (Boudt et al., 2020): a group of n vectors gets its own by
n / (n + ``PRIOR_ROWS``) and its language's by the rest, a language likewise its own and the
quartile spreads of all rows; means and averages are drawn the same way. So groups of every size follow one rule
that is continuous in n. Only sums ever leave a group's rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, packed
from .words import Words, hash_spans, split_words, text_slices

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Sums over a text's words that the vector is made of.
SUMS = ("log_length", "log_length_sq", "odd_words", "alike_bytes")
_STATS_SCHEMA = ", ".join([*(f"{c} long" for c in STATS), *(f"{c} double" for c in SUMS)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

PRIOR_WORDS = 100
PRIOR_ROWS = 40
KEEP_SHARE = 0.75  # of a group that the estimate rests on
QUANTILE = 0.999
#: A guard against steps without end, and no part of the method: steps end when determinants rest (on
#: documents of 0.5 GB after 6 for languages and 6 for sources), and the guard warns if it is met.
STEPS = 100
_RESTS = 1e-3  # change of a log determinant; quantiles of large groups are exact to 1e-4
_TINY = 1e-3  # numerical guard: the least spread of all rows that a feature is taken to have
_BROADCAST_GROUPS = 100_000
_P = 4


def count_stats(w: Words, texts: int) -> pd.DataFrame:
    """STATS and SUMS of each text of a batch."""

    def before(marks: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))

    inside = np.cumsum(np.bincount(w.start, minlength=len(w.x) + 1) - np.bincount(w.end, minlength=len(w.x) + 1))[:-1] > 0
    points, others = before((w.x & 0xC0) != 0x80), before(~_LETTER[w.x])
    symbols = before(_SYMBOL[w.x])
    length = points[w.end] - points[w.start]
    logs = np.log(length)
    odd = others[w.end] > others[w.start]
    n = np.bincount(w.doc, minlength=texts)
    # how often two bytes of a text's words are alike
    doc_of = np.repeat(np.arange(texts), np.diff(w.first))[inside]
    bytes_ = np.bincount(doc_of << 8 | w.x[inside], minlength=texts << 8).reshape(texts, 256).astype(float)
    size = bytes_.sum(1)
    alike = (bytes_ * (bytes_ - 1)).sum(1) / np.maximum(size * (size - 1), 1)
    # lines with a word: each newline ends one, and texts end with one
    ends = np.flatnonzero(w.x == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    words_before = np.searchsorted(w.start, np.concatenate((starts, ends)))
    full = words_before[: len(starts)] < words_before[len(starts) :]
    starts, ends = starts[full], ends[full]
    line_doc = np.searchsorted(w.first, starts, "right") - 1
    repeated = _equal_lines(w, line_doc, starts, ends)
    # words in windows of five that come twice: by hash, and those again by their words
    at, h = w.shingles(5)
    again = at[_twice(h ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    if len(again):
        words, place = np.unique(again[:, None] + np.arange(5), return_inverse=True)
        windows = np.column_stack((w.doc[again], w.ids(words)[place.reshape(-1, 5)]))
        _, where, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        again = again[times[where.ravel()] > 1]
    cover = np.zeros(len(w.hash) + 6, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    covered = np.cumsum(cover)[: len(w.hash)] > 0
    add = lambda x: np.bincount(w.doc, x, minlength=texts)
    return pd.DataFrame(
        {
            "n_words": n,
            "word_chars": add(length).astype(np.int64),
            "n_symbols": symbols[w.first[1:] - 1] - symbols[w.first[:-1]],
            "n_dup_lines": np.bincount(repeated, minlength=texts),
            "n_repeat_words": np.bincount(w.doc[covered], minlength=texts),
            "log_length": add(logs),
            "log_length_sq": add(logs * logs),
            "odd_words": add(odd),
            "alike_bytes": n * alike,
        }
    )


def _twice(key: np.ndarray) -> np.ndarray:
    """Whether each key comes more than once."""
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    return times[where] > 1


def _equal_lines(w: Words, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The text of each line that equals an earlier line of it: those alike by hash, compared whole."""
    alike = np.flatnonzero(_twice(hash_spans(w.x, start, end) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    seen: set[tuple[int, bytes]] = set()
    out = []
    for k in alike.tolist():
        line = int(doc[k]), w.x[start[k] : end[k]].tobytes()
        if line in seen:
            out.append(line[0])
        seen.add(line)
    return np.array(out, np.int64)


def text_stats(texts: pd.Series) -> pd.DataFrame:
    parts = []
    for at in range(0, len(texts), 256):  # few texts are bytes at once
        coded = [t.encode() if t is not None else b"" for t in texts.iloc[at : at + 256]]
        parts += [count_stats(split_words(coded[s]), s.stop - s.start) for s in text_slices([len(t) for t in coded], 1 << 19)]
    if parts:
        return pd.concat(parts, ignore_index=True)
    return pd.DataFrame({c: np.zeros(0, np.int64 if c in STATS else float) for c in STATS + SUMS})


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` of text, lang and source with stats, failed and their groups' names."""
    stats = F.pandas_udf(text_stats, _STATS_SCHEMA)
    counted = rows.withColumn("stats", stats(F.coalesce("text", F.lit(""))))
    failed = (F.col("stats.n_words") < 10) | (F.col("stats.n_repeat_words") * 100 > F.col("stats.n_words") * 20)
    return counted.withColumns({"failed": failed, "lang_source": _name("lang", "source"), "language": _name("lang")})


def _name(*columns: str) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in columns))


def _vector() -> Column:
    """From stats and the language's ``averages`` of SUMS over words."""
    n = F.col("stats.n_words") + F.lit(PRIOR_WORDS)
    mean, square, odd, alike = ((F.col("stats")[c] + F.col("averages")[k] * PRIOR_WORDS) / n for k, c in enumerate(SUMS))
    return F.array(mean, *(F.sqrt(F.greatest(x, F.lit(0.0))) for x in (square - mean * mean, odd, alike)))


def chi2_cdf(x: float, p: int) -> float:
    """By the series of the incomplete gamma function."""
    a, x = p / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = 0
    while term > 1e-15 * total:
        k += 1
        term *= x / (a + k)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def consistency(share: float, p: int) -> float:
    """What a covariance of the inner ``share`` of a normal sample has to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


def _distance() -> Column:
    """Squared Mahalanobis distance of ``f`` under mean and precision (row by row)."""
    off = [F.col("f")[k] - F.col("mean")[k] for k in range(_P)]
    terms = [off[i] * off[j] * F.col("precision")[i * _P + j] * (1 if i == j else 2) for i in range(_P) for j in range(i, _P)]
    return reduce(lambda a, b: a + b, terms)


_ESTIMATE = (
    "name string, start int, size long, centre array<double>, target array<double>, "
    "mean array<double>, scatter array<double>, precision array<double>, log_det double, was double"
)


def _estimate(row: dict, mean: np.ndarray, scatter: np.ndarray, start: int, was: float) -> tuple:
    """One row of _ESTIMATE."""
    precision, log_det = np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])
    return (row["name"], start, row["size"], row["centre"], row["target"], mean.tolist(), scatter.ravel().tolist(), precision.ravel().tolist(), log_det, was)


def _starts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From each group's median: with the target's diagonal, and with the target."""
    for pdf in parts:
        out = []
        for row in pdf.to_dict("records"):
            target = np.array(row["target"]).reshape(_P, _P)
            for start, scatter in enumerate((np.diag(np.diag(target)), target)):
                out.append(_estimate(row, np.array(row["median"]), scatter, start, math.inf))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ESTIMATE.split(", ")])


def _concentrated(share: float, shrink_mean: bool = False):
    """Sums of the inner ``share`` of groups to regularised estimates."""
    factor = consistency(share, _P)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                mean = np.array([row[f"s{i}"] for i in range(_P)]) / row["n"]
                own = np.empty((_P, _P))
                for i in range(_P):
                    for j in range(i, _P):
                        own[i, j] = own[j, i] = row[f"s{i}_{j}"] / row["n"] - mean[i] * mean[j]
                weight = row["size"] / (row["size"] + PRIOR_ROWS)
                scatter = weight * factor * own + (1 - weight) * np.array(row["target"]).reshape(_P, _P)
                if shrink_mean:
                    mean = weight * mean + (1 - weight) * np.array(row["centre"])
                out.append(_estimate(row, mean, scatter, row["start"], row["log_det"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ESTIMATE.split(", ")])

    return run


def _sums(rows: DataFrame) -> DataFrame:
    f = [F.col("f")[i] for i in range(_P)]
    carried = [F.any_value(c).alias(c) for c in ("size", "centre", "target", "log_det")]
    sums = [F.sum(f[i]).alias(f"s{i}") for i in range(_P)]
    products = [F.sum(f[i] * f[j]).alias(f"s{i}_{j}") for i in range(_P) for j in range(i, _P)]
    return rows.groupBy("name", "start").agg(F.count(F.lit(1)).alias("n"), *carried, *sums, *products)


def _few(groups: DataFrame) -> DataFrame:
    """Groups are languages times sources; broadcast only if few enough."""
    return F.broadcast(groups) if groups.limit(_BROADCAST_GROUPS + 1).count() <= _BROADCAST_GROUPS else groups


def _estimates(points: DataFrame, targets: DataFrame, steps: int) -> DataFrame:
    """_ESTIMATE for each name of ``points`` (name, f); ``targets`` has a centre and a target for
    each."""
    median = F.array(*[F.percentile_approx(F.col("f")[k], 0.5, 10_000) for k in range(_P)])
    middle = points.groupBy("name").agg(F.count(F.lit(1)).alias("size"), median.alias("median"))
    now = materialise(middle.join(_few(targets), "name").mapInPandas(_starts, _ESTIMATE), "quality-start")
    send = F.broadcast if now.limit(_BROADCAST_GROUPS + 1).count() <= _BROADCAST_GROUPS else lambda groups: groups
    for _ in range(steps):
        near = points.join(send(now.drop("was")), "name").withColumn("d", _distance())
        edge = near.groupBy("name", "start").agg(F.percentile_approx("d", KEEP_SHARE, 10_000).alias("edge"))
        inner = near.join(send(edge), ["name", "start"]).filter(F.col("d") <= F.col("edge"))
        now = materialise(_sums(inner).mapInPandas(_concentrated(KEEP_SHARE), _ESTIMATE), "quality-step")
        moved = now.agg(F.max(F.abs(F.col("log_det") - F.col("was"))).alias("m")).head().m
        if moved is None or moved <= _RESTS:
            break
    else:
        warnings.warn(f"determinants have not come to rest in {steps} steps", stacklevel=2)
    names = [c.split()[0] for c in _ESTIMATE.split(", ")]
    best = now.groupBy("name").agg(F.min_by(F.struct(*names[1:]), F.struct("log_det", "start")).alias("b")).select("name", "b.*")
    near = points.join(send(best.drop("was")), "name").filter(_distance() <= chi2_quantile(0.975, _P))
    return materialise(_sums(near).mapInPandas(_concentrated(0.975, shrink_mean=True), _ESTIMATE), "quality-estimates")


def fit_groups(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """(lang_source, averages, mean, precision) for each language and source of ``docs`` that has
    rows which pass the base rules; only these rows count."""
    return _fit(_vectors(docs), steps)


def _vectors(docs: DataFrame) -> DataFrame:
    return materialise(_counted(docs.select("doc_id", "text", "lang", "source")).drop("text", "lang", "source"), "quality-vectors")


def _fit(vectors: DataFrame, steps: int) -> DataFrame:
    sound = vectors.filter(~F.col("failed"))
    each = [F.percentile_approx(F.col(f"stats.{c}") / F.col("stats.n_words"), 0.5, 10_000) for c in SUMS]
    literal = lambda a: F.array(*map(F.lit, np.ravel(a).tolist()))
    overall = literal([x or 0.0 for x in sound.agg(*each).head()])
    weight = F.count(F.lit(1)) / (F.count(F.lit(1)) + PRIOR_ROWS)
    averages = sound.groupBy("language").agg(F.zip_with(F.array(*each), overall, lambda own, all_: weight * own + (1 - weight) * all_).alias("averages"))
    averages = materialise(averages, "quality-averages")
    made = sound.join(_few(averages), "language").select("language", "lang_source", _vector().alias("f"))
    points = materialise(made.distinct(), "quality-points")
    by_language = materialise(points.select(F.col("language").alias("name"), "f").distinct(), "quality-points")
    # one row: what an empty language would have
    cuts = by_language.agg(*[F.percentile_approx(F.col("f")[k], [0.25, 0.5, 0.75], 10_000).alias(f"q{k}") for k in range(_P)]).head()
    q = np.array([x or [0.0, 0.0, 0.0] for x in cuts])
    spread = np.diag(np.square(np.maximum((q[:, 2] - q[:, 0]) * 0.7413, _TINY)))
    whole = averages.select(F.col("language").alias("name"), literal(q[:, 1]).alias("centre"), literal(spread).alias("target"))
    languages = _estimates(by_language, whole, steps).select(F.col("name").alias("language"), F.col("mean").alias("centre"), F.col("scatter").alias("target"))
    groups = materialise(points.select("language", "lang_source").distinct(), "quality-groups")
    targets = groups.join(_few(languages), "language").select(F.col("lang_source").alias("name"), "centre", "target")
    found = _estimates(points.select(F.col("lang_source").alias("name"), "f"), materialise(targets, "quality-targets"), steps)
    fitted = found.select(F.col("name").alias("lang_source"), "mean", "scatter", "precision").join(groups, "lang_source").join(averages, "language")
    return materialise(fitted.select("lang_source", "averages", "mean", "scatter", "precision"), "quality-fit")


def _verdicts(counted: DataFrame, groups: DataFrame, quantile: float) -> DataFrame:
    """_counted() rows with distance and kept."""
    judged = counted.join(_few(groups), "lang_source", "left").withColumn("f", _vector())
    judged = judged.withColumn("distance", F.sqrt(F.greatest(_distance(), F.lit(0.0))))
    kept = ~F.col("failed") & (F.col("distance") <= math.sqrt(chi2_quantile(quantile, _P)))
    return judged.withColumn("kept", F.coalesce(kept, F.lit(False)))


def judge_documents(docs: DataFrame, quantile: float = QUANTILE, steps: int = STEPS) -> DataFrame:
    """(doc_id, STATS, base_failed, kept, distance), a row for each row of ``docs``.

    Null and empty texts have no words and fail the base rules; texts of any length are counted
    whole. Null languages and sources are groups like any other. Repeated rows get equal verdicts
    and count once in the estimates; so do rows whose vectors tie. Other columns are not read,
    whatever their names. An empty table gives an empty one.
    """
    vectors = _vectors(docs)
    judged = _verdicts(vectors, _fit(vectors, steps), quantile)
    return judged.select("doc_id", *(f"stats.{c}" for c in STATS), F.col("failed").alias("base_failed"), "kept", "distance")


def keep_documents(docs: DataFrame, quantile: float = QUANTILE, steps: int = STEPS) -> DataFrame:
    """The rows of ``docs`` that judge_documents() keeps, with all their columns, whatever their
    names. Repeated rows stay or go together; an empty table gives an empty one. Counts are taken a
    second time, so that texts need no shuffle."""
    groups = fit_groups(docs, steps)
    rows = packed(docs).select("row", "row.text", "row.lang", "row.source")
    return _verdicts(_counted(rows), groups, quantile).filter("kept").select("row.*")
