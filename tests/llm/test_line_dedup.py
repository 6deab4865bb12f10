import hashlib
from collections import defaultdict

import numpy as np

from photolake.llm import line_dedup as ld

LONG = "  The Quick brown fox jumps over the lazy dog again and again \t"


def brute(rows, min_docs=5):
    key = lambda x: x.strip("\x20\t\n\x0b\x0c\r").translate(str.maketrans(ld.UPPER, ld.LOWER))
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 40:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    base = [(k, f"{LONG}\nown line {k}\n{LONG.upper()}\n\n" + (f"é{'x' * 39}\n" if k % 2 else "")) for k in range(12)]
    return [*base, (5, LONG), (20, None), (21, ""), (22, "\n"), (None, LONG), (23, "y" * 200_000), (24, "four docs only, which is one fewer than needed\n" * 2)] + [
        (30 + k, "four docs only, which is one fewer than needed") for k in range(3)
    ]


def result(df):
    import pyspark.sql.functions as F

    got = df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    return sorted(map(tuple, got), key=str)


SCHEMA = "doc_id long, text string"


def test_drop_lines_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], SCHEMA + ", n_lines int")
    assert result(ld.drop_lines(df)) == brute(rows())


def test_insert_then_delete_comes_back(spark):
    old = spark.createDataFrame(rows(), SCHEMA)
    more = [(100 + k, "four docs only, which is one fewer than needed") for k in range(2)]
    state = ld.insert_documents(ld.build_state(old), spark.createDataFrame(more, SCHEMA))
    both = spark.createDataFrame(rows() + more, SCHEMA)
    assert result(ld.drop_lines(both, state)) == brute(rows() + more)
    state = ld.delete_documents(state, spark.createDataFrame(more, SCHEMA))
    assert result(ld.drop_lines(old, state)) == brute(rows())


def test_empty(spark):
    assert ld.drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cuckoo_filter_has_no_false_negatives_and_deletes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (20_000, 2)).astype(np.uint64)
    filter_ = ld.build_filter(keys)
    assert filter_.contains(keys).all()
    other = rng.integers(0, 2**63, (20_000, 2)).astype(np.uint64)
    assert filter_.contains(other).mean() < 0.001
    filter_.delete(keys[:10_000])
    back = ld.CuckooFilter.loads(filter_.dumps())
    assert back.contains(keys[10_000:]).all() and back.contains(keys[:10_000]).mean() < 0.01
