from pyspark.sql import functions as F

from photolake.llm import jump_shard as js


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * js.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_shards_equal_the_published_loop(spark):
    keys = [0, 1, 2, 7, 10**12, 2**62 + 12345, -1, -(2**63), 2**63 - 1, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 50):
        for r in df.select("k", js.jump_shards(F.col("k"), n).alias("s")).collect():
            assert (r.s.shard, r.s.grown) == (jump(r.k, n), jump(r.k, n + 1))


def test_rows(spark):
    rows = [(k, f"text {k}", 3) for k in range(500)] + [(5, None, 1), (5, None, 1), (None, "", 0), (None, "é", 0)]
    got = js.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 16).collect()
    assert len(got) == len(rows)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert sorted(r.size for r in got if r.doc_id is None) == [1, 3]


def test_empty(spark):
    assert js.shard_rows(spark.createDataFrame([], "doc_id long, text string"), 16).count() == 0
