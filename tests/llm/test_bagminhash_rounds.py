"""A bucket whose pivot is the same text in every turn."""

from pyspark.sql import functions as F

from photolake.llm import bagminhash as bm


def test_pairs_without_the_pivot_are_compared(spark, monkeypatch):
    near = [" ".join(f"w{i}" for i in range(150)), " ".join([*(f"w{i}" for i in range(149)), "other"])]
    others = spark.range(200).select(F.concat(F.lit("nothing like them "), "id").alias("text"))
    both = spark.createDataFrame([(t,) for t in near], "text string")
    turns = [F.xxhash64("node", F.lit(k)).alias(f"t{k}") for k in range(bm.PIVOT_ROUNDS)]
    hashes = lambda df: df.select("text", bm._node(F.col("text")).alias("node")).select("text", *turns).collect()
    least = [min(r[1 + k] for r in hashes(both)) for k in range(bm.PIVOT_ROUNDS)]
    pivot = next(r.text for r in hashes(others) if all(r[1 + k] < least[k] for k in range(bm.PIVOT_ROUNDS)))
    monkeypatch.setattr(bm, "_bands", lambda docs: docs.select(bm._node(F.col("text")).alias("node")).distinct().withColumn("bands", F.array(F.lit(1).cast("long"))))
    docs = spark.createDataFrame(list(enumerate([pivot, *near])), "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.class_docs) for r in bm.near_duplicates(docs).collect())
    assert got == [(0, 0, 1), (1, 1, 2), (2, 1, 2)]
