"""Runs and batches without a window over a whole group."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from photolake.functions import cut
from photolake.operators import articles, inventory, redaction


def test_runs_over_edges_of_partitions(spark):
    rng = random.Random(3)
    rows = [(lang, k, rng.choice(["a", None, "b"]) if lang != "one" else "a") for lang in ("de", "en", "one", None) for k in range(300)]
    df = spark.createDataFrame(rows, "lang string, ord long, grp string").repartition(7)
    want = []
    for lang in ("de", "en", "one", None):
        for run, (grp, own) in enumerate(groupby((r for r in rows if r[0] == lang), lambda r: r[2]), 1):
            own = list(own)
            want.append((lang, run, grp, own[0][1], len(own)))
    found = articles.group_runs(df)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert "windowspecdefinition(lang" not in found._jdf.queryExecution().optimizedPlan().toString().split("Window [")[-1]


def test_batches_are_told_without_a_window(spark):
    files = spark.createDataFrame([(1, "a.jpg", "", 5, 1), (2, "a.txt", "", 5, 1), (3, "b.png", "", 0, 1), (4, "c.txt", "", 5, 2), (5, "d.txt", "", 5, None)], "photo_id long, name string, mime string, bytes long, batch_id long")
    told = inventory.classify_files(files)
    assert {r.photo_id: r.reason for r in told.collect()} == {1: None, 2: "dropped", 3: "The file is empty", 4: "Not an image file", 5: "Not an image file"}
    assert "Window" not in told._jdf.queryExecution().optimizedPlan().toString() and told.columns == [*files.columns, "is_image", "reason"]


def test_faces_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """All faces were sorted in as many tasks as there are shuffle partitions."""
    monkeypatch.setattr(cut, "TASK_ROWS", 100, raising=False)
    faces = spark.range(3000).selectExpr("id % 500 AS photo_id", "id AS det_id", "double(id * 7 % 90) AS x", "double(id * 13 % 70) AS y", "9D AS width", "8D AS height")
    found = redaction.number_faces(faces, spark.range(500).selectExpr("id AS photo_id", "80 AS width", "60 AS height"))
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 20 and max(r["count"] for r in tasks) < 400
    rows = [(k % 500, min(59, k * 13 % 70), min(79, k * 7 % 90)) for k in range(3000)]
    want = {f: [(y, x) for _, y, x in sorted(r for r in rows if r[0] == f)] for f in range(500)}
    got = {f: [] for f in range(500)}
    for r in sorted(found.collect(), key=lambda r: (r.photo_id, r.face_no)):
        assert r.face_id == f"face-{r.face_no}" and r.face_no == len(got[r.photo_id])
        got[r.photo_id].append((r.y, r.x))
    assert got == want
