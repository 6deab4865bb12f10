"""Queries whose whole job is more than their SQL on small tables shows."""

import duckdb
import pytest

from photolake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_line_is_a_source(spark):
    rows = QUERIES["k2_attach_all_sources"](spark, SF).collect()
    assert sum(r.sources for r in rows) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", ["m9_segments", "m10_m14_scrub_jpeg"])
def test_whole_texts_in_jpegs(spark, tmp_path, name):
    """Texts at a segment's limit, over several and empty, with letters cut between segments."""
    texts = ["", "a" * 65533, "a" * 65534, "é" * 100_000, "b" * 65533 * 3, "short"]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLE_SQL[name]).fetchall())
    if name == "m9_segments":
        bodies = {k: [r[3] - 4 for r in got if r[0] == k and r[2] == "E1"] for k in range(6)}
        assert bodies == {0: [0], 1: [65533], 2: [65533, 1], 3: [65533, 65533, 65533, 3401], 4: [], 5: [5]}
    else:
        assert {r[0]: r[2] for r in got} == {k: 0 if k == 4 else sum(4 + len(t[s : s + 65533]) for t in [t.encode()] for s in range(0, len(t) or 1, 65533)) + 13 for k, t in enumerate(texts)}


def test_spaces_of_every_layout_tile_the_canvas(spark):
    """Each space is the size of its gaps away from its neighbours, for every collage and layout."""
    found = {}
    for r in QUERIES["c2_collage_spaces"](spark, SF).collect():
        found.setdefault(r.collage_id, []).append(r)
    orders = [r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    assert set(found) == {k for k in orders if k % 7 or k % 11 > 3}
    for k, spaces in found.items():
        assert len(spaces) == [2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 9][k % 11]
        g = (400 + k % 3000) * (k % 5) / 100
        wide, high = spaces[0].canvas_w - g, spaces[0].canvas_h - g
        # with a gap to the right and below, spaces cover the canvas without its first gaps
        assert abs(sum((s.w + g) * (s.h + g) for s in spaces) - wide * high) < 1e-3 * wide
        assert all(s.x >= g - 1e-5 and s.y >= g - 1e-5 and s.x + s.w <= wide + 1e-5 and s.y + s.h <= high + 1e-5 for s in spaces)
        for s in spaces:
            for t in spaces:
                assert s.slot_no == t.slot_no or max(abs(2 * (s.x - t.x) + s.w - t.w) - s.w - t.w, abs(2 * (s.y - t.y) + s.h - t.h) - s.h - t.h) >= 2 * g - 1e-4


def test_names_of_whole_texts_meet_the_limits(spark):
    rows = QUERIES["p8_p9_safe_names"](spark, SF).collect()
    assert max(len(r.clean) for r in rows) == 120 and max(len(r.safe) for r in rows) == 200 and max(len(r.slug) for r in rows) > 200
