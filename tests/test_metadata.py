"""Tags as maps."""

from photolake.operators import metadata


def test_repeated_tags_have_one_value(spark):
    rows = [(1, "a", "z"), (1, "a", "b"), (1, "a", "b"), (1, "c", None), (1, "d", "2.5"), (2, "c", None)]
    got = metadata.tag_maps(spark.createDataFrame(rows, "photo_id long, tag string, value string")).collect()
    assert len(got) == 1 and {k: tuple(v) for k, v in got[0].tags.items()} == {"a": ("b", None), "d": ("2.5", 2.5)}
