"""Seeking pages against plain offsets; files written, read back, and read again after changes."""

import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import library as lib
from lectern.operators import timeline as tl
from lectern.sources import projects as pj

ORDER = [("day", True), ("id", False)]


@pytest.fixture
def rows(spark):
    return spark.range(0, 500).select("id", F.date_add(F.lit("2024-01-01"), (F.col("id") * 7 % 13).cast("int")).alias("day"))


def test_pages_by_seek_equal_pages_by_offset(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or the small ranges become one
    want = [tuple(r) for r in rows.orderBy(F.desc("day"), "id").collect()]
    for offset in (0, 1, 249, 499, 500):
        assert [tuple(r) for r in lib.page_at(rows, ORDER, 7, offset).collect()] == want[offset:offset + 7]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for at in (0, 38, 498, 499):
        key = (want[at][1], want[at][0])
        assert [tuple(r) for r in lib.page_after(rows, ORDER, key, 7).collect()] == want[at + 1:at + 8]
    with pytest.raises(ValueError):
        lib.page_after(rows, ORDER, key, 0)


def test_the_first_bound_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "r"))
    import datetime as dt

    page = lib.page_after(spark.read.parquet(str(tmp_path / "r")), ORDER, (dt.date(2024, 1, 5), 7), 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(day,2024-01-05)" in plan.split("PushedFilters")[1]


def test_reorder_needs_exactly_the_items(spark):
    items = spark.createDataFrame([(s, i, 1.0) for s in (1, 2, 3, 4) for i in "abc"], "story_id int, id string, duration double")
    asked = [(1, "c", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "b", 2), (3, "a", 1), (3, "b", 2), (3, "b", 3),
             (4, "a", 1), (4, "b", 2), (4, "c", 3), (4, "d", 4), (5, "a", 1)]
    got = tl.reorder(items, spark.createDataFrame(asked, "story_id int, id string, ord int"), 0)
    assert sorted((r["story_id"], r["id"], r["start_time_ms"]) for r in got.collect()) == [
        (1, "a", 1000), (1, "b", 2000), (1, "c", 0)]


def test_only_changed_files_are_opened(spark, tmp_path):
    root = str(tmp_path / "f")
    files = lambda names, body: spark.createDataFrame([(n, body) for n in names], "path string, content string")
    assert pj.write_files(files(["a/1.json", "b/c/2.json", "3.json"], '{"text": "old"}'), root) == 3
    read = lambda: spark.read.schema("text string").option("recursiveFileLookup", True).json(root)
    first = pj.modified_since(read(), None)
    assert first.count() == 3
    since = first.agg(F.max("mtime").alias("m")).first()["m"]
    time.sleep(1.1)
    pj.write_files(files(["a/1.json", "4.json"], '{"text": "new"}'), "file:" + root)
    late = pj.modified_since(read(), F.lit(since)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["text"]) for r in late) == [("1.json", "new"), ("4.json", "new")]
