import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog as cat
from lectern.operators import library as lib
from lectern.operators import timeline as tl
from lectern.operators import validation as val
from lectern.session import scratch_root


def numbers(spark, expr, top=20, **kw):
    df = spark.range(1, top + 1).withColumn("e", F.lit(expr))
    return [r["id"] for r in df.filter(cat.in_ranges(F.col("id"), F.col("e"), **kw)).orderBy("id").collect()]


def test_range_expressions(spark):
    assert numbers(spark, "3, 1-2, x, 2") == [1, 2, 3]
    assert numbers(spark, "5-3") == []
    assert numbers(spark, "5-3", swap_reversed=True) == [3, 4, 5]
    assert numbers(spark, "18-40", swap_reversed=True) == [18, 19, 20]
    assert numbers(spark, "1-2-3,4") == [4]
    assert numbers(spark, " ALL ", top=3) == numbers(spark, "", top=3) == [1, 2, 3]
    assert numbers(spark, "-5,,7") == [7]
    assert numbers(spark, "1-9999999999", top=2) == [1, 2]
    assert cat.strict_ranges("1-3, 7") == [(1, 3), (7, 7)]
    for bad in ("1,x", "", "1-2-3"):
        with pytest.raises(ValueError):
            cat.strict_ranges(bad)


def test_start_times(spark):
    df = spark.createDataFrame([("s", "a", 1, 1.2349), ("s", "b", 2, None), ("s", "c", 3, 2.0)],
                               "story_id string, id string, position int, duration double")
    got = tl.sequential_starts(df, ["position", "id"], "position").orderBy("position").collect()
    assert [r["start_time_ms"] for r in got] == [0, 1434, 1634]
    items = spark.createDataFrame([("s", 0, 0, 1.5), ("s", 0, 2000, 0.5)],
                                  "story_id string, track int, start_time_ms bigint, duration double")
    target = spark.createDataFrame([("s", 0), ("s", 9)], "story_id string, track int")
    assert {r["track"]: r["next_start_ms"] for r in tl.append_position(items, target).collect()} == {0: 2700, 9: 0}


ITEM = ("id string, story_id string, start_time_ms bigint, trim_start_ms bigint, trim_end_ms bigint, duration double, "
        "volume double")


def test_clip_split(spark):
    df = spark.createDataFrame([("i", "s", 1000, 500, 700, 10.0, 0.5)], ITEM)
    got = {r["part"]: r for r in tl.split_clips(df, F.lit(3000)).collect()}
    assert (got["left"]["trim_start_ms"], got["left"]["trim_end_ms"]) == (500, 6500)
    right = got["right"]
    assert (right["start_time_ms"], right["trim_start_ms"], right["trim_end_ms"], right["volume"]) == (4000, 3500, 700, 0.5)
    for at in (0, 8800, 9000):
        assert [r["part"] for r in tl.split_clips(df, F.lit(at)).collect()] == ["whole"]


def test_interval_lookup_finds_short_and_very_long_items(spark):
    items = spark.createDataFrame(
        [("a", "s", 0, 0, 0, 0.001, 1.0), ("b", "s", 10, 0, 0, 500_000.0, 1.0), ("c", "s", 4000, 100, 100, 0.3, 1.0),
         ("d", "s", 7999, 0, 0, 0.002, 1.0), ("e", "s", 5, 1000, 1000, 1.5, 1.0)], ITEM)
    probes = spark.createDataFrame([("s", t) for t in (0, 1, 10, 4000, 4099, 4100, 7999, 8000, 8001, 500_000_009,
                                                       500_000_010)], "story_id string, at_ms bigint")
    got = {}
    for r in tl.active_at(items, probes).collect():
        got.setdefault(r["at_ms"], []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {
        0: ["a"], 10: ["b"], 4000: ["b", "c"], 4099: ["b", "c"], 4100: ["b"], 7999: ["b", "d"], 8000: ["b", "d"],
        8001: ["b"], 500_000_009: ["b"]}


def test_import_names(spark):
    taken = spark.createDataFrame([("A",), ("A (1)",), ("A (3)",), ("B (1)",)], "name string")
    wanted = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "C"), (6, "A")], "ord bigint, name string")
    got = {r["ord"]: r["name"] for r in lib.import_names(wanted, taken).collect()}
    assert got == {1: "A (2)", 2: "A (4)", 3: "B", 4: "B (2)", 5: "C", 6: "A (5)"}


def test_name_rules(spark):
    df = spark.createDataFrame([(1, "Anna"), (2, "anna"), (3, "Anna")], "id bigint, name string")
    assert [(r["name"], r["holders"]) for r in lib.duplicate_names(df).collect()] == [("Anna", 2)]
    wanted = spark.createDataFrame([(1, "anna"), (2, "anna")], "id bigint, name string")
    assert [r["id"] for r in lib.name_conflicts(wanted, df).collect()] == [1]


def test_page_limits(spark):
    df = spark.range(10)
    for limit, offset in ((0, 0), (201, 0), (5, -1)):
        with pytest.raises(ValueError):
            lib.page(df, [F.asc("id")], limit, offset)
    assert [r["id"] for r in lib.page(df, [F.desc("id")], 3, 2).collect()] == [7, 6, 5]


def test_renumbering_is_a_permutation(spark):
    segs = spark.createDataFrame([("p", n, "R", f"t{n}") for n in range(1, 8)],
                                 "project string, num int, profile_id string, text string")
    cuts = spark.createDataFrame([("p", 2, "a", "b"), ("p", 7, "c", "d")], "project string, num int, part1 string, part2 string")
    got = cat.split_segments(segs, cuts).orderBy("num").collect()
    assert [r["num"] for r in got] == list(range(1, 10))
    assert [r["text"] for r in got] == ["t1", "a", "b", "t3", "t4", "t5", "t6", "c", "d"]


def test_chain_errors(spark):
    kind = "array<struct<type:string,enabled:boolean,params:map<string,string>>>"
    rows = [
        [("gain", True, {"gain_db": "3"})], [("gain", True, {"gain_db": "50"})], [("gain", True, {"x": "1"})],
        [("gain", True, {"gain_db": '"3"'})], [("delay", True, {}), ("robot", True, {})], [], [("gain", True, {"gain_db": "-40"})],
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    got = [r["e"] for r in df.select("i", val.chain_error(F.col("c")).alias("e")).orderBy("i").collect()]
    assert got == [
        None, "Effect 'gain' at index 0: param 'gain_db' must be between -40.0 and 40.0 (got 50)",
        "Effect 'gain' at index 0: unknown param 'x'", "Effect 'gain' at index 0: param 'gain_db' must be a number",
        "Unknown effect type 'robot' at index 1", None, None]


def test_engine_rule(spark):
    df = spark.createDataFrame([("preset", "kokoro", "v", None, "kokoro"), ("preset", "kokoro", "v", None, "qwen"),
                                ("designed", None, None, " ", "qwen"), (None, None, None, None, "kokoro")],
                               "k string, e string, v string, p string, q string")
    got = [r[0] for r in df.select(val.engine_error(*[F.col(c) for c in "kevpq"])).collect()]
    assert got == [None, "other engine", "missing design prompt", "engine cannot clone"]


def test_shared_folder_setting_is_read(spark):
    assert scratch_root(spark) == scratch_root(spark)
