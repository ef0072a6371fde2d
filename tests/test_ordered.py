import random

from pyspark.sql import functions as F

from lectern.operators import ordered as od


def test_scans_match_a_plain_walk_whatever_the_block_size(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.choice([None, 1, 2, 5])) for k in ("a", "b") for p in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, p int, v bigint")
    step = lambda before, now: F.coalesce(now, F.lit(10)) - F.coalesce(before["v"], F.lit(3))
    opens = lambda before, now: before.isNull() | (now == 2)
    for size in (1, 7, 1000, None):
        block = od.block_of(F.col("p"), size) if size else None
        got = od.ordered_scan(df, ["k"], ["p"], block, [
            od.running_steps(F.col("v"), step, "st"), od.kept_since(F.col("v"), opens, F.col("p"), "op"),
            od.running_sum(F.col("v"), "s"), od.sum_before(F.col("v"), "sb"), od.previous(F.col("v"), "pv"),
            od.following(F.col("v"), "nx"), od.last_known(F.col("v"), "lk"), od.last_known_before(F.col("v"), "lb"),
            od.next_known_after(F.col("v"), "na")])
        seen = {(r["k"], r["p"]): r for r in got.collect()}
        for key in ("a", "b"):
            order = sorted((p, v) for k, p, v in rows if k == key)
            values = [v for _, v in order]
            for i, (p, v) in enumerate(order):
                r = seen[key, p]
                past, upto = values[:i], values[: i + 1]
                known = lambda xs: next((x for x in xs if x is not None), None)
                has = any(x is not None for x in upto)
                assert r["s"] == (sum(x or 0 for x in upto) if has else None)
                assert r["sb"] == sum(x or 0 for x in past)
                assert r["pv"] == (values[i - 1] if i else None)
                assert r["nx"] == (values[i + 1] if i + 1 < len(values) else None)
                assert r["lk"] == known(reversed(upto)) and r["lb"] == known(reversed(past))
                assert r["na"] == known(values[i + 1:])
                steps = [(10 if b is None else b) - (3 if a is None else a) for a, b in zip([None, *values], upto)]
                assert r["st"] == sum(steps)
                assert r["op"] == max(q for j, (q, x) in enumerate(order[:i + 1]) if j == 0 or x == 2)


def test_islands_cover_the_input(spark):
    values = [None, None, 1, 1, 2, 1, 1, None]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, p int, v int")
    for block in (od.block_of(F.col("p"), 3), None):
        got = od.islands(df, ["k"], ["p"], block, F.col("v"), "g").orderBy("p").collect()
        assert [r["g"] for r in got] == [1, 1, 2, 2, 3, 4, 4, 5]


def test_runs_read_their_input_twice(spark, tmp_path):
    spark.range(100).selectExpr("'k' AS k", "id AS p", "id % 7 AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = od.merged_runs(df, ["k"], ["p"], od.block_of(F.col("p"), 30), F.col("v"), {"n": F.count("*")})
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_equal_ranges_need_no_block(spark):
    """One moment may hold any number of rows: ranges are dealt by rank, not by time."""
    df = spark.range(0, 20_000).selectExpr("id", "1 AS ts").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or the small ranges become one
    dealt = od.dealt_by_range(df, [], ["ts", "id"], "part")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000
    got = od.ordered_scan(df, [], ["ts", "id"], None, [od.running_sum(F.lit(1).cast("bigint"), "n")])
    assert got.filter("n <> id + 1").count() == 0


def test_one_hot_key_is_spread_over_blocks(spark):
    df = spark.range(0, 5000).select(F.lit("hot").alias("k"), F.col("id").alias("p"))
    got = od.row_numbers(df, ["k"], ["p"], od.block_of(F.col("p"), 100), "n")
    assert got.filter("n <> p + 1").count() == 0 and got.count() == 5000
