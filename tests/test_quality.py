from pyspark.sql import functions as F

from lectern.operators import quality as qc


def col(spark, values, fn, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_buckets_and_rounding(spark):
    assert col(spark, [0.5, 0.51, 10.0, 10.01], qc.duration_bucket) == ["0.5", "1", "10", "15"]
    assert col(spark, [0.296, 0.125, 0.135], qc.half_up_percent) == [30, 13, 14]
    assert col(spark, [0.125, 0.135, 0.5], qc.half_even_percent) == [12, 14, 50]


def test_nearest_slice_tie_takes_the_earlier(spark):
    labels = [("0.5", 0.5), ("1", 1.0), ("2", 2.0), ("3", 3.0), ("5", 5.0), ("full", 8.0)]
    slices = spark.createDataFrame([("v", i, l, s, [1.0, 0.0]) for i, (l, s) in enumerate(labels)],
                                   "voice string, ord int, slice string, ref_sec double, emb array<float>")
    takes = spark.createDataFrame([("v", 1.5, [3.0, 4.0]), ("v", 0.2, [1.0, 0.0]), ("x", 2.0, [1.0, 0.0])],
                                  "voice string, duration double, emb array<float>")
    got = {(r["voice"], r["duration"]): r for r in qc.score_takes(takes, slices).collect()}
    assert got["v", 1.5]["matched_ref_sec"] == 1.0 and round(got["v", 1.5]["score"], 9) == 0.6
    assert got["v", 1.5]["low_confidence"] is False
    assert got["v", 0.2]["reason"] == "too_short" and got["v", 0.2]["score"] is None
    assert got["x", 2.0]["reason"] == "no_voiceprint"


def test_anomaly_vectors(spark):
    rows = [(1, 0.296, None, "Known"), (2, 0.1, "forced", "Known"), (3, 0.9, "force_refused", "Known"),
            (4, None, None, "Known"), (5, 0.1, None, "Other"), (6, 0.294, None, "Known")]
    segs = spark.createDataFrame(
        [("p", n, "R", v, s, 0.4, st, True) for n, s, st, v in rows],
        "project string, num int, profile_id string, generated_voice string, qc_score double, qc_duration double, "
        "qc_status string, has_audio boolean")
    by_voice = spark.createDataFrame([("Known", "0.5", 30.0)], "voice_name string, bucket string, pct double")
    by_role = spark.createDataFrame([], "project string, role string, bucket string, pct double")
    assert sorted(r["num"] for r in qc.anomalies(segs, by_voice, by_role).collect()) == [3, 4, 6]


def choose(spark, rows, slot_mode=False):
    data = [(k, i, ok, s, float(t)) for i, (k, ok, s, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, attempt int, ok boolean, score double, threshold double")
    return {r["k"]: r for r in qc.choose_takes(df, ["k"], slot_mode).collect()}


def test_selection_vectors(spark):
    rows = [("a", True, 0.40, 70), ("a", True, 0.72, 70), ("a", True, 0.90, 70),
            ("b", True, 0.40, 70), ("b", True, 0.55, 70), ("b", True, 0.55, 70),
            ("c", True, 0.50, 70), ("c", False, None, 70), ("c", True, 0.99, 70),
            ("d", True, None, 70), ("d", True, 0.99, 70)]
    got = choose(spark, rows)
    assert (got["a"]["attempt"], got["a"]["passed"], got["a"]["tries"]) == (1, True, 2)
    assert (got["b"]["attempt"], got["b"]["passed"]) == (4, False)
    assert (got["c"]["attempt"], got["c"]["tries"]) == (6, 2)
    assert got["d"]["attempt"] is None
    assert choose(spark, rows, slot_mode=True)["d"]["attempt"] == 9


def test_only_twenty_attempts_count(spark):
    rows = [("k", True, 0.10 + i / 100, 70) for i in range(20)] + [("k", True, 0.99, 70)]
    got = choose(spark, rows)["k"]
    assert (got["attempt"], got["passed"], got["tries"]) == (19, False, 20)
