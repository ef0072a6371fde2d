import json
import struct

from pyspark.sql import functions as F

from lectern.sources import projects as pj


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_segments_legacy_and_takes(spark, tmp_path):
    for n, body in ((3, {"profile_id": "ANNA", "text": "un", "qc_score": 0.5}), (7, {"text": "deux", "read": 0})):
        put(tmp_path / f"new/tts/seg{n:05d}.json", json.dumps(body, indent=2))
    put(tmp_path / "new/tts/seg00009.json", "{not json")
    put(tmp_path / "new/book/seg00001.txt", "ignored")
    put(tmp_path / "old/book/seg00001.txt", " vieux\n")
    put(tmp_path / "old/book/seg00004.txt", "texte")
    root = str(tmp_path)
    got = pj.project_segments(pj.read_segments(spark, root), pj.read_legacy_segments(spark, root)).orderBy(
        "project", "num").collect()
    assert [(r["project"], r["num"], r["profile_id"], r["text"]) for r in got] == [
        ("new", 1, "ANNA", "un"), ("new", 2, None, "deux"), ("new", 3, None, None), ("old", 1, "Narrator", "vieux"),
        ("old", 2, "Narrator", "texte")]
    for name in ("seg00001.wav", "seg00001_v10.wav", "seg00001_v2.wav", "seg00001_vx.wav", "segxx.wav", "other.wav"):
        put(tmp_path / "new/audio" / name, b"x")
    takes = pj.takes_from_paths(pj.list_files(spark, f"{root}/*/audio/*.wav")).orderBy("k", "version").collect()
    assert [(r["project"], r["num"], r["version"], r["k"]) for r in takes] == [
        ("new", 1, "main", 0), ("new", 1, "vx", 0), ("new", 1, "v2", 2), ("new", 1, "v10", 10)]


def wav(rate, channels, bits, size, extra=b""):
    fmt = struct.pack("<HHIIHH", 1, channels, rate, 0, 0, bits)
    return (b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + fmt + b"data"
            + struct.pack("<I", size))


def test_audio_headers(spark, tmp_path):
    junk = b"LIST" + struct.pack("<I", 6) + b"abcdef"
    for name, data in (("a", wav(16000, 1, 16, 64000)), ("b", wav(24000, 2, 16, 96000, junk)), ("c", b"ID3 no"),
                       ("d", b"RIFF0000WAVE")):
        put(tmp_path / f"{name}.wav", data)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.wav").select(
        F.regexp_extract("path", r"(\w)\.wav$", 1).alias("n"), "content")
    got = {r["n"]: r["duration"] for r in pj.audio_durations(files).collect()}
    assert got == {"a": 2.0, "b": 1.0, "c": None, "d": None}


def test_markup(spark):
    html = ("<html><head><style>p{}</style><title>T &amp; U</title></head><body><!-- no --><h1>Un <b>deux</b></h1>"
            "<script>var x='<h2>no</h2>'</script><p>l&#233;ger&nbsp; &lt;b&gt;</p><h5>x</h5><h2> </h2></body></html>")
    got = pj.markup_blocks(spark.createDataFrame([(1, html)], "i int, h string"), "i", "h").orderBy("block_no").collect()
    assert [(r["kind"], r["text"]) for r in got] == [
        ("TITLE", "=== Un deux ==="), ("TEXT", "T & U Un deux léger <b> x")]


def test_sink_replaces_only_its_projects(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "project string, num int, text string")
    pj.write_segments(rows, path)
    pj.write_segments(spark.createDataFrame([("a", 1, "new")], rows.schema), path)
    got = spark.read.parquet(path).orderBy("project", "num").collect()
    assert [(r["project"], r["segment_id"], r["text"]) for r in got] == [("a", "seg00001", "new"), ("b", "seg00001", "z")]


def test_sink_does_not_grow_folders_with_projects(spark, tmp_path):
    path, folders = str(tmp_path / "out"), lambda: len([p for p in (tmp_path / "out").iterdir() if p.is_dir()])
    rows = spark.range(300).selectExpr("IF(id = 7, NULL, id) AS project", "CAST(id % 3 AS INT) AS num", "concat('t', id) AS text")
    pj.write_segments(rows, path)
    assert folders() <= pj.SINK_FOLDERS
    again = rows.filter("project % 50 = 0 OR project IS NULL").withColumn("text", F.lit("new"))
    pj.write_segments(again, path)
    pj.write_segments(again.filter("project = 0").withColumn("num", F.lit(9)), path)
    assert folders() <= pj.SINK_FOLDERS
    got = {r["project"]: (r["segment_id"], r["text"]) for r in spark.read.parquet(path).collect()}
    want = {i: (f"seg{i % 3:05d}", "new" if i % 50 == 0 else f"t{i}") for i in range(300) if i != 7}
    assert got == want | {None: ("seg00001", "new"), 0: ("seg00009", "new")} and spark.read.parquet(path).count() == 300


def test_json_maps(spark):
    df = spark.createDataFrame([('{"v1": {"0.5": 19, "1": 25.5}, "v2": {}}',), ("oops",)], "j string")
    got = pj.threshold_rows(df, "j").orderBy("bucket").collect()
    assert [(r["voice_id"], r["bucket"], r["pct"]) for r in got] == [("v1", "0.5", 19.0), ("v1", "1", 25.5)]


def test_segment_files_are_opened_once(spark, tmp_path):
    for p in ("a", "b"):
        put(tmp_path / f"{p}/tts/seg00001.json", '{"text": "x"}')
        put(tmp_path / f"{p}/tts/old/seg00002.json", '{"text": "deeper"}')
        put(tmp_path / f"{p}/tts/note.json", '{"text": "other"}')
        put(tmp_path / f"{p}/book/seg00001.txt", "y")
    for rows in (pj.read_segments(spark, str(tmp_path)), pj.read_legacy_segments(spark, str(tmp_path))):
        assert not [f for f in rows.inputFiles() if f.endswith((".json", ".txt"))]
        assert [(r["project"], r["file"][:8], r["num"]) for r in rows.orderBy("project").collect()] == [
            ("a", "seg00001", 1), ("b", "seg00001", 1)]
