"""Project files: segments, takes, audio headers, JSON maps, markup — and the sinks that write them."""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.functions.rows import numbered_rows
from lectern.operators.catalog import version_number
from lectern.operators.ordered import block_of, row_numbers
from lectern.session import written

SEGMENT_SCHEMA = ("profile_id string, text string, generated_voice string, qc_score double, qc_duration double, "
                  "read int, qc_status string")
#: Small files: Spark's reader puts some 32 into a split, and a task takes up to so many splits.
SPLITS_PER_TASK = 16
TASKS_PER_CORE = 4
_PROJECT = r"([^/]+)/(?:tts|book|audio)/[^/]+$"


def _project_of(path: Column) -> Column:
    """The folder's name; `%` signs are decoded, a plus sign is a plus sign."""
    return F.url_decode(F.replace(F.regexp_extract(path, _PROJECT, 1), F.lit("+"), F.lit("%2B")))


def _with_place(df: DataFrame, path: Column) -> DataFrame:
    """Project, file name and position from a path; the position is the rank of the name, not its digits."""
    placed = df.withColumns({
        "project": _project_of(path), "file": F.regexp_extract(path, r"([^/]+)$", 1)})
    # The first signs of a name never decrease along the names: `seg00` holds a thousand five-digit ones.
    ranked = row_numbers(placed, ["project"], ["file"], F.substring("file", 1, 5), "num")
    return ranked.withColumn("num", F.col("num").cast("int"))


def _read_once(spark: SparkSession, reader: DataFrameReader, root: str, folder: str, files: str, name: str) -> DataFrame:
    """The files `root/*/<folder>/<files>`, opened once: their rows and paths, written to the shared folder.

    Folders are listed, not single files, and one task opens as many small files as it takes to keep tasks few.
    """
    raw = reader.option("pathGlobFilter", files).load(f"{root}/*/{folder}").withColumn("__path", F.input_file_name())
    direct = raw.filter(F.col("__path").rlike(f"/{folder}/[^/]+$"))
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, raw.rdd.getNumPartitions() // SPLITS_PER_TASK)
    return written(direct.coalesce(tasks), name)


def read_segments(spark: SparkSession, root: str) -> DataFrame:
    """`root/<project>/tts/seg*.json`; a file that is not valid JSON gives a row without fields."""
    reader = spark.read.format("json").schema(SEGMENT_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
    raw = _read_once(spark, reader, root, "tts", "seg*.json", "segments-read")
    return _with_place(raw, F.col("__path")).drop("__path")


def read_legacy_segments(spark: SparkSession, root: str) -> DataFrame:
    """`root/<project>/book/seg*.txt`, spoken by the narrator."""
    raw = _read_once(spark, spark.read.format("text").option("wholetext", True), root, "book", "seg*.txt", "legacy-read")
    placed = _with_place(raw, F.col("__path"))
    return placed.select("project", "file", "num", F.lit("Narrator").alias("profile_id"),
                         tx.strip(F.col("value")).alias("text"))


def project_segments(json_segments: DataFrame, legacy: DataFrame) -> DataFrame:
    """JSON segments, and text segments only for projects that have no JSON."""
    old = legacy.join(json_segments.select("project").distinct(), "project", "left_anti")
    return json_segments.unionByName(old, allowMissingColumns=True)


def write_files(files: DataFrame, root: str) -> int:
    """Write each `(path, content)` as the file `root/path` and return their number.

    The tasks write, through the store that `root` names; a task that runs again writes the same files again.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri("file://" + root[5:] if root.startswith("file:/") and root[5:7] != "//" else root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = posixpath.join(base, path)
                if posixpath.dirname(target) not in made:
                    made.add(posixpath.dirname(target))
                    store.create_dir(posixpath.dirname(target), recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(content)
            yield batch.select(["path"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(put, "path string").count()


def modified_since(files: DataFrame, since: Column | None) -> DataFrame:
    """Rows of files changed after `since`, with their path and time; NULL: all.

    The condition is on the files' own data, so that Spark drops the others when it lists them and never opens them.
    """
    rows = files if since is None else files.filter(F.col("_metadata.file_modification_time") > since)
    return rows.select("*", F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_modification_time").alias("mtime"))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths, times and sizes; the contents are not read because the column is not selected.

    Spark's file scan leaves out files of zero bytes.
    """
    return spark.read.format("binaryFile").load(pattern).select(
        "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def takes_from_paths(files: DataFrame) -> DataFrame:
    """`…/<project>/audio/segNNNNN.wav` and `segNNNNN_vK.wav` → (project, num, version, k); other names are ignored."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    number = F.regexp_extract(name, r"^seg(\d{5})(?:_v[^.]*)?\.wav$", 1).try_cast("int")
    version = F.regexp_extract(name, r"^seg\d{5}_(v[^.]*)\.wav$", 1)
    rows = files.withColumns({
        "project": F.coalesce(F.try_url_decode(F.replace(F.regexp_extract("path", _PROJECT, 1), F.lit("+"), F.lit("%2B"))),
                              F.regexp_extract("path", _PROJECT, 1)), "num": number,
        "version": F.when(version == "", "main").otherwise(version)})
    return rows.filter("num IS NOT NULL").withColumn("k", version_number(F.col("version")))


def _riff_seconds(head: bytes | None) -> float | None:
    """Seconds of audio a RIFF/WAVE header announces."""
    if head is None or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, bytes_per_second = 12, None
    while at + 8 <= len(head):
        name, size = struct.unpack_from("<4sI", head, at)
        if name == b"fmt " and at + 24 <= len(head):
            channels, rate = struct.unpack_from("<HI", head, at + 10)
            (bits,) = struct.unpack_from("<H", head, at + 22)
            bytes_per_second = rate * channels * (bits // 8)
        if name == b"data":
            return size / bytes_per_second if bytes_per_second else None
        at += 8 + size
    return None


@F.pandas_udf(T.DoubleType())
def _wav_seconds(heads: pd.Series) -> pd.Series:
    return heads.map(_riff_seconds).astype("Float64")


def audio_durations(files: DataFrame, content: str = "content", head_bytes: int = 65536) -> DataFrame:
    """Duration from the header; NULL when it is no RIFF/WAVE file.

    The head is enough for nearly all files.  Where long chunks stand before
    the sound, the whole content follows; all other rows send NULL instead.
    """
    head = files.withColumn("duration", _wav_seconds(F.substring(content, 1, head_bytes)))
    deep = F.col("duration").isNull() & (F.length(content) > head_bytes) & (
        F.substring(content, 1, 4) == F.lit(b"RIFF"))
    whole = head.withColumn("__rest", F.when(deep, F.col(content))).withColumn("__whole", _wav_seconds("__rest"))
    return whole.withColumn("duration", F.coalesce("duration", "__whole")).drop(content, "__rest", "__whole")


def threshold_rows(df: DataFrame, column: str) -> DataFrame:
    """JSON `{voice: {bucket: percent}}` → (voice_id, bucket, pct)."""
    outer = df.select(F.explode_outer(F.from_json(column, "map<string, map<string, double>>")).alias("voice_id", "m"))
    return outer.select("voice_id", F.explode_outer("m").alias("bucket", "pct")).filter("bucket IS NOT NULL")


def name_rows(df: DataFrame, column: str) -> DataFrame:
    """JSON `{name: id}` → (name, voice_id)."""
    return df.select(F.explode_outer(F.from_json(column, "map<string, string>")).alias("name", "voice_id")).filter(
        "name IS NOT NULL")


# ---------------------------------------------------------------- markup

#: Named references: the standard table, with a plain blank for the one that doesn't break.
_NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


_REFERENCE = r"#\d{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]*;"


def _signs(text: Column) -> Column:
    """Map of the character references that occur, without their `&`, to what they stand for; each is looked up once."""
    names = F.create_map(*[F.lit(x) for pair in sorted(_NAMED.items()) for x in pair])

    def sign(r: Column) -> Column:
        number = F.when(r.rlike("^#[0-9]"), F.substring(r, 2, F.length(r) - 2).try_cast("int")).when(
            r.startswith("#"), F.conv(F.substring(r, 3, F.length(r) - 3), 16, 10).try_cast("int"))
        return F.coalesce(
            F.when(number.between(1, 1114111), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")),
            F.try_element_at(names, F.substring(r, 1, F.length(r) - 1)))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"&({_REFERENCE})"), F.lit(1)))
    pairs = F.transform(found, lambda r: F.struct(r.alias("r"), sign(r).alias("s")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["s"].isNotNull()))


def _decoded(c: Column, signs: Column | None = None) -> Column:
    """Character references by number, decimal or hexadecimal, and by name; what is none stays as written.

    `signs` is the map of the page that the text is a part of, else that of the text.
    """
    signs = _signs(c) if signs is None else signs

    def put(p: Column, i: Column) -> Column:
        end = F.instr(p, ";")
        found = F.try_element_at(signs, F.substring(p, F.lit(1), end))
        return F.when(i == 0, p).otherwise(F.coalesce(
            F.concat(found, F.substring(p, end + 1, F.length(p))), F.concat(F.lit("&"), p)))

    return F.when(c.contains("&"), F.array_join(F.transform(F.split(c, "&"), put), "")).otherwise(c)


def _text_pieces(html: Column, signs: Column) -> Column:
    """Text between tags, decoded."""
    pieces = F.split(F.regexp_replace(html, r"(?s)<[^>]*>", "\x01"), "\x01")
    return F.transform(pieces, lambda p: _decoded(p, signs))


def markup_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Page → its headings as `=== heading ===`, then its whole text (headings included) on one line."""
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>|<![^>]*>", "\x01")
    clean = pages.select(key, body.alias("__b"))

    def blocks(page: Column) -> Column:
        signs = page["signs"]
        found = F.regexp_extract_all(page["b"], F.lit(r"(?is)<(h[1-4])\b[^>]*>(.*?)</\1\s*>"), F.lit(2))
        heads = F.transform(found, lambda h: F.array_join(F.filter(F.transform(
            _text_pieces(h, signs), tx.strip), lambda p: p != ""), " "))
        titles = F.transform(F.filter(heads, lambda h: h != ""), lambda h: F.struct(
            F.lit("TITLE").alias("kind"), F.concat(F.lit("=== "), h, F.lit(" ===")).alias("text")))
        # no reference holds a blank, so the pieces may be put together first
        whole = tx.squeeze(_decoded(F.regexp_replace(page["b"], r"(?s)<[^>]*>|\x01", " "), signs))
        text = F.filter(F.array(F.struct(F.lit("TEXT").alias("kind"), whole.alias("text"))), lambda b: b["text"] != "")
        return F.concat(titles, text)

    # a lambda's argument is evaluated once, however often the body names it
    page = F.array(F.struct(F.col("__b").alias("b"), _signs(F.col("__b")).alias("signs")))
    rows = numbered_rows(clean, [key], F.transform(page, blocks)[0], "block_no", "b")
    return rows.select(key, "block_no", "b.*")


# ---------------------------------------------------------------- sinks


#: Folders of a sink.  It is part of the stored form: a project stays in its folder, so a new number needs a new store.
SINK_FOLDERS = 64


def _replace_projects(rows: DataFrame, path: str, block: Column) -> None:
    """Replace the stored rows of exactly the projects in `rows`; projects are dealt to `SINK_FOLDERS` folders by hash.

    Folders and files do not grow with the number of projects.  A folder that gets rows is written anew with the rows of its
    other projects.  All that goes into a store that is there is first written to the scratch folder: the store is not read
    while it changes, and after a failure between two folders their rows are still in the scratch folder.
    """
    dealt = rows.withColumn("project_folder", F.pmod(F.xxhash64(F.col("project").cast("string")), F.lit(SINK_FOLDERS)).cast("int"))
    try:
        stored = rows.sparkSession.read.parquet(path)
    except AnalysisException as why:
        if why.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        dealt = written(dealt, "sink")
        given = dealt.select("project", "project_folder").distinct()
        own = given.select(F.col("project").alias("__project"))
        kept = stored.join(given.select("project_folder").distinct(), "project_folder", "left_semi").join(
            own, stored["project"].eqNullSafe(own["__project"]), "left_anti")
        dealt = written(dealt.unionByName(kept, allowMissingColumns=True), "sink")
    dealt.repartition("project_folder", block).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("project_folder").parquet(path)


def write_segments(segments: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Replace the stored segments of exactly the projects in `segments`.

    Rows are spread by folder of projects and stretch of numbers, so small
    projects share a file and a very large one is written by several tasks.
    Each segment gets its zero-padded id from its number.
    """
    named = segments.withColumn("segment_id", F.concat(F.lit("seg"), F.lpad(F.col("num").cast("string"), 5, "0")))
    _replace_projects(named, path, block_of(F.col("num"), rows_per_file))


def write_chunks(chunks: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Replace the stored chunks of the projects in `chunks` and return the catalogue of these projects."""
    _replace_projects(chunks, path, block_of(F.col("idx"), rows_per_file))
    stored = chunks.sparkSession.read.parquet(path).join(chunks.select("project").distinct(), "project", "left_semi")
    return stored.select("project", "idx", F.length("text").alias("chars"), tx.preview(F.col("text")).alias("preview"))
