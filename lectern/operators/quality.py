"""Voice quality control: scores against reference slices, thresholds, anomalies and take selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine, norm
from lectern.operators.catalog import role_filter, segment_voice, voice_ids
from lectern.operators.joins import optional_join

# Duration limits, reference slices, buckets and default thresholds.
FLOOR_SEC = 0.3
LOW_CONFIDENCE_SEC = 1.5
SLICE_SECS = (0.5, 1.0, 2.0, 3.0, 5.0)
SLICE_LABELS = ("0.5", "1", "2", "3", "5", "full")
BUCKET_EDGES = ("0.5", "1", "2", "3", "4", "5", "6", "7", "10")
LAST_BUCKET = "15"
DEFAULT_THRESHOLDS = {
    "0.5": 19.0, "1": 25.0, "2": 33.0, "3": 43.0, "4": 47.0, "5": 53.0, "6": 60.0, "7": 65.0, "10": 70.0,
}
ACCEPT_AT = 0.70
MAX_ATTEMPTS = 20


def duration_bucket(seconds: Column) -> Column:
    bucket = F.lit(LAST_BUCKET)
    for edge in reversed(BUCKET_EDGES):
        bucket = F.when(seconds <= float(edge), F.lit(edge)).otherwise(bucket)
    return bucket


def half_up_percent(score: Column) -> Column:
    """Percent as the screen rounds it: halves go up."""
    return F.floor(score * 100 + 0.5).cast("bigint")


def half_even_percent(score: Column) -> Column:
    """Percent as the generation loop rounds it: halves go to the even number."""
    return F.bround(score * 100, 0).cast("bigint")


def eligible_slices(samples: DataFrame, key: str, duration: str) -> DataFrame:
    """Reference slices a sample is long enough for, plus the whole sample."""
    fits = F.filter(F.array(*map(F.lit, SLICE_SECS)), lambda s: s <= F.col(duration))
    whole = F.array(F.struct(F.lit("full").alias("slice"), F.col(duration).alias("ref_sec")))
    cut = F.transform(fits, lambda s: F.struct(
        F.regexp_replace(s.cast("string"), r"\.0$", "").alias("slice"), s.alias("ref_sec")))
    return samples.select(key, F.explode(F.concat(cut, whole)).alias("s")).select(key, "s.*")


def voiceprints(slices: DataFrame) -> DataFrame:
    """One row per voice with its slices in index order (`prints`).

    A repeated label keeps the first by `ord`, before the shuffle; a voice has
    then one slice for each of the few labels it was cut with, whatever they are.
    """
    entry = F.struct("ord", "slice", "ref_sec", "emb", norm(F.col("emb")).alias("norm"))
    firsts = slices.groupBy("voice", "slice").agg(F.min_by(entry, "ord").alias("entry"))
    return firsts.groupBy("voice").agg(F.array_sort(F.collect_list("entry")).alias("prints"))


def score_takes(takes: DataFrame, slices: DataFrame) -> DataFrame:
    """Score takes `(voice, duration, emb, …)` against the slice of matching length.

    Below the floor there is no score (`too_short`); a voice without a print
    gives no score (`no_voiceprint`).
    """
    joined = takes.join(voiceprints(slices), "voice", "left")
    gap = F.transform("prints", lambda p: F.struct(F.abs(p["ref_sec"] - F.col("duration")).alias("g"), p["ord"]))
    best = F.array_min(gap)
    chosen = F.get(F.filter("prints", lambda p: p["ord"] == F.col("__best.ord")), F.lit(0))
    matched = joined.withColumn("__best", best).withColumn("__print", chosen)
    short = F.col("duration") < FLOOR_SEC
    return matched.select(
        *takes.columns,
        F.when(~short, cosine(F.col("emb"), F.col("__print.emb"), F.col("__print.norm"))).alias("score"),
        F.when(~short, F.col("__print.ref_sec")).alias("matched_ref_sec"),
        F.when(~short & F.col("__print").isNotNull(), F.col("duration") < LOW_CONFIDENCE_SEC).alias("low_confidence"),
        F.when(short, "too_short").when(F.col("__print").isNull(), "no_voiceprint").alias("reason"),
    )


def rescore(
    segments: DataFrame, audio: DataFrame, mapping: DataFrame, voices: DataFrame, slices: DataFrame,
    role: str | None = None,
) -> DataFrame:
    """Score the audio `(project, num, duration, emb)` of every segment anew, also of those already rated.

    One row per segment with audio, of one role or of all: the voice really
    used, and the score and duration to write.  A segment whose voice has no
    print keeps what it has (`rescored` is false); a clip too short to judge
    is written without a score.  `slices` are named by voice id.  Segments
    without a voice are dealt over filler keys.
    """
    wanted = segments.withColumn("profile_id", F.trim("profile_id"))
    chosen = role_filter(wanted, role and role.strip()).filter("has_audio").select(
        "project", "num", "profile_id", "generated_voice", "qc_score", "qc_duration")
    named = voice_ids(segment_voice(chosen, mapping), voices)
    filler = F.concat(F.lit("\x00"), F.xxhash64("project", "num").cast("string"))
    takes = named.join(audio.select("project", "num", "duration", "emb"), ["project", "num"]).withColumn(
        "voice", F.coalesce("voice_id", filler))
    scored = score_takes(takes, slices)
    fresh = F.col("voice_id").isNotNull() & (F.coalesce("reason", F.lit("")) != "no_voiceprint")
    return scored.select(
        "project", "num", "voice_name", "voice_id", fresh.alias("rescored"),
        F.when(fresh, F.col("score")).otherwise(F.col("qc_score")).alias("qc_score"),
        F.when(fresh, F.col("duration")).otherwise(F.col("qc_duration")).alias("qc_duration"))


def fixed_verdict(score: Column) -> Column:
    return F.when(score >= ACCEPT_AT, "accepted").when(score.isNotNull(), "refused")


# ---------------------------------------------------------------- thresholds


def with_default_thresholds(store: DataFrame, voices: DataFrame) -> DataFrame:
    """Every known voice gets each missing bucket from the default series; the last bucket stays open."""
    defaults = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(p).alias("__default"))
                                   for b, p in DEFAULT_THRESHOLDS.items()]))
    wanted = voices.filter("voice_id IS NOT NULL").select("voice_id").distinct().select(
        "voice_id", defaults.alias("d")).select("voice_id", "d.*")
    return wanted.join(store, ["voice_id", "bucket"], "full_outer").select(
        "voice_id", "bucket", F.coalesce("pct", "__default").alias("pct"))


def segment_thresholds(segments: DataFrame, mapping: DataFrame, voices: DataFrame, store: DataFrame) -> DataFrame:
    """Threshold of each segment: its actual voice, else its role's voice; NULL when anything is unknown."""
    mapped = mapping.select("project", F.col("role").alias("__role"), F.col("voice").alias("__mapped"))
    named = (
        segments.withColumn("__role", F.replace("profile_id", F.lit("’"), F.lit("'")))
        .join(mapped, ["project", "__role"], "left")
        .withColumn("voice_name", F.coalesce(F.when(F.col("generated_voice") != "", F.col("generated_voice")),
                                             "__mapped"))
        .withColumn("bucket", F.when(F.col("qc_duration").isNotNull(), duration_bucket(F.col("qc_duration"))))
    )
    ids = voice_ids(named.select("voice_name").filter("voice_name IS NOT NULL").distinct(), voices)
    found = optional_join(named, ids, ["voice_name"], ["project", "num"])
    return optional_join(found, store, ["voice_id", "bucket"], ["project", "num"]).drop("__role", "__mapped")


def role_thresholds(mapping: DataFrame, voices: DataFrame, store: DataFrame) -> DataFrame:
    """Thresholds shown per role; voices without an entry are left out."""
    ids = voice_ids(mapping.select(F.col("voice").alias("voice_name")).distinct(), voices)
    return mapping.withColumnRenamed("voice", "voice_name").join(ids, "voice_name").join(store, "voice_id").select(
        "project", "role", "bucket", "pct")


def adopt_role_thresholds(
    old: DataFrame, mapping: DataFrame, voices: DataFrame, store: DataFrame
) -> DataFrame:
    """Copy per-role thresholds `(project, role, bucket, pct)` to voices that have none yet.

    The first role (by project, role) that names a voice gives that voice all
    its buckets; a voice already in the store keeps what it has.
    """
    ids = voice_ids(mapping.select(F.col("voice").alias("voice_name")).distinct(), voices)
    owned = mapping.withColumnRenamed("voice", "voice_name").join(
        ids.filter("voice_id IS NOT NULL"), "voice_name").select("project", "role", "voice_id")
    rows = old.join(owned, ["project", "role"]).join(store.select("voice_id").distinct(), "voice_id", "left_anti")
    first = rows.groupBy("voice_id").agg(F.min(F.struct("project", "role")).alias("f")).select("voice_id", "f.*")
    fresh = rows.join(first, ["voice_id", "project", "role"], "left_semi").select("voice_id", "bucket", "pct")
    return store.select("voice_id", "bucket", "pct").unionByName(fresh)


def anomalies(
    segments: DataFrame, voice_thresholds: DataFrame, role_thresholds: DataFrame, role: str | None = None
) -> DataFrame:
    """Segments to look at again.

    A manual refusal is always in, a manual acceptance always out; otherwise a
    segment is in when it has a threshold and no score or a lower score.  The
    role's thresholds are used only when the actual voice has none at all.
    """
    bucket = duration_bucket(F.coalesce("qc_duration", F.lit(0.0)))
    by_voice = voice_thresholds.select(F.col("voice_name").alias("generated_voice"), "bucket",
                                       F.col("pct").alias("__voice_pct"))
    has_voice = by_voice.select("generated_voice", F.lit(True).alias("__has")).distinct()
    by_role = role_thresholds.select("project", F.col("role").alias("profile_id"), "bucket",
                                     F.col("pct").alias("__role_pct"))
    judged = (
        optional_join(
            optional_join(role_filter(segments, role).filter("has_audio").withColumn("bucket", bucket),
                          has_voice, ["generated_voice"], ["project", "num"]),
            by_voice, ["generated_voice", "bucket"], ["project", "num"])
        .join(by_role, ["project", "profile_id", "bucket"], "left")
        .withColumn("threshold", F.when(F.col("__has"), F.col("__voice_pct")).otherwise(F.col("__role_pct")))
    )
    status = F.coalesce("qc_status", F.lit(""))
    below = F.col("qc_score").isNull() | (half_up_percent(F.col("qc_score")) < F.col("threshold"))
    return judged.filter((status == "force_refused") | (
        ~status.isin("forced", "accepted") & F.col("threshold").isNotNull() & below)).drop(
        "__has", "__voice_pct", "__role_pct")


# ---------------------------------------------------------------- choosing takes


def choose_takes(attempts: DataFrame, keys: list[str], slot_mode: bool = False,
                 max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The attempt kept for each key, from `(keys, attempt, ok, score, threshold)`.

    Attempts are tried in order, `max_attempts` at most: the first that reaches the
    threshold wins.  A failed or unscored attempt ends the series; then the
    best scored one so far is kept, the earliest on ties.  In slot mode an
    unscored take is accepted as it is.

    The rank filter runs before the shuffle, so no key ever brings more than
    `max_attempts` rows per task, which bounds the collected series too.
    """
    order = Window.partitionBy(*keys).orderBy("attempt")
    first = attempts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_attempts)
    pct = half_even_percent(F.col("score"))
    end = F.when(~F.col("ok"), "failed").when(F.col("score").isNull(), "unscored").when(
        pct >= F.col("threshold"), "passed")
    series = first.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("r", "attempt", pct.alias("pct"), end.alias("end")))).alias("s"))
    stop = F.get(F.filter("s", lambda a: a["end"].isNotNull()), F.lit(0))
    before = F.filter("s", lambda a: F.col("__stop").isNull() | (a["r"] < F.col("__stop.r")))
    best = F.array_max(F.transform(before, lambda a: F.struct(a["pct"], -a["r"], a["attempt"])))
    picked = series.withColumn("__stop", stop).withColumn("__best", best)
    takes_last = F.col("__stop.end").isin("passed", *(["unscored"] if slot_mode else []))
    return picked.select(
        *keys,
        F.when(takes_last, F.col("__stop.attempt")).otherwise(F.col("__best.attempt")).alias("attempt"),
        F.when(takes_last, F.col("__stop.pct")).otherwise(F.col("__best.pct")).alias("pct"),
        F.coalesce(F.col("__stop.end") == "passed", F.lit(False)).alias("passed"),
        F.coalesce(F.col("__stop.r"), F.size("s")).cast("int").alias("tries"),
    )


def slots_produced(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """How many slots of each segment got a take."""
    return chosen.groupBy(*keys).agg(F.count("attempt").alias("produced"), F.count("*").alias("slots"))


# ---------------------------------------------------------------- status changes


def reset_for_new_audio(segments: DataFrame, changed: DataFrame) -> DataFrame:
    """New audio: unread again, manual status and old score removed."""
    hit = changed.select("project", "num").distinct().withColumn("__new", F.lit(True))
    fresh = F.col("__new").isNotNull()
    return segments.join(hit, ["project", "num"], "left").withColumns({
        "read": F.when(fresh, 0).otherwise(F.col("read")),
        "qc_status": F.when(~fresh, F.col("qc_status")),
        "qc_score": F.when(~fresh, F.col("qc_score")),
    }).drop("__new")


def promote_version(takes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen version becomes `main`; other takes of that segment are dropped."""
    picks = chosen.select("project", "num", F.col("version").alias("__pick")).join(
        takes.select("project", "num", F.col("version").alias("__pick")).distinct(), ["project", "num", "__pick"],
        "left_semi")
    return takes.join(picks, ["project", "num"], "left").filter(
        F.col("__pick").isNull() | (F.col("version") == F.col("__pick"))).withColumn(
        "version", F.when(F.col("__pick").isNotNull(), "main").otherwise(F.col("version"))).drop("__pick")


def mark_read(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Choosing a version counts as having listened to it."""
    hit = keys.select("project", "num").distinct().withColumn("__hit", F.lit(True))
    return segments.join(hit, ["project", "num"], "left").withColumn(
        "read", F.when(F.col("__hit"), 1).otherwise(F.col("read"))).drop("__hit")
