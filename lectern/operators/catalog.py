"""The segment catalogue: listing, numbering, roles and voices of a project's segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import (
    block_of, last_known_before, next_known_after, ordered_scan, row_numbers, running_sum, sum_before,
)

# ---------------------------------------------------------------- ranges


def range_intervals(expr: Column, swap_reversed: bool = False) -> Column:
    """`"1-10, 12, x"` → array of (lo, hi); parts that are no number or range are ignored.

    A reversed range selects nothing, or is turned round with `swap_reversed`.
    """
    number = lambda c: F.trim(c).try_cast("bigint")
    if swap_reversed:
        number = lambda c: F.regexp_extract(F.trim(c), r"^([+-]?\d+)", 1).try_cast("bigint")

    def interval(part: Column) -> Column:
        ends = F.split(part, "-")
        lo, hi = number(F.get(ends, 0)), number(F.get(ends, 1))
        if swap_reversed:
            lo, hi = F.least(lo, hi), F.greatest(lo, hi)
            pair_ok = (F.size(ends) >= 2) & F.get(ends, 0).isNotNull() & number(F.get(ends, 0)).isNotNull() & number(
                F.get(ends, 1)).isNotNull()
        else:
            pair_ok = F.size(ends) == 2
        one = number(part)
        return F.when(pair_ok, F.struct(lo.alias("lo"), hi.alias("hi"))).when(
            F.size(ends) == 1, F.struct(one.alias("lo"), one.alias("hi")))

    parts = F.transform(F.split(expr, ","), interval)
    return F.filter(parts, lambda p: p.isNotNull() & p["lo"].isNotNull() & p["hi"].isNotNull())


def in_ranges(num: Column, expr: Column, swap_reversed: bool = False) -> Column:
    """True where `num` is selected; `all` or an empty expression selects everything.

    The ranges stay intervals, so `1-1000000000` costs no more than `1-2`.
    """
    everything = F.lower(F.trim(F.coalesce(expr, F.lit("")))).isin("", "all")
    hit = F.exists(range_intervals(expr, swap_reversed), lambda p: num.between(p["lo"], p["hi"]))
    return everything | F.coalesce(hit, F.lit(False))


def strict_ranges(expr: str) -> list[tuple[int, int]]:
    """Parse a range parameter; any bad part is an error."""
    out = []
    for part in expr.split(","):
        lo, dash, hi = part.strip().partition("-")
        out.append((int(lo), int(hi) if dash else int(lo)))
    return out


def select_strict(df: DataFrame, column: str, expr: str) -> DataFrame:
    """Rows whose number is in a well-formed range parameter; the test reaches the scan as plain comparisons."""
    hit = F.lit(False)
    for lo, hi in strict_ranges(expr):
        hit = hit | F.col(column).between(lo, hi)
    return df.filter(hit)


#: Role filters that mean "no filter".
_NO_ROLE = ("", "all", "tous", "tous les acteurs")


def role_filter(segments: DataFrame, role: str | None) -> DataFrame:
    """One role, or everything for the words that mean so."""
    if role is None or role.strip().lower() in _NO_ROLE:
        return segments
    return segments.filter(F.col("profile_id") == role)


# ---------------------------------------------------------------- names and voices


def name_key(name: Column) -> Column:
    """Comparison form of a voice or role name."""
    return F.replace(F.lower(F.trim(name)), F.lit("’"), F.lit("'"))


def upper_key(name: Column) -> Column:
    return F.replace(F.upper(F.trim(name)), F.lit("’"), F.lit("'"))


def voice_ids(names: DataFrame, voices: DataFrame, column: str = "voice_name") -> DataFrame:
    """Voice id per name: the exact name first, else the normalised one, the first in index order."""
    exact = voices.groupBy(F.col("name").alias(column)).agg(F.min_by("voice_id", "ord").alias("__exact"))
    loose = voices.groupBy(name_key(F.col("name")).alias("__key")).agg(F.min_by("voice_id", "ord").alias("__loose"))
    return (
        names.join(exact, column, "left").withColumn("__key", name_key(F.col(column))).join(loose, "__key", "left")
        .withColumn("voice_id", F.coalesce("__exact", "__loose")).drop("__exact", "__loose", "__key")
    )


def profile_lookup(wanted: DataFrame, profiles: DataFrame, column: str = "wanted") -> DataFrame:
    """Profile by id first, then by name without regard to case."""
    ids = profiles.select(F.col("id").cast("string").alias(column), F.col("id").alias("__by_id"))
    names = profiles.groupBy(F.lower("name").alias("__key")).agg(F.min("id").alias("__by_name"))
    return (
        wanted.join(ids, column, "left").withColumn("__key", F.lower(column)).join(names, "__key", "left")
        .withColumn("profile_id", F.coalesce("__by_id", "__by_name")).drop("__by_id", "__by_name", "__key")
    )


#: Roles that never have a voice of their own, and the direction role.
NARRATOR_ROLES = ("Narrator", "NARRATEUR", "DIDAS")
DIRECTION = "DIDAS"


def segment_voice(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Voice really used by each segment: actual → mapped role → narrator's voice.

    `mapping(project, role, voice)`.  A role name is never returned as a voice.
    """
    narrator = mapping.groupBy("project").agg(F.coalesce(
        F.max(F.when(F.col("role") == "NARRATEUR", F.col("voice"))),
        F.max(F.when(F.col("role") == "Narrator", F.col("voice")))).alias("__narrator"))
    mapped = mapping.select("project", F.col("role").alias("__role"), F.col("voice").alias("__mapped"))
    role = F.trim(F.coalesce("profile_id", F.lit("")))
    usable = (role != "") & ~role.isin(*NARRATOR_ROLES) & F.col("__mapped").isNotNull() & (
        F.col("__mapped") != DIRECTION)
    return (
        segments.withColumn("__role", role).join(mapped, ["project", "__role"], "left")
        .join(narrator, "project", "left")
        .withColumn("voice_name", F.when(F.coalesce("generated_voice", F.lit("")) != "", F.col("generated_voice"))
                    .when(usable, F.col("__mapped")).otherwise(F.col("__narrator")))
        .drop("__role", "__mapped", "__narrator")
    )


def play_voice(segments: DataFrame, mapping: DataFrame, direction_voice: str) -> DataFrame:
    """Play form: mapped voice, else the role name itself; the direction role gets a fixed voice."""
    mapped = mapping.select("project", F.col("role").alias("profile_id"), F.col("voice").alias("__mapped"))
    voice = F.coalesce("__mapped", "profile_id")
    return segments.join(mapped, ["project", "profile_id"], "left").withColumn(
        "voice_name", F.when(voice == DIRECTION, F.lit(direction_voice)).otherwise(voice)).drop("__mapped")


def voices_to_refresh(segments: DataFrame) -> DataFrame:
    """Distinct actual voice, else role."""
    return segments.select("project", F.coalesce("generated_voice", "profile_id").alias("voice_name")).distinct()


def voices_used(segments: DataFrame, voices: DataFrame) -> DataFrame:
    """Distinct actual voices of each project with their ids."""
    used = segments.filter(F.coalesce("generated_voice", F.lit("")) != "").select(
        "project", F.col("generated_voice").alias("voice_name")).distinct()
    return voice_ids(used, voices)


def characters(segments: DataFrame) -> DataFrame:
    """Distinct roles of each project, sorted."""
    return segments.select("project", "profile_id").distinct().orderBy("project", "profile_id")


def several_voices(segments: DataFrame) -> DataFrame:
    """Does a project use more than one actual voice?"""
    voice = F.when(F.col("generated_voice") != "", F.col("generated_voice"))
    return segments.groupBy("project").agg(
        F.coalesce(F.min(voice) < F.max(voice), F.lit(False)).alias("several_voices"))


def clean_characters(names: Column, project_type: str = "novel", detected: Column | None = None) -> Column:
    """Upper-case, trimmed, sorted, distinct names; plays get DIDAS, multi-voice novels NARRATEUR."""
    cleaned = F.filter(F.transform(names, upper_key), lambda n: n != "")
    if project_type == "theatre":
        cleaned = F.array_union(cleaned, F.array(F.lit(DIRECTION)))
    if project_type == "novel_multi":
        cleaned = F.array_union(names if detected is None else F.array_union(names, detected),
                                F.array(F.lit("NARRATEUR")))
        cleaned = F.array_except(cleaned, F.array(F.lit("Narrator")))
    return F.array_sort(F.array_distinct(cleaned))


def all_characters(declared: DataFrame, segments: DataFrame) -> DataFrame:
    """Declared, detected and implied roles `(project, role)` without the technical narrator."""
    seen = segments.select("project", F.col("profile_id").alias("role"))
    implied = declared.select("project", F.lit("NARRATEUR").alias("role"))
    return declared.select("project", "role").union(seen).union(implied).distinct().filter(F.col("role") != "Narrator")


# ---------------------------------------------------------------- listing and progress


def with_takes(segments: DataFrame, takes: DataFrame) -> DataFrame:
    """Segments with what was recorded for them; `read` counts as 1 when absent or without audio."""
    found = takes.groupBy("project", "num").agg(
        F.max(F.col("version") == "main").alias("has_main"),
        F.count_if(F.col("version") != "main").alias("version_count"))
    main = F.coalesce("has_main", F.lit(False))
    return segments.join(found, ["project", "num"], "left").withColumns({
        "has_main": main,
        "version_count": F.coalesce("version_count", F.lit(0)),
        "read": F.when(main, F.coalesce("read", F.lit(1))).otherwise(F.lit(1)),
    })


def version_number(version: Column) -> Column:
    """`v12` → 12; anything else counts as 0."""
    return F.coalesce(F.regexp_extract(version, r"^v(\d+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def versions_in_number_order(takes: DataFrame) -> DataFrame:
    """Version labels of each segment ranked by number, not by spelling."""
    found = takes.filter(F.col("version") != "main").withColumn("k", version_number(F.col("version")))
    return row_numbers(found, ["project", "num"], ["k", "version"], block_of(F.col("k")), "rank").drop("k")


def any_audio() -> Column:
    """A segment counts as recorded when it has a main take or any version."""
    return F.col("has_main") | (F.col("version_count") > 0)


def neighbours_with_audio(segments: DataFrame, role: str | None = None) -> DataFrame:
    """Nearest earlier and later segment with audio, inside the role filter."""
    number = F.when(F.col("has_audio"), F.col("num"))
    return ordered_scan(
        role_filter(segments, role), ["project"], ["num"], block_of(F.col("num")),
        [last_known_before(number, "previous_audio"), next_known_after(number, "next_audio")])


def project_summary(listing: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts per project from a file listing `(project, folder, name)` and `meta(project, type)`."""
    name = F.lower("name")
    seg = F.col("name").startswith("seg")
    counts = listing.groupBy("project").agg(
        F.count_if((F.col("folder") == "book") & seg & F.col("name").endswith(".txt")).alias("text_segments"),
        F.count_if((F.col("folder") == "tts") & seg & F.col("name").endswith(".json")).alias("json_segments"),
        F.count_if((F.col("folder") == "audio") & seg & F.col("name").endswith(".wav")).alias("generated_audio"),
        F.coalesce(F.bool_or((F.col("folder") == "") & name.endswith(".mp3")), F.lit(False)).alias("has_final_mp3"),
        F.coalesce(F.bool_or((F.col("folder") == "book") & name.endswith("_parsed.txt")), F.lit(False))
        .alias("__parsed"),
    )
    return counts.join(meta.select("project", "type", F.lit(True).alias("__meta")), "project", "left").select(
        "project",
        F.when(F.col("__meta"), F.coalesce("type", F.lit("novel")))
        .otherwise(F.when(F.col("__parsed"), "theatre").otherwise("novel")).alias("type"),
        F.greatest("text_segments", "json_segments").alias("total_segments"), "generated_audio", "has_final_mp3")


def percent(done: Column, total: Column) -> Column:
    """Whole percent, rounded half up; 0 for an empty total."""
    return F.when(total > 0, F.floor(F.lit(100) * done / total + 0.5)).otherwise(F.lit(0)).cast("bigint")


# ---------------------------------------------------------------- numbering


def split_segments(segments: DataFrame, splits: DataFrame) -> DataFrame:
    """Replace each `splits(project, num, part1, part2)` segment by two; later ones move up."""
    marked = segments.join(splits, ["project", "num"], "left")
    cut = F.col("part1").isNotNull()
    shifted = ordered_scan(marked, ["project"], ["num"], block_of(F.col("num")),
                           [sum_before(F.when(cut, 1).otherwise(0).cast("bigint"), "__shift")])
    first = (F.col("num") + F.col("__shift")).cast("int")
    parts = F.when(cut, F.array(
        F.struct(first.alias("num"), F.col("part1").alias("text"), F.lit(True).alias("is_new")),
        F.struct((first + 1).alias("num"), F.col("part2").alias("text"), F.lit(True).alias("is_new")),
    )).otherwise(F.array(F.struct(first.alias("num"), F.col("text"), F.lit(False).alias("is_new"))))
    return shifted.select("project", "profile_id", F.explode(parts).alias("p")).select(
        "project", "profile_id", "p.*")


def takes_after_split(takes: DataFrame, segments: DataFrame, splits: DataFrame) -> DataFrame:
    """Takes follow their segment's new number; takes of a split segment are removed."""
    marked = segments.select("project", "num").join(
        splits.select("project", "num", F.lit(1).cast("bigint").alias("__cut")), ["project", "num"], "left")
    moves = ordered_scan(marked, ["project"], ["num"], block_of(F.col("num")),
                         [sum_before(F.coalesce("__cut", F.lit(0)), "__shift")]).filter("__cut IS NULL")
    return takes.join(moves, ["project", "num"]).withColumn(
        "num", (F.col("num") + F.col("__shift")).cast("int")).drop("__cut", "__shift")


def delete_segments(segments: DataFrame, doomed: DataFrame) -> DataFrame:
    """Remove segments `(project, num)`; later ones move down."""
    marked = segments.join(doomed.select("project", "num", F.lit(1).cast("bigint").alias("__gone")),
                           ["project", "num"], "left").fillna(0, ["__gone"])
    return ordered_scan(marked, ["project"], ["num"], block_of(F.col("num")),
                        [sum_before(F.col("__gone"), "__shift")]).filter("__gone = 0").withColumn(
        "num", (F.col("num") - F.col("__shift")).cast("int")).drop("__gone", "__shift")


def shift_range(segments: DataFrame, start: int, end: int, delta: int) -> DataFrame:
    """Move the numbers start..end by delta; a moved segment overwrites what it lands on."""
    inside = F.col("num").between(start, end)
    moved = segments.filter(inside).withColumn("num", (F.col("num") + delta).cast("int"))
    stay = segments.filter(~inside).join(moved.select("project", "num"), ["project", "num"], "left_anti")
    return moved.unionByName(stay)


def latest_lines(log: DataFrame, key: str, order: list[str], keep: int = 500) -> DataFrame:
    """The latest `keep` lines per key.  The rank filter is pushed below the shuffle, so a hot key costs `keep` rows per task."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= keep).drop("__r")


def queue_positions(queue: DataFrame) -> DataFrame:
    """Position of every entry in one global queue: counted in ranges of equal size, however many share a moment."""
    return ordered_scan(queue, [], ["ts", "event_id"], None, [running_sum(F.lit(1).cast("bigint"), "position")])


def enqueue_missing(wanted: DataFrame, queue: DataFrame) -> DataFrame:
    """`(project, num)` requests that are neither active nor pending, each once."""
    return wanted.select("project", "num").distinct().join(queue, ["project", "num"], "left_anti")


# ---------------------------------------------------------------- source files


def _ends(suffix: str) -> Column:
    return F.lower("name").endswith(suffix)


def _is_segment_file() -> Column:
    return F.lower("name").startswith("seg")


def play_source(files: DataFrame) -> DataFrame:
    """Text to split for a play: `_chunked` > `_parsed` > any other text that is no segment file."""
    tier = F.when(_ends("_chunked.txt"), 0).when(_ends("_parsed.txt"), 1).when(
        _ends(".txt") & ~_is_segment_file(), 2)
    return _first_by(files, tier, [F.col("name")])


def book_source(files: DataFrame) -> DataFrame:
    """Text to split for a book: `_chunked` > any text that is no segment file."""
    tier = F.when(_ends("_chunked.txt"), 0).when(_ends(".txt") & ~_is_segment_file(), 1)
    return _first_by(files, tier, [F.col("name")])


#: Words that mark a copy of the book rather than the book.
_COPY_WORDS = ("save", "backup", "copy", "copie", "bak", "old")


def attribution_source(files: DataFrame) -> DataFrame:
    """Text for role attribution: `_formated` > largest plain text > largest copy."""
    copy = F.lower("name").rlike("|".join(_COPY_WORDS))
    plain = _ends(".txt") & ~_ends("_parsed.txt") & ~_ends("_chunked.txt")
    tier = F.when(_is_segment_file(), None).when(_ends("_formated.txt"), 0).when(plain & ~copy, 1).when(plain, 2)
    size = F.when(tier == 0, F.lit(0).cast("bigint")).otherwise(-F.col("size"))
    return _first_by(files, tier, [size, F.col("name")])


def _first_by(files: DataFrame, tier: Column, rest: list[Column]) -> DataFrame:
    return files.withColumn("__tier", tier).filter("__tier IS NOT NULL").groupBy("project").agg(
        F.min_by("name", F.struct(F.col("__tier"), *rest)).alias("name"))


def artefact_inventory(files: DataFrame) -> DataFrame:
    """One file of each kind per project and the one to display."""
    kind = F.when(_ends("_chunked.txt"), "chunked").when(_ends("_parsed.txt"), "parsed").when(
        _ends("_formated.txt"), "formated").otherwise("source")
    kept = files.filter(_ends(".txt") & ~_is_segment_file()).withColumn("kind", kind)
    kinds = ("source", "formated", "parsed", "chunked")
    return kept.groupBy("project").agg(*[
        F.max(F.when(F.col("kind") == k, F.col("name"))).alias(f"{k}_file") for k in kinds
    ]).withColumn("display_file", F.coalesce("chunked_file", "parsed_file", "formated_file", "source_file"))
