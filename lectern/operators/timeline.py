"""Story timelines: placing, moving, cutting and looking up clips.  All times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.library import with_single
from lectern.operators.ordered import block_of, ordered_scan, sum_before
from lectern.session import written

GAP_MS = 200


def duration_ms(duration: Column) -> Column:
    """Seconds → milliseconds, cut towards zero; a missing duration counts as 0."""
    return F.coalesce((duration * 1000).cast("bigint"), F.lit(0).cast("bigint"))


def effective_ms() -> Column:
    """Audible length of an item after both trims."""
    return duration_ms(F.col("duration")) - F.col("trim_start_ms") - F.col("trim_end_ms")


def sequential_starts(items: DataFrame, order: list[str], position: str, gap_ms: int = GAP_MS) -> DataFrame:
    """Lay the items of each story one after the other with a gap between them."""
    step = duration_ms(F.col("duration")) + gap_ms
    return ordered_scan(items, ["story_id"], order, block_of(F.col(position)), [sum_before(step, "start_time_ms")])


def reorder(items: DataFrame, wanted: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """New start times for `wanted(story_id, id, ord)`.

    A story changes only when the wanted ids are exactly its items; otherwise
    it is left out of the result.
    """
    met = written(wanted.select("story_id", "id", "ord", F.lit(True).alias("__asked")).join(
        items.select("story_id", "id", "duration", F.lit(True).alias("__own")), ["story_id", "id"], "full"), "order")
    exact = met.groupBy("story_id").agg(
        (F.count("__asked") == F.count("*")) & (F.count("__own") == F.count("*")) & (F.count_distinct("id") == F.count("*")))
    exact = exact.toDF("story_id", "__exact").filter("__exact").select("story_id")
    kept = met.select("story_id", "id", "ord", "duration").join(exact, "story_id", "left_semi")
    return sequential_starts(kept, ["ord", "id"], "ord", gap_ms)


def append_position(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Where a new clip starts on each `(story_id, track)`: latest full end + gap, 0 on an empty track."""
    ends = items.groupBy("story_id", "track").agg(
        (F.max(F.col("start_time_ms") + duration_ms(F.col("duration"))) + GAP_MS).alias("next_start_ms"))
    return targets.join(ends, ["story_id", "track"], "left").fillna(0, ["next_start_ms"])


def timeline_length(items: DataFrame) -> DataFrame:
    """End of the last audible clip per story."""
    return items.groupBy("story_id").agg(F.max(F.col("start_time_ms") + effective_ms()).alias("length_ms"))


def track_list(items: DataFrame, defaults: list[int], extra: list[int] = ()) -> DataFrame:
    """Tracks of each story: the defaults, the extra ones and those in use, highest first."""
    fixed = F.explode(F.array(*[F.lit(int(n)) for n in [*defaults, *extra]])).alias("track")
    stories = items.select("story_id").distinct()
    return items.select("story_id", "track").union(stories.select("story_id", fixed)).distinct().orderBy(
        "story_id", F.desc("track"))


def trims_valid() -> Column:
    """Trims must be non-negative and leave something to hear."""
    return (
        (F.col("trim_start_ms") >= 0) & (F.col("trim_end_ms") >= 0)
        & (F.col("trim_start_ms") + F.col("trim_end_ms") < duration_ms(F.col("duration")))
    )


def split_clips(items: DataFrame, at_ms: Column) -> DataFrame:
    """Cut each clip `at_ms` after its start into a left and a right part; impossible cuts keep the clip."""
    cut = items.withColumn("__at", at_ms)
    inside = (F.col("__at") > 0) & (F.col("__at") < effective_ms())
    total = duration_ms(F.col("duration"))
    whole = F.struct(F.lit("whole").alias("part"), "start_time_ms", "trim_start_ms", "trim_end_ms")
    left = F.struct(
        F.lit("left").alias("part"), F.col("start_time_ms"), F.col("trim_start_ms"),
        (total - (F.col("trim_start_ms") + F.col("__at"))).alias("trim_end_ms"))
    right = F.struct(
        F.lit("right").alias("part"), (F.col("start_time_ms") + F.col("__at")).alias("start_time_ms"),
        (F.col("trim_start_ms") + F.col("__at")).alias("trim_start_ms"), F.col("trim_end_ms"))
    parts = F.explode(F.when(inside, F.array(left, right)).otherwise(F.array(whole)))
    kept = [c for c in items.columns if c not in ("start_time_ms", "trim_start_ms", "trim_end_ms")]
    return cut.select(*kept, parts.alias("__p")).select(*kept, "__p.*")


def duplicate_clips(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """A copy of each chosen clip, placed a gap after the audible end of the original."""
    copies = items.join(chosen.select("id").distinct(), "id", "left_semi").withColumns({
        "start_time_ms": F.col("start_time_ms") + effective_ms() + GAP_MS,
        "id": F.concat("id", F.lit("-copy")),
    })
    return items.unionByName(copies.select(*items.columns))


def batch_move(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply `moves(story_id, generation_id, new_start_ms)`, all or nothing per story.

    A generation used several times in a story moves only its last item.
    """
    last = items.groupBy("story_id", "generation_id").agg(F.max_by("id", F.struct("position", "id")).alias("id"))
    asked = moves.join(last, ["story_id", "generation_id"], "left")
    broken = asked.filter("id IS NULL").select("story_id").distinct()
    hit = asked.join(broken, "story_id", "left_anti").select("id", "new_start_ms")
    return items.join(hit, "id", "left").withColumn(
        "start_time_ms", F.coalesce("new_start_ms", "start_time_ms")).drop("new_start_ms")


def add_generations(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids to return for `wanted(story_id, generation_id)`: the existing item, or a new one (`created`)."""
    first = items.groupBy("story_id", "generation_id").agg(F.min_by("id", F.struct("position", "id")).alias("have"))
    return wanted.distinct().join(first, ["story_id", "generation_id"], "left").select(
        "story_id", "generation_id", F.col("have").isNull().alias("created"),
        F.coalesce("have", F.concat(F.lit("new-"), F.col("generation_id").cast("string"))).alias("id"))


def valid_pins(items: DataFrame, pins: DataFrame, versions: DataFrame) -> DataFrame:
    """Pins `(id, version_id)` whose version belongs to the item's own generation."""
    own = versions.select(F.col("id").alias("version_id"), "generation_id")
    return pins.join(items.select("id", "generation_id"), "id").join(
        own, ["version_id", "generation_id"], "left_semi").select("id", "version_id")


#: Interval index: widths grow by this factor from level to level.
_GROWTH = 8
_LEVELS = 14


def _level(length: Column, base_ms: int) -> Column:
    level = F.lit(_LEVELS)
    for n in reversed(range(_LEVELS)):
        level = F.when(length <= base_ms * _GROWTH**n, n).otherwise(level)
    return level


def active_at(items: DataFrame, probes: DataFrame, base_ms: int = 4000) -> DataFrame:
    """Items heard at each probe `(story_id, at_ms)`: start ≤ at < start + audible length.

    Each item is filed under the smallest cell width that covers its length, so
    it lands in at most two cells whatever its length; a probe looks into one
    cell per width that occurs.  The join key (story, level, cell) also spreads one very
    busy story over many tasks.
    """
    start, end = F.col("start_time_ms"), F.col("start_time_ms") + effective_ms()
    filed = items.withColumn("__end", end).filter(F.col("__end") > start).withColumn(
        "__level", _level(F.col("__end") - start, base_ms))
    width = F.lit(base_ms) * F.pow(F.lit(_GROWTH), F.col("__level"))
    cell = F.explode(F.array_distinct(F.array(
        F.floor(start / width).cast("bigint"), F.floor((F.col("__end") - 1) / width).cast("bigint"))))
    filed = filed.withColumn("__cell", cell)
    # One row tells which widths occur; a probe looks into those only.
    looks = F.explode(F.transform("__levels", lambda n: F.struct(n.alias("__level"), F.floor(
        F.col("at_ms") / (F.lit(base_ms) * F.pow(F.lit(_GROWTH), n))).cast("bigint").alias("__cell"))))
    used = items.filter(end > start).agg(F.collect_set(_level(end - start, base_ms)).alias("__levels"))
    asked = with_single(probes, used).select(*probes.columns, looks.alias("__k")).select(*probes.columns, "__k.*")
    return asked.join(filed, ["story_id", "__level", "__cell"]).filter(
        (F.col("start_time_ms") <= F.col("at_ms")) & (F.col("at_ms") < F.col("__end"))).drop(
        "__level", "__cell", "__end")
