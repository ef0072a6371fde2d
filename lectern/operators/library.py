"""Profiles, generations and their versions: list, count, resolve and maintain.

Joins are written as plain equi joins.  A hot profile or generation is split by
adaptive execution (skew join); grouped results use aggregates that combine on
the map side, so no list of a whole group is ever built.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.joins import optional_join
from lectern.operators.ordered import block_of, dealt_by_range, ordered_scan, running_sum, sum_before, time_block
from lectern.session import written


_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

def with_history_defaults(generations: DataFrame) -> DataFrame:
    """Rows written before the columns existed count as `qwen` / `completed`."""
    return generations.withColumns({
        "engine": F.coalesce("engine", F.lit("qwen")),
        "status": F.coalesce("status", F.lit("completed")),
    })


def history(generations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Generations that still have a profile, with its name."""
    names = profiles.select(F.col("id").alias("profile_id"), F.col("name").alias("profile_name"))
    return with_history_defaults(generations).join(names, "profile_id")


def text_search(df: DataFrame, column: str, query: str) -> DataFrame:
    """SQL `LIKE %query%` where `%` and `_` in the query stay wildcards; A-Z match a-z, other letters only themselves."""
    wanted = query.translate(_ASCII_LOWER).replace("\\", "\\\\")
    return df.filter(F.translate(column, string.ascii_uppercase, string.ascii_lowercase).like(f"%{wanted}%"))


def contains_search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Keep rows where any column contains the query, ignoring case; an empty query keeps all."""
    wanted = query.strip().lower()
    if not wanted:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted)
    return df.filter(hit)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of rows; the caller's order must be total."""
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def _beyond(order: list[tuple[str, bool]], key: tuple, inclusive: bool) -> Column:
    """Rows behind `key` in the order of (column, descending) pairs.

    The bound on the first column stands by itself, so that it reaches the scan and prunes by minimum and maximum.
    """
    found = F.lit(inclusive)
    for (name, down), value in reversed(list(zip(order, key))):
        c, v = F.col(name), F.lit(value)
        found = (c < v if down else c > v) | ((c == v) & found)
    (name, down), value = order[0], key[0]
    first = F.col(name) <= F.lit(value) if down else F.col(name) >= F.lit(value)
    return first & found


def _sorted(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def page_after(df: DataFrame, order: list[tuple[str, bool]], key: tuple, limit: int) -> DataFrame:
    """The next `limit` rows behind the row whose order columns are `key`: no row before it is sorted or kept.

    `order` is a total order of (column, descending) pairs over columns without nulls.
    """
    check_page(limit, 0)
    return df.filter(_beyond(order, key, False)).orderBy(*_sorted(order)).limit(limit)


def page_at(df: DataFrame, order: list[tuple[str, bool]], limit: int, offset: int) -> DataFrame:
    """The page at a deep offset, which sorts one range of keys and then keeps `limit` rows only.

    The order columns alone are dealt by range; the counts of the ranges tell which of them holds the page's first row,
    and a seek from that row's key does the rest.
    """
    check_page(limit, offset)
    names = [c for c, _ in order]
    dealt = dealt_by_range(df.select(*names), [], _sorted(order), "__part")
    start = 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("__part").count().collect()):
        if offset < start + n:
            inside = Window.partitionBy("__part").orderBy(*_sorted(order))
            key = dealt.filter(F.col("__part") == part).withColumn("__n", F.row_number().over(inside)).filter(
                F.col("__n") == offset - start + 1).select(*names).first()
            return df.filter(_beyond(order, tuple(key), True)).orderBy(*_sorted(order)).limit(limit)
        start += n
    return df.limit(0)


def check_page(limit: int, offset: int, largest: int = 200) -> None:
    if not 1 <= limit <= largest:
        raise ValueError(f"limit must be between 1 and {largest}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The page with the total row count of the unpaged result on every row.

    The total is a one-row aggregate, so the join adds one value, not rows.
    """
    return with_single(page(df, order, limit, offset), df.agg(F.count("*").alias("total")))


def with_single(df: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row.

    An aggregate without keys has exactly one row whatever its input, which is
    the size bound that allows the broadcast; without it all rows would meet in
    one partition.
    """
    return df.withColumn("__one", F.lit(1)).join(
        F.broadcast(single.withColumn("__one", F.lit(1))), "__one", "left").drop("__one")


def story_detail(items: DataFrame, generations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Story items with their generation and profile."""
    made = history(generations, profiles).select(
        F.col("id").alias("generation_id"), "profile_id", "profile_name", "text", "engine")
    return items.join(made, "generation_id")


def profile_counts(profiles: DataFrame, generations: DataFrame, samples: DataFrame) -> DataFrame:
    """Every profile with its number of generations and samples, 0 when absent."""
    made = generations.groupBy("profile_id").agg(F.count("*").alias("generation_count"))
    kept = samples.groupBy("profile_id").agg(F.count("*").alias("sample_count"))
    return (
        profiles.withColumnRenamed("id", "profile_id")
        .join(made, "profile_id", "left")
        .join(kept, "profile_id", "left")
        .fillna(0, ["generation_count", "sample_count"])
    )


def resolved_audio(items: DataFrame, generations: DataFrame, versions: DataFrame) -> DataFrame:
    """The pinned version's file when that version exists, else the generation's own file."""
    pinned = versions.select(F.col("id").alias("version_id"), F.col("audio_path").alias("__pinned"))
    own = generations.select(F.col("id").alias("generation_id"), F.col("audio_path").alias("__own"))
    return (
        optional_join(items.join(own, "generation_id"), pinned, ["version_id"], ["id"])
        .withColumn("audio_path", F.coalesce("__pinned", "__own")).drop("__pinned", "__own")
    )


def full_task_view(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """Tasks and progress side by side on `key`, with the first known error and status."""
    left = tasks.select("key", F.col("status").alias("task_status"), F.col("error").alias("task_error"))
    right = progress.select("key", F.col("status").alias("progress_status"), F.col("error").alias("progress_error"))
    return left.join(right, "key", "full_outer").select(
        "key",
        F.coalesce("task_status", "progress_status").alias("status"),
        F.coalesce("task_error", "progress_error").alias("error"),
    )


def key_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides."""
    return left.select(key).union(right.select(key)).distinct()


def available_for_story(generations: DataFrame, items: DataFrame, query: str = "") -> DataFrame:
    """Completed generations no story item uses yet."""
    used = items.select(F.col("generation_id").alias("id"))
    done = with_history_defaults(generations).filter(F.col("status") == "completed")
    return contains_search(done.join(used, "id", "left_anti"), ["text"], query)


def history_statistics(generations: DataFrame) -> DataFrame:
    """Count and total duration per profile and overall (profile NULL), in one pass."""
    return generations.rollup("profile_id").agg(
        F.count("*").alias("generations"),
        F.coalesce(F.sum(F.col("duration").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("total_duration"),
    )


def stories_with_counts(stories: DataFrame, items: DataFrame) -> DataFrame:
    """Stories with their number of items."""
    counts = items.groupBy(F.col("story_id").alias("id")).agg(F.count("*").alias("item_count"))
    return stories.join(counts, "id", "left").fillna(0, ["item_count"])


def ordered_versions(versions: DataFrame, seconds: int = 30 * 86400) -> DataFrame:
    """Versions numbered by creation inside each generation, the active one marked.

    The result stays flat (one row per version), so a generation with very many
    versions is spread over tasks.  Active is the latest default version.
    """
    numbered = ordered_scan(
        versions, ["generation_id"], ["created_at", "id"], time_block(F.col("created_at"), seconds),
        [running_sum(F.lit(1).cast("bigint"), "ordinal")],
    )
    active = (
        versions.filter("is_default").groupBy("generation_id")
        .agg(F.max_by("id", F.struct("created_at", "id")).alias("__active"))
    )
    return (
        numbered.join(active, "generation_id", "left")
        .withColumn("is_active", F.coalesce(F.col("id") == F.col("__active"), F.lit(False))).drop("__active")
    )


def default_version(versions: DataFrame) -> DataFrame:
    """Per generation the earliest default version, else the earliest version."""
    first = F.struct(~F.col("is_default"), "created_at", "id")
    return versions.groupBy("generation_id").agg(F.min_by("id", first).alias("version_id"))


def source_version(generations: DataFrame, versions: DataFrame) -> DataFrame:
    """File to reprocess: first version without effects, else the generation's own."""
    clean = versions.filter(F.col("effects_chain").isNull()).groupBy(F.col("generation_id").alias("id")).agg(
        F.min_by(F.struct(F.col("id").alias("version_id"), "audio_path"), F.struct("created_at", "id")).alias("clean"))
    return generations.join(clean, "id", "left").select(
        F.col("id").alias("generation_id"), F.col("clean.version_id").alias("version_id"),
        F.coalesce("clean.audio_path", F.col("audio_path")).alias("audio_path"))


def append_version_labels(
    new: DataFrame, versions: DataFrame, prefix: str = "version-", seconds: int = 30 * 86400
) -> DataFrame:
    """Label new rows `prefix{n+1}`, counting on from the versions a generation already has."""
    counts = versions.groupBy("generation_id").agg(F.count("*").alias("__have"))
    numbered = ordered_scan(
        new, ["generation_id"], ["created_at", "id"], time_block(F.col("created_at"), seconds),
        [running_sum(F.lit(1).cast("bigint"), "__n")],
    )
    return (
        numbered.join(counts, "generation_id", "left")
        .withColumn("label", F.concat(F.lit(prefix), (F.coalesce("__have", F.lit(0)) + F.col("__n")).cast("string")))
        .drop("__have", "__n")
    )


def drop_generations(generations: DataFrame, versions: DataFrame, condition: Column):
    """Cascade delete: what is left of both tables after removing the matching generations."""
    gone = generations.filter(condition).select(F.col("id").alias("generation_id"))
    left = generations.filter(~F.coalesce(condition, F.lit(False)))
    return left, versions.join(gone, "generation_id", "left_anti")


def set_default(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Make `chosen(generation_id, version_id)` the only default of its generation."""
    return versions.join(chosen.withColumnRenamed("version_id", "__chosen"), "generation_id", "left").withColumn(
        "is_default",
        F.when(F.col("__chosen").isNull(), F.col("is_default")).otherwise(F.col("id") == F.col("__chosen")),
    ).drop("__chosen")


def paths_after_default(generations: DataFrame, versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Generations whose file becomes that of the chosen default version."""
    files = chosen.join(
        versions.select("generation_id", F.col("id").alias("version_id"), F.col("audio_path").alias("__new")),
        ["generation_id", "version_id"])
    return (
        generations.join(files.select(F.col("generation_id").alias("id"), "__new"), "id", "left")
        .withColumn("audio_path", F.coalesce("__new", "audio_path")).drop("__new")
    )


def delete_versions(versions: DataFrame, doomed: DataFrame) -> DataFrame:
    """Remove versions but never the last one of a generation; pass the default on to the earliest left.

    A request that would empty a generation keeps that generation's earliest version.
    """
    marked = versions.join(doomed.select(F.col("id"), F.lit(True).alias("__doomed")), "id", "left").withColumn(
        "__doomed", F.coalesce("__doomed", F.lit(False)))
    age = F.struct("created_at", "id")
    fate = marked.groupBy("generation_id").agg(
        F.min_by("id", age).alias("__first"),
        F.min_by(F.when(~F.col("__doomed"), F.col("id")), F.when(~F.col("__doomed"), age)).alias("__heir"),
        F.max(F.col("is_default") & ~F.col("__doomed")).alias("__kept_default"),
        F.max("is_default").alias("__had_default"),
    )
    survivor = F.coalesce("__heir", "__first")
    return (
        marked.join(fate, "generation_id")
        .filter(~F.col("__doomed") | (F.col("__heir").isNull() & (F.col("id") == F.col("__first"))))
        .withColumn("is_default", F.when(F.col("__had_default") & ~F.col("__kept_default"), F.col("id") == survivor)
                    .otherwise(F.col("is_default")))
        .select(*versions.columns)
    )


def backfill_versions(generations: DataFrame, versions: DataFrame, listing: DataFrame) -> DataFrame:
    """One default `clean` version for each completed generation that has a file and no version."""
    have = versions.select(F.col("generation_id").alias("id"))
    made = (
        with_history_defaults(generations)
        .filter((F.col("status") == "completed") & (F.coalesce("audio_path", F.lit("")) != ""))
        .join(have, "id", "left_anti")
        .join(listing.select(F.col("path").alias("audio_path")), "audio_path", "left_semi")
    )
    return made.select(
        F.concat(F.lit("clean-"), F.col("id").cast("string")).alias("id"), F.col("id").alias("generation_id"),
        F.lit("clean").alias("label"), F.lit(True).alias("is_default"), "created_at", "audio_path")


def toggle(df: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """Flip a boolean on the listed ids."""
    listed = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return df.join(listed, "id", "left").withColumn(
        flag, F.when(F.col("__hit"), ~F.col(flag)).otherwise(F.col(flag))).drop("__hit")


def duplicate_names(profiles: DataFrame) -> DataFrame:
    """Names (case-sensitive) held by more than one profile."""
    return profiles.groupBy("name").agg(F.count("*").alias("holders")).filter("holders > 1")


def name_conflicts(updates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Updates `(id, name)` whose name another profile already holds."""
    held = profiles.select(F.col("id").alias("other_id"), "name")
    return updates.join(held, "name").filter("other_id <> id")


def import_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Give each imported `(ord, name)` a free name: `name`, `name (1)`, `name (2)` …

    Bulk form.  Requests for one base name get its free numbers in `ord` order;
    the numbers already taken are read from the existing names, so the result
    equals importing one after the other unless a request itself looks like
    `base (k)` for another requested base.
    """
    pattern = r"^(.*) \((\d+)\)$"
    used = taken.select(
        F.explode(F.array(
            F.struct(F.col("name").alias("base"), F.lit(0).cast("bigint").alias("k")),
            F.struct(F.regexp_extract("name", pattern, 1).alias("base"),
                     F.regexp_extract("name", pattern, 2).try_cast("bigint").alias("k")),
        )).alias("u")).select("u.*").filter("base <> '' AND k IS NOT NULL").distinct()
    ranked = ordered_scan(
        wanted.withColumnRenamed("name", "base"), ["base"], ["ord"], block_of(F.col("ord")),
        [sum_before(F.lit(1).cast("bigint"), "pos")])
    # The i-th free number is i plus the used numbers with at most i free ones below them.  Both sides are
    # laid on one line of positions, so the count is a running sum and no request meets every used number.
    placed = ordered_scan(used, ["base"], ["k"], block_of(F.col("k")), [sum_before(F.lit(1).cast("bigint"), "below")])
    line = placed.select("base", (F.col("k") - F.col("below")).alias("pos"), F.lit(1).cast("bigint").alias("taken"),
                         F.col("k").alias("ord")).unionByName(
        ranked.select("base", F.col("pos").cast("bigint"), F.lit(0).cast("bigint").alias("taken"), "ord"))
    line = written(line, "names")
    counted = ordered_scan(
        line.withColumn("kind", 1 - F.col("taken")), ["base"], ["pos", "kind", "ord"], block_of(F.col("pos")),
        [running_sum(F.col("taken"), "skip")])
    number = F.col("pos") + F.col("skip")
    return counted.filter("taken = 0").select("ord", F.when(number == 0, F.col("base")).otherwise(
        F.concat("base", F.lit(" ("), number.cast("string"), F.lit(")"))).alias("name"))


def replace_mappings(mappings: DataFrame, changes: DataFrame, key: str, value: str, known: DataFrame) -> DataFrame:
    """Replace all mappings of the changed keys; keys that name an unknown id keep their old rows."""
    broken = changes.join(known.select(value), value, "left_anti").select(key).distinct()
    valid = changes.join(broken, key, "left_anti").select(key, value).distinct()
    return mappings.join(valid.select(key).distinct(), key, "left_anti").select(key, value).unionByName(valid)


def default_mapping(profiles: DataFrame, channel_id: int) -> DataFrame:
    """Every profile on the default channel."""
    return profiles.select(F.lit(channel_id).alias("channel_id"), F.col("id").alias("profile_id"))


def adopt_imports(rows: DataFrame, profiles: DataFrame, parent_id: int, parent_name: str):
    """Imported rows under one parent profile that is created only when missing."""
    fresh = rows.select(
        "id", F.lit(parent_id).cast("bigint").alias("profile_id"), "text", F.lit("import").alias("source"))
    parent = rows.sparkSession.range(1).select(
        F.lit(parent_id).cast("bigint").alias("id"), F.lit(parent_name).alias("name"))
    grown = profiles.select("id", "name").unionByName(parent.join(profiles.select("name"), "name", "left_anti"))
    return fresh, grown


def merge_pages(pages: DataFrame, order: list[str]) -> DataFrame:
    """Append pages and keep each id once, the first occurrence winning."""
    rest = [c for c in pages.columns if c != "id"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return pages.groupBy("id").agg(first).select("id", "row.*")


def last_seen(requests: DataFrame) -> DataFrame:
    """Latest request time per client on the tracked paths (equal to or below `/mcp`, `/speak`)."""
    tracked = F.lit(False)
    for prefix in ("/mcp", "/speak"):
        tracked = tracked | (F.col("path") == prefix) | F.col("path").startswith(prefix + "/")
    return requests.filter(tracked).groupBy("client_id").agg(F.max("ts").alias("last_seen_at"))


def resolve_voice(requests: DataFrame, profiles: DataFrame, clients: DataFrame, default_id: int | None) -> DataFrame:
    """Explicit voice (id, then name; no fall-through) → client binding → global default → none."""
    by_name = profiles.groupBy(F.lower("name").alias("__name")).agg(F.min("id").alias("__named"))
    by_id = profiles.select(F.col("id").cast("string").alias("explicit_voice"), F.col("id").alias("__hit"))
    bound = clients.join(profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_semi").select(
        "client_id", F.col("profile_id").alias("__bound"))
    fallback = profiles.filter(F.col("id") == default_id).agg(F.max("id").alias("__default"))
    asked = with_single(requests, fallback).withColumn("__name", F.lower("explicit_voice"))
    asked = optional_join(asked, by_id, ["explicit_voice"], requests.columns)
    asked = optional_join(asked, by_name, ["__name"], requests.columns).join(bound, "client_id", "left")
    return asked.withColumn(
        "resolved_profile", F.when(F.col("explicit_voice").isNotNull(), F.coalesce("__hit", "__named"))
        .otherwise(F.coalesce("__bound", "__default"))).select(*requests.columns, "resolved_profile")


def invalidate_refined(captures: DataFrame, retranscribed: DataFrame) -> DataFrame:
    """A new transcript clears the refined text and flags."""
    fresh = retranscribed.select("id", F.col("transcript_raw").alias("__new"))
    joined = captures.join(fresh, "id", "left")
    hit = F.col("__new").isNotNull()
    return joined.withColumns({
        "transcript_raw": F.coalesce("__new", "transcript_raw"),
        "transcript_refined": F.when(~hit, F.col("transcript_refined")),
    }).drop("__new")


def refinement_flags(df: DataFrame, column: str = "refinement_flags") -> DataFrame:
    """JSON text → three booleans; a missing text or key means true."""
    names = ("smart_cleanup", "self_correction", "preserve_technical")
    parsed = F.from_json(F.col(column), ", ".join(f"{n} boolean" for n in names))
    return df.withColumns({n: F.coalesce(parsed[n], F.lit(True)) for n in names})


def relative_paths(df: DataFrame, column: str, root: str) -> DataFrame:
    """Rows whose absolute path below `root` becomes relative; only changed rows are returned."""
    prefix = root.rstrip("/") + "/"
    return (
        df.filter(F.col(column).startswith(prefix))
        .withColumn("old_path", F.col(column))
        .withColumn(column, F.substring(F.col(column), len(prefix) + 1, 1 << 30))
    )
