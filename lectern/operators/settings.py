"""Settings of projects as data: ordered rules, play style, cast, page numbers.

Every project has its own, so they are tables and not arguments: `rules(project, position, search, replace, active)`
and `settings(project, style, actors, remove_page_numbers)`.  Each distinct rule or cast is translated once, in Arrow
batches, and the JVM's own compiler, called from an expression, tells which patterns it can run; a bad rule is skipped, a
bad style gives way to `modern`.  Documents then meet the settings of their project in an equi join, which adaptive
execution broadcasts when the settings turn out small and splits by skew when one project holds most documents;
documents without a project are dealt over filler keys.  All that follows stays within the document's row, as in `play`
and `text`.

A document whose project is null or unknown gets `NO_SETTINGS`: no rules, style `modern`, the built-in names, page
numbers removed.  A project listed twice takes the lesser row by style, names and page-number flag.  Rules are applied by
position, equal ones by search text; rules and settings without a project belong to no document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.operators import play
from lectern.operators.joins import optional_join

RULES_TYPE = "array<struct<pattern:string,replacement:string>>"
_STRINGS = T.ArrayType(T.StringType())
_RULE = T.StructType().add("pattern", T.StringType()).add("replacement", T.StringType())
_CAST = (T.StructType().add("boxed", T.StringType()).add("comma", T.StringType()).add("names", _STRINGS)
         .add("plain", _STRINGS).add("speech", T.StringType()).add("groups", T.IntegerType())
         .add("modern", T.StringType()).add("modern_groups", T.IntegerType()))


@F.pandas_udf(_RULE)
def _translated(search: pd.Series, replace: pd.Series) -> pd.DataFrame:
    done = [tx.translate_rule(tx.Rule(s or "", r or "")) for s, r in zip(search, replace)]
    return pd.DataFrame({"pattern": [d and d.pattern for d in done], "replacement": [d and d.replacement for d in done]},
                        dtype=object)


def compiled_rules(rules: DataFrame) -> DataFrame:
    """project and the array of its active, valid rules in order."""
    live = rules.filter("active AND search <> '' AND project IS NOT NULL").select(
        "project", "position", "search", F.coalesce("replace", F.lit("")).alias("replace"))
    texts = live.select("search", "replace").distinct().withColumn("r", _translated("search", "replace"))
    good = texts.filter("r.pattern IS NOT NULL").withColumn("ok", tx.java_pattern_ok(F.col("r.pattern"))).filter("ok")
    rows = live.join(good, ["search", "replace"]).select("project", F.struct(
        "position", "search", "r.pattern", "r.replacement").alias("r"))
    return rows.groupBy("project").agg(F.sort_array(F.collect_list("r")).alias("r")).select(
        "project", F.transform("r", lambda r: F.struct(
            r["pattern"].alias("pattern"), r["replacement"].alias("replacement"))).cast(RULES_TYPE).alias("rules"))


def _cast_row(style: str | None, actors) -> tuple:
    names = [a.strip().upper() for a in (actors if actors is not None else ()) if a and a.strip()] or list(play.DEFAULT_ACTORS)
    style = play.PLAY_STYLES.get(style or "modern", style or "modern")
    # empty groups behind the style's own: groups up to the third can always be read
    found = [(f"{pattern}()()()", groups) for pattern, groups in (
        play.style_pattern(s, names) for s in (style, play.PLAY_STYLES["modern"]))]
    return (*play.head_patterns(names), names, [n.replace("’", "'") for n in names], *found[0], *found[1])


@F.pandas_udf(_CAST)
def _cast(style: pd.Series, actors: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_cast_row(s, a) for s, a in zip(style, actors)], columns=_CAST.names)


def compiled_casts(settings: DataFrame) -> DataFrame:
    """project, style, remove_page_numbers and the patterns of its cast."""
    row = F.min(F.struct("style", "actors", "remove_page_numbers")).alias("s")
    made = settings.filter("project IS NOT NULL").groupBy("project").agg(row).withColumn("cast", _cast("s.style", "s.actors"))
    valid = made.withColumn("ok", tx.java_pattern_ok(F.col("cast.speech")))
    return valid.select(
        "project", F.coalesce("s.style", F.lit("modern")).alias("style"),
        F.coalesce("s.remove_page_numbers", F.lit(True)).alias("remove_page_numbers"),
        *[F.col("cast." + c) for c in ("boxed", "comma", "names", "plain")],
        F.when(F.col("ok"), F.col("cast.speech")).otherwise(F.col("cast.modern")).alias("speech"),
        F.when(F.col("ok"), F.col("cast.groups")).otherwise(F.col("cast.modern_groups")).alias("groups"))


def _no_settings() -> dict[str, Column]:
    boxed, comma, names, plain, speech, groups, *_ = _cast_row(None, None)
    array = lambda xs: F.array(*map(F.lit, xs))
    return {"style": F.lit("modern"), "remove_page_numbers": F.lit(True), "boxed": F.lit(boxed), "comma": F.lit(comma),
            "names": array(names), "plain": array(plain), "speech": F.lit(speech), "groups": F.lit(groups)}


def with_rules(docs: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with `__rules`, the compiled rules of their project."""
    found = compiled_rules(rules).withColumnRenamed("rules", "__rules")
    none = F.array().cast(RULES_TYPE)
    return optional_join(docs, found, ["project"], [key]).withColumn("__rules", F.coalesce("__rules", none))


def with_cast(docs: DataFrame, settings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with `__cast`, a struct of their project's style, names and patterns."""
    casts = compiled_casts(settings)
    found = casts.select("project", F.struct(*[c for c in casts.columns if c != "project"]).alias("__cast"))
    given = optional_join(docs, found, ["project"], [key])
    none = F.struct(*[c.alias(n) for n, c in _no_settings().items()])
    return given.withColumn("__cast", F.coalesce("__cast", none))


def cast_columns(cast: str = "__cast") -> play.Cast:
    return play.Cast(*[F.col(f"{cast}.{c}") for c in ("boxed", "comma", "names", "plain", "speech", "groups")])


def normalise_projects(docs: DataFrame, rules: DataFrame, settings: DataFrame, text: str, out: str,
                       key: str = "doc_id") -> DataFrame:
    """`play.normalise_text` with the rules, style, names and page-number flag of each document's project."""
    df = with_cast(with_rules(docs, rules, key), settings, key).withColumn("__lines", tx.lines(F.col(text)))
    names, given = cast_columns(), F.col("__rules")
    plain, pages = F.col("__cast.style") == "none", F.col("__cast.remove_page_numbers")

    def step(kept: Column) -> DataFrame:
        return df.withColumn("__lines", kept)

    lines = F.col("__lines")
    df = step(F.when(plain & pages, tx.drop_page_numbers(lines, tx.PAGE_NUMBER_PROSE)).otherwise(lines))
    df = step(tx.apply_rules_to_lines(lines, given))
    df = step(F.when(~plain & pages, tx.drop_page_numbers(lines, tx.PAGE_NUMBER_PLAY)).otherwise(lines))
    df = step(F.when(~plain, play.merge_cast_lines(F.transform(lines, tx.strip), names)).otherwise(lines))
    df = step(F.when(~plain, play.format_cast_speeches(lines, names)).otherwise(lines))
    df = step(F.when(~plain, tx.apply_rules_to_lines(lines, given)).otherwise(lines))
    return df.withColumn(out, F.array_join(tx.collapse_blank_lines(lines), "\n")).drop("__lines", "__rules", "__cast")


def parse_projects(docs: DataFrame, settings: DataFrame, text: str, out: str, key: str = "doc_id") -> DataFrame:
    """`play.parse_play` with the cast of each document's project."""
    return play.parse_play(with_cast(docs, settings, key), text, out, cast_columns()).drop("__cast")
