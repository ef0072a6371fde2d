"""Plays: formatting styles, speech and direction parsing, clean-up of extracted lines.

A document is one row, its lines or blocks are an array column, and each step
is a fold or a neighbour comparison over that array, so nothing shuffles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rows import numbered_rows
from lectern.operators.chunking import slices

DIRECTION = "DIDAS"

# Built-in play styles and the names used when a project lists none.
PLAY_STYLES = {
    "modern": r"^__ACTORS__\s*(?:\(([^)]*)\))?\s*[-–—]\s*(.*)$",
    "classic": r"^__ACTORS__\s*\.\s*(.*)$",
    "moliere": r"^\s*__ACTORS__\s*$",
}
DEFAULT_ACTORS = ("EVA", "ALBAN", "JEANNE", "SIMON", "RALPH", "DORINE", "ORGON", "DIDAS")


def names_pattern(names: list[str] | tuple[str, ...]) -> str:
    """Alternation of names in which either apostrophe matches."""
    quoted = [re.sub("['’]", "['’]", re.sub(r"([^\w\s'’])", r"\\\1", n)) for n in names]
    return "|".join(quoted)


def style_pattern(style: str, actors: list[str]) -> tuple[str, int]:
    """Pattern of a play style for these actors and its number of groups; a bad pattern falls back to modern."""
    group = f"({names_pattern(actors)})"
    for template in (style, PLAY_STYLES["modern"]):
        pattern = template.replace("__ACTORS__", group).replace("$ACTORS", group)
        try:
            return f"(?iU)^(?:{pattern})", re.compile(pattern).groups
        except re.error:
            continue
    raise ValueError("no usable play style")


@dataclass(frozen=True)
class Cast:
    """The names of a play as columns, so that each row can have its own.

    `boxed` and `comma` are the patterns of `NAME (direction) …` and `NAME, …`;
    `names` are the names as listed, `plain` with plain apostrophes.  `speech`
    and `groups` are the pattern of the play's style and its number of groups.
    """

    boxed: Column
    comma: Column
    names: Column
    plain: Column
    speech: Column | None = None
    groups: Column | None = None


def head_patterns(names: list[str] | tuple[str, ...]) -> tuple[str, str]:
    """Patterns of a name with a bracketed direction and of a name with a comma."""
    known = names_pattern(names)
    return rf"(?iU)^({known})\s*\(([^)]*)\)\s*(.*)$", rf"(?iU)^({known})\s*,\s*(.*)$"


def plain_name(name: Column) -> Column:
    return F.replace(F.upper(name), F.lit("’"), F.lit("'"))


def merge_speech_lines(array: Column, pattern: str, groups: int, actors: list[str]) -> Column:
    """Join a line to the one before unless it opens a speech or follows a bare name (one-group styles)."""
    known = [a.replace("’", "'") for a in actors]
    named = (lambda x: plain_name(x).isin(*known)) if groups == 1 else None
    return _merged(array, lambda x: x.rlike(pattern), named)


def _merged(array: Column, opens, named) -> Column:
    """Lines joined to the one before, unless `opens(line)` or `named(what was joined so far)`."""

    def step(out: Column, line: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        free = last.isNull() | (last == "") | (line == "") | opens(line)
        if named is not None:
            free = free | named(last)
        body = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(free, F.concat(out, F.array(line))).otherwise(
            F.concat(body, F.array(F.concat(last, F.lit(" "), line))))

    return F.aggregate(array, F.array().cast("array<string>"), step)


def format_speeches(array: Column, pattern: str, groups: int) -> Column:
    """Speech lines → NAME, blank, text, blank; a direction in its own group goes in front in brackets."""
    part = lambda line, n: F.regexp_extract(line, pattern, n) if n <= groups else F.lit("")
    return _formatted(array, lambda x: x.rlike(pattern), part, groups)


def _formatted(array: Column, matches, part, groups: int | Column) -> Column:
    opens = lambda line: matches(line) & (part(line, 1) != "")

    def spoken(line: Column, n: int) -> Column:
        if n == 1:
            return F.array(F.lit(""))
        if n == 2:
            return F.array(tx.strip(part(line, 2)), F.lit(""))
        said = tx.strip(part(line, 3))
        return F.array(F.when(part(line, 2) != "", F.concat(
            F.lit("("), tx.strip(part(line, 2)), F.lit(") "), said)).otherwise(said), F.lit(""))

    def block(line: Column, before: Column) -> Column:
        lead = F.when(before.isNotNull() & (before != "") & ~opens(before), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>"))
        head = F.array(plain_name(part(line, 1)), F.lit(""))
        if isinstance(groups, Column):
            body = F.when(groups >= 3, spoken(line, 3)).when(groups == 2, spoken(line, 2)).otherwise(spoken(line, 1))
        else:
            body = spoken(line, min(groups, 3))
        return F.when(opens(line), F.concat(lead, head, body)).otherwise(F.array(line))

    return F.flatten(tx.with_previous(array, block))


def merge_cast_lines(array: Column, cast: Cast) -> Column:
    """`merge_speech_lines` with the style and names of the row."""
    named = lambda x: (cast.groups == 1) & F.array_contains(cast.plain, plain_name(x))
    return _merged(array, lambda x: F.regexp_instr(x, cast.speech) > 0, named)


def format_cast_speeches(array: Column, cast: Cast) -> Column:
    """`format_speeches` with the style of the row; its pattern has three groups at least, the last ones empty."""
    return _formatted(array, lambda x: F.regexp_instr(x, cast.speech) > 0,
                      lambda line, n: F.call_function("regexp_extract", line, cast.speech, F.lit(n)), cast.groups)


def normalise_text(
    df: DataFrame, text: str, out: str, style: str = "modern", actors: list[str] = (), rules: list[tx.Rule] = (),
    remove_page_numbers: bool = True,
) -> DataFrame:
    """The whole normalisation of one text column.

    Style `none`: page numbers, rules, blank-line runs.  Otherwise: rules, page
    numbers, line merging, speech formatting, rules, blank-line runs.
    """
    lines, rules = "__lines", list(rules)
    df = df.withColumn(lines, tx.lines(F.col(text)))
    if style == "none":
        if remove_page_numbers:
            df = df.withColumn(lines, tx.drop_page_numbers(F.col(lines), tx.PAGE_NUMBER_PROSE))
        df = df.withColumn(lines, tx.apply_rules_to_lines(F.col(lines), rules))
    else:
        names = [a.strip().upper() for a in actors if a.strip()] or list(DEFAULT_ACTORS)
        pattern, groups = style_pattern(PLAY_STYLES.get(style, style), names)
        df = df.withColumn(lines, tx.apply_rules_to_lines(F.col(lines), rules))
        if remove_page_numbers:
            df = df.withColumn(lines, tx.drop_page_numbers(F.col(lines), tx.PAGE_NUMBER_PLAY))
        df = df.withColumn(lines, F.transform(lines, tx.strip))
        df = df.withColumn(lines, merge_speech_lines(F.col(lines), pattern, groups, names))
        df = df.withColumn(lines, format_speeches(F.col(lines), pattern, groups))
        df = df.withColumn(lines, tx.apply_rules_to_lines(F.col(lines), rules))
    return df.withColumn(out, F.array_join(tx.collapse_blank_lines(F.col(lines)), "\n")).drop(lines)


# ---------------------------------------------------------------- speech / direction parser


def blocks(text: Column) -> Column:
    """Blank-line separated blocks, stripped."""
    joined = F.array_join(F.transform(tx.lines(text), lambda x: F.when(tx.strip(x) == "", "").otherwise(x)), "\n")
    parts = F.transform(F.split(joined, rf"(?U)\n{tx.SPACE}*\n"), tx.strip)
    return F.filter(parts, lambda b: b != "")


def classify_block(block: Column, names: list[str] | Cast, strict: bool = False) -> Column:
    """Block → struct(kind, name, rest): heading, inline (name with direction), name or text.

    The strict form knows only `NAME, direction` and compares names exactly.
    """
    heading = block.startswith("ACTE") | block.startswith("SCÈNE")
    if isinstance(names, Cast):
        boxed, comma = names.boxed, names.comma
        listed = lambda x: F.array_contains(names.names, x)
        plainly = lambda x: F.array_contains(names.plain, x)
        # unlike rlike, these keep the last pattern compiled
        fits = lambda p: F.regexp_instr(block, p) > 0
        part = lambda p, n: F.call_function("regexp_extract", block, p, F.lit(n))
    else:
        boxed, comma = head_patterns(names)
        listed = lambda x: x.isin(*names)
        plainly = lambda x: x.isin(*[n.replace("’", "'") for n in names])
        fits = block.rlike
        part = lambda p, n: F.regexp_extract(block, p, n)
    if strict:
        head = F.trim(F.substring_index(block, ",", 1))
        rest = F.trim(F.substring(block, F.instr(block, ",") + 1, F.length(block)))
        inline = block.contains(",") & listed(head)
        full = F.concat(F.upper(F.substring(head, 1, 1)), F.lower(F.substring(head, F.lit(2), F.length(head))), F.lit(", "), rest)
        name, bare = head, listed(block)
        own = block
    else:
        inline = fits(boxed) | fits(comma)
        name = plain_name(F.when(fits(boxed), part(boxed, 1)).otherwise(part(comma, 1)))
        full = F.concat(name, F.lit(", "), F.when(fits(boxed), F.concat(
            F.lit("("), part(boxed, 2), F.lit(") "), part(boxed, 3))).otherwise(part(comma, 2)))
        own = plain_name(block)
        bare = plainly(own)
    nothing = F.lit(None).cast("string")
    make = lambda kind, who, what: F.struct(
        F.lit(kind).alias("kind"), who.alias("name"), what.alias("text"))
    return F.when(heading, make("heading", nothing, block)).when(inline, make("inline", name, full)).when(
        bare, make("name", own, nothing)).otherwise(make("text", nothing, block))


def bracket_parts(text: Column, nested: bool = True) -> Column:
    """Cut a text at its outer brackets → array of struct(direction, text).

    Nesting is counted; a bracket that never closes stays with the tail.
    """
    if nested:
        tokens = F.regexp_extract_all(text, F.lit(r"[^()]+|[()]"), F.lit(0))

        def step(acc: Column, tok: Column) -> Column:
            opens = (tok == "(") & (acc["depth"] == 0)
            closes = (tok == ")") & (acc["depth"] == 1)
            grown = F.concat(acc["cur"], tok)
            depth = acc["depth"] + F.when(tok == "(", 1).when((tok == ")") & (acc["depth"] > 0), -1).otherwise(0)
            return F.struct(
                depth.alias("depth"),
                F.when(opens, tok).when(closes, F.lit("")).otherwise(grown).alias("cur"),
                F.when(opens, F.concat(acc["parts"], F.array(acc["cur"]))).when(
                    closes, F.concat(acc["parts"], F.array(grown))).otherwise(acc["parts"]).alias("parts"))

        zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"),
                        F.array().cast("array<string>").alias("parts"))
        parts = F.aggregate(tokens, zero, step, lambda acc: F.concat(acc["parts"], F.array(acc["cur"])))
    else:
        parts = F.split(F.regexp_replace(text, r"(\([^)]*\))", "\x01$1\x01"), "\x01")
    clean = F.filter(F.transform(parts, tx.strip), lambda p: p != "")
    return F.transform(clean, lambda p: F.struct(
        (p.startswith("(") & p.endswith(")")).alias("direction"), p.alias("text")))


def parse_play(df: DataFrame, text: str, out: str, names: list[str] | Cast, strict: bool = False) -> DataFrame:
    """Play text → array of struct(speaker, text).

    A heading clears the speaker, a name sets it; text without a speaker is a
    direction; a speaker's plain blocks alternate speech / direction, starting
    with speech after a name or direction.
    """
    empty = F.array().cast("array<struct<speaker:string,text:string>>")
    row = lambda who, what: F.struct(who.alias("speaker"), what.alias("text"))

    def step(acc: Column, b: Column) -> Column:
        body = b["text"] if strict else tx.strip(F.array_join(tx.lines(b["text"]), " "))
        actor, said = acc["actor"], acc["said"]
        split = body.contains("(") & body.contains(")")
        parts = bracket_parts(body, nested=not strict)
        pieces = F.transform(parts, lambda p: row(F.when(p["direction"], F.lit(DIRECTION)).otherwise(actor), p["text"]))
        last_spoken = ~F.coalesce(F.try_element_at(parts, F.lit(-1))["direction"], ~said)
        plain = (b["kind"] == "text") & actor.isNotNull()
        rows = F.when(b["kind"] == "name", empty).when(~plain, F.array(row(F.lit(DIRECTION), b["text"]))).when(
            split, pieces).otherwise(F.array(row(F.when(said, F.lit(DIRECTION)).otherwise(actor), body)))
        return F.struct(
            F.when(b["kind"] == "heading", F.lit(None)).otherwise(F.coalesce(b["name"], actor)).cast("string")
            .alias("actor"),
            F.when(~plain & (b["kind"] != "text"), False).when(plain & split, last_spoken).when(plain, ~said)
            .otherwise(said).alias("said"),
            F.concat(acc["out"], rows).alias("out"))

    zero = F.struct(F.lit(None).cast("string").alias("actor"), F.lit(False).alias("said"), empty.alias("out"))
    kinds = df.withColumn("__b", F.transform(blocks(F.col(text)), lambda b: classify_block(b, names, strict)))
    return kinds.withColumn(out, F.aggregate("__b", zero, step, lambda acc: acc["out"])).drop("__b")


def block_speakers(df: DataFrame, text: str, key: str, names: list[str] | Cast) -> DataFrame:
    """Kind of every block and the speaker in force after it."""
    kinds = df.select(key, F.transform(blocks(F.col(text)), lambda b: classify_block(b, names)).alias("b"))

    def step(acc: Column, b: Column) -> Column:
        who = F.when(b["kind"] == "heading", F.lit("")).otherwise(F.coalesce(b["name"], acc["who"]))
        return F.struct(who.alias("who"), F.concat(acc["out"], F.array(F.struct(
            b["kind"].alias("kind"), F.nullif(who, F.lit("")).alias("speaker")))).alias("out"))

    zero = F.struct(F.lit("").alias("who"),
                    F.array().cast("array<struct<kind:string,speaker:string>>").alias("out"))
    walked = kinds.withColumn("w", F.aggregate("b", zero, step, lambda acc: acc["out"]))
    return numbered_rows(walked, [key], "w", "block_no", "r").select(key, "block_no", "r.*")


# ---------------------------------------------------------------- line clean-up


def split_name(line: Column, names: list[str]) -> Column:
    """`NAME` or `NAME rest` → struct(name, rest); both NULL for other lines.  The first listed name wins."""
    bare = tx.strip(line)
    out = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("rest"))
    for n in reversed(names):
        rest = F.when(bare != n, tx.strip(F.substring(bare, F.lit(len(n) + 2), F.length(bare))))
        out = F.when((bare == n) | bare.startswith(n + " "),
                     F.struct(F.lit(n).alias("name"), rest.alias("rest"))).otherwise(out)
    return out


def drop_repeats(array: Column) -> Column:
    """Neighbouring lines that differ only in case are kept once; blank lines are dropped."""
    kept = F.filter(F.transform(array, tx.strip), lambda x: x != "")
    marked = tx.with_previous(kept, lambda x, p: F.when(p.isNull() | (F.lower(x) != F.lower(p)), x))
    return F.array_compact(marked)


# Words that mark a line as a stage direction.
DIRECTION_WORDS = ("un temps", "regarde", "geste", "silence", "entre", "sort", "sursaute", "regardant", "à voix basse",
                   "ironiquement", "doucement", "embarrassée", "se met à rire")
TAG = "[DIDASCALIE]"


def is_direction(line: Column, names: list[str]) -> Column:
    """Short bracketed line, `NAME,`, a direction word or a lower-case start — but never a scene title."""
    bare = tx.strip(line)
    title = (bare == "SCÈNE") | bare.startswith("SCÈNE ")
    named = F.lit(False)
    for n in names:
        named = named | bare.startswith(n + ",")
    first = F.substring(bare, 1, 1)
    lower_start = (first == F.lower(first)) & (first != F.upper(first))
    return ~title & (
        (bare.startswith("(") & bare.endswith(")") & (F.length(bare) < 40)) | named
        | F.lower(bare).rlike("|".join(DIRECTION_WORDS)) | lower_start)


def merge_scene_titles(array: Column) -> Column:
    """A lone `SCÈNE` takes the first word of the next non-blank line; what is left becomes a line of its own."""
    flat = lambda x: tx.strip(F.replace(x, F.lit("\xa0"), F.lit(" ")))
    kept = F.filter(array, lambda x: flat(x) != "")

    def step(acc: Column, x: Column) -> Column:
        line = flat(x)
        word = F.regexp_extract(line, r"^(\S+)", 1)
        rest = tx.strip(F.substring(line, F.length(word) + 1, F.length(line)))
        title = F.array(F.concat(F.lit("SCÈNE "), word))
        joined = F.when(rest == "", title).otherwise(F.concat(title, F.array(rest)))
        waits = ~acc["open"] & (line == "SCÈNE")
        return F.struct(waits.alias("open"), F.concat(acc["out"], F.when(acc["open"], joined).when(
            waits, F.array().cast("array<string>")).otherwise(F.array(x))).alias("out"))

    zero = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))
    # A title with nothing after it stays as it was.
    return F.aggregate(kept, zero, step, lambda acc: F.when(
        acc["open"], F.concat(acc["out"], F.array(F.lit("SCÈNE")))).otherwise(acc["out"]))


def dedupe_directions(array: Column, names: list[str] | tuple[str, ...] = ()) -> Column:
    """Tagged directions against the last three kept lines: equal or contained → dropped, containing → replaces.

    A direction `NAME, text` of a listed name first puts out the name and the
    bare direction; the line itself, which contains it, then takes its place.
    """
    body_of = lambda x: tx.strip(F.regexp_replace(tx.strip(x), r"^\[DIDASCALIE\]", ""))
    norm = lambda x: F.replace(F.lower(body_of(x)), F.lit("  "), F.lit(" "))
    item = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("line"), norm(x).alias("norm"))

    def items(raw: Column) -> Column:
        line = tx.strip(raw)
        own = F.array(F.when(line.startswith(TAG), item("tagged", line)).otherwise(item("plain", line)))
        out = own
        for n in reversed(names):
            bare = F.concat(F.lit(TAG + " "), tx.strip(F.substring(body_of(line), F.lit(len(n) + 2), F.length(line))))
            out = F.when(line.startswith(TAG) & body_of(line).startswith(n + ","), F.concat(
                F.array(item("name", F.lit(n)), item("bare", bare)), own)).otherwise(out)
        return out

    def step(acc: Column, x: Column) -> Column:
        out, mine, line = acc["out"], x["norm"], x["line"]
        tail = F.slice(out, F.greatest(F.size(out) - 2, F.lit(1)), 3)
        near = F.filter(tail, lambda p: p.startswith(TAG) & (norm(p).contains(mine) | mine.contains(norm(p))))
        first = F.try_element_at(near, F.lit(1))
        same = acc["last"].eqNullSafe(mine)
        body = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        fresh = (x["kind"] == "bare") | ((x["kind"] == "tagged") & ~same & first.isNull())
        return F.struct(
            F.when(x["kind"] == "plain", F.lit(None).cast("string")).when(fresh, mine).otherwise(acc["last"]).alias("last"),
            F.when(x["kind"].isin("plain", "name") | fresh, F.concat(out, F.array(line))).when(
                same | norm(first).contains(mine), out).otherwise(F.concat(body, F.array(line))).alias("out"))

    zero = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.flatten(F.transform(array, items)), zero, step, lambda acc: acc["out"])


def join_broken_lines(df: DataFrame, lines: str, out: str) -> DataFrame:
    """Lines are collected until one ends a sentence; a tagged direction stands alone."""
    closes = lambda x: x.rlike(r"[.!?…]$|\.\)$")
    opens = df.withColumn("__s", tx.indexes(tx.with_previous(
        F.col(lines), lambda x, p: p.isNull() | closes(p) | p.startswith(TAG) | x.startswith(TAG))))
    return opens.withColumn(out, F.transform(
        slices(F.col(lines), F.col("__s")), lambda xs: tx.strip(F.array_join(xs, " ")))).drop("__s")


def italic_runs(spans: Column) -> Column:
    """Spans `array<struct<text, is_italic>>` of one document → text with italics in brackets.

    A blank span is italic only between two italic neighbours; runs of one
    style are merged before wrapping.
    """
    blank = lambda s: tx.strip(s["text"]) == ""

    def forward(acc: Column, s: Column) -> Column:
        style = F.when(blank(s), acc["style"]).otherwise(F.coalesce(s["is_italic"], F.lit(False)))
        return F.struct(style.alias("style"), F.concat(acc["out"], F.array(style)).alias("out"))

    zero = F.struct(F.lit(False).alias("style"), F.array().cast("array<boolean>").alias("out"))
    before = F.aggregate(spans, zero, forward, lambda acc: acc["out"])
    after = F.reverse(F.aggregate(F.reverse(spans), zero, forward, lambda acc: acc["out"]))
    # For a span with text both sides equal its own style.
    styled = F.zip_with(spans, F.zip_with(before, after, lambda a, b: a & b), lambda s, i: F.struct(
        s["text"].alias("text"), i.alias("italic")))

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        body = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(last["italic"].eqNullSafe(s["italic"]), F.concat(body, F.array(F.struct(
            F.concat(last["text"], s["text"]).alias("text"), s["italic"].alias("italic"))))).otherwise(
            F.concat(acc, F.array(s)))

    runs = F.aggregate(styled, F.array().cast("array<struct<text:string,italic:boolean>>"), merge)
    wrapped = F.transform(runs, lambda r: F.when(r["italic"] & (tx.strip(r["text"]) != ""), F.regexp_replace(
        r["text"], r"(?sU)^(\s*)(.*?)(\s*)$", "$1($2)$3")).otherwise(r["text"]))
    whole = F.array_join(wrapped, "")
    whole = F.regexp_replace(whole, r"(?U)\(\s*\(\s*(.*?)\s*\)\s*\)", "($1)")
    whole = F.regexp_replace(whole, r"[ \t]*\([ \t]*", " (")
    return F.regexp_replace(whole, r"[ \t]*\)[ \t]*", ") ")
