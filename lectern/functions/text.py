"""Scalar text functions as column expressions.  Everything runs in the JVM."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException, SparkRuntimeException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters a Python-style `strip()` removes.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Unicode-aware white space for patterns; put `(?U)` in front of the pattern.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


#: The signs of `SPACE` written out, a blank last: a plain class is tested faster than a Unicode property.
_SPACES = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000 "


def squeeze(c: Column) -> Column:
    """Runs of white space → one space, ends stripped; a single blank, the usual case, is no match."""
    return strip(F.regexp_replace(c, f"[{_SPACES[:-1]}][{_SPACES}]*| [{_SPACES}]+", " "))


def is_blank(c: Column) -> Column:
    """Nothing but white space; reads no further than the first other sign."""
    return F.ltrim(c, F.lit(BLANKS)) == ""


def lines(text: Column) -> Column:
    """Text → array of lines; a final line break does not open an empty last line."""

    def without_last(parts: Column) -> Column:
        return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    # The parts are the variable of a lambda, so that a text is split once and not once per mention.
    return F.get(F.transform(F.array(F.split(text, _LINE_BREAK)), without_last), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(text, f"(?U){SPACE}+"), lambda w: w != "")


def is_upper(c: Column) -> Column:
    """At least one cased letter and no lower-case one."""
    return (c == F.upper(c)) & (c != F.lower(c))


def with_previous(array: Column, fn) -> Column:
    """`fn(element, previous)` over an array; the first element sees NULL."""
    shifted = F.slice(F.concat(F.array(F.lit(None)), array), 1, F.size(array))
    return F.zip_with(array, shifted, fn)


def with_next(array: Column, fn) -> Column:
    """`fn(element, next)` over an array; the last element sees NULL."""
    shifted = F.slice(F.concat(array, F.array(F.lit(None))), 2, F.size(array))
    return F.zip_with(array, shifted, fn)


def indexes(flags: Column) -> Column:
    """0-based positions at which a boolean array is true."""
    return F.array_compact(F.transform(flags, lambda f, i: F.when(f, i)))


# ---------------------------------------------------------------- user rules


@dataclass(frozen=True)
class Rule:
    """One search/replace rule as users write it."""

    search: str
    replace: str = ""
    active: bool = True


@dataclass(frozen=True)
class CompiledRule:
    pattern: str
    replacement: str


def compile_rule(rule: Rule) -> CompiledRule | None:
    """`translate_rule`, and None also for a pattern that the JVM cannot run."""
    done = translate_rule(rule)
    return done if done and _runs_in_java(done.pattern) else None


def translate_rule(rule: Rule) -> CompiledRule | None:
    """Translate one user rule for Spark; None when it is inactive, empty or not a valid pattern.

    `/pattern/flags` honours `i` and `m`; other text is a pattern if it is a
    valid one, else a literal.  In the replacement `$1` and `\\1` name groups,
    a group that does not exist stays as written, `\\n` is a line break.
    """
    if not rule.active or not rule.search:
        return None
    text, flags = rule.search, ""
    if text.startswith("/") and "/" in text[1:]:
        text, _, tail = text[1:].rpartition("/")
        flags = "".join(f for f in "im" if f in tail)
        groups = _group_count(text)
        if groups is None:
            return None
    else:
        groups = _group_count(text)
        if groups is None:
            text, groups = re.escape(text), 0
    # Unicode classes cost time, so they are asked for only by patterns that use a class.
    flags = flags.replace("i", "iu") + ("U" if re.search(r"\\[wWdDsSbB]", text) else "")
    pattern = (f"(?{flags})" if flags else "") + _java_pattern(text)
    return CompiledRule(pattern, _java_replacement(rule.replace, groups))


def java_pattern_ok(pattern: Column) -> Column:
    """Whether the JVM can compile a pattern that is data."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


_PROBED: dict[str, bool] = {}
_TOKENS = re.compile(r"""
    (?P<escape>\\.) | (?P<name>\(\?P<) | (?P<back>\(\?P=(?P<to>\w+)\))
    | (?P<count>\{(?P<low>\d*)(?P<comma>,?)(?P<high>\d*)\}) | (?P<brace>[{}]) | (?P<open>\[\^?\]?) | (?P<rest>.)
""", re.VERBOSE | re.DOTALL)


def _java_pattern(pattern: str) -> str:
    """The same pattern in Java's dialect: literal braces, open counts, and signs that only Java knows in a class."""
    out, in_class = [], False
    for m in _TOKENS.finditer(pattern):
        sign = m[0]
        if m["escape"]:
            out.append(sign)
        elif in_class:
            in_class = sign != "]"
            for c in sign:
                out.append("\\" + c if c in "[&" else c)
        elif m["open"]:
            in_class = True
            out.append(sign[:-1] + "\\]" if sign.endswith("]") else sign)
        elif m["name"]:
            out.append("(?<")
        elif m["back"]:
            out.append(rf"\k<{m['to']}>")
        elif m["count"] and (m["low"] or m["comma"]):
            out.append(f"{{{m['low'] or 0}{m['comma']}{m['high']}}}")
        elif m["count"] or m["brace"]:
            out.append(re.sub(r"[{}]", r"\\\g<0>", sign))
        else:
            out.append(sign)
    return "".join(out)


def _runs_in_java(pattern: str) -> bool:
    """Ask the JVM's own compiler; without a session there is nobody to ask."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    if pattern not in _PROBED:
        try:  # constants only: the planner computes this, no job runs
            spark.sql("SELECT regexp_replace('', :pattern, '')", args={"pattern": pattern}).collect()
            _PROBED[pattern] = True
        except (SparkRuntimeException, IllegalArgumentException, ParseException, AnalysisException):
            _PROBED[pattern] = False
    return _PROBED[pattern]


def _group_count(pattern: str) -> int | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # signs that other dialects read differently
            return re.compile(pattern).groups
    except re.error:
        return None


def _java_replacement(template: str, groups: int) -> str:
    out, after_group = [], False
    for piece in re.split(r"([$\\]\d+)", template.replace("\\n", "\n")):
        if re.fullmatch(r"[$\\]\d+", piece) and int(piece[1:]) <= groups:
            out.append(f"${int(piece[1:])}")
            after_group = True
            continue
        for ch in piece:
            # A backslash makes any character literal, also a digit right after a group.
            out.append("\\" + ch if ch in "\\$" or (after_group and ch.isdigit()) else ch)
            after_group = False
    return "".join(out)


def apply_rules(line: Column, rules: list[Rule]) -> Column:
    """Apply the rules in order to one line; bad rules are skipped."""
    for rule in filter(None, map(compile_rule, rules)):
        line = F.regexp_replace(line, F.lit(rule.pattern), F.lit(rule.replacement))
    return line


def apply_rules_to_lines(array: Column, rules: list[Rule] | Column) -> Column:
    """Rules over an array of lines.

    A line with text that becomes blank is dropped, a blank line stays, and
    line breaks made by a rule cut the line again.  Rules that differ by row are
    a column `array<struct<pattern, replacement>>`; each is compiled once per row.
    """
    had = lambda x: (~is_blank(x)).alias("had")
    if isinstance(rules, Column):
        now = F.aggregate(rules, array, lambda xs, r: F.transform(
            xs, lambda x: F.regexp_replace(x, r["pattern"], r["replacement"])))
        done = F.zip_with(array, now, lambda x, y: F.struct(had(x), y.alias("now")))
    elif not any(map(compile_rule, rules)):
        return array
    else:
        done = F.transform(array, lambda x: F.struct(had(x), apply_rules(x, rules).alias("now")))
    kept = F.filter(done, lambda r: ~(r["had"] & is_blank(r["now"])))
    return F.flatten(F.transform(kept, lambda r: F.when(
        ~r["now"].rlike(_LINE_BREAK), F.array(r["now"])).otherwise(lines(r["now"]))))


# ---------------------------------------------------------------- line filters

#: What a page number looks like in prose and in plays.
PAGE_NUMBER_PROSE = (r"(?U)^\d+$", rf"(?U)^[-–—]?{SPACE}*\d+{SPACE}*[-–—]?$", rf"(?Ui)^(page|p\.){SPACE}*\d+$")
PAGE_NUMBER_PLAY = (r"(?U)^\d+$", rf"(?U)^\d+\.{SPACE}+.*$")


def is_page_number(line: Column, patterns: tuple[str, ...]) -> Column:
    bare = strip(line)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | bare.rlike(p)
    return hit


def drop_page_numbers(array: Column, patterns: tuple[str, ...]) -> Column:
    return F.filter(array, lambda x: ~is_page_number(x, patterns))


def collapse_blank_lines(array: Column) -> Column:
    """Runs of empty lines → one."""
    marked = with_previous(array, lambda x, p: F.when(~((x == "") & p.eqNullSafe(F.lit(""))), x))
    return F.array_compact(marked)


def collapse_blank_lines_loose(array: Column) -> Column:
    """Runs of blank lines → one, counting white space as blank and dropping leading ones."""
    marked = with_previous(
        array, lambda x, p: F.when(~((strip(x) == "") & (p.isNull() | (strip(p) == ""))), x))
    return F.array_compact(marked)


def join_hyphens(text: Column) -> Column:
    """Words broken over a line end are put together again."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(unix, r"(?U)(\w)-\n(\w)", "$1$2")


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, each unwrapped to one line."""
    joined = F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: strip(F.regexp_replace(
        F.regexp_replace(p, rf"(?U){SPACE}*\n{SPACE}*", " "), r"[ \t]{2,}", " ")))
    return F.filter(joined, lambda p: p != "")


# ---------------------------------------------------------------- single values


def closed_for_speech(text: Column) -> Column:
    """End a text with terminal punctuation so that synthesis does not wait for more."""
    bare = strip(text)
    cut = F.regexp_replace(bare, rf"(?U)[{SPACE[1:-1]}:;,\-–—«»\"“”'’]+$", "")
    return F.when(cut == "", bare).when(F.right(cut, F.lit(1)).isin(".", "!", "?", "…"), cut).otherwise(
        F.concat(cut, F.lit(".")))


def without_direction_brackets(speaker: Column, text: Column) -> Column:
    """Stage directions lose one enclosing pair of brackets."""
    bare = strip(text)
    boxed = (speaker == "DIDAS") & bare.startswith("(") & bare.endswith(")")
    return F.when(boxed, strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(text)


def clean_segment(text: Column) -> Column:
    """Braces → space, no guillemets or double quotes, no leading dialogue dash, white space squeezed."""
    t = F.translate(text, "{}", "  ")
    t = F.regexp_replace(t, '[«»"]', "")
    t = F.regexp_replace(t, rf"(?U)^{SPACE}*[—–]{SPACE}*", "")
    return squeeze(t)


def comparison_form(text: Column) -> Column:
    """Only the words: quotes and dashes → space, squeezed, lower case."""
    return F.lower(squeeze(F.regexp_replace(text, '[«»"‘’–—]', " ")))


def comparison_words(text: Column) -> Column:
    """Lower-case words with quotes, brackets, dashes and punctuation removed."""
    return words(F.lower(F.regexp_replace(text, r"[«»\"{}()\[\]…—–\-.,;:!?’']", " ")))


def preview(text: Column, length: int = 140) -> Column:
    return F.substring(squeeze(text), 1, length)


def fingerprint(content: Column, text: Column) -> Column:
    """MD5 over audio bytes followed by the text's UTF-8 bytes."""
    return F.md5(F.concat(content, F.encode(text, "UTF-8")))


def minutes_seconds(seconds: Column) -> Column:
    """`m:ss`, fractions cut."""
    whole = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def file_size(size: Column) -> Column:
    """Bytes in the largest fitting unit, at most two decimals, trailing zeros removed."""
    out = F.lit(None)
    for power, unit in enumerate(("Bytes", "KB", "MB", "GB")):
        value = F.floor(size / F.lit(1024.0**power) * 100 + 0.5) / 100
        shown = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
        out = F.when(size >= 1024**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.when(size == 0, "0 Bytes").otherwise(out)


#: Engine keys and how they are shown.
ENGINE_NAMES = {"qwen": "Qwen", "luxtts": "LuxTTS", "chatterbox": "Chatterbox", "chatterbox_turbo": "Chatterbox Turbo"}


def engine_label(engine: Column, model_size: Column) -> Column:
    """Display name; only one engine family shows its model size."""
    known = F.create_map(*[F.lit(x) for kv in ENGINE_NAMES.items() for x in kv])
    name = F.coalesce(F.try_element_at(known, F.coalesce(engine, F.lit("qwen"))), engine, F.lit("Qwen"))
    return F.when((engine == "qwen") & (F.coalesce(model_size, F.lit("")) != ""),
                  F.concat(name, F.lit(" "), model_size)).otherwise(name)


def utc_instant(text: Column) -> Column:
    """Timestamp text; without a zone it is UTC.  The session zone must be UTC."""
    return F.try_to_timestamp(strip(text))
