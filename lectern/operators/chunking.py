"""Documents → sentences → chunks.

Every job here works inside one document row and only explodes the result, so
none of them shuffles and no document waits for another.  Array columns that
are used more than once are materialised with their own `withColumn`, so that
a split is evaluated once per document.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.functions.rows import numbered_rows

# ---------------------------------------------------------------- slicing and packing


def slices(array: Column, starts: Column) -> Column:
    """Cut `array` at the 0-based `starts` → array of arrays (what lies before the first start is left out)."""
    return tx.with_next(starts, lambda s, n: F.slice(array, s + 1, F.coalesce(n, F.size(array)) - s))


def pack(df: DataFrame, parts: str, out: str, limit: int, separator: str = " ") -> DataFrame:
    """Greedily join neighbouring `parts` while the result stays within `limit` characters.

    A part longer than the limit stands alone.  The fold carries lengths and
    the start of each chunk only; text is joined once, afterwards.
    """
    gap = len(separator)

    def step(acc: Column, part: Column) -> Column:
        grown = acc["length"] + gap + F.length(part)
        opens = (acc["index"] == 0) | (grown > limit)
        return F.struct(
            F.when(opens, F.length(part)).otherwise(grown).alias("length"),
            (acc["index"] + 1).alias("index"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["index"]))).otherwise(acc["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).alias("length"), F.lit(0).alias("index"),
                    F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(parts, zero, step, lambda acc: acc["starts"])
    packed = df.withColumn("__starts", starts)
    joined = F.transform(slices(F.col(parts), F.col("__starts")), lambda xs: F.array_join(xs, separator))
    return packed.withColumn(out, joined).drop("__starts")


def explode_chunks(df: DataFrame, keys: list[str], chunks: str) -> DataFrame:
    """One row per chunk, numbered from 0."""
    return numbered_rows(df, keys, chunks, "chunk_no", "text")


# ---------------------------------------------------------------- sentences

#: The cut points of the three sentence splitters.
_SENTENCE_STRICT = (
    r"(?U)(?<!\b[A-Za-zÀ-ÿ]\.)(?<!\bMme\.)(?<!\bMlle\.)(?<!\bDr\.)(?<!\betc\.)(?<=[.!?…])\s+"
)
_SENTENCE_LEGACY = r"(?U)(?<=[.!?;])\s+"
_CAPITAL_WORD = r"^[A-ZÀ-Ÿ][a-zà-ÿ]"
_CAPITAL_WORD_ASCII = r"^[A-Z][a-z]"
#: Abbreviations whose point ends no sentence (found anywhere in a word).
PROTECTED = (
    "M.", "MM.", "Mme.", "Mmes.", "Mlle.", "Mlles.", "Dr.", "Pr.", "Me.", "Mr.", "Mrs.", "Ms.", "St.", "Ste.",
    "etc.", "cf.", "p.", "pp.", "vol.", "chap.", "fig.", "art.", "No.", "n°.", "av.", "apr.", "J.-C.", "op.", "éd.",
)


def _alternatives(abbreviations: tuple[str, ...]) -> str:
    return "|".join(a[:-1].replace(".", r"\.") for a in abbreviations)


def merge_ellipses(parts: Column, capital: str) -> Column:
    """Join a sentence that ends in `…` with the next one unless that starts with a capitalised word.

    A joined pair is not looked at again.
    """

    def step(acc: Column, nxt: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        joins = acc["open"] & last.endswith("…") & (nxt != "") & ~nxt.rlike(capital)
        body = F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        joined = F.concat(body, F.array(F.concat(last, F.lit(" "), nxt)))
        grown = F.when(nxt == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(nxt)))
        return F.struct(F.when(joins, joined).otherwise(grown).alias("out"), (~joins & (nxt != "")).alias("open"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))
    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def sentences_strict(df: DataFrame, text: str, out: str) -> DataFrame:
    """Cut after `.!?…` but not after initials and titles; ellipses are merged."""
    cut = df.withColumn("__parts", F.transform(F.split(tx.strip(F.col(text)), _SENTENCE_STRICT), tx.strip))
    return cut.withColumn(out, merge_ellipses(F.col("__parts"), _CAPITAL_WORD)).drop("__parts")


def sentences_legacy(df: DataFrame, text: str, out: str) -> DataFrame:
    """Older splitter: cut after `.!?;`, ASCII capitals for the ellipsis test."""
    cut = df.withColumn("__parts", F.transform(F.split(tx.strip(F.col(text)), _SENTENCE_LEGACY), tx.strip))
    return cut.withColumn(out, merge_ellipses(F.col("__parts"), _CAPITAL_WORD_ASCII)).drop("__parts")


def sentences(text: Column) -> Column:
    """Cut after `.!?…` and an optional closer when a capital, digit, opener or dash follows."""
    # The point comes first in the pattern, so the look-behind runs at points only and not at every character.
    shielded = F.regexp_replace(text, rf"\.(?<=(?:{_alternatives(PROTECTED)})\.)", "\x00")
    cut = F.regexp_replace(
        shielded, rf"(?U)([.!?…]+[\"»”'\)\]]?){tx.SPACE}+(?=[«\"“\(\[A-ZÀ-ÖØ-Þ0-9—–-])", "$1\n")
    parts = F.transform(F.split(F.replace(cut, F.lit("\x00"), F.lit(".")), "\n"), tx.strip)
    return F.filter(parts, lambda s: s != "")


_STRONG_END = r"[.!?…\"»”\)\]]$"


def repair_paragraphs(df: DataFrame, parts: str, out: str) -> DataFrame:
    """Join a paragraph to the one before unless that one ends a sentence (and not with an abbreviation)."""
    closed = lambda p: p.rlike(_STRONG_END) & ~p.rlike(rf"(?:{_alternatives(PROTECTED)})\.$")
    opens = df.withColumn("__starts", tx.indexes(tx.with_previous(
        F.col(parts), lambda x, p: p.isNull() | closed(p))))
    return opens.withColumn(out, F.transform(
        slices(F.col(parts), F.col("__starts")), lambda xs: F.array_join(xs, " "))).drop("__starts")


# ---------------------------------------------------------------- position-based chunkers

#: Abbreviations and closing quotes of the prose and the play chunker.
PROSE_ABBREVIATIONS = ("M.", "MM.", "Mme.", "Mlle.", "Mr.", "Mrs.", "Ms.", "Dr.", "Pr.", "St.", "Ste.", "etc.", "cf.",
                       "J.-C.")
PROSE_CLOSERS = "»”\"’'"
PLAY_ABBREVIATIONS = ("M.", "Mme.", "Mlle.", "Dr.", "etc.")
PLAY_CLOSERS = "»”\""


def _ends_sentence(abbreviations: tuple[str, ...]) -> str:
    """What must hold just after a terminator: no abbreviation and no single initial before it."""
    return rf"(?<!(?:{_alternatives(abbreviations)})\.)(?<!\b[A-Za-zÀ-ÿ]\.)"


def prose_chunks(text: Column, low: int = 400, high: int = 500) -> Column:
    """Strict prose chunks as one ordered pattern.

    Each alternative is one tier of the search, a greedy count gives the
    rightmost cut inside the tier, and consecutive matches are the chunks.
    """
    ok = _ends_sentence(PROSE_ABBREVIATIONS)
    quote = rf"[ \x{{A0}}]{{0,3}}[{PROSE_CLOSERS}]"
    tier = lambda a, b: rf".{{{a},{b - 1}}}[.!?]{ok}(?:{quote})?"
    near = max(0, low - 200)
    early = [tier(1, near), rf"[.!?]{ok}{quote}"] if near > 1 else []
    pattern = "|".join([
        rf".{{1,{high}}}\z", tier(low, high), tier(near, low), tier(high, high + 150), *early,
        rf".{{{low},{high - 1}}} ", rf".{{{high + 1}}}",
    ])
    return _matches(text, pattern)


def play_chunks(text: Column, low: int = 250, high: int = 400) -> Column:
    """Play chunks: `.!?`, else `:`, else `,`, else a space, else a hard cut.

    Only the last terminator of the window is tested as a full stop; if it is
    an abbreviation or initial, full stops are given up for `!` and `?`.
    """
    window = rf".{{{low},{high - 1}}}"
    quote = rf"(?: {{0,2}}[{PLAY_CLOSERS}])?"
    pattern = "|".join([
        rf".{{1,{high}}}\z", rf"(?>{window}[.!?]){_ends_sentence(PLAY_ABBREVIATIONS)}{quote}",
        rf"{window}[!?]{quote}", rf"{window}:{quote}", rf"{window},{quote}", rf"{window} ", rf".{{{high + 1}}}",
    ])
    return _matches(text, pattern)


def _matches(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(tx.strip(text), F.lit(rf"(?sU)\G{tx.SPACE}*({pattern})"), F.lit(1))
    return F.filter(F.transform(found, tx.strip), lambda c: c != "")


def flat_text(text: Column) -> Column:
    """Non-blank lines, stripped and joined by a space."""
    return F.array_join(F.filter(F.transform(tx.lines(text), tx.strip), lambda x: x != ""), " ")


def attribution_chunks(df: DataFrame, text: str, out: str, limit: int = 2000) -> DataFrame:
    """Chunks of whole paragraphs; with one paragraph only, of lines; long paragraphs are cut at sentence ends."""
    clean = lambda a: F.filter(F.transform(a, tx.strip), lambda p: p != "")
    paras = df.withColumn("__p", clean(F.split(F.col(text), rf"(?U)\n{tx.SPACE}*\n")))
    units = paras.withColumn("__p", F.when(F.size("__p") <= 1, clean(tx.lines(F.col(text)))).otherwise(F.col("__p")))
    units = units.withColumn("__u", F.flatten(F.transform("__p", lambda p: F.when(
        F.length(p) > limit, packed_sentences(p, limit)).otherwise(F.array(p)))))
    return pack(units, "__u", out, limit, "\n\n").drop("__p", "__u")


def packed_sentences(paragraph: Column, limit: int) -> Column:
    """One long paragraph → sentence groups within the limit, inside a lambda (no columns can be added there)."""
    parts = F.split(paragraph, rf"(?U)(?<=[.!?…»\"]){tx.SPACE}+")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.length(last) + 1 + F.length(s) <= limit
        body = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.size(acc) == 0, F.array(s)).when(
            fits, F.concat(body, F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


# Abbreviations the long-form splitter skips (dotted ones can never match a run of letters).
LONG_FORM_ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "ave", "blvd", "inc", "ltd", "corp", "dept", "est", "approx",
    "vs", "etc", "e.g", "i.e", "a.m", "p.m", "u.s", "u.s.a", "u.k",
)


#: A run of letters and digits, and the stop behind it.
_WIDE = "。！？"
_STOP = re.compile(rf"(?<![^\W_])[^\W_]*+[.!?]|[{_WIDE}]")
_CLAUSE_MARK = re.compile("[;:,—]")
_TAG = re.compile(r"\[[^\]]*\]")


def _is_sentence_end(run: str, sign: str) -> bool:
    """A full stop doesn't end a sentence behind an abbreviation, a number, or letters that follow a number."""
    letters = run.lstrip(string.digits) if run.isascii() else re.sub(r".*\d", "", run)
    return sign != "." or not (any(map(str.isdigit, run)) or letters.lower() in LONG_FORM_ABBREVIATIONS)


class _Marks:
    """Where one text may be cut, found once; a chunk asks for the last place before its end."""

    def __init__(self, text: str):
        self.text = text
        self.tags = [m.span() for m in _TAG.finditer(text)]
        self.tag_starts = [a for a, _ in self.tags]
        #: Each stop with the start of the letters and digits before it, which tell whether it ends a sentence.
        self.runs = {m.end() - 1: m.start() for m in _STOP.finditer(text)}
        self.stops = list(self.runs)
        self.clauses = [m.start() for m in _CLAUSE_MARK.finditer(text)]

    def _may_end(self, at: int, start: int, end: int) -> bool:
        if self.text[at] in _WIDE:
            return True
        if at in self.runs and not _is_sentence_end(self.text[max(start, self.runs[at]):at], self.text[at]):
            return False
        tag = bisect_right(self.tag_starts, at) - 1
        if tag >= 0 and start <= self.tags[tag][0] and at < self.tags[tag][1] <= end:
            return False
        return at == end - 1 or at + 1 == len(self.text) or self.text[at + 1].isspace()

    def cut(self, start: int, end: int) -> int:
        """The end of the chunk from `start`: behind a sentence, a clause or a blank, else at `end` or before a tag."""
        for marks in (self.stops, self.clauses):
            for k in range(bisect_left(marks, end) - 1, -1, -1):
                if marks[k] < start:
                    break
                if self._may_end(marks[k], start, end):
                    return marks[k] + 1
        blank = self.text.rfind(" ", start, end)
        if blank >= 0:
            return blank + 1
        tag = bisect_right(self.tag_starts, end - 2) - 1
        return self.tags[tag][0] if tag >= 0 and self.tags[tag][1] == end and self.tags[tag][0] > start else end


def long_form_chunks(limit: int = 800):
    """Arrow UDF: text → chunks of at most `limit` characters that never cut inside a `[tag]` that fits one."""

    def chunks(text: str | None) -> list[str]:
        text = (text or "").strip()
        marks, out, at = _Marks(text) if len(text) > limit else None, [], 0
        while len(text) - at > limit:
            end = marks.cut(at, at + limit)
            out.append(text[at:end].strip())
            at = end
            while at < len(text) and text[at].isspace():
                at += 1
        return [c for c in [*out, text[at:]] if c]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(chunks)

    return split


# ---------------------------------------------------------------- segments


def speaker_runs(df: DataFrame, text: str, out: str) -> DataFrame:
    """Lines → runs `(speaker, text)`: an all-caps line of one to three words opens a run.

    Text before the first speaker is dropped, as are runs without text.
    """
    header = lambda x: tx.is_upper(x) & F.size(tx.words(x)).between(1, 3)
    cut = df.withColumn("__l", tx.lines(F.col(text)))
    cut = cut.withColumn("__s", tx.indexes(F.transform("__l", header)))
    runs = F.transform(slices(F.col("__l"), F.col("__s")), lambda xs: F.struct(
        F.get(xs, F.lit(0)).alias("speaker"),
        tx.strip(F.array_join(F.slice(xs, 2, F.size(xs) - 1), " ")).alias("text")))
    return cut.withColumn(out, F.filter(runs, lambda r: r["text"] != "")).drop("__l", "__s")


def play_run_chunks(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Speaker runs cut into play chunks; every chunk keeps its speaker."""
    runs = speaker_runs(df, text, "__r")
    each = F.flatten(F.transform("__r", lambda r: F.transform(
        play_chunks(r["text"]), lambda c: F.struct(r["speaker"].alias("speaker"), c.alias("text")))))
    return numbered_rows(runs, keys, each, "chunk_no", "__c").select(*keys, "chunk_no", "__c.*")


def line_segments(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One segment per non-blank line, numbered from 1, spoken by the narrator."""
    kept = F.filter(F.transform(tx.lines(F.col(text)), tx.strip), lambda x: x != "")
    return numbered_rows(df, keys, kept, "n", "text").select(
        *keys, (F.col("n") + 1).alias("num"), F.lit("Narrator").alias("profile_id"), "text")


def paragraph_segments(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One segment per blank-line separated paragraph, its lines joined by a space."""
    body = F.transform(F.split(F.col(text), rf"(?U)\n{tx.SPACE}*\n"), lambda p: F.array_join(
        F.filter(F.transform(tx.lines(p), tx.strip), lambda x: x != ""), " "))
    kept = F.filter(body, lambda p: p != "")
    return numbered_rows(df, keys, kept, "n", "text").select(*keys, (F.col("n") + 1).alias("num"), "text")


def pair_segments(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Alternating speaker / text lines → segments; an odd last line is dropped."""
    cut = df.withColumn("__l", F.filter(F.transform(tx.lines(F.col(text)), tx.strip), lambda x: x != ""))
    pairs = F.transform(F.filter(tx.with_next(F.transform("__l", lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                                              lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                                 lambda p: (p["a"]["i"] % 2 == 0) & p["b"].isNotNull()),
                        lambda p: F.struct(F.replace(F.upper(p["a"]["x"]), F.lit("’"), F.lit("'")).alias("s"),
                                           p["b"]["x"].alias("b")))
    rows = numbered_rows(cut, keys, pairs, "n", "p")
    return rows.select(*keys, (F.col("n") + 1).alias("num"), F.col("p.s").alias("profile_id"),
                       tx.without_direction_brackets(F.col("p.s"), F.col("p.b")).alias("text"))


def numbered_seeds(chunks: DataFrame, seed: int) -> DataFrame:
    """A seed of its own for every chunk that can be derived again."""
    return chunks.withColumn("seed", F.lit(seed) + F.col("chunk_no"))


def chunk_statistics(chunks: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Count, mean length and longest chunk per key, and whether all stay within the limit."""
    n = F.length("text")
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunks"), F.round(F.avg(n)).cast("bigint").alias("mean_chars"),
        F.max(n).cast("bigint").alias("max_chars"), F.count_if(n > limit).alias("over_limit"))
