"""Who speaks: dialogue markup, reading replies, assigning speakers and checking the result.

The unit is one text chunk per row; replies from the attribution step are an
input column.  Array columns hold a chunk's pieces, which the chunk size bounds.
"""

from __future__ import annotations

import difflib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.functions.rows import plain_rows
from lectern.operators.chunking import slices
from lectern.operators.ordered import block_of, row_numbers
from lectern.session import written

NARRATOR = "NARRATEUR"
UNKNOWN = "PERSONNAGE"
LEAST_RATIO = 0.30
INTACT_RATIO = 0.995

# Dialogue marks, speech verbs and the grammar of a narrative aside.
DIALOGUE_MARKS = "[—–\\-«»\"“]"
DIALOGUE_START = "^[—–\\-«“\"]"
SPEECH_VERBS = (
    "dit", "répondit", "repartit", "s'écria", "s'exclama", "demanda", "ajouta", "reprit", "articula", "murmura",
    "hurla", "lança", "fit", "poursuivit", "conclut", "soupira", "gronda", "s'écriait", "aboya", "annonça", "riposta",
    "objecta", "renchérit", "glissa", "coupa", "acquiesça", "disait", "répondait", "ajoutait", "reprenait",
    "murmurait", "hurlait", "lançait", "faisait",
)
_OBJECT = r"(?:lui|leur|me|te|se|nous|vous|y)\s+"
_NAME = r"[A-ZÀ-Ý][\wÀ-ÿ'’\-\.]*"
_ARTICLE = r"le|la|l['’]|les|un|une|des|ce|cet|cette|mon|ton|son|notre|votre|leur|de|du"
_SUBJECT = rf"(?:\s+(?:{_ARTICLE})?\s*{_NAME}(?:\s+(?:de|du|des|d['’])?\s*{_NAME})*|-\w+)"
_MANNER = r",?\s*(?:d['’]|avec\b|sur\b)[^.!?»«\"]*"
_VERB = "|".join(f"[{v[0]}{v[0].upper()}]{v[1:]}".replace("'", "['’]") for v in SPEECH_VERBS)
ASIDE = rf"(?U)\s*(?:{_OBJECT})?(?:{_VERB})\b{_SUBJECT}(?:{_MANNER})?\s*[.,]?"


def _by_first_letter(verbs: tuple[str, ...]) -> str:
    rest: dict[str, list[str]] = {}
    for v in verbs:
        rest.setdefault(v[0], []).append(v[1:].replace("'", "['’]"))
    return "|".join(f"[{a}{a.upper()}](?:{'|'.join(r)})" for a, r in rest.items())


#: `ASIDE` without the blanks before it, for a search through long texts: one look at a letter turns most places down.
_ASIDE_CORE = (rf"(?U)(?=[lmtsnvy{''.join(sorted({c for v in SPEECH_VERBS for c in (v[0], v[0].upper())}))}])"
               rf"(?:{_OBJECT})?(?:{_by_first_letter(SPEECH_VERBS)})\b{_SUBJECT}(?:{_MANNER})?\s*[.,]?")

# Stems of verbs that announce speech.
SPEECH_STEMS = (
    "dit", "dis", "disait", "répond", "repond", "repart", "répart", "écria", "exclam", "demand", "ajout", "reprit",
    "reprend", "articul", "murmur", "hurl", "lanc", "fit", "poursuiv", "conclu", "soupir", "grond", "aboy", "annonc",
    "ripost", "object", "renchér", "gliss", "coup", "acquiesc", "cri", "répét", "repet", "s'écri", "s'exclam",
)

_PAIRS = "array<struct<speaker:string,text:string>>"


def _pair(speaker: Column, text: Column) -> Column:
    return F.struct(speaker.alias("speaker"), text.alias("text"))


# ---------------------------------------------------------------- paragraphs and asides


def dialogue_lines(text: Column) -> Column:
    """Lines cut after closing quotes and before opening quotes and dashes; blank lines stay."""
    def cut(line: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(tx.strip(line), "([»”])", "$1\n"), "([«“—–])", "\n$1")
        return F.filter(F.transform(F.split(marked, "\n"), tx.strip), lambda p: p != "")

    return F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(
        tx.strip(x) == "", F.array(F.lit(""))).otherwise(cut(x))))


def dialogue_paragraphs(df: DataFrame, text: str, out: str) -> DataFrame:
    """One paragraph per dialogue line; neighbouring narration lines are joined; a blank line closes."""
    spoken = lambda x: x.rlike(DIALOGUE_START)
    cut = df.withColumn("__l", dialogue_lines(F.col(text)))
    cut = cut.withColumn("__s", tx.indexes(tx.with_previous(F.col("__l"), lambda x, p: (
        p.isNull() | (p == "") | (x == "") | spoken(x) | spoken(p)))))
    joined = F.transform(slices(F.col("__l"), F.col("__s")), lambda xs: F.array_join(xs, " "))
    return cut.withColumn(out, F.filter(joined, lambda p: p != "")).drop("__l", "__s")


def mark_asides(paragraph: Column) -> Column:
    """Bracket narrative asides; a paragraph without any dialogue mark is narration as a whole."""
    marked = tx.squeeze(_in_brackets(paragraph))
    marked = F.regexp_replace(F.regexp_replace(marked, rf"(?U),{tx.SPACE}*\(", " ("), rf"(?U)\){tx.SPACE}*,", ")")
    return F.when(paragraph.rlike(DIALOGUE_MARKS), marked).otherwise(F.concat(F.lit("("), paragraph, F.lit(")")))


def _in_brackets(paragraph: Column) -> Column:
    """Asides as ` (…) `; blanks around them stay, for the caller squeezes them."""
    pieces = F.split(F.regexp_replace(paragraph, f"({_ASIDE_CORE})", "\x01$1\x01"), "\x01")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(
        i % 2 == 1, F.concat(F.lit(" ("), tx.strip(p), F.lit(") "))).otherwise(p)), "")


def premark(df: DataFrame, text: str, out: str) -> DataFrame:
    """Paragraphs with bracketed asides, separated by blank lines."""
    built = dialogue_paragraphs(df, text, "__p")
    return built.withColumn(out, F.array_join(F.transform("__p", mark_asides), "\n\n")).drop("__p")


# ---------------------------------------------------------------- quotes and dashes


def mark_quotes(df: DataFrame, text: str, out: str) -> DataFrame:
    """`«…»` becomes a speech turn `}«…»{` unless it is a quotation inside a sentence."""
    # Contiguous matches only: without `\\G` every « that never closes would scan to the end of the text.
    pattern = r"(?s)\G([^«]*+)«(.*?)»"
    befores = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    inners = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2))
    cut = df.withColumn("__b", befores).withColumn("__i", inners)
    pieces = F.zip_with("__b", "__i", lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    stems = "^(?:" + "|".join(SPEECH_STEMS) + ")"

    def turn(piece: Column, before: Column) -> Column:
        context = F.rtrim(F.concat(F.coalesce(F.concat(F.lit("«"), before["i"], F.lit("»")), F.lit("")), piece["b"]))
        context = F.regexp_replace(context, rf"(?U){tx.SPACE}+$", "")
        word = F.regexp_extract(context, r"(?U)(\S+)$", 1)
        base = F.replace(F.lower(F.btrim(word, F.lit(".,;!?»«\"()"))), F.lit("’"), F.lit("'"))
        tail = F.regexp_extract(F.substring_index(base, "-", 1), "([^']*)$", 1)
        content = tx.strip(piece["i"])
        first = F.substring(content, 1, 1)
        speech = (context == "") | context.rlike("[:—–}.!?…]$") | tx.is_upper(first) | base.rlike(stems) | tail.rlike(
            stems)
        quoted = F.concat(F.lit("«"), piece["i"], F.lit("»"))
        return F.concat(piece["b"], F.when(speech, F.concat(F.lit("}"), quoted, F.lit("{"))).otherwise(quoted))

    used = F.aggregate(pieces, F.lit(0), lambda acc, p: acc + F.length(p["b"]) + F.length(p["i"]) + 2)
    tail = F.substring(F.col(text), used + 1, F.length(text))
    return cut.withColumn(out, F.concat(F.array_join(tx.with_previous(pieces, turn), ""), tail)).drop("__b", "__i")


def mark_dashes(text: Column) -> Column:
    """A dash at a line start opens a turn; other dashes open and close an aside in turn."""
    pieces = F.split(text, "—")

    def step(acc: Column, piece: Column) -> Column:
        bare = F.rtrim(piece, F.lit(" \t"))
        at_start = bare.endswith("\n") | ((acc["n"] == 0) & (bare == ""))
        inline = acc["inline"] + F.when(at_start, 0).otherwise(1)
        sign = F.when(at_start, "}—").when(inline % 2 == 1, "—{").otherwise("}—")
        return F.struct((acc["n"] + 1).alias("n"), inline.alias("inline"),
                        F.concat(acc["out"], F.array(sign)).alias("out"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("inline"), F.array().cast("array<string>").alias("out"))
    signs = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), zero, step,
                        lambda acc: F.concat(acc["out"], F.array(F.lit(""))))
    return F.array_join(F.zip_with(pieces, signs, lambda p, s: F.concat(p, s)), "")


def premark_turns(df: DataFrame, text: str, out: str) -> DataFrame:
    """Quotes, then dashes; a text that is already marked is left alone."""
    marked = mark_quotes(df, text, "__q").withColumn("__q", mark_dashes(F.col("__q")))
    done = F.col(text).contains("}«") | F.col(text).contains("»{")
    return marked.withColumn(out, F.when(done, F.col(text)).otherwise(F.col("__q"))).drop("__q")


def marked_segments(text: Column) -> Column:
    """Marked text → array of struct(type, text): `}` opens speech (S), `{` narration (N)."""
    pieces = F.split(F.regexp_replace(text, "([{}])", "\x01$1"), "\x01")
    typed = F.transform(pieces, lambda p: F.struct(
        F.when(p.startswith("}"), "S").otherwise("N").alias("type"),
        tx.strip(F.regexp_replace(p, "^[{}]", "")).alias("text")))
    return F.filter(typed, lambda s: s["text"] != "")


# ---------------------------------------------------------------- replies


def speaker_header(line: Column) -> Column:
    """An all-caps line of less than fifty characters without sentence or quote marks."""
    return tx.is_upper(line) & (F.length(line) < 50) & ~line.rlike('[.!?«»"–—{}]')


def speaker_blocks(df: DataFrame, reply: str, out: str) -> DataFrame:
    """Reply text → array of struct(speaker, text), one per header with text below it."""
    kept = F.filter(F.transform(F.split(F.col(reply), "\n"), tx.strip), lambda x: x != "")
    cut = df.withColumn("__l", kept).withColumn("__s", tx.indexes(F.transform("__l", speaker_header)))
    parts = F.transform(slices(F.col("__l"), F.col("__s")), lambda xs: _pair(
        F.get(xs, F.lit(0)), F.array_join(F.slice(xs, 2, F.size(xs) - 1), " ")))
    return cut.withColumn(out, F.filter(parts, lambda p: p["text"] != "")).drop("__l", "__s")


def speakers(reply: Column) -> Column:
    """Named speakers of a reply in order of appearance, without the narrator and the placeholder."""
    kept = F.transform(F.split(reply, "\n"), tx.strip)
    return F.array_distinct(F.filter(kept, lambda x: speaker_header(x) & ~x.isin(NARRATOR, UNKNOWN)))


def project_speakers(replies: DataFrame) -> DataFrame:
    """Distinct speakers over all analysed chunks of a project, sorted."""
    return plain_rows(replies, ["project"], speakers(F.col("reply")), "speaker").distinct().orderBy(
        "project", "speaker")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _shared_words(targets: pd.Series, blocks: pd.Series) -> pd.Series:
    """Words in common runs of each target and each block; 0 where their bags of words already tell that it's too few."""

    def shared(one: list[str], two: list[str]) -> int:
        if 2 * (Counter(one) & Counter(two)).total() < LEAST_RATIO * (len(one) + len(two)):
            return 0
        return sum(m.size for m in difflib.SequenceMatcher(None, one, two, autojunk=False).get_matching_blocks())

    return pd.Series([[[shared(list(t), list(b)) for b in bs] for t in ts] for ts, bs in zip(targets, blocks)])


def _closest(counts: Column, words: Column, named: Column) -> Column:
    """The speaker of the block with the highest share of common words, the first of equals; NULL if it is low."""
    rated = F.zip_with(counts, F.transform(named, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda n, b: F.struct(
        F.when(F.size(words) + F.size(b["b"]["words"]) == 0, F.lit(1.0)).otherwise(
            2 * n / (F.size(words) + F.size(b["b"]["words"]))).alias("ratio"), (-b["i"]).alias("order"),
        b["b"]["speaker"].alias("speaker")))
    best = F.array_max(rated)
    return F.when(best["ratio"] >= LEAST_RATIO, best["speaker"])


def assign_speakers(df: DataFrame, segments: str, reply: str, out: str) -> DataFrame:
    """Narration → narrator; each speech segment → the reply block with the most similar wording."""
    read = speaker_blocks(df, reply, "__b")
    named = F.transform(F.filter("__b", lambda b: b["speaker"] != NARRATOR), lambda b: F.struct(
        b["speaker"].alias("speaker"), tx.comparison_words(b["text"]).alias("words")))
    read = read.withColumn("__k", named)
    words = F.transform(segments, lambda s: F.when(s["type"] == "S", tx.comparison_words(s["text"])).otherwise(
        F.array().cast("array<string>")))
    read = read.withColumn("__t", words)
    read = read.withColumn("__n", _shared_words(F.col("__t"), F.transform("__k", lambda b: b["words"])))
    read = read.withColumn("__w", F.zip_with("__n", "__t", lambda n, w: F.when(
        F.size("__k") > 0, _closest(n, w, F.col("__k")))))
    pairs = F.zip_with(segments, "__w", lambda s, w: _pair(
        F.when(s["type"] == "N", NARRATOR).otherwise(F.coalesce(w, F.lit(UNKNOWN))), s["text"]))
    return read.withColumn(out, pairs).drop("__b", "__k", "__t", "__n", "__w")


def merge_neighbours(pairs: Column) -> Column:
    """Join neighbouring pieces of one speaker by a space."""

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        body = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(last["speaker"].eqNullSafe(p["speaker"]) & last.isNotNull(), F.concat(body, F.array(_pair(
            p["speaker"], F.concat(last["text"], F.lit(" "), p["text"]))))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(pairs, F.array().cast(_PAIRS), step)


def tidy_pairs(pairs: Column) -> Column:
    """Clean every piece, drop what is empty, join neighbours."""
    clean = F.transform(pairs, lambda p: _pair(p["speaker"], tx.clean_segment(p["text"])))
    return merge_neighbours(F.filter(clean, lambda p: p["text"] != ""))


def rendered(pairs: Column) -> Column:
    """Readable script: the speaker's name where it changes, then the text."""
    parts = tx.with_previous(pairs, lambda p, b: F.concat(
        F.when(b.isNull() | (b["speaker"] != p["speaker"]), F.concat(F.lit("\n"), p["speaker"], F.lit("\n\n")))
        .otherwise(F.lit("")), p["text"]))
    return tx.strip(F.array_join(parts, "\n"))


# ---------------------------------------------------------------- transfer onto the original text


_RUNS = T.ArrayType(T.StructType().add("i", T.IntegerType()).add("j", T.IntegerType()).add("n", T.IntegerType()))


@F.pandas_udf(_RUNS)
def _common_runs(one: pd.Series, two: pd.Series) -> pd.Series:
    """Runs of words that two texts share in order: their starts in both and their length; the last is empty, at the ends."""
    return pd.Series([[{"i": m.a, "j": m.b, "n": m.size} for m in difflib.SequenceMatcher(
        None, list(a), list(b), autojunk=False).get_matching_blocks()] for a, b in zip(one, two)])


def _gaps(runs: Column) -> Column:
    """Each run with the stretches before it: struct(i0, j0, i, j, n)."""
    return tx.with_previous(runs, lambda r, p: F.struct(
        F.coalesce(p["i"] + p["n"], F.lit(0)).alias("i0"), F.coalesce(p["j"] + p["n"], F.lit(0)).alias("j0"),
        r["i"].alias("i"), r["j"].alias("j"), r["n"].alias("n")))


def _steps(i: Column, j: Column, n: Column) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(-1), n - 1), lambda k: k >= 0), lambda k: F.struct(
        (i + k).alias("i"), (j + k).alias("j")))


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"(?U)[^\wÀ-ÿ]", ""))


def transfer_tags(df: DataFrame, text: str, tagged: str, out: str) -> DataFrame:
    """Speakers of a tagged reply carried onto the original words, whose text stays as it is.

    Words the reply lost take the speaker before them; neighbours are joined.
    """
    words = df.withColumn("__o", tx.words(F.col(text)))
    words = words.withColumn("__t", tagged_words(F.col(tagged)))
    runs = _common_runs(F.transform("__o", _bare), F.transform("__t", lambda w: _bare(w["word"])))
    words = words.withColumn("__r", runs)
    # Words in place of others take their speakers one by one, as far as both stretches go.
    met = F.flatten(F.transform(_gaps(F.col("__r")), lambda g: F.concat(
        _steps(g["i0"], g["j0"], F.least(g["i"] - g["i0"], g["j"] - g["j0"])), _steps(g["i"], g["j"], g["n"]))))
    words = words.withColumn("__m", met)
    upto = F.concat(F.slice(F.transform("__m", lambda m: m["i"]), F.lit(2), F.greatest(F.size("__m") - 1, F.lit(0))),
                    F.array(F.size("__o")))
    spread = F.zip_with("__m", upto, lambda m, end: F.array_repeat(F.get("__t", m["j"])["speaker"], end - m["i"]))
    first = F.array_repeat(F.lit(NARRATOR), F.coalesce(F.get("__m", F.lit(0))["i"], F.size("__o")))
    words = words.withColumn("__g", F.concat(first, F.when(F.size("__m") > 0, F.flatten(spread)).otherwise(
        F.array().cast("array<string>"))))
    words = words.withColumn("__s", tx.indexes(tx.with_previous(
        F.col("__g"), lambda x, p: p.isNull() | (x != p))))
    runs = F.zip_with(slices(F.col("__o"), F.col("__s")), slices(F.col("__g"), F.col("__s")), lambda w, g: _pair(
        F.get(g, F.lit(0)), F.array_join(w, " ")))
    return words.withColumn(out, runs).drop("__o", "__t", "__r", "__m", "__g", "__s")


def tagged_words(reply: Column) -> Column:
    """Tagged reply → array of struct(word, speaker).

    A header line names the speaker, text in brackets is the narrator's, and a
    capitalised name right after a closing bracket names the next speaker.
    """
    header = lambda x: tx.is_upper(x) & (F.length(x) < 50) & ~x.rlike('[.!?«»"–—()]')
    rows = F.filter(F.transform(F.split(reply, "\n"), tx.strip), lambda x: x != "")
    # One token per header, line start (\\x02), bracket or stretch of text.
    tokens = F.flatten(F.transform(rows, lambda x: F.when(header(x), F.array(F.concat(F.lit("\x01"), x))).otherwise(
        F.concat(F.array(F.lit("\x02")), F.regexp_extract_all(x, F.lit(r"[()]|[^()]+"), F.lit(0))))))
    lead = r"(?U)^([A-ZÀ-Ý0-9_\s\-]{3,50})\b"

    def step(acc: Column, tok: Column) -> Column:
        is_head = tok.startswith("\x01")
        sign = tok.isin("(", ")", "\x02")
        after = acc["closed"] & ~is_head & ~sign
        body = F.when(after, tx.strip(tok)).otherwise(tok)
        name = F.when(after, F.regexp_extract(body, lead, 1)).otherwise("")
        found = tx.strip(name) != ""
        speaker = F.when(is_head, F.substring(tok, F.lit(2), F.length(tok))).when(found, tx.strip(name)).otherwise(acc["speaker"])
        said = F.when(found, F.substring(body, F.length(tx.strip(name)) + 1, F.length(body))).otherwise(body)
        inside = F.when(is_head, False).when(tok == "(", True).when(tok == ")", False).otherwise(acc["inside"])
        who = F.when(inside, F.lit(NARRATOR)).otherwise(speaker)
        fresh = F.transform(tx.words(said), lambda w: F.struct(w.alias("word"), who.alias("speaker")))
        return F.struct(
            speaker.alias("speaker"), inside.alias("inside"), (tok == ")").alias("closed"),
            F.when(is_head | sign, acc["out"]).otherwise(F.concat(acc["out"], fresh)).alias("out"))

    zero = F.struct(F.lit(NARRATOR).alias("speaker"), F.lit(False).alias("inside"), F.lit(False).alias("closed"),
                    F.array().cast("array<struct<word:string,speaker:string>>").alias("out"))
    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


# ---------------------------------------------------------------- post-processing and checks


def post_process(df: DataFrame, pairs: str, out: str) -> DataFrame:
    """Buried asides to the narrator, unmarked long text to the narrator, tails of asides back to the speaker;
    then quotes and brackets off, empty pieces dropped, neighbours joined."""
    def split_asides(p: Column) -> Column:
        pieces = F.split(F.regexp_replace(p["text"], f"({ASIDE})", "\x01$1\x01"), "\x01")
        typed = F.transform(pieces, lambda x, i: _pair(
            F.when(i % 2 == 1, F.lit(NARRATOR)).otherwise(p["speaker"]), tx.strip(x)))
        return F.when(p["speaker"] == NARRATOR, F.array(p)).otherwise(F.filter(typed, lambda q: q["text"] != ""))

    def demote(p: Column) -> Column:
        body = tx.strip(p["text"])
        long_plain = (p["speaker"] != NARRATOR) & ~body.rlike(DIALOGUE_MARKS) & (F.size(tx.words(body)) > 6)
        return _pair(F.when(long_plain, NARRATOR).otherwise(p["speaker"]), body)

    def hand_back(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        aside = F.regexp_extract(p["text"], f"(?s)^({ASIDE})", 1)
        rest = tx.strip(F.substring(p["text"], F.length(aside) + 1, F.length(p["text"])))
        gives = (p["speaker"] == NARRATOR) & (last["speaker"] != NARRATOR) & (aside != "") & (rest != "")
        return F.concat(acc, F.when(F.coalesce(gives, F.lit(False)), F.array(
            _pair(F.lit(NARRATOR), tx.strip(aside)), _pair(last["speaker"], rest))).otherwise(F.array(p)))

    step1 = df.withColumn("__a", F.transform(F.flatten(F.transform(pairs, split_asides)), demote))
    step2 = step1.withColumn("__a", F.aggregate("__a", F.array().cast(_PAIRS), hand_back))
    clean = F.transform("__a", lambda p: _pair(p["speaker"], tx.strip(F.regexp_replace(p["text"], '[«»"()]', ""))))
    return step2.withColumn(out, merge_neighbours(F.filter(clean, lambda p: p["text"] != ""))).drop("__a")


def lost_words(docs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Words that occur less often after than before, per document, without aligning anything."""
    count = lambda c, sign: plain_rows(docs, [key], tx.words(tx.comparison_form(F.col(c))), "word").withColumn(
        "d", F.lit(sign))
    return count(before, 1).unionByName(count(after, -1)).groupBy(key, "word").agg(
        F.sum("d").alias("lost")).filter("lost > 0")


def integrity(df: DataFrame, before: str, after: str, out: str) -> DataFrame:
    """Word-sequence similarity of a chunk before and after, and the passages lost with six words of context."""
    form = lambda c: tx.words(tx.comparison_form(F.col(c)))
    read = df.withColumns({"__a": form(before), "__z": form(after)}).withColumn(
        "__r", _common_runs(F.col("__a"), F.col("__z")))
    both = F.size("__a") + F.size("__z")
    kept = F.aggregate("__r", F.lit(0), lambda acc, r: acc + r["n"])
    lost = F.transform(F.filter(_gaps(F.col("__r")), lambda g: g["i"] > g["i0"]), lambda g: F.struct(
        F.array_join(F.slice("__a", g["i0"] + 1, g["i"] - g["i0"]), " ").alias("passage"),
        F.array_join(F.slice("__z", F.greatest(g["j0"] - 6, F.lit(0)) + 1, F.least(g["j0"], F.lit(6))), " ").alias("context")))
    return read.withColumn(out, F.struct(
        F.when(both == 0, F.lit(1.0)).otherwise(2 * kept / both).alias("ratio"),
        F.filter(lost, lambda x: x["passage"].rlike(r"[\p{L}\p{N}_]")).alias("lost"))).drop("__a", "__z", "__r")


def narrator_speaks() -> Column:
    """Structure check on `(speaker, text)`: a narrator piece that starts with a dialogue mark."""
    body = tx.strip(F.col("text"))
    return (F.col("speaker") == NARRATOR) & body.rlike(DIALOGUE_START) & (F.length(body) > 2)


def best_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """Attempt kept per key from `(attempt, ratio, missing, errors)`.

    Attempts end with the first perfect one.  The highest ratio wins; on a tie
    a later attempt replaces an earlier one only when it has no errors.
    """
    perfect = attempts.filter("missing = 0 AND errors = 0").groupBy(key).agg(F.min("attempt").alias("__end"))
    tried = attempts.join(perfect, key, "left").filter(F.col("__end").isNull() | (F.col("attempt") <= F.col("__end")))
    clean = F.col("errors") == 0
    rank = F.struct("ratio", clean, F.when(clean, F.col("attempt")).otherwise(-F.col("attempt")))
    return tried.groupBy(key).agg(F.max_by(F.struct("attempt", "ratio"), rank).alias("b"),
                                  F.count("*").alias("tries")).select(key, "b.*", "tries")


def assembled(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Validated chunk texts in order, one row per chunk; what is blank adds nothing."""
    texts = results.select("project", "idx", tx.strip(F.col("text")).alias("text"))
    return chunks.select("project", "idx").join(texts, ["project", "idx"]).filter("text <> ''")


def assembly_report(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Included, total and missing chunks per project."""
    texts = results.select("project", "idx", F.lit(True).alias("__has"),
                           (tx.strip(F.col("text")) != "").alias("__text"))
    return chunks.select("project", "idx").join(texts, ["project", "idx"], "left").groupBy("project").agg(
        F.count_if("__text").alias("included"), F.count("*").alias("total"),
        F.count_if(F.col("__has").isNull()).alias("missing"))


def missing_chunks(chunks: DataFrame, results: DataFrame) -> DataFrame:
    return chunks.select("project", "idx").join(results.select("project", "idx"), ["project", "idx"], "left_anti")


def append_speakers(declared: DataFrame, seen: DataFrame) -> DataFrame:
    """Declared roles `(project, ord, role)` followed by new ones in order of first appearance `(project, pos, role)`."""
    have = declared.groupBy("project").agg(F.max("ord").alias("__last"))
    fresh = seen.groupBy("project", "role").agg(F.min("pos").alias("pos")).join(
        declared.select("project", "role"), ["project", "role"], "left_anti")
    fresh = written(fresh, "speakers")
    ranked = row_numbers(fresh, ["project"], ["pos", "role"], block_of(F.col("pos")), "__n")
    added = ranked.join(have, "project", "left").select(
        "project", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("bigint").alias("ord"), "role")
    return declared.select("project", F.col("ord").cast("bigint").alias("ord"), "role").unionByName(added)


def as_narration(text: Column) -> Column:
    """A whole chunk spoken by the narrator."""
    return F.concat(F.lit(f"{NARRATOR}\n\n"), tx.strip(text), F.lit("\n"))
