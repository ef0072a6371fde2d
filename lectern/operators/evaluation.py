"""Loops in transcripts, refinement and persona scorecards, roll-ups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.chunking import slices

# Loop limits, filler words, leak and refusal openings, length limits.
MIN_RUN = 6
LONGEST_UNIT = 60
FILLERS = ("um", "uh", "er", "hmm", "ah", "like", "you know", "i mean", "basically", "literally")
PROMPT_LEAKS = (
    r"^here (?:is|'s) the cleaned",
    r"^the cleaned (?:version|transcript)",
    r"^cleaned (?:version|transcript):",
    r"^output:\s*$",
    r"^sure,?\s+(?:here|i'll|let)",
    r"^okay,?\s+(?:here(?:'s)?|i'?ll|let me|i understand|no problem)",
    r"^i (?:cannot|can't|will not|refuse)",
    r"^as an ai",
)
ANSWER_LEAKS = (
    r"^(?:why did|here's a|the answer is|there once was)",
    r"^(?:a joke|one joke|programming joke)",
)
PERSONA_LEAKS = (
    r"^here (?:is|'s) the cleaned",
    r"^here (?:is|'s) a",
    r"^as (?:an ai|the character)",
    r"^character description",
    r"^task:\s*",
    r"^output:\s*$",
    r"^sure,?\s+(?:here|i'?ll|let)",
)
REFUSALS = (
    r"\bi (?:cannot|can't|won'?t|will not|refuse)\b",
    r"\bi'?m sorry(?:,|\s+but)",
    r"\bi apologi[sz]e",
)
STAGE_DIRECTION = r"[\*\(_].{0,60}?[\*\)_]"
TOO_SHORT, TOO_LONG = 0.25, 1.5


def _word_runs(df: DataFrame, text: str) -> DataFrame:
    """Adds `__runs`: neighbouring words with the same key; punctuation-only words stand alone."""
    key = lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w]", ""))
    keyed = df.withColumn("__w", F.transform(tx.words(F.col(text)), lambda w: F.struct(w.alias("w"), key(w).alias("k"))))
    starts = tx.indexes(tx.with_previous(F.col("__w"), lambda x, p: p.isNull() | (x["k"] == "") | (x["k"] != p["k"])))
    return keyed.withColumn("__s", starts).withColumn("__runs", slices(F.col("__w"), F.col("__s")))


def _is_loop(run: Column, min_run: int) -> Column:
    return (F.size(run) >= min_run) & (F.get(run, F.lit(0))["k"] != "")


def collapse_word_loops(df: DataFrame, text: str, out: str, min_run: int = MIN_RUN) -> DataFrame:
    """Drop runs of `min_run` or more equal words; shorter texts are left alone."""
    runs = _word_runs(df, text)
    kept = F.flatten(F.filter("__runs", lambda r: ~_is_loop(r, min_run)))
    joined = F.array_join(F.transform(kept, lambda x: x["w"]), " ")
    return runs.withColumn(out, F.when(F.size("__w") < min_run, F.col(text)).otherwise(joined)).drop(
        "__w", "__s", "__runs")


#: Texts are searched together up to so many characters.
CHUNK_CHARS = 1 << 20


def _repeats(codes: np.ndarray, unit: int, min_run: int) -> list[tuple[int, int]]:
    """Stretches (from, to) whose characters equal those `unit` places on, long enough for `min_run` units."""
    at = np.flatnonzero(codes[unit:] == codes[:-unit])
    least = (min_run - 1) * unit
    if len(at) < least:
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
    long = last - first >= least
    return list(zip(first[long].tolist(), last[long].tolist()))


def _loops(found: list[tuple[int, int, int]], min_run: int) -> list[tuple[int, int]]:
    """The loops to drop, from left to right: the leftmost, there the shortest unit, as often as it repeats.

    `found` has (unit, from, to) of one text; a loop of a unit can begin anywhere from which enough repeats are left.
    """
    waiting = [(first, unit, last) for unit, first, last in found]
    heapq.heapify(waiting)
    out, at = [], 0
    while waiting:
        first, unit, last = heapq.heappop(waiting)
        if last - max(first, at) < (min_run - 1) * unit:
            continue
        if first < at:
            heapq.heappush(waiting, (at, unit, last))
            continue
        at = first + unit * (1 + (last - first) // unit)
        out.append((first, at))
        heapq.heappush(waiting, (at, unit, last))
    return out


def _without_loops(texts: list[str], min_run: int) -> list[str]:
    """Texts side by side, with signs between them that equal nothing, are compared with themselves unit by unit."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.cumsum([len(c) + 1 for c in codes])
    line = np.concatenate([x for k, c in enumerate(codes) for x in (c, np.array([0x110000 + k], np.uint32))])
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    for unit in range(2, min(LONGEST_UNIT, len(line) - 1) + 1):
        for first, last in _repeats(line, unit, min_run):
            k = int(np.searchsorted(ends, first, "right"))
            start = int(ends[k]) - len(codes[k]) - 1
            by_text.setdefault(k, []).append((unit, first - start, last - start))
    out = list(texts)
    for k, found in by_text.items():
        kept, at = [], 0
        for first, last in _loops(found, min_run):
            kept.append(texts[k][at:first])
            at = last
        out[k] = "".join([*kept, texts[k][at:]])
    return out


def _drop_loops(min_run: int):
    def drop(texts: pd.Series) -> pd.Series:
        out, part, load = [None] * len(texts), [], 0
        given = [i for i, t in enumerate(texts) if t is not None]
        for n, i in enumerate(given):
            part.append(i)
            load += len(texts.iloc[i])
            if load > CHUNK_CHARS or n == len(given) - 1:
                for j, t in zip(part, _without_loops([texts.iloc[j] for j in part], min_run)):
                    out[j] = t
                part, load = [], 0
        return pd.Series(out, dtype=object)

    return F.pandas_udf(drop, "string")


def collapse_character_loops(text: Column, min_run: int = MIN_RUN) -> Column:
    """Drop the shortest unit of 2 to 60 characters that repeats `min_run` times; squeeze only when something went.

    For each unit length the text is compared with itself shifted by it, so the work is in proportion to the text, whatever
    is in it.
    """
    done = _drop_loops(min_run)(text)
    return F.when(done == text, text).otherwise(tx.squeeze(done))


def collapse_loops(df: DataFrame, text: str, out: str, min_run: int = MIN_RUN) -> DataFrame:
    words = collapse_word_loops(df, text, out, min_run)
    return words.withColumn(out, collapse_character_loops(F.col(out), min_run))


def detect_loops(df: DataFrame, text: str, out: str, min_run: int = MIN_RUN) -> DataFrame:
    """True where some word repeats `min_run` times in a row."""
    return _word_runs(df, text).withColumn(out, F.exists("__runs", lambda r: _is_loop(r, min_run))).drop(
        "__w", "__s", "__runs")


def filler_count(text: Column) -> Column:
    """Occurrences of filler words, as whole words in any case."""
    total = F.lit(0)
    for word in FILLERS:
        total = total + F.regexp_count(text, F.lit(rf"(?iU)\b{word}\b"))
    return total


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Text of the first pattern found after leading blanks, NULL without one."""
    bare = F.ltrim(text, F.lit(tx.BLANKS))
    hits = [F.regexp_substr(bare, F.lit(f"(?iU){p}")) for p in patterns]
    return F.coalesce(*hits)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def two_places(x: Column) -> Column:
    """A non-negative double below 2**20 with two decimals, rounded by its exact binary value, ties to even.

    The JVM's formats round its shortest decimal form half up.  Split in two parts, 200 x is exact, and so is the sign of its
    distance to the tie.
    """
    low = F.floor(x * 100)
    high = F.floor(x * (1 << 26)) / (1 << 26)
    past = (high * 200 - (low * 2 + 1)) + (x - high) * 200
    cents = low + F.when((past > 0) | ((past == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)


def refinement_scores(df: DataFrame) -> DataFrame:
    """Scorecard of `(raw, refined, must_contain array, keep_question_mark, must_not_loop)`.

    Length is measured against the raw text after its loops were removed.
    """
    card = detect_loops(collapse_loops(df, "raw", "__clean"), "refined", "has_loop")
    card = card.withColumns({
        "fillers_raw": filler_count(F.col("raw")),
        "fillers_refined": filler_count(F.col("refined")),
        "length_ratio": F.length("refined") / F.greatest(F.length("__clean"), F.lit(1)),
        "prompt_leak": first_match(F.col("refined"), PROMPT_LEAKS),
        "answer_leak": first_match(F.col("refined"), ANSWER_LEAKS),
        "missing": F.filter("must_contain", lambda n: ~F.lower("refined").contains(F.lower(n))),
        "lost_question": F.col("keep_question_mark") & ~F.rtrim(F.col("refined"), F.lit(tx.BLANKS)).endswith("?"),
    })
    flags = F.array_compact(F.array(
        F.when(F.col("prompt_leak").isNotNull(), F.concat(F.lit("prompt-leak("), _quoted(F.col("prompt_leak")), F.lit(")"))),
        F.when(F.col("answer_leak").isNotNull(), F.concat(F.lit("answer-leak("), _quoted(F.col("answer_leak")), F.lit(")"))),
        F.when(F.col("must_not_loop") & F.col("has_loop"), "loop-echo"),
        F.when(F.size("missing") > 0, F.concat(
            F.lit("lost-terms=["), F.array_join(F.transform("missing", _quoted), ", "), F.lit("]"))),
        F.when(F.col("lost_question"), "question→statement"),
        F.when((F.col("fillers_raw") > 0) & (F.col("fillers_refined") >= F.col("fillers_raw")), F.format_string(
            "fillers-not-removed(%d→%d)", "fillers_raw", "fillers_refined")),
        F.when(F.col("length_ratio") < TOO_SHORT, F.concat(
            F.lit("too-short("), two_places(F.col("length_ratio")), F.lit(")"))),
        F.when(F.col("length_ratio") > TOO_LONG, F.concat(
            F.lit("too-long("), two_places(F.col("length_ratio")), F.lit(")"))),
    ))
    return card.withColumn("flags", flags).drop("__clean")


def persona_scores(df: DataFrame) -> DataFrame:
    """Scorecard of rewritten text `refined`: empty, leaked prompt, refusal, first three stage directions."""
    card = df.withColumns({
        "prompt_leak": first_match(F.col("refined"), PERSONA_LEAKS),
        "refusal": first_match(F.col("refined"), REFUSALS),
        "stage_directions": F.slice(F.regexp_extract_all("refined", F.lit(STAGE_DIRECTION), F.lit(0)), 1, 3),
    })
    return card.withColumn("flags", F.array_compact(F.array(
        F.when(tx.strip(F.col("refined")) == "", "empty-output"),
        F.when(F.col("prompt_leak").isNotNull(), F.concat(F.lit("prompt-leak("), _quoted(F.col("prompt_leak")), F.lit(")"))),
        F.when(F.col("refusal").isNotNull(), F.concat(F.lit("refusal("), _quoted(F.col("refusal")), F.lit(")"))),
        F.when(F.size("stage_directions") > 0, F.concat(
            F.lit("stage-directions=["), F.array_join(F.transform("stage_directions", _quoted), ", "), F.lit("]"))),
    )))


def model_rollup(cards: DataFrame) -> DataFrame:
    """Per model: clean cards, all cards, mean latency cut to whole milliseconds."""
    return cards.groupBy("model").agg(
        F.count_if(F.size("flags") == 0).alias("clean"), F.count("*").alias("total"),
        F.floor(F.sum("latency_ms") / F.count("*")).cast("bigint").alias("mean_latency_ms"))
