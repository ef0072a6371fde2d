"""Awkward documents that every operator must take."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def awkward_rows() -> list[tuple]:
    long = prose(1, 20_000)
    texts = [None, "", " \n\t ", "one", "Two words", long, long, prose(2, 120), prose(2, 120), prose(3, 300) + "\n" * 3,
             "é" * 5000, "x" * 70_000, "a\x1cb c d", "▁ marks ▁▁", "  lead  and  trail  ",
             'password="abcdefghijkl" AKIA' + "A" * 16, "<|startoftext|> plain", "line\nline\nline\nother"]
    rows = [(i, t, (None, "en", "fr")[i % 3], (None, "a", "a", "b")[i % 4], len(t) if t is not None else None)
            for i, t in enumerate(texts)]
    near = prose(9, 200).split()
    for i in range(8):
        copy = list(near)
        copy[5 * i:5 * i + 2] = ["changed", str(i)]
        rows.append((100 + i, " ".join(copy), "en", "a", 1))
    return rows + [(None, None, None, None, None), (None, prose(4, 80), "en", "b", 3), rows[7], rows[7]]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def with_clashes(df):
    """The same rows with more columns, named like those that operators work with."""
    for name in ("q", "kept", "size", "key", "row", "place", "p", "copy", "upto", "tie", "n_words", "slot", "score", "w",
                 "stratum", "ids", "found", "class", "q_w", "plan_source"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def spark_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
