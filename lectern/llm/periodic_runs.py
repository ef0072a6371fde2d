"""Periodic runs of words: multi-scale minimizers seed them, direct lag scans cover the short periods.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(`LEAST`, 3 q) that no neighbouring word extends.  Two ways find all of them, whatever the text:

* Periods below `DIRECT`: the text is compared with itself at each lag; long stretches of agreement are runs.
* Periods of a to 2a - 1, for a = DIRECT, 2 DIRECT, 4 DIRECT ...: every K = a / 2 consecutive words get a hash, and
  every window of a consecutive hashes selects its minima.  Inside a run windows one period apart hold the same hashes,
  so they select minima one period apart, with equal hashes.  Each pair of equal selected hashes a to 2a - 1 words apart
  is a seed, which is compared word by word to both sides as far as it agrees.

Hashes that lie in a run already found with a period of at most K / 3 select nothing.  A run of a longer period holds
other hashes too (two stretches of periods up to K / 3 that overlap by K - 1 words are one stretch), and those are more
than K / 3 words apart where equal, so the number of pairs stays in proportion to the text.  Words are compared by
number, never by hash, so a clash of hashes costs time but changes no result.  Every text is worked on whole, one task
has one batch of texts at a time, and nothing is shuffled.

A null or empty text has no words, no runs and an empty collapsed text.  Rows come back one for one, repeated rows and
rows without doc_id too; an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let, words

LEAST = 24
DIRECT = 48
#: Texts are taken together up to so many characters.
CHUNK_CHARS = 1 << 21
_SQL_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _least_of(x: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (np.minimum or np.maximum) over each `width` consecutive values."""
    done = 1
    while 2 * done <= width:
        x, done = pick(x[:-done], x[done:]), 2 * done
    return pick(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive values; `width` is three times a power of two."""
    one = _mixed(x.astype(np.uint64))
    h, done = _mixed(one[:-2] * np.uint64(3) + _mixed(one[1:-1] * np.uint64(5) + one[2:])), 3
    while done < width:
        h, done = _mixed(h[:-done] * np.uint64(3) + h[done:]), 2 * done
    return h


def _agreements(x: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one positions of the stretches of `least` or more values equal to the value `lag` later."""
    at = np.flatnonzero(x[lag:] == x[:-lag])
    if len(at) < least:
        return at[:0], at[:0]
    cut = np.flatnonzero(np.diff(at) > 1)
    first = at[np.concatenate([[0], cut + 1])]
    last = at[np.concatenate([cut, [len(at) - 1]])] + 1
    long = last - first >= least
    return first[long], last[long]


def _agrees_until(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading values on which both agree."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at:min(n, at + step)] != b[at:min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


def _seeds(x: np.ndarray, a: int, found: dict) -> Iterator[tuple[int, int]]:
    """(lag, position) of equal selected hashes a to 2a - 1 apart, by lag and position."""
    width = a // 2
    h = _hashes(x, width)
    if len(h) < a:
        return
    no = np.uint64(0xFFFFFFFFFFFFFFFF)
    for (s, e), q in found.items():
        if 3 * q <= width <= e - s:
            h[s:e - width + 1] = no
    least = np.concatenate([np.zeros(a - 1, np.uint64), _least_of(h, a, np.minimum), np.zeros(a - 1, np.uint64)])
    at = np.flatnonzero((_least_of(least, a, np.maximum) == h) & (h != no))
    at = at[np.argsort(h[at], kind="stable")]
    key, pairs, step = h[at], [], 1
    while step < len(at):
        near = (key[step:] == key[:-step]) & (at[step:] - at[:-step] < 2 * a)
        if not near.any():
            break
        first = at[:-step][near]
        lag = at[step:][near] - first
        pairs.append(np.stack([lag[lag >= a], first[lag >= a]], axis=1))
        step += 1
    if pairs:
        both = np.concatenate(pairs)
        yield from both[np.lexsort((both[:, 1], both[:, 0]))].tolist()


def runs_of(x: np.ndarray, longest: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of all runs in `x`; no run is longer than `longest`."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(DIRECT, longest // 3 + 1)):
        for s, e in zip(*_agreements(x, q, max(LEAST, 3 * q) - q)):
            found.setdefault((int(s), int(e) + q), q)
    a = DIRECT
    while 3 * a <= longest:
        done = (0, 0)  # lag, and up to where its agreements are known
        for q, at in _seeds(x, a, found):
            if done[0] == q and at < done[1]:
                continue
            e = at + _agrees_until(x[at:-q], x[at + q:])
            s = at - _agrees_until(x[:at][::-1], x[q:at + q][::-1])
            done = (q, e)
            if e - s >= 2 * q:
                found.setdefault((s, e + q), q)
        a *= 2
    return found


def _long_enough(x: np.ndarray, first: np.ndarray, sizes: np.ndarray, least: int):
    """The texts of `least` words or more, a separator that equals nothing after each; where they begin."""
    keep = np.flatnonzero(sizes >= least)
    if not len(keep):
        return None
    taken = np.repeat(first[keep] - np.concatenate([[0], np.cumsum(sizes[keep] + 1)[:-1]]), sizes[keep] + 1)
    at = np.arange(len(taken)) + taken
    ends = np.cumsum(sizes[keep] + 1) - 1
    at[ends] = 0
    out = x[at]
    out[ends] = -1 - np.arange(len(keep))
    return out, keep, ends - sizes[keep]


def _searched(texts: pa.Array) -> list[pa.Array]:
    """Number of words, runs, greatest run and collapsed text of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(flat, "")
    flat, owner = flat.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    drop = np.zeros(len(x) + 1, np.int64)
    # texts of similar length together, so that long lags are looked for in long texts only
    low = LEAST
    while low <= sizes.max(initial=0):
        part = _long_enough(x, first, np.where(sizes < 4 * low, sizes, 0), low)
        if part:
            line, keep, starts = part
            for (s, e), q in runs_of(line, int(sizes[keep].max())).items():
                k = int(np.searchsorted(starts, s, "right")) - 1
                own = keep[k]
                runs[own].append((s - int(starts[k]), e - s, q))
                drop[first[own] + s - starts[k] + q] += 1
                drop[first[own] + e - starts[k]] -= 1
        low *= 4
    kept = np.cumsum(drop)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(texts)))])
    left = pa.ListArray.from_arrays(ends.astype(np.int32), flat.filter(pa.array(kept)))
    joined = pc.binary_join(left, pa.scalar(" ", pa.large_string()))
    listed = [[dict(zip(("start", "length", "period"), r)) for r in sorted(own, key=lambda r: (r[0], r[2]))] for own in runs]
    best = [min(own, default=None, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) for own in listed]
    return [pa.array(sizes), pa.array(listed, pa.list_(_RUN)), pa.array(best, _RUN), joined.cast(pa.string())]


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    at, load = 0, 0
    for i, n in enumerate(lengths):
        if load and load + n > CHUNK_CHARS:
            yield at, i
            at, load = i, 0
        load += int(n)
    if len(lengths) > at:
        yield at, len(lengths)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        for a, b in _pieces(lengths):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *_searched(part.column("text"))], ["doc_id", "n_words", "runs", "greatest", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs by start, then period, the run with the greatest exponent, and the collapsed text.

    The greatest is by exact length / period; ties go to the smaller start, then period; null where there is no run.  The
    collapsed text keeps, joined by one space, the words that no run holds after its first period.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _map, f"doc_id long, n_words long, runs array<{_SQL_RUN}>, greatest {_SQL_RUN}, collapsed string")


def repeating_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by checksum of doc_id, repeat a stretch of words to their end.

    Rows without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def altered(w):
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))),
                                                      lambda i: F.get(w, at(i))), " "))

    text = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(let(words(F.col("text")), altered), F.col("text")))
    return docs.select("doc_id", text.otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Number of runs, the one with the greatest exponent, and checksums of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return find_runs(repeating_texts(docs)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "greatest.start", "greatest.length", "greatest.period",
        F.expr("(1000 * greatest.length) div greatest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
