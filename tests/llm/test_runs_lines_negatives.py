"""Periodic runs, line dedup and hard negatives against plain versions."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives, line_dedup, periodic_runs
from lectern.llm.common import table
from tests.llm.helpers import SMALL, awkward, awkward_rows, empty, prose, rows_of, spark_words, with_clashes


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs -------------------------------------------------------------------------------------------------

def plain_runs(w: list[str]) -> list[tuple[int, int, int]]:
    """All (start, length, period) by trying every period everywhere."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w: list[str], runs) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repeating(r: random.Random) -> list[str]:
    n, v = r.choice([0, 1, 23, 24, 100, 400, 1200]), r.choice([1, 2, 3, 40, 1000])
    w = [str(r.randrange(v)) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n > 24 else 0):
        p, s = r.randint(1, n // 3), r.randrange(n)
        inner = r.randint(1, p)
        base = ([str(r.randrange(v)) for _ in range(inner)] * (p // inner + 1))[:p]
        base[r.randrange(p)] = "x"
        for i in range(s, min(n, s + r.randint(p, 5 * p))):
            w[i] = base[(i - s) % p]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    docs = [repeating(r) for _ in range(60)]
    _, runs, best, left = periodic_runs._searched(pa.array([" ".join(d) for d in docs]))
    long = 0
    for d, own, top, text in zip(docs, runs.to_pylist(), best.to_pylist(), left.to_pylist()):
        want = plain_runs(d)
        assert sorted(tuple(x.values()) for x in own) == want and text == collapsed(d, want)
        long += sum(q >= periodic_runs.DIRECT for _, _, q in want)
        first = min(want, default=None, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
        assert (tuple(top.values()) if top else None) == first
    assert long, "no run came from the minimizers"


def test_runs_do_not_depend_on_the_first_scale(monkeypatch):
    """With direct scans for all periods nothing is left to the minimizers; the runs are the same."""
    r = random.Random(7)
    texts = pa.array([" ".join(repeating(r)) for _ in range(60)])
    want = [c.to_pylist() for c in periodic_runs._searched(texts)]
    monkeypatch.setattr(periodic_runs, "DIRECT", 48 << 4)
    assert [c.to_pylist() for c in periodic_runs._searched(texts)] == want


def test_run_search_stays_linear():
    """Texts that repeat at every scale: one word, nested repeats, Fibonacci words."""
    a, b = "a", "ab"
    while len(b) < 60_000:
        a, b = b, b + a
    nested = list("abc")
    for k in range(9):
        nested = nested * 3 + [str(k)]
    for w in (["w"] * 100_000, list(b), nested, (["p"] * 40 + ["q"]) * 2000):
        size = len(w)
        x = np.unique(np.array(w), return_inverse=True)[1].astype(np.int64)
        found = periodic_runs.runs_of(np.append(x, -1), size)
        assert len(found) < size


def changed(doc_id, text) -> str:
    w = spark_words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return text or ""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def run_row(doc_id, text):
    w = spark_words(changed(doc_id, text))
    runs = plain_runs(w)
    s, n, q = min(runs, default=(None,) * 3, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
    return (doc_id, len(runs), s, n, q, n and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(collapsed(w, runs)))


def test_run_report(spark):
    rows = [(r[0], r[1]) for r in awkward_rows() if len(r[1] or "") < 30_000]
    rows += [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").limit(120).collect()]
    rows += [(i, " ".join(repeating(random.Random(i)))) for i in range(300, 340)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = rows_of(periodic_runs.run_report(docs))
    assert got == sorted((run_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20
    assert periodic_runs.run_report(empty(spark)).count() == 0


# --- line dedup ----------------------------------------------------------------------------------------------------

def plain_dedup(rows, min_documents=2):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            home = min((x for x in holders[k] if x is not None), default=None)
            if len(k) < 10 or len(holders[k]) < min_documents or d == home:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def shared_lines(n: int):
    r = random.Random(n)
    pool = [prose(i, 3) for i in range(12)] + ["  Ärger UND Öl  ", "short", "tab\tbed line\x0b", "ÀÉÎ lower Case", ""]
    pool += [p.upper() for p in pool[:4]] + [" " + pool[5] + "\r", "\x1cnot stripped\x1c", "not stripped!"]
    rows = [(r.choice([None, i, i, i // 2]), "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(n)]
    return rows + [rows[3], rows[3], (7, "\n".join(pool * 3)), (8, None), (None, pool[0])]


@pytest.mark.parametrize("frequent", [4096, 3])
def test_line_dedup(spark, monkeypatch, frequent):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)  # few: most keys go by the shuffle join
    rows = shared_lines(80) + [r[:2] for r in awkward_rows()]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert rows_of(line_dedup.dedup_report(docs)) == plain_dedup(rows)
    whole = line_dedup.without_shared_lines(docs)
    assert set(whole.columns) == {*docs.columns, "n_lines", "n_dropped"} and whole.count() == len(rows)
    assert line_dedup.dedup_report(empty(spark)).count() == 0


def test_line_dedup_threshold(spark):
    rows = shared_lines(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.without_shared_lines(docs, min_documents=9).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    assert rows_of(out) == plain_dedup(rows, 9)


def test_line_dedup_runs_in_the_jvm(spark):
    plan = line_dedup.dedup_report(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- hard negatives ------------------------------------------------------------------------------------------------

def plain_negatives(rows, every=50, positives=5, negatives=3):
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v
            and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, y, v in rows:
        if i % every or (i, y, tuple(v)) in seen:
            continue
        seen.add((i, y, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, u)), j, z) for j, z, u in rows if j != i and len(u) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [(t, k) for t, k, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(fit)]
    return sorted(out, key=repr)


def vectors(n: int, dim: int, seed: int):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    rows = [(int(i), [float(np.float32(x)) for x in (centres[i % 4] + r.normal(size=dim)) / 4], int(r.integers(0, 4)))
            for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None, 1), (150, [], 1), (200, [nan] * dim, 1), (250, [inf] + [0.1] * (dim - 1), 2), (None, [0.1] * dim, 1),
           (300, [0.1] * dim, None), (350, [0.5, 0.5], 1), (351, [0.5, 0.4], 1), (352, [0.5, 0.3], 2), (400, [0.0] * dim, 3),
           (401, [None] + [0.1] * (dim - 1), 1), (450, [-0.3] * dim, 2)]
    return rows + odd + rows[:3] + [rows[5]] * 9


@pytest.mark.parametrize("shard, block, dim", [(8192, 8192, 7), (60, 3, 64), (100, 8192, 33)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shard, block, dim):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "PROBE", 8)
    rows = vectors(500, dim, dim)
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4))
    assert rows_of(hard_negatives.mined(df)) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mined(none).count() == 0


def test_summaries_bound_scores():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(40, 37)) * 9, r.normal(size=(30, 37)) * 5 + 2
    a, b = (hard_negatives.Shard(p, *hard_negatives.summaries(p, 16), 37) for p in (x, y))
    widths = []
    for level, segments in enumerate(hard_negatives.LEVELS):
        low, high = a.bounds(level, b, np.arange(30), slice(0, 40))
        low, high = low.T if low.shape != (40, 30) else low, high.T if high.shape != (40, 30) else high
        assert (low <= x @ y.T).all() and (x @ y.T <= high).all()
        widths.append((high - low).mean())
        fine = hard_negatives.summaries(y, 16)
        for got, want in zip(hard_negatives.coarser(*fine, 3, segments), hard_negatives.summaries(np.pad(y, ((0, 0), (0, 11))), segments)):
            assert np.allclose(got, want)
    assert widths == sorted(widths, reverse=True)
