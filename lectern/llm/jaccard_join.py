"""Exact n-gram Jaccard join with set-relation skipping, and the classes its links form.

A document's set holds its distinct five-word shingles (A-Z lowered), as 64-bit hashes; a text with one to four words is
one shingle.  Two sets link when 100 * intersection >= 80 * union.  No pair is missed by design: candidates come from
bounds that every linked pair meets, and the bounds use counts over all documents.

1. Equal sets have equal 128-bit fingerprints and count as one set.
2. Every shingle goes, packed with its set's place, to one of many hash ranges, where the number of sets that hold it is
   counted.  Only shingles of two or more sets come back.  A set links only if at least four fifths of it came back.
3. What came back is ordered by frequency, then hash.  Two linked sets meet in the lists of their first shingles (prefix
   filter).  Shingles that a task meets often are sent once, with their count, so no range collects a hot list.
4. Index lists are answered by leaders: a few sets of a list are compared with the rest, exactly.  Sets that link to one
   are one class, and no pair inside a class is looked at again.  After `ROUNDS` rounds, what is left in lists with
   several classes is joined by blocks of set size, skipping pairs whose places in the lists leave too little to share,
   and pairs whose intersections with the list's first leader, already computed, bound their own below the threshold.
5. Classes are the connected components of the links; a class is named by its smallest doc_id.

Nulls: documents without words or text have no shingles and a class of their own.  A null doc_id takes part, but never
names a class that has others.  Repeated rows share their class.  An empty table gives an empty result; extra columns
stay out of the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import fresh, stored

PERCENT = 80
WORDS = 5
#: Rounds of leaders, and leaders of a list in each: the set with the smallest share of shingles of its own, then sets
#: by hash.
ROUNDS, LEADERS = 2, 6
#: Sets and shingles that a task packs at once, and the bits of a shingle's hash that are sent.
CHUNK_SETS, CHUNK_SHINGLES, BITS = 30_000, 2_000_000, 48
#: From so many sets of a chunk on, a shingle is sent once for all of them.
HOT = 64
_ALL = 0xFFFF
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                     0x85EBCA77C2B2AE63], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, WORDS)
    s = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        s += w[j:n - k + 1 + j] * _FACTORS[j]
    return np.unique(_mixed(s, 0xBF58476D1CE4E5B9))


def fingerprint(s: np.ndarray) -> bytes:
    parts = [int(_mixed(s, f).sum(dtype=np.uint64)) for f in (0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
    return b"".join(p.to_bytes(8, "big") for p in parts)


def _need(n):
    """The least intersection that a set of n shingles needs with any set it links to."""
    return -(-n * PERCENT // 100)


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, four bytes each where they fit."""
    steps = np.diff(values, prepend=values[:1] * 0).astype(np.uint64)
    small = not len(steps) or steps.max() < 1 << 32
    return (b"\4" if small else b"\10") + steps.astype("<u4" if small else "<u8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4" if data[0] == 4 else "<u8", offset=1).astype(np.uint64), dtype=np.uint64)


_SENT = ["key", "unit", "kind", "a", "b", "c", "d"]
_SENT_TYPE = "key long, unit long, kind int, a binary, b binary, c binary, d binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32()) + (pa.binary(),) * 4
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_SENT)


class _Chunk:
    """Documents packed by one task: their sets, and which shingles each holds."""

    def __init__(self, unit: int, buckets: int):
        self.unit, self.buckets, self.docs, self.sets, self.size = unit, buckets, [], {}, 0

    def add(self, doc_id: int | None, s: np.ndarray) -> None:
        sid = fingerprint(s)
        self.docs.append((doc_id, len(s), sid))
        if len(s) and sid not in self.sets:
            self.sets[sid] = s
            self.size += len(s)

    def rows(self) -> list[tuple]:
        sids = sorted(self.sets)
        sizes = np.array([len(self.sets[s]) for s in sids], np.int64)
        tokens = np.concatenate([self.sets[s] for s in sids] or [np.zeros(0, np.uint64)]) >> np.uint64(64 - BITS)
        place = np.repeat(np.arange(len(sids)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, place = tokens[order], place[order]
        known, first, count = np.unique(tokens, return_index=True, return_counts=True)
        hot = np.repeat(count >= HOT, count)
        side = (_pack(tokens[hot]), place[hot].astype("<u2").tobytes())
        lone = ~hot
        lone[first] = True
        sent, at, weight = tokens[lone], np.where(hot, _ALL, place)[lone], np.where(hot, np.repeat(count, count), 1)[lone]
        edges = np.searchsorted(sent >> np.uint64(BITS - 24), np.arange(self.buckets + 1) * (1 << 24) // self.buckets)
        ids = np.array([0 if d is None else d for d, _, _ in self.docs], "<i8")
        doc = b"".join((ids.tobytes(), np.array([d is None for d, _, _ in self.docs], "u1").tobytes(),
                        np.array([n for _, n, _ in self.docs], "<i4").tobytes(), b"".join(s for _, _, s in self.docs)))
        out = [(-1 - self.unit, self.unit, 0, doc, b"".join(sids), sizes.astype("<i4").tobytes() , side[0]),
               (-1 - self.unit, self.unit, 1, side[1], None, None, None)]
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
            if j > i:
                heavy = at[i:j] == _ALL
                out.append((b, self.unit, 2, _pack(sent[i:j]), at[i:j].astype("<u2").tobytes(),
                            weight[i:j][heavy].astype("<u4").tobytes(), None))
        return out


def _packer(buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unit = _WordHashes(), TaskContext.get().partitionId() << 24
        chunk = _Chunk(unit, buckets)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(doc_id, shingles(text.as_py(), hashes))
                if len(chunk.docs) >= CHUNK_SETS or chunk.size >= CHUNK_SHINGLES:
                    yield _sent(chunk.rows())
                    unit += 1
                    chunk = _Chunk(unit, buckets)
        if chunk.docs:
            yield _sent(chunk.rows())
    return pack


def _counted(table: pa.Table) -> pa.Table:
    """For one range of hashes: what two or more sets hold goes back to each chunk with its frequency.

    Frequencies are sent as levels, eight to an octave: they only order shingles.
    """
    kinds = table.column("kind").to_numpy()
    if len(kinds) and kinds[0] != 2:
        return table
    units = table.column("unit").to_numpy()
    parts = [(_unpack(a), np.frombuffer(b, "<u2"), np.frombuffer(c, "<u4")) for a, b, c in zip(
        *(table.column(x).to_pylist() for x in "abc"))]
    sizes = [len(t) for t, _, _ in parts]
    tokens, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    weight = np.ones(len(tokens), np.int64)
    weight[place == _ALL] = np.concatenate([p[2] for p in parts])
    _, back, = np.unique(tokens, return_inverse=True)
    total = np.bincount(back, weights=weight)[back]
    level = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype("u1")
    out, at = [], 0
    for unit, n in zip(units, sizes):
        keep = np.flatnonzero(total[at:at + n] >= 2) + at
        at += n
        if len(keep):
            out.append((-1 - int(unit), int(unit), 2, _pack(tokens[keep]), place[keep].astype("<u2").tobytes(),
                        level[keep].tobytes(), None))
    return pa.Table.from_batches([_sent(out)])


_GATHERED = "doc_id long, n long, sid binary, alone int, prefix int, tokens array<long>"


def _gathered(table: pa.Table) -> pa.Table:
    """For one chunk: a row per document (without tokens), and one per set that may link (without doc_id)."""
    rows = table.select(["kind", "a", "b", "c", "d"]).to_pylist()
    head = next(r for r in rows if r["kind"] == 0)
    tail = next(r for r in rows if r["kind"] == 1)
    doc, m = head["a"], len(head["a"]) // 29
    ids, missing = np.frombuffer(doc, "<i8", m), np.frombuffer(doc, "u1", m, 8 * m).astype(bool)
    counts = np.frombuffer(doc, "<i4", m, 9 * m)
    sids = [doc[13 * m + 16 * i:13 * m + 16 * i + 16] for i in range(m)]
    sizes = np.frombuffer(head["c"], "<i4").astype(np.int64)
    hot, hot_place = _unpack(head["d"]), np.frombuffer(tail["a"], "<u2").astype(np.int64)
    got = [(_unpack(r["a"]), np.frombuffer(r["b"], "<u2").astype(np.int64), np.frombuffer(r["c"], "u1"))
           for r in rows if r["kind"] == 2]
    none = np.zeros(0, np.uint64)
    tokens, place, level = (np.concatenate([g[i] for g in got] or [none.astype(t)])
                            for i, t in enumerate((np.uint64, np.int64, np.uint8)))
    shared = place == _ALL
    order = np.argsort(tokens[shared])
    hot_level = level[shared][order][np.searchsorted(tokens[shared][order], hot)] if len(hot) else level[:0]
    tokens = np.concatenate((tokens[~shared], hot))
    place, level = np.concatenate((place[~shared], hot_place)), np.concatenate((level[~shared], hot_level))
    order = np.lexsort((tokens, level, place))
    tokens, met = tokens[order].astype(np.int64), np.bincount(place, minlength=len(sizes))
    ends = np.cumsum(met)
    may = np.flatnonzero((met >= _need(sizes)) & (met > 0))
    lists = [None] * m + [tokens[ends[i] - met[i]:ends[i]] for i in may]
    alone = sizes - met
    prefix = sizes - _need(sizes) + 1 - alone
    return pa.table({
        "doc_id": pa.array(np.concatenate((ids, may * 0)), pa.int64(), mask=np.concatenate((missing, may >= 0))),
        "n": pa.array(np.concatenate((counts, sizes[may])), pa.int64()),
        "sid": pa.array(sids + [head["b"][16 * i:16 * i + 16] for i in may], pa.binary()),
        "alone": pa.array(np.concatenate((counts * 0, alone[may])), pa.int32()),
        "prefix": pa.array(np.concatenate((counts * 0, prefix[may])), pa.int32()),
        "tokens": pa.array(lists, pa.list_(pa.int64()))})


def set_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every document; (sid, n, alone, prefix, tokens) of the sets that may link.

    `tokens` are the shingles that other sets hold too, in the order of the index; `alone` counts the rest.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(buckets), _SENT_TYPE)
    counted = sent.groupBy("key").applyInArrow(_counted, _SENT_TYPE)
    both = stored(counted.groupBy("unit").applyInArrow(_gathered, _GATHERED), "sets")
    nodes = both.where("tokens IS NOT NULL").select("sid", "n", "alone", "prefix", "tokens").dropDuplicates(["sid"])
    return both.where("tokens IS NULL").select("doc_id", "n", "sid"), stored(nodes, "nodes")


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, na, nb, common): exact intersections of pairs of sets."""
    one = nodes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = nodes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return stored(pairs.join(one, "a").join(two, "b").select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common")), "compared")


def _links(compared: DataFrame) -> DataFrame:
    return compared.where(f"100 * common >= {PERCENT} * (na + nb - common)").select("a", "b")


def classes(edges: DataFrame) -> DataFrame:
    """(node, class): the connected components of `edges` (a, b), named by their smallest node.

    Each round a node takes the smallest name among its neighbours and their names' names; every round is written.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    names = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("class")), "names")
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "class"), "b").select(F.col("a").alias("node"), "class")
        least = near.unionByName(names).groupBy("node").agg(F.min("class").alias("low"))
        jump = names.select(F.col("node").alias("low"), F.col("class").alias("lower"))
        step = stored(least.join(jump, "low").join(names, "node").select(
            "node", F.col("lower").alias("now"), "class"), "names")
        changed = step.where("now <> class").limit(1).count()
        names = step.select("node", F.col("now").alias("class"))
        if not changed:
            return names


def _open_entries(entries: DataFrame, names: DataFrame) -> DataFrame:
    """The entries of lists in which several classes are left, with their classes."""
    named = entries.drop("class").join(names.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "class", F.coalesce("class", "sid"))
    several = named.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y")
    return stored(named.join(several.select("token"), "token"), "entries")


def _size_fits(x: str, y: str) -> str:
    return f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"


def linked_classes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, classes) of the sets in `nodes`: links found between them, and the class of each linked set."""
    entries = stored(nodes.select("sid", "n", "alone", F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias(
        "at", "token")).select("token", "sid", "n", (F.col("alone") / F.col("n")).alias("lone"),
        (F.col("alone") + F.col("at")).alias("at"), F.col("sid").alias("class")), "entries")
    entries = _open_entries(entries, entries.select(F.col("sid").alias("node"), F.col("sid").alias("class")).limit(0))
    links = names = None
    for turn in range(ROUNDS):
        lead = F.struct("sid", "n", "class")
        first = [F.min_by(lead, F.struct("lone", "sid"))] + [
            F.min_by(lead, F.xxhash64("sid", F.lit(turn * LEADERS + i))) for i in range(1, LEADERS)]
        led = entries.groupBy("token").agg(*[f.alias(f"lead{i}") for i, f in enumerate(first)])
        met = entries.join(led, "token").withColumn("leads", F.array(*[f"lead{i}" for i in range(LEADERS)]))
        pairs = met.select("sid", "n", "class", F.explode(F.array_distinct("leads")).alias("lead")).where(
            "sid <> lead.sid AND class <> lead.class").where(_size_fits("n", "lead.n")).select(
            F.least("sid", "lead.sid").alias("a"), F.greatest("sid", "lead.sid").alias("b")).distinct()
        compared = _compared(pairs, nodes)
        links = _links(compared) if links is None else links.unionByName(_links(compared))
        names = classes(links)
        rest = met.where("NOT exists(leads, x -> x.sid = sid)").drop("class", "leads")
        if not turn:
            known = compared.select("a", "b", "common").unionByName(
                compared.select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
            rest = rest.withColumn("a", F.col("lead0.sid")).join(
                known.withColumnRenamed("b", "sid"), ["a", "sid"], "left").drop("a")
        entries = _open_entries(rest.drop(*[f"lead{i}" for i in range(LEADERS)]), names)
        if entries.limit(1).count() == 0:
            return links, names
    step = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + 1e-9)
    x = entries.select("token", *[F.col(c).alias(f"{c}x") for c in ("sid", "n", "at", "class", "common")],
                       F.explode(F.array(step, step + 1)).alias("block"))
    y = entries.select("token", *[F.col(c).alias(f"{c}y") for c in ("sid", "n", "at", "class", "common")],
                       step.alias("block"))
    need = f"{PERCENT} * (nx + ny) <= {100 + PERCENT} * "
    skip = "coalesce(least(commony + nx - commonx, commonx + ny - commony), least(nx, ny))"
    pairs = x.join(y, ["token", "block"]).where("classx <> classy AND (nx < ny OR nx = ny AND sidx < sidy)").where(
        _size_fits("nx", "ny")).where(f"{need} least(nx - atx, ny - aty)").where(f"{need} {skip}").select(
        F.col("sidx").alias("a"), F.col("sidy").alias("b")).distinct()
    links = links.unionByName(_links(_compared(pairs, nodes)))
    return links, classes(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, nodes = set_tables(docs)
    _, names = linked_classes(nodes)
    sets = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = sets.join(names.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "class", F.coalesce("class", "sid"))
    heads = named.groupBy("class").agg(F.min("least").alias("component_id"))
    homes = stored(named.join(heads, "class").select("sid", "component_id"), "homes")
    full = rows.where("n > 0").join(homes, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns it came with.

    Rows are told apart by a hash of id and text, so null and repeated ids need no care; of equal rows one stays.
    """
    row = fresh(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"))
    heads = found.where("component_id = doc_id").select(F.col("doc_id").alias(row)).distinct()
    place = fresh(keyed, "place")
    first = Window.partitionBy(row, "doc_id").orderBy(F.xxhash64(*docs.columns))
    return keyed.join(heads, row, "left_semi").withColumn(place, F.row_number().over(first)).where(
        F.col(place) == 1).select(*docs.columns)
