"""Joins, shards, token files, mixing, top-k and the pipeline against plain versions."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import jaccard_join, mixing, piece_codec, sharding, token_store, topk
from lectern.llm.common import stored, table, tokenizer_path
from tests.llm.helpers import SMALL, awkward, awkward_rows, empty, prose, rows_of, spark_words, with_clashes


# --- near duplicates -----------------------------------------------------------------------------------------------

def plain_classes(rows):
    sets = []
    for _, text in rows:
        w = spark_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    of = list(range(len(rows)))

    def find(a):
        while of[a] != a:
            of[a] = of[of[a]]
            a = of[a]
        return a

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in lists[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                of[find(i)] = find(j)
        for g in s:
            lists[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(n: int) -> list[tuple[int, str]]:
    """Copies of one text at all distances around the threshold, and texts that share one passage."""
    r = random.Random(n)
    base, passage = prose(77, 150).split(), prose(78, 40)
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(len(copy))] = f"w{r.randrange(10 ** 6)}"
        out.append((1000 + i, " ".join(copy)))
        out.append((5000 + i, passage + " " + prose(900 + i, r.choice([2, 4, 8, 60]))))
    return out


def test_classes_equal_brute_force(spark):
    rows = [(i, t) for i, t, *_ in awkward_rows()] + family(60)
    rows += [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect() if r[0] >= 18]
    rows = [(d, t) for k, (d, t) in enumerate(rows)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert rows_of(jaccard_join.near_duplicates(docs)) == sorted(plain_classes(rows), key=repr)


def test_classes_do_not_depend_on_packing(spark, monkeypatch):
    docs = spark.createDataFrame(family(50), "doc_id long, text string").repartition(2)
    want = rows_of(jaccard_join.near_duplicates(docs))
    assert want == sorted(plain_classes(family(50)), key=repr)
    # leaders give way to the join by blocks, shingles of two sets already count as hot
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    assert rows_of(jaccard_join.near_duplicates(docs)) == want


@pytest.mark.parametrize("hot", [2, 64])
def test_packed_chunks_come_back_whole(hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    hashes = jaccard_join._WordHashes()
    sent = []
    for unit, rows in enumerate((family(20), family(21)[::-1])):
        chunk = jaccard_join._Chunk(unit, 8)
        for d, t in rows:
            chunk.add(d, jaccard_join.shingles(t, hashes))
        sent += chunk.rows()
    by = defaultdict(list)
    for r in sent:
        by[r[0]].append(r)
    units = defaultdict(list)
    for rows in by.values():
        back = jaccard_join._counted(jaccard_join.pa.Table.from_batches([jaccard_join._sent(rows)]))
        for r in back.to_pylist():
            units[r["unit"]].append(tuple(r[c] for c in jaccard_join._SENT))
    count = Counter(int(g) >> 16 for rows in (family(20), family(21)) for s in {
        jaccard_join.shingles(t, hashes).tobytes() for _, t in rows} for g in np.frombuffer(s, np.uint64))
    for unit, rows in enumerate((family(20), family(21))):
        got = jaccard_join._gathered(jaccard_join.pa.Table.from_batches([jaccard_join._sent(units[unit])])).to_pylist()
        assert sorted(r["doc_id"] for r in got if r["tokens"] is None) == sorted(d for d, _ in rows)
        sets = {jaccard_join.fingerprint(s): s for s in (jaccard_join.shingles(t, hashes) for _, t in rows)}
        for r in got:
            if r["tokens"] is not None:
                shared = sorted(int(g) >> 16 for g in sets[r["sid"]] if count[int(g) >> 16] > 1)
                assert sorted(r["tokens"]) == shared and r["alone"] == r["n"] - len(shared)


def test_one_of_each_class_stays(spark):
    docs = with_clashes(awkward(spark))
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    classes = {(c if c is not None else repr(t), n > 0 or d) for (d, n, c), (_, t, *_) in zip(
        plain_classes([(i, t) for i, t, *_ in awkward_rows()]), awkward_rows())}
    assert out.count() == len(classes)
    assert jaccard_join.near_duplicates(empty(spark)).count() == jaccard_join.one_of_each(empty(spark)).count() == 0


# --- shards --------------------------------------------------------------------------------------------------------

def test_shards(spark):
    docs = with_clashes(awkward(spark)).unionByName(with_clashes(table(spark, SMALL, "documents")))
    text = {}
    for r in docs.select("doc_id", "text").collect():
        text.setdefault(r[0], []).append(r[1] or "")
    out = sharding.shard_documents(docs, shards=5, slots=256).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r["size"], r["text_crc32"]) in [(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in text[r["doc_id"]]]
    load = Counter()
    for s in range(5):
        here = sorted(r["slot"] for r in out if r["shard"] == s)
        assert here == list(range(len(here)))
    for r in out:
        load[r["shard"]] += r["size"]
    slots = Counter()
    for r in out:
        slots[r["virtual_slot"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= max(slots.values())
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_slot_maps_are_versioned_and_grow(spark, tmp_path):
    records = spark.range(5000).select(sharding.slot_of(F.col("id"), slots=128).alias("slot"), (F.col("id") % 97 + 1).alias("size"))
    loads = stored(sharding.slot_bytes(records, 128), "loads")
    maps = sharding.SlotMaps(spark, str(tmp_path / "maps"))
    maps.store(0, sharding.initial_map(spark, 4, 128))
    maps.store(1, sharding.rebalance(maps.load(0), loads, 4))
    maps.store(2, sharding.grow(maps.load(1), loads, 4))
    old, new = ({r["slot"]: r["shard"] for r in maps.load(v).collect()} for v in (1, 2))
    assert set(old) == set(new) == set(range(128)) and all(new[s] in (old[s], 4) for s in old)
    size = {r["slot"]: r["bytes"] for r in loads.collect()}
    load = Counter()
    for s in new:
        load[new[s]] += size[s]
    assert load[4] > 0.6 * sum(load.values()) / 5


# --- token files ---------------------------------------------------------------------------------------------------

def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    docs = with_clashes(awkward(spark)).unionByName(with_clashes(table(spark, SMALL, "documents").where("doc_id >= 120")))
    docs = docs.dropDuplicates(["doc_id"])
    rows = sorted(((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for i, t in rows:
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert rows_of(token_store.token_report(docs, path)) == sorted(want, key=repr)
    assert token_store.token_report(empty(spark), path).count() == 0


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    model, encoder, r = Tokenizer.from_file(path), token_store.WordEncoder(path), random.Random(7)
    bits = ["Hello", "it's", "'s", ",", "!!", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "é", "H̱", "ẖ", "İ", "ſ",
            " ", "\n", "\x1c", "\xa0", "12", "%%%", "ß.", "世界", "…", "̸", "<", "=", "_", "A", "ﬁ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 15))) for _ in range(2000)]
    ids, sizes = encoder.texts(token_store.pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes):
        assert ids[at:at + n].tolist() == model.encode(t, add_special_tokens=False).ids + [2], t
        at += n


# --- pieces --------------------------------------------------------------------------------------------------------

def test_scan_and_units_equal_the_library():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    c, model, r = piece_codec.codec(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    bits = ["a", "the", "ing", " ", "  ", "     ", "é", "ß", "\n", "▁", "1", "世", "😀", "er", "tion", "x"]
    for _ in range(400):
        text, size = "".join(r.choice(bits) for _ in range(r.randint(1, 80))), r.choice([3, 5, 17, 40])
        want, s, chunks = model.encode(text), piece_codec.marked(text), []
        for at in range(0, len(s), size):
            base, upto = max(0, at - c.longest), min(len(s), at + size)
            chunks.append(piece_codec.Chunk(c, s[base:at + size + c.longest], at - base, upto - base, upto == len(s)))
        states = piece_codec.best_states([x.matrix() for x in chunks])
        laid = b"".join(x.lay(x.entries[i], x.exits[j]) for x, i, j in zip(chunks, states[:-1], states[1:]))
        assert np.frombuffer(laid, "<i4").tolist() == np.frombuffer(c.encode([text])[0], "<i4").tolist() == want
        assert c.decode(np.array(want)) == text.replace("▁", " ")


def test_codec_over_awkward_rows(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = with_clashes(awkward(spark))
    want = []
    for i, t, *_ in awkward_rows():
        ids = model.encode(t or "")
        want.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}i", *ids)), len(t or ""), True))
    assert rows_of(piece_codec.codec_report(docs, path, giant=900, chunk=300)) == sorted(want, key=repr)
    assert piece_codec.codec_report(empty(spark), path).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------

def test_targets_equal_resharing(spark):
    r = random.Random(4)
    sizes = [(f"s{i:03}", r.choice([0, 1, 10, 1000, 50_000])) for i in range(40)] + [(None, 77)]
    got = {x["source"]: x["target"] for x in mixing.targets(
        spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
    target, left, open_ = dict.fromkeys(weight, 0.0), 1.5 * sum(n for _, n in sizes), set(weight)
    while left > 1e-6 and open_:
        total = sum(weight[s] for s in open_)
        share, left = {s: left * weight[s] / total for s in open_}, 0.0
        for s, x in share.items():
            target[s] += x
        for s, n in sizes:
            if target[s] > 2 * n:
                left += target[s] - 2 * n
                target[s] = 2.0 * n
                open_.discard(s)
    assert all(math.isclose(got[s], target[s], rel_tol=1e-9, abs_tol=1e-6) for s in target)


def test_mix_takes_its_targets(spark):
    docs = with_clashes(awkward(spark)).unionByName(with_clashes(table(spark, SMALL, "documents")))
    out = mixing.mix_report(docs)
    assert rows_of(out) == rows_of(mixing.mix_report(docs.repartition(5))) and out.count() == docs.count()
    assert out.where("taken < 0 OR taken > 2 * size").count() == 0
    one = docs.where("source IS NOT NULL AND doc_id >= 120")
    per = mixing.mix_report(one).join(one.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("x"))
    assert per.where("abs(t - x) > 1").count() == 0
    mixed = mixing.mixed_documents(docs)
    words = sum(len(spark_words(r["text"])) for r in mixed.select("text").collect())
    assert mixed.columns == docs.columns and words == out.agg(F.sum("taken")).first()[0]
    assert mixing.mix_report(empty(spark)).count() == mixing.mixed_documents(empty(spark)).count() == 0


def test_a_rest_that_rounds_up_to_a_source_is_an_epoch(spark, monkeypatch):
    given = {"a": (1, 0.6, 1), "b": (3, 2.6, 3), "c": (3, 5.6, 6), "d": (3, 2.4, 2), "e": (0, 0.0, 0), None: (1, 1.7, 2)}
    texts = [(i, " ".join(["w"] * n), s) for i, (s, (n, _, _)) in enumerate(given.items())]
    texts[1:2] = [(10 + i, f"w{i}", "b") for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    want = spark.createDataFrame([(s, x) for s, (_, x, _) in given.items()], "s string, target double")
    monkeypatch.setattr(mixing, "targets", lambda sizes: sizes.join(
        want, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target"))
    taken = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken"))
    assert {r[0]: r[1] for r in taken.collect()} == {s: n for s, (_, _, n) in given.items()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len(spark_words(r["text"]))
    assert got == Counter({s: n for s, (_, _, n) in given.items() if n})


# --- top k ---------------------------------------------------------------------------------------------------------

def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 520)]
    rows += [(550, None), (600, [None] * 6), (650, [float("nan")] * 6), (700, [float("inf")] * 6), (None, [1.0] * 6),
             (750, []), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (50, rows[50][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("size", F.lit("x"))
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, a in sorted(good):
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:5])]
    assert rows_of(topk.top_k(vectors)) == sorted(want, key=repr)
    assert topk.top_k(vectors.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stored(stage(spark, docs, SMALL), name)
        if k < 4:
            assert docs.columns == before.columns
    assert docs.count() > 0 and docs.columns == ["doc_id", "n_pieces", "ids"]
    assert rows_of(docs) == rows_of(corpus_pipeline.run(spark, SMALL))
