"""Token ids in ORC files.

Documents are sorted by id over the files and inside them.  A file holds the ids of whole documents: integers are
run-length encoded by ORC, stripes can be read in parallel, and row indexes and a Bloom filter on doc_id let a reader
skip stripes and row groups.  Each document's ids end with `END`.

Encoding is by distinct words: the tokenizer drops white space and never joins across it, so texts are split at ASCII
white space, each word not met before is encoded by the tokenizers library, and a text's ids are those of its words.

Nulls: a null text is an empty one, its only id is `END`; a null doc_id comes first.  Equal doc_ids are ordered by a
hash of the text.  An empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import fresh
from lectern.session import scratch_path

END = 2
#: Parts of words whose ids a Python worker remembers; it only saves time.
REMEMBERED = 500_000
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20), "compression": "zstd",
}
#: Signs at the end of a word that never share a token with the letter or digit before them.
_SIGNS = ".,;:!?%&$#*|"
#: Letters and digits of ASCII and Latin; left out are the two signs among them and the one letter whose lower form has two.
_LETTER_LAST = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]$"
_TAIL = r"(?s)^.*?([.,;:!?%&$#*|]+)$"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of parts of words, as bytes, remembered between the batches of a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def split(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Parts of words that the tokenizer encodes on their own: the cores, the signs behind some, and behind which.

        ASCII is lowered, as the tokenizer does.
        """
        special = pc.match_substring(words, "<|")
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(special))
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        core = pc.utf8_rtrim(words, characters=_SIGNS)
        apart = pc.and_(pc.and_(pc.not_equal(core, words), pc.invert(special)), pc.match_substring_regex(core, _LETTER_LAST))
        tails = pc.replace_substring_regex(words.filter(apart), _TAIL, r"\1")
        return pc.if_else(apart, core, words), tails, apart.to_numpy(zero_copy_only=False)

    def encoded(self, parts: list[str]) -> list[bytes]:
        """The ids of each part; beyond the limit, parts that are not among these are forgotten."""
        known = self.parts
        todo = [p for p in parts if p not in known]
        for at in range(0, len(todo), 20_000):
            some = todo[at:at + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[p] = array("i", e.ids).tobytes()
        found = [known[p] for p in parts]
        if len(known) > REMEMBERED:
            self.parts = dict(zip(parts, found))
        return found

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; every part is looked up once."""
        core, tails, apart = self.split(words)
        core, tails = pc.dictionary_encode(core), pc.dictionary_encode(tails)
        found = self.encoded(core.dictionary.to_pylist() + tails.dictionary.to_pylist())
        ids, sizes = np.frombuffer(b"".join(found), "<i4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        parts = np.full((len(words), 2), -1)
        parts[:, 0] = core.indices.to_numpy(zero_copy_only=False)
        parts[apart, 1] = tails.indices.to_numpy(zero_copy_only=False) + len(core.dictionary)
        length = np.where(parts >= 0, sizes[parts], 0)
        return _laid(ids, sizes, parts[parts >= 0]), length.sum(axis=1)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, `END` after each, and how many each has.

        Arrow numbers the distinct words of the batch, so Python meets each of them once.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = pc.dictionary_encode(split.flatten())
        codes = flat.indices.to_numpy(zero_copy_only=False)
        ids, sizes = self.words(flat.dictionary)
        upto = np.concatenate(([0], np.cumsum(sizes[codes])))
        ends = upto[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        return np.insert(_laid(ids, sizes, codes), ends, END), np.diff(ends, prepend=0) + 1


def _laid(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of the pieces `which`, one after the other; `ids` has those of all pieces, `sizes` how many each has."""
    starts, length = (np.cumsum(sizes) - sizes)[which], sizes[which]
    before = np.cumsum(length) - length
    return ids[np.repeat(starts - before, length) + np.arange(length.sum())]


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


#: Texts are encoded together up to so many bytes.
CHUNK_BYTES = 12 << 20


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about `CHUNK_BYTES` of text, at least one row each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + CHUNK_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write (doc_id, tie, ids) in ascending doc_id order below `path`.  The texts are shuffled once, by id ranges."""
    tie = fresh(docs, "tie")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias(tie), "text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in _cut(batch):
                ids, sizes = encoder.texts(part.column(2))
                offsets, flat = np.concatenate(([0], np.cumsum(sizes))), pa.array(ids.astype("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets.astype("<i4")), flat)],
                    names=["doc_id", "tie", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows.mapInArrow(encode, f"doc_id {kind}, tie long, ids array<int>").write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """doc_id, ids, and the file's number, of all documents in the files; filters on doc_id reach the ORC reader."""
    return spark.read.schema(f"doc_id {kind}, tie long, ids array<int>").orc(path).select(
        "doc_id", "tie", "ids", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("file"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].data) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(at).astype("int64")),
             pa.array(crc, pa.int64())], names=["doc_id", "tie", "file", "n_tokens", "ids_crc32"])


def token_index(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents in `read_tokens`.

    Starts are summed inside each file and added to the sum of the files before; only counts are shuffled.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.select("doc_id", "tie", "ids", "file").mapInArrow(
        _checksums, f"doc_id {kind}, tie long, file long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("file").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.select("file", F.size("ids").alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    bases = sizes.select(F.col("file").alias("in_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.withColumn("at", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(bases, placed["file"] == bases["in_file"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files, read them back and describe each document."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return token_index(read_tokens(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString()))
