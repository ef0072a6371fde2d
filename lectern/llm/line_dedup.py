"""Line dedup: lines found in several documents stay in the first of them only.

Lines are exploded with a hash of their normal form, documents are counted per hash, and what passes the threshold is
dropped from all documents but the one with the smallest doc_id; the rest is put together again by position.

* Counting shuffles (hash, doc_id) first, so a line found in a third of all documents is counted by many tasks.
* The lines of frequent hashes meet their counts by a broadcast join.  A hash is frequent if it has more than 1/`FREQUENT`
  of all (hash, document) pairs, so there are fewer than `FREQUENT` of them at any size.  All other hashes are joined by
  shuffle, and none of those is hot.
* Texts are shuffled once, to meet the positions to drop; exploded lines travel as hashes.

Keys are compared by their MD5 digest, 128 bits.  A null or empty text is one empty line; it comes back as an empty text.
Rows with equal doc_id are one document.  Rows without doc_id are together one more document, behind all others.  Rows
come back one for one, equal rows too, with all their columns; columns of any name may be there.  An empty table gives an
empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import GAPS, fresh, let, stored

FREQUENT = 4096
MIN_CHARS = 10
MIN_DOCUMENTS = 2


def lines(text: Column) -> Column:
    """The lines of a text, the empty ones too."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Without white space at both ends, A-Z in lower case; all else as it is."""
    bare = F.btrim(line, F.lit(GAPS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _to_drop(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """doc_id, `body` (digest of the text) and the positions `gone` of the lines to drop, for texts that have some."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", _digest(text).alias("body"), F.posexplode(lines(text)).alias("pos", "line"))
    each = each.where(F.char_length(F.btrim("line", F.lit(GAPS))) >= min_chars)
    each = stored(each.select("doc_id", "body", "pos", _digest(line_key(F.col("line"))).alias("hash")), "lines")
    nameless = F.max(F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    counts = each.groupBy("hash").agg(F.min("doc_id").alias("home"), (F.count_distinct("doc_id") + nameless).alias("n"))
    shared = stored(counts.where(F.col("n") >= min_documents), "shared")
    pairs = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent = F.broadcast(shared.where(F.col("n") > pairs / FREQUENT))
    rare = shared.where(F.col("n") <= pairs / FREQUENT)
    met = each.join(frequent, "hash").unionByName(
        each.join(frequent.select("hash"), "hash", "left_anti").join(rare, "hash"))
    return met.where(~F.col("doc_id").eqNullSafe(F.col("home"))).groupBy("doc_id", "body").agg(
        F.collect_set("pos").alias("gone"))


def without_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
                         n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """`docs` with shared lines dropped from `text`, and how many lines there were and went.

    Lines whose key has fewer than `min_chars` code points stay.  The two counts replace columns of those names.
    """
    found = _to_drop(docs.select("doc_id", "text"), min_chars, min_documents)
    body, gone = fresh(docs, "body"), fresh(docs, "gone")
    found = found.select(F.col("doc_id").alias("of"), F.col("body").alias("digest"), F.col("gone").alias("out"))
    own = docs.withColumn(body, _digest(F.coalesce(F.col("text"), F.lit(""))))
    met = own.join(found, own["doc_id"].eqNullSafe(found["of"]) & (own[body] == found["digest"]), "left").select(
        *[own[c] for c in docs.columns], found["out"].alias(gone))
    left = let(lines(F.col("text")), lambda all_: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(gone)), lambda i: F.get(all_, i)), "\n"))
    size = F.size(lines(F.col("text"))).cast("long")
    return met.withColumns({
        "text": F.when(F.col(gone).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(left),
        n_lines: size, n_dropped: F.coalesce(F.size(gone), F.lit(0)).cast("long")}).drop(gone)


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lines before dropping, lines dropped, checksum of the text that is left."""
    return without_shared_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
