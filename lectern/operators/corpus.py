"""Corpus-wide text jobs on a `(doc_id, text)` table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rows import numbered_rows, plain_rows


def normalised_lines(docs: DataFrame, rules: list[tx.Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rules over every line; one row per remaining line, numbered from 0."""
    done = tx.apply_rules_to_lines(tx.lines(F.col(text)), rules)
    return numbered_rows(docs, [key], done, "line_no", "line")


def changed_lines(docs: DataFrame, rule: tx.Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines one rule would change, before and after; none for a pattern that is not valid."""
    rows = numbered_rows(docs, [key], tx.lines(F.col(text)), "line_no", "before")
    return rows.withColumn("after", tx.apply_rules(F.col("before"), [rule])).filter("before <> after")


def rule_dry_run(docs: DataFrame, rules: list[tx.Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """How many lines, matches and documents each rule would change, in one pass over the corpus."""
    tests = []
    for n, rule in enumerate(rules):
        compiled = tx.compile_rule(rule)
        if compiled:
            after = F.regexp_replace("before", F.lit(compiled.pattern), F.lit(compiled.replacement))
            tests.append(F.when(after != F.col("before"), F.struct(
                F.lit(n).alias("rule"), F.regexp_count("before", F.lit(compiled.pattern)).alias("n"))))
    rows = plain_rows(docs, [key], tx.lines(F.col(text)), "before")
    hits = plain_rows(rows, [key], F.array_compact(F.array(*tests)), "t").select(key, "t.*")
    per_doc = hits.groupBy("rule", key).agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    return per_doc.groupBy("rule").agg(
        F.sum("k").alias("changed_lines"), F.sum("m").alias("matches"), F.count("*").alias("documents"))


def first_holder(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Mark rows whose key was met earlier, so that the earlier result can be reused."""
    first = rows.groupBy(key).agg(F.min(order).alias("first_id"))
    return rows.join(first, key).withColumn("reused", F.col(order) > F.col("first_id"))


def set_fingerprint(members: DataFrame, key: str, member: str) -> DataFrame:
    """First 12 hex digits of the MD5 of the sorted member ids joined by `-`.

    Members are dealt by key and sorted inside the tasks; each task feeds them
    to a running digest as they stream by, so a set may have any size.  Null
    members take no part; a set of them only has a null fingerprint, as in SQL.
    """
    rows = members.select(key, F.col(member).cast("string").alias("__m"))
    dealt = rows.repartition(key).sortWithinPartitions(key, "__m")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, now, digest, begun = [], [], None, None, False

        def rows_so_far():
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, schema_type), pa.array(found, pa.string())], names=[key, "fingerprint"])

        schema_type = None
        for batch in batches:
            schema_type = batch.column(0).type
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun or k != now:
                    if begun:
                        keys.append(now)
                        found.append(digest and digest.hexdigest()[:12])
                    now, digest, begun = k, None, True
                if m is None:
                    continue
                if digest is None:
                    digest = hashlib.md5(m.encode())
                else:
                    digest.update(b"-" + m.encode())
            if keys:
                yield rows_so_far()
                keys, found = [], []
        if begun:
            keys.append(now)
            found.append(digest and digest.hexdigest()[:12])
            yield rows_so_far()

    kind = members.schema[key].dataType.simpleString()
    return dealt.mapInArrow(digests, f"`{key}` {kind}, fingerprint string")
