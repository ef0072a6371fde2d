"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words.  Sources get budgets by weight, none above `cap` times its size; what a capped
source leaves goes to the others by weight, which is a common level: target = min(cap * size, weight * level).

Each document has the key -ln(u) / q, u from a hash of its id and text and q from its quality (the share of words among
words and stray symbols).  Sorted by key, a source is a weighted random order without replacement.  Whole epochs of the
source come first; the rest of the budget is filled along that order, the document that meets the end of the budget in
part.  Only the key where a source's budget ends is kept, so a document's share follows from its own row and a table of
sources.  The order is summed by ranges of keys: a source with a third of all rows is spread over many tasks.

Nulls: a null text has size 0; a null source is a source, the last one; a null doc_id is hashed as empty.  Equal rows
have equal keys and share what is left for them evenly, so reruns agree.  Sources without words get nothing.  An empty
table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, running_total, stored, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def sampling_key(doc_id: Column, text: Column, size: Column, seed: str = SEED) -> Column:
    text = F.coalesce(text, F.lit(""))
    mark = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    u = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    stray = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    quality = F.when(size > 0, size / (size + stray)).otherwise(1.0)
    return -F.log(u) / quality


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights are dealt in turn to the sources by code point, null last.  The level is found along the sources sorted by
    how soon they reach their cap.  Both orders are summed by ranges, so sources may be many.
    """
    ranked = running_total(sizes.withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")}),
                           [], ["last", "source"], "one", "rank")
    weigh = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    caps = ranked.select("source", "last", "source_size", weigh.cast("long").alias("weight")).withColumns({
        "cap": F.col("source_size") * cap, "full_at": F.col("source_size") * cap / F.col("weight")})
    order = ["full_at", "last", "source"]
    summed = running_total(running_total(caps, [], order, "cap", "caps_before"), [], order, "weight", "weights_before")
    whole = summed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"))
    level = (F.lit(share) * F.col("s") - F.col("caps_before")) / (F.col("w") - F.col("weights_before"))
    found = summed.join(F.broadcast(whole), F.lit(True)).withColumn("level", level).where(
        F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct(*order)).alias("level"))
    return summed.join(F.broadcast(found), F.lit(True)).select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def sized(docs: DataFrame, size: str, key: str) -> DataFrame:
    """Add each document's size and sampling key."""
    out = docs.withColumn(size, F.size(words(F.col("text"))).cast("long"))
    return out.withColumn(key, sampling_key(F.col("doc_id"), F.col("text"), F.col(size)))


def mix_plan(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_words), one row per source, from (source, size, key).

    Documents with a smaller key than `cut_key` come once more than `epochs` times, those with that key come with
    `cut_words` words more.
    """
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    budget = targets(sizes)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5)
    budget = budget.withColumn("epochs", epochs).withColumn("rest", rest)
    # A rest that rounds up to the whole source is one more epoch: no row would end it.
    full = (F.col("source_size") > 0) & (F.col("rest") >= F.col("source_size"))
    budget = stored(budget.select("source", "source_size", "target", (F.col("epochs") + full.cast("long")).alias("epochs"),
                                  F.when(full, 0).otherwise(F.col("rest")).alias("rest")), "budgets")
    keyed = rows.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("equal"))
    ordered = running_total(keyed, ["source"], ["key"], "size", "before")
    on = ordered["source"].eqNullSafe(budget["source"])
    cut = ordered.join(budget.select("source", "rest"), on).where("before + size > rest").groupBy(
        budget["source"].alias("cut_source")).agg(F.min(F.struct(
            "key", F.floor((F.col("rest") - F.col("before")) / F.col("equal")).alias("words"))).alias("cut"))
    return stored(budget.join(cut, budget["source"].eqNullSafe(cut["cut_source"]), "left").select(
        "source", "source_size", "target", "epochs", F.col("cut.key").alias("cut_key"),
        F.col("cut.words").alias("cut_words")), "plan")


def _planned(rows: DataFrame, plan: DataFrame, size: str, key: str, out: str) -> DataFrame:
    """Add the struct `out`: source_size, target, epochs and the words taken beyond them."""
    p = plan.withColumnRenamed("source", fresh(rows, "plan_source"))
    on = F.col("source").eqNullSafe(p[p.columns[0]])
    extra = F.when(F.col(key) < p["cut_key"], F.col(size)).when(
        F.col(key) == p["cut_key"], F.least(F.col(size), p["cut_words"])).otherwise(0)
    return rows.join(p, on).select(*[rows[c] for c in rows.columns], F.struct(
        p["source_size"], p["target"], p["epochs"], extra.cast("long").alias("extra")).alias(out))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = stored(sized(docs.select("doc_id", "source", "text"), "size", "key").drop("text"), "sized")
    return _planned(rows, mix_plan(rows), "size", "key", "p").select(
        "doc_id", "size", "p.source_size", "p.target",
        (F.col("p.epochs") * F.col("size") + F.col("p.extra")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: one row per epoch, the last one cut where its source's budget ends."""
    rows = stored(sized(docs.select("doc_id", "source", "text"), "size", "key").select("source", "size", "key"), "sized")
    size, key = fresh(docs, "size"), fresh(docs, "key")
    p, copy, upto = fresh(docs, "p"), fresh(docs, "copy"), fresh(docs, "upto")
    taken = _planned(sized(docs, size, key), mix_plan(rows), size, key, p)
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col(f"{p}.epochs") + 1), lambda i: F.when(
        i <= F.col(f"{p}.epochs"), F.col(size)).otherwise(F.col(f"{p}.extra")))
    out = taken.withColumn(upto, F.explode(F.filter(copies, lambda n: n > 0)))
    cut = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col(upto).cast("int")), " ")
    shown = {"text": F.when(F.col(upto) == F.col(size), F.col("text")).otherwise(cut)}
    out = out.withColumns(shown)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
