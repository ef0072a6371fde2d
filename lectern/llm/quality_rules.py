"""Quality rules with risk-controlled thresholds.

Every document gets five shares of trouble: symbols, equal lines, repeated three-word windows, capitals and exclamation
marks.  A share has twenty levels (level i: the share is above i/20), in integers, so no rounding decides a case.  Per
stratum (language) and rule the cutoff is chosen from the loosest to the tightest by a fixed sequence of exact tests:
with n labelled good documents of which k would be rejected, a cutoff is certified when a binomial(n, `risk` / rules)
gives k or fewer with a probability of at most `miss` / (strata * rules).  The first cutoff that fails ends the
sequence.  So, with probability 1 - `miss` over all strata and rules together, each stratum loses at most `risk` of its
good documents to the rules.  A stratum with too few labels to certify anything rejects nothing beyond the base rule.

Nulls: a null text has no words and fails the base rule; a null language is a stratum of its own; labels without
doc_id or quality are left out, and a document with several labels counts by its lowest.  Repeated rows are judged one
by one; an empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, fresh, let, stored, words

LEVELS = 20
RULES = ("symbols", "equal_lines", "repeats", "capitals", "exclamations")
SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-Z]"
#: Bits for a window's place in its text, below the bits of its hash.
PLACE_BITS = 20
RISK = 0.02
MISS = 0.05


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _covered(pairs: Column) -> Column:
    """How many words the windows that start at the positions in `pairs` cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(F.flatten(pairs), lambda i: F.array(i, i + 1, i + 2)))))


def _repeat_words_by_sort(v: Column) -> Column:
    """The words of all windows sorted, so that equal windows are neighbours."""
    windows = F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.struct(
        F.get(v, i).alias("a"), F.get(v, i + 1).alias("b"), F.get(v, i + 2).alias("c"), i.alias("i")))
    return let(F.sort_array(windows), lambda s: _covered(F.zip_with(
        F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
        lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["i"], y["i"]))
        .otherwise(F.array().cast("array<int>")))))


def _repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    A window is one number, hash above position, which sorts fast.  Neighbours with equal hashes are compared word by
    word; if any two differ, or the text has more words than positions, the windows themselves are sorted.
    """
    mask = F.lit(-(1 << PLACE_BITS))

    def same(v, i, j):
        return ((F.get(v, i) == F.get(v, j)) & (F.get(v, i + 1) == F.get(v, j + 1))
                & (F.get(v, i + 2) == F.get(v, j + 2)))

    def place(x):
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def by_hash(v):
        packed = F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(
            F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)).bitwiseAND(mask).bitwiseOR(i.cast("long")))

        def neighbours(s):
            met = F.filter(
                F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
                           lambda x, y: F.when(x.bitwiseXOR(y).bitwiseAND(mask) == 0, F.array(place(x), place(y)))),
                lambda p: p.isNotNull())
            return let(met, lambda m: F.when(F.size(m) == 0, F.lit(0)).when(
                F.exists(m, lambda p: ~same(v, p[0], p[1])), _repeat_words_by_sort(v)).otherwise(_covered(m)))

        return let(F.sort_array(packed), neighbours)

    return let(w, lambda v: F.when(F.size(v) < 4, F.lit(0)).when(
        F.size(v) >= (1 << PLACE_BITS), _repeat_words_by_sort(v)).otherwise(by_hash(v))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _level(part: Column, whole: Column) -> Column:
    """How many of the cutoffs 1/20 ... 19/20 lie below part / whole."""
    level = F.least(F.lit(LEVELS - 1).cast("long"), F.call_function("div", part * LEVELS - 1, whole))
    return F.when((part > 0) & (whole > 0), level).otherwise(0).cast("int")


def measure(docs: DataFrame, out: str) -> DataFrame:
    """Add the struct `out`: counts, base verdict and levels of the rules of each whole text.

    Counts stay plain columns until the last step: parts of a struct would be computed anew at each use.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ("w", "l", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
             "n_exclamations")
    at = {n: fresh(docs, f"{out}_{n}") for n in names}
    c = {n: F.col(x) for n, x in at.items()}
    df = docs.withColumns({at["w"]: words(F.col("text")), at["l"]: _lines(text)})
    df = df.withColumns({
        at["n_words"]: F.size(c["w"]).cast("long"), at["word_chars"]: F.length(F.array_join(c["w"], "")).cast("long"),
        at["n_symbols"]: _count(text, SYMBOLS), at["n_lines"]: F.size(c["l"]).cast("long"),
        at["n_dup_lines"]: (F.size(c["l"]) - F.size(F.array_distinct(c["l"]))).cast("long"),
        at["n_repeat_words"]: _repeat_words(c["w"]), at["n_capitals"]: _count(text, CAPITALS),
        at["n_exclamations"]: (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
    })
    return df.withColumn(out, F.struct(
        F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), *[c[n].alias(n) for n in names[2:7]],
        ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("base_failed"),
        F.array(_level(c["n_symbols"], c["word_chars"]), _level(c["n_dup_lines"], c["n_lines"]),
                _level(c["n_repeat_words"], c["n_words"]), _level(c["n_capitals"], c["word_chars"]),
                _level(c["n_exclamations"], c["n_words"])).alias("levels"))).drop(*at.values())


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), summed term by term; 1 where k is above the mean, which no test needs."""
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct((n * F.log1p(F.lit(-p))).alias("log"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["log"] + F.log((n - i) / (i + 1)) + F.log(F.lit(p / (1 - p)))).alias("log"),
                                (acc["sum"] + F.exp(acc["log"])).alias("sum")),
        lambda acc: acc["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(terms)


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, miss: float = MISS) -> DataFrame:
    """(stratum, cutoffs): the tightest certified level of each rule, null where none is.

    `measured`: doc_id and the struct `q` of `measure`.  One row per stratum.
    """
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    good = measured.where("NOT q.base_failed").select("doc_id", "q.stratum", "q.levels").join(
        truth.where("quality = 1").select("doc_id"), "doc_id")
    counts = stored(good.select("stratum", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum((F.col("level") >= i).cast("long")) for i in range(LEVELS - 1, 0, -1)]).alias("k")), "counts")
    tests = max(1, counts.count())
    certified = F.aggregate(
        F.transform("k", lambda k: _tail(F.col("n"), k, risk / len(RULES)) <= miss / tests),
        F.struct(F.lit(0).alias("passed"), F.lit(True).alias("open")),
        lambda acc, ok: F.struct((acc["passed"] + (acc["open"] & ok).cast("int")).alias("passed"),
                                 (acc["open"] & ok).alias("open")),
        lambda acc: acc["passed"])
    cut = F.when(F.col("passed") > 0, F.lit(LEVELS) - F.col("passed"))
    table = counts.withColumn("passed", certified).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == i, cut)).alias(r) for i, r in enumerate(RULES)])
    return stored(table.select("stratum", F.array(*RULES).alias("cutoffs")), "cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, q: str, out: str) -> DataFrame:
    """Add `out`: whether the document is kept.

    `cutoffs` was written by `fit_cutoffs`, so Spark knows its size and broadcasts it only below the threshold of the
    session; beyond it, adaptive execution splits a hot stratum.
    """
    cuts = cutoffs.select(F.col("stratum").alias(fresh(measured, "cut_stratum")),
                          F.col("cutoffs").alias(fresh(measured, "cut_levels")))
    on, levels = cuts.columns
    over = F.exists(F.zip_with(f"{q}.levels", levels, lambda a, b: F.coalesce(a >= b, F.lit(False))), lambda x: x)
    return measured.join(cuts, F.col(f"{q}.stratum") == F.col(on), "left").withColumn(
        out, ~F.col(f"{q}.base_failed") & ~F.coalesce(over, F.lit(False))).drop(on, levels)


def rule_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document."""
    measured = stored(measure(docs.select("doc_id", "text", "lang"), "q").select("doc_id", "q"), "measured")
    judged = judge(measured, fit_cutoffs(measured, labels), "q", "kept")
    return judged.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
                         "q.base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    measured = stored(measure(docs.select("doc_id", "text", "lang"), "q").select("doc_id", "q"), "measured")
    cutoffs = fit_cutoffs(measured, labels)
    q, kept = fresh(docs, "q"), fresh(docs, "kept")
    return judge(measure(docs, q), cutoffs, q, kept).where(kept).select(*docs.columns)
