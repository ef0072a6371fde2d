"""Toxicity by weak supervision.

Voters look at a text: each of the strongest entries of a lexicon is a voter of its own, weaker entries share voters,
and patterns (threats, shouting, density of hits) vote too; one voter votes for clean where no entry is met.  A voter
that sees nothing abstains, which is no evidence.  The lexicon holds a list of insults and the words and word beginnings
that labelled toxic texts use far more often than labelled clean ones.  A generative label model, a class
of known share and votes given the class, is fitted by EM over the counts of all vote signatures outside the held-out
fold; votes that go together within the toxic class share their weight by their correlations.  A linear classifier on
hit counts and pattern votes is then trained on the posterior labels and scores every text, on one scale; texts without
hits differ by their pattern votes only.

Labels are read from rows only where crc32(doc_id) mod `FOLDS` is not `HELD_OUT`.  Mining and the classifier use at
most `MOST_TOXIC` + `MOST_CLEAN` labelled rows, chosen by hash; voting, signatures and scores cover every document.

Nulls: a null text is an empty one and scores as a text without hits or patterns; a row without doc_id is not held out and has no
label; labels without doc_id or toxic are left out, and a document with several labels counts as toxic if one says so.
Repeated rows score alike; an empty table gives an empty result; without labels the list of insults alone votes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from lectern.llm.common import let, stored, words

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MOST_TOXIC, MOST_CLEAN = 10_000, 30_000
#: Entries of the mined lexicon, those with voters of their own, and voters that the others share.
ENTRIES, OWN, SHARED = 256, 32, 4
#: A mined entry occurs in so many toxic texts, in such a share of them, and so many times as often as in clean ones.
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 8, 0.01, 20.0
#: What an occurrence in clean texts costs an entry when entries are ranked, in occurrences in toxic ones.
CLEAN_COST = 10.0
PREFIXES = (4, 5, 6)
STEPS = 6

# Insults and contempt in the languages of the corpus.
INSULTS = tuple("""
idiot idiots moron morons stupid dumb dumbass fool loser losers clown trash garbage scum worthless pathetic disgusting
imbecile cretin retard bastard bitch asshole jerk filth vermin pig rat creep freak
imbécile crétin connard connasse salaud ordure minable débile abruti pourriture
dummkopf trottel arschloch abschaum widerlich erbärmlich wertlos depp vollidiot mistkerl
idiota imbécil estúpido estúpida basura escoria payaso asqueroso patético inútil cabrón
""".split())
THREATS = re.compile(
    r"\b(?:shut up|go to hell|kill yourself|drop dead|ta gueule|va te faire|halt die klappe|halt's maul|cállate|muérete)\b")

_WORDS = re.compile(r"[^\W\d_]+")
#: Threats, density, shouting and silence.
_PATTERNS = 4


class Lexicon(NamedTuple):
    words: dict[str, int]  #: whole word -> entry
    beginnings: dict[str, int]  #: beginning of a word -> entry
    entries: int
    own: int  #: so many mined entries, the first ones, have a voter of their own

    @property
    def voters(self) -> int:
        return self.patterns + _PATTERNS

    @property
    def patterns(self) -> int:
        """The first of the voters by pattern: threat, density, shouting, silence."""
        return self.own + SHARED + 1

    def voter(self, entry: int, mined: int) -> int:
        if entry >= mined:
            return self.own + SHARED
        return entry if entry < self.own else self.own + entry % SHARED


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _features(text: str | None) -> set[str]:
    found = set(_WORDS.findall(text.lower())) if text else set()
    return found | {w[:n] + "*" for w in found for n in PREFIXES if len(w) > n}


def _mined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = Counter(), Counter()

    def rows():
        keys = list(set(counts[0]) | set(counts[1]))
        return pd.DataFrame({"entry": pd.Series(keys, dtype=object), "clean": [counts[0][k] for k in keys], "toxic": [counts[1][k] for k in keys]})

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts[int(toxic > 0)].update(_features(text))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield rows()
                counts = Counter(), Counter()
    yield rows()


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of a bounded sample of the rows that may be learned from; the share of toxic ones of all."""
    known = stored(labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(
        fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "known")
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double")).alias("x")).first()["x"]
    some = [known.where(rule).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            for rule, most in (("toxic > 0", MOST_TOXIC), ("toxic <= 0", MOST_CLEAN))]
    picked = stored(some[0].unionByName(some[1]), "picked")
    # At most MOST_TOXIC + MOST_CLEAN pairs of numbers are broadcast.
    return stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "labelled"), share or 0.0


def _sketch(w, seed: int):
    """The least hash of a text's three-word windows: near copies mostly have the same."""
    return let(w, lambda v: F.when(F.size(v) < 3, F.xxhash64(F.array_join(v, " "), F.lit(seed))).otherwise(F.array_min(
        F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(
            F.get(v, i), F.get(v, i + 1), F.get(v, i + 2), F.lit(seed))))))


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with near copies thinned out, so that a text's own rare words don't look like a vocabulary."""
    rows = sample.withColumn("w", words(F.col("text"))).withColumns({f"s{i}": _sketch(F.col("w"), i) for i in range(3)})
    for i in range(3):
        rest = [f"s{j}" for j in range(i + 1, 3)]
        rows = rows.groupBy("toxic", f"s{i}").agg(
            F.min_by(F.struct("doc_id", "text", *rest), F.struct("doc_id", "text")).alias("x")).select("toxic", "x.*")
    return stored(rows.select("text", "toxic"), "mined")


def lexicon(sample: DataFrame) -> tuple[Lexicon, int]:
    """The lexicon and how many of its entries, the first ones, are mined."""
    sample = without_copies(sample)
    total = sample.agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("t"),
                       F.count(F.when(F.col("toxic") <= 0, 1)).alias("c")).first()
    counts = sample.select("text", "toxic").mapInPandas(_mined, "entry string, clean long, toxic long").groupBy(
        "entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = counts.where(F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * total["t"])).where(
        F.col("toxic") * (total["c"] + 1.0) >= LEAST_RATIO * (F.col("clean") + 0.5) * (total["t"] + 1.0))
    gain = F.col("toxic") / (total["t"] + 1.0) - CLEAN_COST * F.col("clean") / (total["c"] + 1.0)
    best = strong.orderBy(gain.desc(), F.col("entry").endswith("*"), F.desc(F.length("entry")), "entry").limit(
        8 * ENTRIES).collect()
    picked: list[tuple[str, int]] = []
    for row in best:
        plain = row["entry"].rstrip("*")
        if len(picked) < ENTRIES and not any(
                e.endswith("*") and plain.startswith(e[:-1]) or row["entry"].endswith("*") and e.startswith(plain)
                and row["toxic"] <= 1.1 * n for e, n in picked):
            picked.append((row["entry"], row["toxic"]))
    mined = [e for e, _ in picked]
    words = {e: i for i, e in enumerate(mined) if not e.endswith("*")}
    beginnings = {e[:-1]: i for i, e in enumerate(mined) if e.endswith("*")}
    seeds = [w for w in INSULTS if w not in words and not any(w[:n] in beginnings for n in PREFIXES)]
    words |= {w: len(mined) + i for i, w in enumerate(seeds)}
    return Lexicon(words, beginnings, len(mined) + len(seeds), min(OWN, len(mined))), len(mined)


_VOTES = StructType().add("signature", LongType()).add("n_words", IntegerType()).add(
    "entries", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType()))


def _voted(text: str | None, lex: Lexicon, mined: int) -> tuple[int, int, list[int], list[int]]:
    lower = text.lower() if text else ""
    words = Counter(_WORDS.findall(lower))
    hits: Counter[int] = Counter()
    for word, n in words.items():
        if (e := lex.words.get(word)) is not None:
            hits[e] += n
        else:
            for k in PREFIXES:
                if len(word) > k and (e := lex.beginnings.get(word[:k])) is not None:
                    hits[e] += n
                    break
    total, met = sum(words.values()), sum(hits.values())
    signature, base = 0, lex.patterns
    for e in hits:
        signature |= 1 << lex.voter(e, mined)
    signature |= (bool(lower) and THREATS.search(lower) is not None) << base
    signature |= (met * 100 >= total > 0) << (base + 1)
    if text and total >= 5:
        signature |= (sum(map(str.isupper, text)) * 2 > sum(map(str.isalpha, text))) << (base + 2)
    signature |= (not hits) << (base + 3)
    return signature, total, list(hits), list(hits.values())


def votes(docs: DataFrame, lex: Lexicon, mined: int) -> DataFrame:
    """doc_id, signature, n_words and hits of every document: one pass over whole texts, without a shuffle."""

    @pandas_udf(_VOTES)
    def vote(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_voted(t, lex, mined) for t in texts], columns=_VOTES.names)

    return docs.select("doc_id", vote("text").alias("v")).select("doc_id", "v.*")


class LabelModel(NamedTuple):
    prior: float
    rates: np.ndarray  #: of each vote, for clean and for toxic texts
    weights: np.ndarray  #: of each voter, less than 1 where it goes with others

    def posterior(self, signatures: np.ndarray) -> np.ndarray:
        bits = (signatures[:, None] >> np.arange(len(self.weights))) & 1
        odds = bits @ (self.weights * (np.log(self.rates[1]) - np.log(self.rates[0])))
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.prior / (1 - self.prior)), -50, 50)))


def fit_label_model(signatures: DataFrame, voters: int, prior: float) -> LabelModel:
    """EM over (signature, toxic or null, count).  Each step sends back sums, (voters + 1) squared numbers a class."""
    start = np.tile([[0.01], [0.3]], voters)
    start[:, -1] = 0.9, 0.1  # silence, the last voter, speaks for clean
    model = LabelModel(prior, start, np.ones(voters))

    def sums(current: LabelModel) -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((2, voters + 1, voters + 1))
            for batch in batches:
                s, count = batch["signature"].to_numpy(), batch["count"].to_numpy(float)
                given = batch["toxic"].to_numpy(float)
                p = np.where(np.isnan(given), current.posterior(s), given > 0)
                bits = np.insert((s[:, None] >> np.arange(voters)) & 1, 0, 1, axis=1).astype(float)
                out += [(bits * (w * count)[:, None]).T @ bits for w in (1 - p, p)]
            yield pd.DataFrame({"at": np.arange(out.size), "value": out.ravel()})

        rows = signatures.mapInPandas(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("v")).collect()
        out = np.zeros(2 * (voters + 1) ** 2)
        for r in rows:
            out[r["at"]] = r["v"]
        return out.reshape(2, voters + 1, voters + 1)

    for _ in range(STEPS):
        m = sums(model)
        total = m[:, 0, 0]
        rates = np.clip((m[:, 0, 1:] + 0.01) / (total[:, None] + 1), 1e-6, 1 - 1e-6)
        joint = m[1, 1:, 1:] / max(total[1], 1e-9)
        spread = np.sqrt(np.maximum(rates[1] * (1 - rates[1]), 1e-12))
        tie = np.clip((joint - np.outer(rates[1], rates[1])) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(tie, 0)
        model = LabelModel(prior, rates, 1 / (1 + tie.sum(axis=1)))
    return model


def _inputs(entries: np.ndarray, counts: np.ndarray, n_words: int, signature: int, lex: Lexicon) -> np.ndarray:
    size = lex.entries
    x = np.zeros(size + _PATTERNS + 1)
    x[entries] = np.log1p(counts)
    x[size] = np.log1p(100 * counts.sum() / max(1, n_words))
    x[size + 1:-1] = (signature >> np.arange(lex.patterns, lex.voters - 1)) & 1  # all but silence
    x[-1] = 1
    return x


def fit_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, decay: float = 0.1) -> np.ndarray:
    """Logistic regression on soft targets by Newton's method; the last input is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), decay)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(voted: DataFrame, sample: DataFrame, lex: Lexicon, share: float) -> tuple[np.ndarray, LabelModel]:
    """Weights of the classifier and the label model, from the votes of all documents outside the held-out fold."""
    prior = float(np.clip(share or 0.05, 1e-4, 0.5))
    labels = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample is bounded, so its labels may be broadcast.
    open_votes = voted.where(F.coalesce(fold(F.col("doc_id")), F.lit(-1)) != HELD_OUT).join(
        F.broadcast(labels), "doc_id", "left")
    signatures = stored(open_votes.groupBy("signature", "toxic").count(), "signatures")
    model = fit_label_model(signatures, lex.voters, prior)
    # Repeated doc_ids may pass the sample's bound; a hash, not the arrival, decides which rows are taken then.
    rows = open_votes.where("toxic IS NOT NULL AND size(entries) > 0").select(
        "signature", "n_words", "entries", "counts", F.xxhash64("doc_id", "signature", "entries", "counts").alias("mark")).orderBy(
        "mark").limit(MOST_TOXIC + MOST_CLEAN).collect()
    silent = open_votes.where("toxic IS NOT NULL AND size(entries) = 0").groupBy("signature").count().limit(
        1 << (_PATTERNS + 1)).collect()
    x = [_inputs(np.array(r["entries"]), np.array(r["counts"]), r["n_words"], r["signature"], lex) for r in rows]
    x += [_inputs(np.zeros(0, int), np.zeros(0), 1, r["signature"], lex) for r in silent]
    if not x:
        x = [_inputs(np.zeros(0, int), np.zeros(0), 1, 0, lex)]
    seen = np.array([r["signature"] for r in rows] + [r["signature"] for r in silent] or [0])
    weight = np.array([1] * len(rows) + [r["count"] for r in silent] or [1], float)
    return fit_classifier(np.array(x), model.posterior(seen), weight), model


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sample, share = labelled_sample(docs, labels)
    lex, mined = lexicon(sample)
    voted = stored(votes(docs, lex, mined), "votes")
    w, model = train(voted, sample, lex, share)

    @pandas_udf(DoubleType())
    def score(signature: pd.Series, entries: pd.Series, counts: pd.Series, n_words: pd.Series) -> pd.Series:
        silent: dict[int, float] = {}  # texts without a hit differ by their pattern votes only

        def one(s: int, e: np.ndarray, c: np.ndarray, n: int) -> float:
            if len(e):
                return _logistic(_inputs(e.astype(int), c, n, s, lex) @ w)
            if s not in silent:
                silent[s] = _logistic(_inputs(np.zeros(0, int), np.zeros(0), 1, s, lex) @ w)
            return silent[s]

        return pd.Series([one(*r) for r in zip(signature, entries, counts, n_words)], dtype=float)

    scored = voted.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
                          score("signature", "entries", "counts", "n_words").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
