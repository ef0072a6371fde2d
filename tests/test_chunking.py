"""Chunkers against short, plain re-statements of their rules and as properties."""

import random
import re

from pyspark.sql import functions as F

from lectern.operators import chunking as ch


def rows(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def invented_texts(n=25, seed=7):
    rng = random.Random(seed)
    words = "le la M. Dr. etc. A. maison grande; eau, feu: non! oui? fin. «Bon.» dit-il \"Ah!\" J.-C. cf. vent… Bref. "
    words = words.split() + ["x" * 70, "12.5", "mot"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 420))) for _ in range(n)] + ["", " ", "y" * 1300]


def chunks(spark, column, texts):
    got = rows(spark, *texts).select("i", column(F.col("text")).alias("c")).orderBy("i").collect()
    return [r["c"] for r in got]


def ends_with_stop(text, at, shorts):
    head = text[: at + 1]
    return not head.endswith(tuple(shorts)) and not re.search(r"\b[A-Za-zÀ-ÿ]\.$", head)


def quote_shift(text, at, width, blanks, closers):
    m = re.match(f"[{blanks}]*[{re.escape(closers)}]", text[at + 1: at + 1 + width])
    return m.end() if m else 0


def prose_by_hand(text):
    """Scan right to left inside each tier."""
    out, rest = [], text.strip()
    while len(rest) > 500:
        cut = None
        for low, high in ((400, 500), (200, 400), (500, min(len(rest), 650)), (0, 200)):
            for at in range(high - 1, low - 1, -1):
                if rest[at] in ".!?" and ends_with_stop(rest, at, ch.PROSE_ABBREVIATIONS):
                    got = at + quote_shift(rest, at, 4, " \xa0", ch.PROSE_CLOSERS)
                    cut = got if got > 0 else None
                    break
            if cut:
                break
        if cut is None:
            space = rest.rfind(" ", 400, 500)
            cut = space if space >= 0 else 500
        out.append(rest[: cut + 1].strip())
        rest = rest[cut + 1:].strip()
    return out + ([rest] if rest else [])


def play_by_hand(text):
    out, rest = [], text.strip()
    while len(rest) > 400:
        window = rest[250:400]
        cut = None
        for marks in (".!?", ":", ","):
            found = []
            for mark in marks:
                at = window.rfind(mark)
                if at >= 0 and ends_with_stop(rest, 250 + at, ch.PLAY_ABBREVIATIONS):
                    found.append(250 + at)
            if found:
                cut = max(found) + quote_shift(rest, max(found), 3, " ", ch.PLAY_CLOSERS)
                break
        if cut is None:
            cut = rest.rfind(" ", 250, 400) if " " in window else 400
        out.append(rest[: cut + 1].strip())
        rest = rest[cut + 1:].strip()
    return out + ([rest] if rest else [])


def test_prose_chunks_match_a_plain_scan(spark):
    texts = invented_texts()
    assert chunks(spark, ch.prose_chunks, texts) == [prose_by_hand(t) for t in texts]


def test_play_chunks_match_a_plain_scan(spark):
    texts = invented_texts(seed=11)
    assert chunks(spark, ch.play_chunks, texts) == [play_by_hand(t) for t in texts]


def test_long_form_chunks(spark):
    split = ch.long_form_chunks(40)
    texts = [
        "", "short", "One is here. Then dr. Who is here at last. And more text",
        "no stops at all but, a clause; and then words go on", "x" * 95,
        "pi is 3. and then [laugh. loud] more words follow after", "これは文です。これも文です。" * 3,
        "a" * 30 + "[" + "b" * 8 + "]tail",
    ]
    got = chunks(spark, split, texts)
    assert got[0] == [] and got[1] == ["short"]
    assert got[2] == ["One is here.", "Then dr. Who is here at last.", "And more text"]
    assert got[3][0] == "no stops at all but, a clause;"
    assert [len(c) for c in got[4]] == [40, 40, 15]
    assert not any(c.endswith("3.") or c.endswith("[laugh.") for c in got[5])
    assert all(c.endswith("。") for c in got[6])
    assert got[7] == ["a" * 30, "[bbbbbbbb]tail"]
    for text, parts in zip(texts, got):
        assert all(len(c) <= 40 for c in parts)
        assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)


def test_sentence_vectors(one):
    assert one(ch.sentences, "M. Martin arrive. Il dort… la nuit.") == [["M. Martin arrive.", "Il dort… la nuit."]]
    assert one(ch.sentences, "Le loup. Il part.") == [["Le loup. Il part."]]
    assert one(ch.sentences, "Fin ! « Bon. » Suite (ici.) 12 ans.") == [
        ["Fin !", "« Bon. » Suite (ici.)", "12 ans."]]


def test_strict_sentences(spark):
    texts = ["P. Durand vint. Mme. Roy aussi ! Il… partit. Oui… Non. etc. fin", "A… b… c… Donc. x", ""]
    got = ch.sentences_strict(rows(spark, *texts), "text", "s").orderBy("i").collect()
    assert got[0]["s"] == ["P. Durand vint.", "Mme. Roy aussi !", "Il… partit.", "Oui…", "Non.", "etc. fin"]
    assert got[1]["s"] == ["A… b…", "c…", "Donc.", "x"]
    assert got[2]["s"] == []


def test_legacy_sentences(spark):
    got = ch.sentences_legacy(rows(spark, "M. Roy; oui. Non ! fin"), "text", "s").collect()
    assert got[0]["s"] == ["M.", "Roy;", "oui.", "Non !", "fin"]


def test_packing_keeps_every_sentence(spark):
    texts = invented_texts(seed=3)
    cut = rows(spark, *texts).withColumn("s", ch.sentences(F.col("text")))
    for r in ch.pack(cut, "s", "c", 120).collect():
        assert " ".join(r["c"]) == " ".join(r["s"])
        assert all(len(c) <= 120 or c in r["s"] for c in r["c"])
        left = list(r["s"])
        for chunk, after in zip(r["c"], [*r["c"][1:], None]):
            used = left.pop(0)
            while used != chunk:
                used += " " + left.pop(0)
            # The next sentence would not have fitted.
            assert after is None or len(chunk) + 1 + len(left[0]) > 120


def test_attribution_chunks(spark):
    text = "\n\n".join(["Mot. " * 30, "Long. " * 100, "Fin."])
    got = ch.attribution_chunks(rows(spark, text, "a\nb\nc"), "text", "c", limit=200).orderBy("i").collect()
    assert "".join(got[0]["c"]).split() == text.split() or " ".join(got[0]["c"]).split() == text.split()
    assert all(len(c) <= 200 for c in got[0]["c"])
    assert got[1]["c"] == ["a\n\nb\n\nc"]


def test_speaker_runs_and_pairs(spark):
    got = ch.speaker_runs(rows(spark, "début\nANNA\nBonjour.\nOui.\nLE VIEUX BORIS\nNon.\nCLARA\n"), "text", "r").collect()
    assert [(r["speaker"], r["text"]) for r in got[0]["r"]] == [("ANNA", "Bonjour. Oui."), ("LE VIEUX BORIS", "Non.")]
    pairs = ch.pair_segments(rows(spark, "anna\nOui\n\nDIDAS\n( sort )\nL’AMI\n"), "text", ["i"]).orderBy("num").collect()
    assert [(r["num"], r["profile_id"], r["text"]) for r in pairs] == [(1, "ANNA", "Oui"), (2, "DIDAS", "sort")]


def test_paragraph_segments(spark):
    got = ch.paragraph_segments(rows(spark, "a\n b\n \n\nc\n"), "text", ["i"]).orderBy("num").collect()
    assert [(r["num"], r["text"]) for r in got] == [(1, "a b"), (2, "c")]
