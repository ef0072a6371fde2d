from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import attribution as at
from lectern.operators import play


def rows(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def pairs(value):
    return [(p["speaker"], p["text"]) for p in value]


def test_parse_vector(spark):
    text = "\n\n".join(["ACTE I", "Une salle.", "ANNA", "Bonjour.", "Elle sort.", "BORIS, assis. Entrez.",
                        "Oui (il rit) non."])
    got = play.parse_play(rows(spark, text), "text", "p", ["ANNA", "BORIS"]).collect()[0]["p"]
    assert pairs(got) == [
        ("DIDAS", "ACTE I"), ("DIDAS", "Une salle."), ("ANNA", "Bonjour."), ("DIDAS", "Elle sort."),
        ("DIDAS", "BORIS, assis. Entrez."), ("BORIS", "Oui"), ("DIDAS", "(il rit)"), ("BORIS", "non.")]


def test_alternation_restarts_and_brackets_set_the_side(spark):
    text = "\n\n".join(["anna", "Un.", "Deux.", "Trois.", "Ah (rit)", "Quatre.", "L’ami (bas) dit", "Cinq.\nSix.",
                        "SCÈNE II", "Sept.", "L'AMI", "Huit (a (b) c"])
    got = play.parse_play(rows(spark, text), "text", "p", ["ANNA", "L'AMI"]).collect()[0]["p"]
    assert pairs(got) == [
        ("ANNA", "Un."), ("DIDAS", "Deux."), ("ANNA", "Trois."), ("ANNA", "Ah"), ("DIDAS", "(rit)"), ("ANNA", "Quatre."),
        ("DIDAS", "L'AMI, (bas) dit"), ("L'AMI", "Cinq. Six."), ("DIDAS", "SCÈNE II"), ("DIDAS", "Sept."),
        ("L'AMI", "Huit"), ("L'AMI", "(a (b) c")]


def test_bracket_parts(one):
    show = lambda c: F.transform(play.bracket_parts(c), lambda p: F.concat(
        F.when(p["direction"], "D:").otherwise("S:"), p["text"]))
    got = one(show, "a (b (c) d) e", "x) y (z", "(a (b)", "(un)(deux)", "rien")
    assert got == [["S:a", "D:(b (c) d)", "S:e"], ["S:x) y", "S:(z"], ["D:(a (b)"], ["D:(un)", "D:(deux)"], ["S:rien"]]


def test_strict_parser(spark):
    text = "OLGA, sans bouger.\n\nOui. (Un temps.) Non (a (b)\n\nolga\n\nHUGO\n\nBien."
    got = play.parse_play(rows(spark, text), "text", "p", ["OLGA", "HUGO"], strict=True).collect()[0]["p"]
    assert pairs(got) == [
        ("DIDAS", "Olga, sans bouger."), ("OLGA", "Oui."), ("DIDAS", "(Un temps.)"), ("OLGA", "Non"), ("DIDAS", "(a (b)"),
        ("OLGA", "olga"), ("HUGO", "Bien.")]


def test_styles(spark):
    def run(style, text, actors, rules=()):
        return play.normalise_text(rows(spark, text), "text", "o", style, actors, list(rules)).collect()[0]["o"]

    modern = "Eva (bas) – Bonjour\nà tous\nALBAN — Oui\n\n12\nFin"
    assert run("modern", modern, ["Eva", "Alban"]) == "EVA\n\n(bas) Bonjour à tous\n\nALBAN\n\nOui\n\nFin"
    assert run("classic", "JEANNE. Viens.\nSuite\nSimon . Non", ["Jeanne", "Simon"]) == (
        "JEANNE\n\nViens. Suite\n\nSIMON\n\nNon\n")
    assert run("moliere", "Dorine\nUn vers\nun autre\nOrgon\nFin", ["Dorine", "Orgon"]) == (
        "DORINE\n\nUn vers un autre\n\nORGON\n\nFin")
    assert run("([broken __ACTORS__", "Eva – Oui", ["Eva"]) == "EVA\n\nOui\n"
    assert run("none", "a\n\n\n\nb\n3\nx", [], [tx.Rule("x", "")]) == "a\n\nb"
    assert run("modern", "D’Or - Oui", ["D'Or"]) == "D'OR\n\nOui\n"


def test_scene_titles_and_duplicates(one):
    scenes = one(lambda c: play.merge_scene_titles(tx.lines(c)), "SCÈNE\n\n\xa0II Anna entre\nx\nSCÈNE\nIII\nSCÈNE")
    assert scenes == [["SCÈNE II", "Anna entre", "x", "SCÈNE III", "SCÈNE"]]
    repeats = one(lambda c: play.drop_repeats(tx.lines(c)), "a\nA\n\na\nb\nA")
    assert repeats == [["a", "b", "A"]]


def test_direction_dedupe(one):
    tag = "[DIDASCALIE] "
    text = "\n".join([tag + "il sort", tag + "il sort", tag + "sort", tag + "il sort vite", "Ligne", tag + "il sort"])
    got = one(lambda c: play.dedupe_directions(tx.lines(c)), text)
    assert got == [[tag + "il sort vite", "Ligne"]]
    named = "\n".join([tag + "ANNA,  bas", "Ligne", tag + "ANNA, bas", tag + "bas", tag + "ANNABEL, haut"])
    got = one(lambda c: play.dedupe_directions(tx.lines(c), ["ANNA", "BORIS"]), named)
    # the line itself holds the bare direction and takes its place
    assert got == [["ANNA", tag + "ANNA,  bas", "Ligne", "ANNA", tag + "ANNA, bas", tag + "ANNABEL, haut"]]


def test_broken_lines(spark):
    df = rows(spark, "Un\ndeux.\n[DIDASCALIE] bas\ntrois\nquatre !\ncinq").withColumn("a", tx.lines(F.col("text")))
    got = play.join_broken_lines(df, "a", "j").collect()[0]["j"]
    assert got == ["Un deux.", "[DIDASCALIE] bas", "trois quatre !", "cinq"]


def test_italics(spark):
    spans = [("Un ", False), ("mot", True), (" ", None), ("fort", True), ("\n", None), ("fin", False)]
    df = spark.createDataFrame([(spans,)], "s array<struct<text:string,is_italic:boolean>>")
    assert df.select(play.italic_runs(F.col("s")).alias("v")).collect()[0]["v"] == "Un (mot fort) \nfin"


def test_dash_and_marker_vectors(one):
    assert one(at.mark_dashes, "A —b— c", "— Oui\n  — Non — dit-il — bien", "rien") == [
        "A —{b}— c", "}— Oui\n  }— Non —{ dit-il }— bien", "rien"]
    got = one(lambda c: F.transform(at.marked_segments(c), lambda s: F.concat(s["type"], F.lit(":"), s["text"])),
              "Il entra. }« Bonjour »{ Puis rien.", "}{ }a")
    assert got == [["N:Il entra.", "S:« Bonjour »", "N:Puis rien."], ["S:a"]]


def test_quotes(spark):
    texts = [
        "« Oui », dit-elle.", "en assurant que « ces gens » allaient", "Il dit « va » et partit", "Fin. « bon »",
        "d'un « Net » refus", "ouvert « sans fin", "elle s'écria : « non » puis « ces » mots", "a }« b »",
    ]
    got = [r["o"] for r in at.premark_turns(rows(spark, *texts), "text", "o").orderBy("i").collect()]
    assert got == [
        "}« Oui »{, dit-elle.", "en assurant que « ces gens » allaient", "Il dit }« va »{ et partit", "Fin. }« bon »{",
        "d'un }« Net »{ refus", "ouvert « sans fin", "elle s'écria : }« non »{ puis « ces » mots", "a }« b »"]


def test_paragraphs_and_asides(spark):
    text = "Il vint\ntard.\n— Oui, dit Anna. puis.\n\n« Non » fit-il\nSuite"
    got = at.dialogue_paragraphs(rows(spark, text), "text", "p").collect()[0]["p"]
    assert got == ["Il vint tard.", "— Oui, dit Anna. puis.", "« Non »", "fit-il Suite"]
    marked = at.premark(rows(spark, text), "text", "o").collect()[0]["o"]
    assert marked == "(Il vint tard.)\n\n— Oui (dit Anna.) puis.\n\n« Non »\n\n(fit-il) Suite"


def test_reply_blocks_and_assignment(spark):
    reply = "préambule\nANNA\nBonjour à tous\nmes amis\n\nNARRATEUR\nIl dit\nBORIS\nJe pars demain matin"
    df = rows(spark, "}« Bonjour à tous mes amis »{ dit-elle. }— Je pars demain.{ }Xyz").withColumn("r", F.lit(reply))
    read = at.speaker_blocks(df, "r", "b").collect()[0]["b"]
    assert pairs(read) == [("ANNA", "Bonjour à tous mes amis"), ("NARRATEUR", "Il dit"), ("BORIS", "Je pars demain matin")]
    done = at.assign_speakers(df.withColumn("s", at.marked_segments(F.col("text"))), "s", "r", "p")
    value = done.collect()[0]["p"]
    assert [p["speaker"] for p in value] == ["ANNA", "NARRATEUR", "BORIS", "PERSONNAGE"]
    script = done.select(at.rendered(at.tidy_pairs(F.col("p"))).alias("v")).collect()[0]["v"]
    assert script == ("ANNA\n\nBonjour à tous mes amis\n\nNARRATEUR\n\ndit-elle.\n\nBORIS\n\nJe pars demain.\n\n"
                      "PERSONNAGE\n\nXyz")
    assert spark.range(1).select(at.speakers(F.lit(reply)).alias("s")).collect()[0]["s"] == ["ANNA", "BORIS"]


def test_tag_transfer(spark):
    original = "« Bonjour », dit Anna. « Je pars. » Il sortit vite."
    tagged = "ANNA\n« Bonjour » (dit Anna.) « Je pars. »\nNARRATEUR\nIl sortit."
    df = rows(spark, original).withColumn("t", F.lit(tagged))
    got = pairs(at.transfer_tags(df, "text", "t", "p").collect()[0]["p"])
    assert " ".join(t for _, t in got) == original
    assert [s for s, _ in got] == ["ANNA", "NARRATEUR", "ANNA", "NARRATEUR"]
    words = spark.range(1).select(at.tagged_words(F.lit("(il entra) BORIS Non ! (bas)\nOui")).alias("w")).collect()[0]["w"]
    assert [(w["word"], w["speaker"]) for w in words] == [
        ("il", "NARRATEUR"), ("entra", "NARRATEUR"), ("Non", "BORIS"), ("!", "BORIS"), ("bas", "NARRATEUR"),
        ("Oui", "BORIS")]


def test_post_process(spark):
    given = [("ANNA", "« Aux champs ! s'écria Boule. il y va. »"), ("NARRATEUR", "dit Paul. « Non »"),
             ("BORIS", "un deux trois quatre cinq six sept"), ("BORIS", "()"), ("NARRATEUR", "Fin")]
    df = spark.createDataFrame([(given,)], "p array<struct<speaker:string,text:string>>")
    got = pairs(at.post_process(df, "p", "o").collect()[0]["o"])
    assert got == [("ANNA", "Aux champs !"), ("NARRATEUR", "s'écria Boule."), ("ANNA", "il y va."),
                   ("NARRATEUR", "dit Paul."), ("ANNA", "Non"),
                   ("NARRATEUR", "un deux trois quatre cinq six sept Fin")]


def test_integrity(spark):
    df = spark.createDataFrame([("Un deux trois quatre cinq six sept huit", "un deux trois quatre cinq six huit"),
                                ("même texte", "même « texte »")], "a string, b string")
    got = [r["c"] for r in at.integrity(df, "a", "b", "c").collect()]
    assert [(x["passage"], x["context"]) for x in got[0]["lost"]] == [("sept", "un deux trois quatre cinq six")]
    assert round(got[0]["ratio"], 4) == round(14 / 15, 4) and got[1]["ratio"] == 1.0 and got[1]["lost"] == []


def test_fast_aside_search_finds_what_the_grammar_finds(one):
    import random

    from pyspark.sql import functions as F

    def plain(p):
        pieces = F.split(F.regexp_replace(p, f"({at.ASIDE})", "\x01$1\x01"), "\x01")
        return tx.squeeze(F.array_join(F.transform(pieces, lambda x, i: F.when(
            i % 2 == 1, F.concat(F.lit(" ("), tx.strip(x), F.lit(") "))).otherwise(x)), ""))

    rng = random.Random(5)
    words = [*at.SPEECH_VERBS, "Dit", "S'écria", "s’écriait", "lui", "celui", "maudit", "Anne", "-il", "le", "Vieux", ",", ".",
             "avec joie", "« oui »", " ", "  ", "n'", "vous", "\t"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += [f" {v} Anne d'un ton sec, puis." for v in at.SPEECH_VERBS]
    assert one(lambda c: tx.squeeze(at._in_brackets(c)), *texts) == one(plain, *texts)
    assert not at._ASIDE_CORE.startswith(r"(?U)\s*")
