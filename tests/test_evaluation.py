import random
import re
import time

from pyspark.sql import functions as F

from lectern.operators import evaluation as ev


def collapse(spark, *texts, min_run=6):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in ev.collapse_loops(df, "t", "o", min_run).orderBy("i").collect()]


def test_collapse_vectors(spark):
    got = collapse(
        spark, "Hello " + ("URL " * 8).strip() + " goodbye", "Hello URL, URL, URL, URL, URL, URL. goodbye",
        "hi Url URL url Url URL url bye", "no no no no no", "Okay so the meeting is at three. " + "thanks for watching " * 6,
        "會議在三點開始" + "謝謝觀看" * 7, "that's wooooooow amazing", "好好好好好", "", "loop-phrase " * 7)
    assert got[:4] == ["Hello goodbye", "Hello goodbye", "hi bye", "no no no no no"]
    assert "thanks" not in got[4] and got[4].startswith("Okay so the meeting is at three")
    assert got[5] == "會議在三點開始"
    assert got[6:9] == ["that's wooooooow amazing", "好好好好好", ""]
    assert got[9].strip() == ""
    short = collapse(spark, "ha ha ha ha context", min_run=3)[0]
    assert "ha ha" not in short and "context" in short


def test_loops_equal_the_pattern():
    """The linear search against the backtracking pattern that defines a loop."""
    rng = random.Random(3)
    units = ["ab", "abc", "aab", "thanks ", "x", "謝謝觀看", "a" * 7 + "b", "hello world, ", "\n-"]
    texts = [""]
    for _ in range(400):
        texts.append("".join(rng.choice(units) * rng.choice([1, 1, 2, 5, 6, 7, 13]) for _ in range(rng.randint(1, 6))))
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    for least in (3, 6):
        pattern = re.compile(r"(.{2,60}?)\1{%d,}" % (least - 1), re.S)
        assert ev._without_loops(texts, least) == [pattern.sub("", t) for t in texts]


def test_loop_search_is_linear():
    rng = random.Random(1)
    for text in ("ab" * 500_000, "".join(rng.choice("ab") for _ in range(1_000_000)), ("a" * 59 + "b") * 16_000):
        start = time.process_time()
        ev._without_loops([text], 6)
        assert time.process_time() - start < 3


def test_scorecard(spark):
    rows = [
        ("um so we like ship it um", "So we ship it.", ["ship"], False),
        ("is it on main?", "It is on.", ["main"], True),
        ("uh yes", "Here is the cleaned text: um yes " + "no " * 6, [], False),
        (" ".join(f"w{i}" for i in range(30)), "The answer is", [], False),
    ]
    df = spark.createDataFrame(rows, "raw string, refined string, must_contain array<string>, keep_question_mark boolean")
    got = [r["flags"] for r in ev.refinement_scores(df.withColumn("must_not_loop", F.lit(True))).collect()]
    assert got[0] == []
    assert got[1] == ["lost-terms=['main']", "question→statement"]
    assert got[2] == ["prompt-leak('Here is the cleaned')", "loop-echo", "fillers-not-removed(1→1)", "too-long(8.50)"]
    assert got[3] == ["answer-leak('The answer is')", "too-short(0.12)"]


def test_persona(spark):
    df = spark.createDataFrame([("*smiles* Hi (leans in)",), (" ",), ("As the character, I'm sorry, but no",)],
                               "refined string")
    got = [r["flags"] for r in ev.persona_scores(df).collect()]
    assert got[0] == ["stage-directions=['*smiles*', '(leans in)']"]
    assert got[1] == ["empty-output"]
    assert got[2] == ["prompt-leak('As the character')", "refusal('I'm sorry,')"]


def test_two_places_round_as_python_does(spark):
    values = [a / b for b in (1, 3, 7, 8, 40, 200, 1000) for a in range(0, 900, 7)] + [0.125, 2.025, 2.015, 0.375, 1e5 + 0.005]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", ev.two_places(F.col("x")).alias("t")).collect()
    assert [(r["x"], r["t"]) for r in got if r["t"] != f"{r['x']:.2f}"] == []
