import re

from pyspark.sql import functions as F

from lectern.functions import text as tx


def test_lines_follow_splitlines(one):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc d", " x \n\n y"]
    assert one(tx.lines, *texts) == [t.splitlines() for t in texts]


def test_a_text_is_split_once(spark):
    df = spark.createDataFrame([("a\nb",)], "t string")
    plan = lambda c: df.select(c.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tx.lines(F.col("t"))).count("split(") == 1
    # Once for the text, once for the lines into which a rule has put a break.
    assert plan(tx.apply_rules_to_lines(tx.lines(F.col("t")), [tx.Rule("a", "b")])).count("split(") == 2


def test_blank_follows_strip(one):
    texts = ["", " ", "\xa0\t", " a", "a ", "\u3000\u2028\n", "\u200b"]
    assert one(tx.is_blank, *texts) == [not t.strip() for t in texts]


def test_rules_that_end_a_line_or_break_it_with_other_signs(one):
    rules = [tx.Rule("-", "\\n"), tx.Rule("x", "\x0b"), tx.Rule("z", "\r\n")]
    got = one(lambda c: tx.apply_rules_to_lines(tx.lines(c), rules), "a-\nbxc\ndz\n\ne-", None)
    assert got == [["a", "b", "c", "d", "", "e"], None]


def test_strip_and_words_follow_python(one):
    texts = ["  a b ", "\xa0x ", "\t\n", "", "l m  n"]
    assert one(tx.strip, *texts) == [t.strip() for t in texts]
    assert one(tx.words, *texts) == [t.split() for t in texts]


def test_terminal_punctuation(one):
    got = one(tx.closed_for_speech, "Il dit :", "« Oui »", "…", "»", "Fini.", "Bon, ")
    assert got == ["Il dit.", "« Oui.", "…", "»", "Fini.", "Bon."]


def test_rule_dialect(one):
    def apply(*rules):
        return lambda c: tx.apply_rules(c, list(rules))

    assert one(apply(tx.Rule("/(a)(b)?/i", "<$1|$2>")), "Ac ab") == ["<A|>c <a|b>"]
    assert one(apply(tx.Rule("(x)", r"\1\1$9")), "x") == ["xx$9"]
    assert one(apply(tx.Rule("(x)", "$12")), "x") == ["$12"]
    assert one(apply(tx.Rule("b", "1\\n2")), "abc") == ["a1\n2c"]
    assert one(apply(tx.Rule("[oops", "ok")), "a[oops]") == ["aok]"]
    assert one(apply(tx.Rule("/[oops/", "ok")), "a[oops]") == ["a[oops]"]
    assert one(apply(tx.Rule("a", "\\P$")), "a") == ["\\P$"]
    assert one(apply(tx.Rule("a", "z", active=False), tx.Rule("", "q")), "a") == ["a"]
    assert one(apply(tx.Rule(r"\bé\w", "X")), "été") == ["Xé"]


def test_rules_drop_only_lines_that_lose_their_text(one):
    rules = [tx.Rule("x", ""), tx.Rule("-", "\\n")]
    got = one(lambda c: tx.apply_rules_to_lines(tx.lines(c), rules), "x\n\na-b\n x \ny-")
    assert got == [["", "a", "b", "y"]]


def test_page_numbers(one):
    prose = one(lambda c: tx.drop_page_numbers(tx.lines(c), tx.PAGE_NUMBER_PROSE),
                "12\n - 3 -\nPage 4\np. 5\n1. un\npage x\n– 7")
    assert prose == [["1. un", "page x"]]
    play = one(lambda c: tx.drop_page_numbers(tx.lines(c), tx.PAGE_NUMBER_PLAY), "12\n - 3 -\n1. un\n2.deux")
    assert play == [[" - 3 -", "2.deux"]]


def test_blank_line_runs(one):
    assert one(lambda c: tx.collapse_blank_lines(tx.lines(c)), "\n\na\n\n\n \n\nb") == [["", "a", "", " ", "", "b"]]
    assert one(lambda c: tx.collapse_blank_lines_loose(tx.lines(c)), "\n\na\n\n \nb\n") == [["a", "", "b"]]


def test_paragraphs_and_hyphens(one):
    text = "exem-\nple un\n  suite  de\t\tmots\n \nautre"
    assert one(lambda c: tx.paragraphs(tx.join_hyphens(c)), text) == [["exemple un suite de mots", "autre"]]


def test_file_size_and_labels(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1048576, 5 * 1024**3, 1234567]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s bigint")
    got = [r["v"] for r in df.select("i", tx.file_size(F.col("s")).alias("v")).orderBy("i").collect()]
    assert got == ["0 Bytes", "1 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1 MB", "5 GB", "1.18 MB"]


def test_timestamp_without_zone_is_utc(one):
    got = one(lambda c: F.unix_seconds(tx.utc_instant(c)), "2024-01-01T00:00:10", "2024-01-01T00:00:10Z",
              "2024-01-01T01:00:10+01:00", "nonsense")
    assert got[0] == got[1] == got[2] and got[3] is None


def test_comparison_forms(one):
    assert one(tx.comparison_form, "« Oui » — dit-IL  ‘a’") == ["oui dit-il a"]
    assert one(tx.comparison_words, "« Oui, l'ami… » (non)") == [["oui", "l", "ami", "non"]]
    assert one(tx.clean_segment, " — {Bon} «jour»  \"là\"") == ["Bon jour là"]


def test_upper_test(one):
    texts = ["ABC", "AbC", "1 2", "É À", "STRAßE", ""]
    assert one(tx.is_upper, *texts) == [t.isupper() for t in texts]
    assert not re.search("[a-z]", "ABC")


def test_squeeze_takes_all_white_space(one):
    from lectern.functions import text as tx

    blanks = [chr(c) for c in range(0x3001) if not chr(c).strip() and chr(c) not in "\x00"]
    texts = [f"a{b}b" for b in blanks] + [f"a {b}b" for b in blanks] + [f"{b} a{b}{b}b " for b in blanks]
    assert one(tx.squeeze, *texts) == ["a b"] * len(texts)
    assert one(tx.squeeze, "a​b", "a b c", "  ") == ["a​b", "a b c", ""]
