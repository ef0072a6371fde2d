"""Settings per project give what the same settings as arguments give."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import play, settings

TEXT = "Anna (bas) — foo bar\nsuite\n\nclara – 12\n12\n12. fin\nBORIS. hop\nEVA\nfoo\nPage 3\n\n\n%%%\nfin"
RULES = {
    "a": [tx.Rule("foo", "bar"), tx.Rule("/BAR/i", "$1|\\n"), tx.Rule("(", "["), tx.Rule("x", "y", active=False)],
    "b": [tx.Rule("%%%", ""), tx.Rule("/(a)?(?(1)b|c)/", "never"), tx.Rule("/(s)(u)/", "$2$1")],
    "c": [],
}
STYLES = {
    "a": ("modern", ["anna", "CLARA "], True), "b": ("none", [], True), "c": ("classic", ["boris"], False),
    "d": ("moliere", [], True), "e": ("^__ACTORS__ (", ["ANNA"], True), "f": (None, None, None),
    # Python's answer to this style is a pattern, Java's is not
    "g": ("^__ACTORS__(?(1)x|y)", ["ANNA"], True),
}


@pytest.fixture(scope="module")
def tables(spark):
    rules = [(p, n, r.search, r.replace, r.active) for p, rs in RULES.items() for n, r in enumerate(rs)]
    rules += [(None, 0, "f", "never", True), ("a", 9, "", "never", True)]
    return (spark.createDataFrame(rules, "project string, position int, search string, replace string, active boolean"),
            spark.createDataFrame([(p, *s) for p, s in STYLES.items()] + [(None, "none", [], True)],
                                  "project string, style string, actors array<string>, remove_page_numbers boolean"))


def docs(spark, projects):
    rows = [(n, p, t) for n, (p, t) in enumerate((p, t) for p in projects for t in (TEXT, "", "\n\n", None))]
    return spark.createDataFrame(rows, "doc_id int, project string, text string")


def test_normalising_by_project(spark, tables):
    projects = [*STYLES, None, "unknown"]
    got = settings.normalise_projects(docs(spark, projects), *tables, "text", "out")
    assert got.columns == ["doc_id", "project", "text", "out"]
    for p in projects:
        style, actors, pages = STYLES.get(p, (None, None, None))
        style = "modern" if style is None or p == "g" else style
        want = play.normalise_text(docs(spark, [p]), "text", "out", style, actors or [], RULES.get(p, []), pages is not False)
        mine = got.filter(F.col("project").eqNullSafe(p)).orderBy("doc_id").collect()
        assert [r["out"] for r in mine] == [r["out"] for r in want.orderBy("doc_id").collect()], p


def test_parsing_by_project(spark, tables):
    text = "ACTE I\n\nAnna\n\nbonjour (il rit (fort)) oui\n\nClara, sort\n\nboris (bas) non\n\nfin\n\nEVA\n\nici"
    rows = spark.createDataFrame([(n, p, text) for n, p in enumerate("abcd")] + [(9, None, text)],
                                 "doc_id int, project string, text string")
    got = {r["project"]: r["p"] for r in settings.parse_projects(rows, tables[1], "text", "p").collect()}
    for p in [*"abcd", None]:
        names = [a.strip().upper() for a in (STYLES[p][1] if p else [])] or list(play.DEFAULT_ACTORS)
        want = play.parse_play(rows.filter(F.col("project").eqNullSafe(p)), "text", "p", names).first()["p"]
        assert got[p] == want, p
    assert got["a"] != got["b"]


def test_settings_listed_twice_and_empty_tables(spark, tables):
    rules, styles = tables
    one = docs(spark, ["a", None])
    want = sorted(settings.normalise_projects(one, rules, styles, "text", "out").collect(), key=repr)
    twice = styles.unionByName(styles.withColumn("style", F.lit("zzz")))
    assert sorted(settings.normalise_projects(one, rules, twice, "text", "out").collect(), key=repr) == want
    bare = settings.normalise_projects(one, rules.limit(0), styles.limit(0), "text", "out")
    assert bare.count() == 8 and settings.normalise_projects(one.limit(0), rules, styles, "text", "out").count() == 0
