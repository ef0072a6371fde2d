"""Secret scans, quality rules, pages and toxicity against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from lectern.llm import html_text, quality_rules, secrets, toxicity
from lectern.llm.common import table
from tests.llm.helpers import SMALL, awkward, awkward_rows, empty, rows_of, spark_words, with_clashes


# --- secrets -------------------------------------------------------------------------------------------------------

def plain_base(text):
    text = text or ""
    keys = "(?:%s)" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in
                               ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        keys + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    count = Counter(k for _, k, _ in found)
    return count[0], count[1], count[2], hashlib.sha256(told.encode()).hexdigest(), told


def test_base_spans_match_a_plain_scan(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    texts = [tuple(r) for r in docs.collect()]
    got = rows_of(secrets.find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"))
    assert got == sorted(((i, *plain_base(t)[:4]) for i, t in texts), key=repr)


def test_base_spans_stay_when_the_lexer_adds():
    r = random.Random(3)
    bits = ["password", "Token", "api_key", "db_pass", '"', "'", " ", "=", ":", "a9", "AKIA", "ABC1", "0123456789abcdef",
            "zK9x+/", "\n", "ſecret", "é"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        told = secrets.digest(secrets.scan(text))
        want = plain_base(text)
        assert told[:4] == want[:4]
        assert ",".join(s for s in told[4].split(",") if not s.startswith(("named", "flow"))) == want[4]


@pytest.mark.parametrize("text, found", [
    ('db_pwd = "xK9#mQ2$vL7!"', "named:10:22"),
    ('base = "q8Zr-41Lm+77Px"\nclient_secret = base + "tail"', "flow:8:22"),
    ('export PRIVATE_KEY=Zx81kLmQ92ssTT0', "named:19:34"),
    ('auth_url = "https://host.example/path1"', ""),
    ('password_hint = "Xy12$$kkPl9"', ""),
    ("the secret: nobody knows anything", ""),
    ("a = b\nb = a\nmy_credential = a", ""),
    ('token_limit: 4096', ""),
])
def test_lexer_follows_names_and_constants(text, found):
    assert secrets.digest(secrets.scan(text))[4] == found


@pytest.mark.parametrize("text, found", [
    ('private_key: str = "q7Zp-41Lm+77Px9"', "flow:20:35"),
    ('const dbPwd: string = "q7Zp-41Lm+77Px9";', "flow:23:38"),
    ('dbPwd: Optional[str] = "q7Zp-41Lm+77Px9"', "named:24:39"),
    ('val x: String = "q8Zr-41Lm+77Px"\nclientCredential = x', "flow:17:31"),
    ('title: str = "q8Zr-41Lm+77Px"\ndb_pwd: str = other', ""),
    ('pwd = backup = "xK9#mQ2$vL7!"', "flow:16:28"),
    ("INFO: db_pwd=Abc12345xyz", "named:13:24"),
    ("Cookie: auth=Abc12345xyzQ9", "named:13:26"),
    ("env: ACCESS_KEY=Zx81kLmQ92ssTT0", "named:16:31"),
    ("pwd: db_pwd=Abc12345xyz", "named:12:23"),
    ("see https://host/?page=2&db_pwd=Abc12345xyz", "named:32:43"),
    ("url: https://host/?page=2&db_pwd=Abc12345xyz", "named:33:44"),
    ("run --private-key=Zx81kLmQ92ssTT0", "named:18:33"),
    ("java -Dpwd=Zx81kLmQ92ssTT0 -jar x", "named:11:26"),
    ("cmd: -Dpwd=Zx81kLmQ92ssTT0", "named:11:26"),
    ("2nd-pwd=Zx81kLmQ92ssTT0", "named:8:23"),
    ("db_pwd: Abc:12345xyz", "named:8:20"),
    ("db_pwd: aGVsbG8xPass12= # padded", "named:8:23"),
    ('db_pwd = "x=1;y" + z=Abc12345xyz', "named:19:32"),
])
def test_statements_inside_values(text, found):
    assert secrets.digest(secrets.scan(text))[4] == found


@pytest.mark.parametrize("unit", ["a=", "pwd=", "pwd=a=", "a-", "a--", "1a-", "?x=1 + ", "a:b[", "--"])
def test_lexing_stays_linear(unit):
    began = time.process_time()
    secrets.scan(unit * 20_000 + "example")
    secrets.scan(unit * 20_000)
    assert time.process_time() - began < 5


def test_masking_keeps_everything_else(spark):
    text = 'x password="abcdefghijkl" y AKIA' + "B" * 16 + " z"
    assert secrets.redacted(text) == 'x password="[REDACTED]" y [REDACTED] z'
    docs = with_clashes(awkward(spark))
    out = secrets.without_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert secrets.without_secrets(empty(spark)).count() == 0


# --- quality rules -------------------------------------------------------------------------------------------------

def plain_counts(text):
    w = spark_words(text)
    lines = [x for x in (text or "").split("\n") if spark_words(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_counts_match_a_plain_version(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang").unionByName(
        awkward(spark).select("doc_id", "text", "lang"))
    got = rows_of(quality_rules.rule_report(docs, table(spark, SMALL, "labels")).drop("kept"))
    assert got == sorted(((i, *plain_counts(t)) for i, t, _ in docs.collect()), key=repr)


def test_repeats_by_sort_equal_repeats_by_hash(spark):
    from lectern.llm.common import words
    docs = table(spark, SMALL, "documents").withColumn("w", words(quality_rules.F.col("text")))
    both = docs.select(quality_rules._repeat_words(quality_rules.F.col("w")).alias("a"), quality_rules.F.when(
        quality_rules.F.size("w") > 3, quality_rules._repeat_words_by_sort(quality_rules.F.col("w"))).otherwise(0).alias("b"))
    assert both.where("a <> b").count() == 0


def test_cutoffs_equal_a_plain_fixed_sequence(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        bad = r.random() < 0.3
        level = r.randint(5, 19) if bad or r.random() < 0.004 else r.randint(0, 2)
        rows.append((i, "xy"[i % 2], [level, 0, 0, 0, 0]))
        labels.append((i, 0 if bad else 1))
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, levels array<int>").selectExpr(
        "doc_id", "named_struct('stratum', stratum, 'base_failed', false, 'levels', levels) AS q")
    got = {x["stratum"]: x["cutoffs"] for x in quality_rules.fit_cutoffs(
        measured, spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.1).collect()}
    good = dict(labels)
    for s in "xy":
        level = [lv[0] for i, t, lv in rows if t == s and good[i] == 1]
        n, p, cut = len(level), 0.1 / 5, None
        for c in range(19, 0, -1):
            k = sum(x >= c for x in level)
            tail = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            if tail > 0.05 / 10:
                break
            cut = c
        assert got[s][0] == cut and cut is not None and got[s][1] == 1


def test_quality_takes_awkward_rows(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int")
    docs = with_clashes(awkward(spark))
    out = quality_rules.kept_documents(docs, labels)
    assert out.columns == docs.columns
    assert quality_rules.kept_documents(empty(spark), labels).count() == 0
    assert {r["doc_id"] for r in out.collect()} == {
        i for i, t, *_ in awkward_rows() if not plain_counts(t)[5]}


# --- pages ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("<p>  </p>", ""),
    ("<title>t</title><nav><a href='/'>Home</a></nav><article><h1>Big &amp; old</h1><p>One<br>two\n three</p>"
     "<div class='ad'>buy</div><p>caf&eacute;&#33;</p></article><footer>&copy; me</footer>",
     "Big & old One two three café!"),
    ("<main><p>a<b>b</b>c</p><aside>no</aside><form>x</form><ul><li>item</li></ul></main>", "abc item"),
    ("<article><p>kept</p><script>var t='</p>';</script><section id='comments'><p>reader</p></section></article>", "kept"),
    ("<nav><ul><li>menu<article><p>Unclosed menu ends here</p></article>", "Unclosed menu ends here"),
    ("<div><a href='x'>link</a></div>" + "<p>" + "plain text without a named part " * 4 + "</p><div class='cookie-notice'>no</div>",
     ("plain text without a named part " * 4).strip()),
])
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<body><h1>Short news</h1><p>Nothing happened today.</p></body>", "Short news Nothing happened today."),
    ("<p class=ad>Buy now<p>" + "Real words here. " * 9, ("Real words here. " * 9).strip()),
    ("<p class=ad>Buy <img src=a> now<div>" + "Real words here. " * 9 + "</div>", ("Real words here. " * 9).strip()),
    ("<p class=ad><button>Buy</button> it now</p><p>" + "Real words here. " * 9, ("Real words here. " * 9).strip()),
    ("<ul><li class=menu>Home<ul><li>Deep</ul><li>" + "Real words here. " * 9 + "</ul>", ("Real words here. " * 9).strip()),
    ("<ul><li class=menu>Home</ul><div>" + "Real words here. " * 9 + "</div>", ("Real words here. " * 9).strip()),
    ("<ul><li class=menu><a href=x>Home</a></li></ul>", ""),
])
def test_short_pages_and_unclosed_parts(page, text):
    assert html_text.main_text(page) == text


BODY = "Plain words of the article stand here. " * 4


@pytest.mark.parametrize("page, text", [
    # a heading before short lines, and a short closing part behind adverts
    (f"<h1>Title</h1><p>By A</p><p>May 3</p><p>{BODY}</p>", f"Title By A May 3 {BODY.strip()}"),
    (f"<p>{BODY}</p>" + "<div class='ad'>buy</div>" * 3 + "<p>The end.</p>", f"{BODY.strip()} The end."),
    (f"<p>{BODY * 12}</p>" + "<p><a href=x>link</a></p>" * 3 + f"<p>{BODY}</p>", f"{(BODY * 12).strip()} {BODY.strip()}"),
    # names that tell of the layout or of the article's own parts
    (f"<div class='content with-sidebar'><p>{BODY}</p></div>", BODY.strip()),
    ("<article><div class='article-header'><h1>Big</h1></div><p>One</p></article>", "Big One"),
    ("<article><p>One</p><div class='search-results'><p>Found</p></div></article>", "One Found"),
    (f"<div class='layout-sidebar'><article><p>{BODY}</p></article></div>", BODY.strip()),
    # parts that go, whatever stands beside their sign
    (f"<div class='article-sidebar'>no</div><div id='readerComments'>no</div><p>{BODY}</p><p class='post_ad'>no</p>", BODY.strip()),
    ("<article><p>One</p></article><section class='comments'><article><p>reader</p></article></section>", "One"),
    ("<article><p>One</p></article><article><p>Two</p></article>", "One Two"),
])
def test_pages_lose_nothing_of_the_article(page, text):
    assert html_text.main_text(page) == text


def test_articles_are_found_without_their_tags(spark):
    for row in table(spark, SMALL, "pages").select("html").collect():
        bare = re.sub(r"<(/?)article>", r"<\1div>", row["html"])
        assert html_text.main_text(bare) == html_text.main_text(row["html"]) != ""


def test_pages_of_any_kind(spark):
    pages = table(spark, SMALL, "pages")
    assert html_text.extract(pages.limit(0)).collect() == []
    clash = pages.withColumns({"text": pages.url, "n_chars": pages.page_id, "inside": pages.html})
    assert rows_of(html_text.extract(clash)) == rows_of(html_text.extract(pages))
    assert html_text.extract(clash).columns == ["page_id", "url", "text", "n_chars"]
    long = f"<h1>Title</h1><p>{BODY}</p>" * 20_000
    assert html_text.main_text(long) == " ".join([f"Title {BODY.strip()}"] * 20_000)


def test_pages_whole_table(spark):
    got = html_text.extract(table(spark, SMALL, "pages"))
    for r, p in zip(got.orderBy("page_id").collect(), table(spark, SMALL, "pages").orderBy("page_id").collect()):
        inside = re.search(r"<article>(.*)</article>", p["html"], re.DOTALL)[1]
        import html as h
        want = " ".join(h.unescape(re.sub(r"<(?:br|p|/p|h1|/h1)>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want)
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 2


# --- toxicity ------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = toxicity.score_documents(docs, labels).cache()
    assert out.count() == docs.count()
    seen = out.join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").groupBy("toxic", "predicted").count()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in seen.collect()}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
    assert out.where("score < 0 OR score > 1 OR predicted <> IF(score >= 0.3, 1, 0)").count() == 0


def test_toxicity_ignores_held_out_labels_and_takes_awkward_rows(spark):
    labels = table(spark, SMALL, "labels")
    docs = with_clashes(awkward(spark)).unionByName(with_clashes(table(spark, SMALL, "documents")))
    a = rows_of(toxicity.score_documents(docs, labels))
    flipped = labels.withColumn("toxic", toxicity.F.when(
        toxicity.fold(toxicity.F.col("doc_id")) == 2, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert a == rows_of(toxicity.score_documents(docs, flipped))
    none = labels.limit(0)
    assert toxicity.score_documents(docs, none).count() == docs.count()
    assert toxicity.score_documents(empty(spark), labels).count() == 0


def test_patterns_reach_the_score(spark):
    docs, labels = table(spark, SMALL, "documents").select("doc_id", "text"), table(spark, SMALL, "labels")
    open_ids = [i for i in range(900_000, 900_100) if zlib.crc32(str(i).encode()) % 4 != 2][:8]
    held = next(i for i in range(900_000, 900_100) if zlib.crc32(str(i).encode()) % 4 == 2)
    said = ["kill yourself", "ta gueule", "halt die klappe"]
    rows = [(d, f"{w} {said[n % 3]} {w}") for n, (d, w) in enumerate(zip(
        [*open_ids[:7], held], "alpha beta gamma delta epsilon zeta eta theta".split()))] + [(open_ids[7], "theta so be it theta")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame([(d, 1) for d in open_ids[:6]], "doc_id long, toxic int")
    out = toxicity.score_documents(docs.unionByName(more), labels.select("doc_id", "toxic").unionByName(
        told.withColumn("toxic", toxicity.F.col("toxic").cast(labels.schema["toxic"].dataType))))
    score = {r["doc_id"]: r["score"] for r in out.where("doc_id >= 900000").collect()}
    clean = score[open_ids[7]]
    assert all(score[d] > 2 * clean for d in [*open_ids[:7], held]), score


@pytest.mark.parametrize("chain", ["\n".join(f"pwd_a{i} = pwd_a{i + 1}" for i in range(8000)) + '\npwd_a8000 = "q7Zp9xW2k4Lm8Tz"',
                                   " = ".join(f"pwd_a{i}" for i in range(8000)) + ' = "q7Zp9xW2k4Lm8Tz"'])
def test_chains_of_names_are_followed_once(chain):
    start = time.process_time()
    spans = secrets.scan(chain)
    assert time.process_time() - start < 5
    assert "q7Zp9xW2k4Lm8Tz" in {chain[s.start:s.end] for s in spans if s.kind > 2}


@pytest.mark.parametrize("page", ["<a " * 100_000, "<p class='" * 50_000, "<!" * 100_000, "<script " * 50_000, '<a ">' * 50_000])
def test_pages_of_open_tags_stay_linear(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 2


def test_a_closed_drawing_hides_nothing():
    words = "word " * 30
    assert html_text.main_text(f"<article><svg class='x'/><p>{words}</p></article>") == words.strip()


def test_extract_takes_an_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).count() == 0
    pages = spark.createDataFrame([(1, "u", "<article><p>" + "word " * 40 + "</p></article>"), (2, None, None), (1, "u", "")],
                                  "page_id long, url string, html string")
    assert rows_of(html_text.extract(with_clashes(pages))) == rows_of(html_text.extract(pages))


def test_find_secrets_takes_an_empty_table(spark):
    assert secrets.find_secrets(empty(spark)).count() == 0
