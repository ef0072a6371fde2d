"""Main text of web pages by their line-block distribution.

Markup is stripped into lines, one per block of the page.  Lines in menus, headers, footers, sidebars, notices,
adverts, forms and comments are taken out first, so that an advert between two paragraphs parts nothing; where a page
names its main part (`article`, `main`), so are lines outside it.  A line's weight is the length of its text without
links; each line in a named main part weighs at least `SURGE`.  Weights are summed over sliding windows of `WINDOW`
lines.  Text surges where the sum rises to `SURGE` or more (on a page without such a sum, to its highest sum) and dives
where a whole window has none.  A surge reaches back to the nearest line without weight, so that a heading before short
lines (a byline, a date) stays with its article.  The lines between such points are kept, however short the stretch.

A class, id or role tells a part from the article by its whole names: `sidebar`, `cookie-notice` and `reader-comments`
do, `with-sidebar` does not; names such as `article-header` or `search-results` say that the part belongs to the
article.  No named part hides the first `article` or `main` of the page in it; later ones in comments are comments.

A null page counts as an empty one and gives an empty text.  Unclosed elements end with the page, or where its main part
begins; a paragraph or list item ends where HTML closes it unasked.  Repeated pages are read one by one; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WINDOW = 3
SURGE = 80

_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(?:svg|math)\b[^>]*(?<=/)>"
    r"|<(script|style|noscript|template|svg|math|iframe|textarea|select|title)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)",
    re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"""<(/?)([a-zA-Z][\w:-]*)((?>"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>""")
_MARKS = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_APART = frozenset("nav footer aside form menu dialog button fieldset".split())
_MAIN = frozenset(("article", "main"))
_LISTS = frozenset(("ul", "ol", "menu"))
#: Tags that can't stand in a paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section table td th tr ul".split())
#: Words in a class, id or role that tell a part of the page from its article.
_SIGNS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe signup login sidebar side aside menu nav navbar navigation "
    "breadcrumb breadcrumbs toolbar pagination pager header masthead footer bottom contentinfo complementary search "
    "form comment comments respond reply replies disqus related recommended share sharing social widget tags "
    "copyright".split())
#: Signs that say little beside a word for the article itself, and such words.
_FAINT = frozenset("header masthead search notice alert bottom side".split())
_OWN = frozenset("article post entry story content text title headline result results chapter".split())
#: Names that start so tell how the page is laid out, not what the part is.
_LAYOUT = frozenset("with has no without hide show is not".split())
_SPLIT = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _names_apart(value: str) -> bool:
    for name in _HUMP.sub("-", value).lower().split():
        words = [w for w in _SPLIT.split(name) if w]
        if words and words[0] not in _LAYOUT:
            signs = _SIGNS.intersection(words)
            if signs and not (signs <= _FAINT and not _OWN.isdisjoint(words)):
                return True
    return False


def _apart(name: str, attributes: str, in_main: bool) -> bool:
    if name in _APART or name == "header" and not in_main:
        return True
    if "=" not in attributes or name in ("html", "body") or name in _MAIN:
        return False
    return any(_names_apart(m[1] or m[2] or m[3] or "") for m in _MARKS.finditer(attributes))


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, length of its links, inside the named main part, inside a part that isn't article) of each block."""
    page = _HIDDEN.sub(" ", page)
    out: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    links = main = in_link = 0
    skip, depth, at, lists, seen = "", 0, 0, 0, False

    def close():
        nonlocal links
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((line, links, main > 0, bool(skip)))
            text.clear()
        links = 0

    # behind the last `>` no tag ends, and looking for its end from each `<` would take the square of the length
    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):
        if m.start() > at:
            piece = page[at:m.start()]
            text.append(piece)
            if in_link:
                links += len(piece)
        at = m.end()
        ends, name, attributes = m[1] or m[4], (m[2] or m[5]).lower(), m[3] or m[6] or ""
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            in_link = 0 if ends else 1
        empty = name in _VOID or attributes.endswith("/")
        if skip == "li" and name in _LISTS:
            lists += -1 if ends else 1
        if skip == "p" and name in _ENDS_P or skip == "li" and (
                lists < 0 or name == "li" and not lists):
            close()
            skip = ""
        apart = not ends and not empty and not skip and _apart(name, attributes, main > 0)
        if name not in _INLINE or apart or name == skip:
            close()
        if skip:
            if name == skip and not empty:
                depth += -1 if ends else 1
                if not depth:
                    skip = ""
            elif name in _MAIN and not ends and not main and not seen:
                skip = ""
        elif apart:
            skip, depth, lists = name, 1, 0
        if name in _MAIN and not skip:
            main = max(0, main - 1) if ends else main + 1
            seen = True
    text.append(page[at:])
    close()
    return out


def main_text(page: str | None) -> str:
    """The article of one page; empty if there is none."""
    if not page:
        return ""
    found = lines(page)
    named = any(inside and not apart for _, _, inside, apart in found)
    kept = [(line, links) for line, links, inside, apart in found if not apart and (inside or not named)]
    weight = [max(SURGE, len(line)) if named else max(0, len(line) - links) for line, links in kept]
    sums = [sum(weight[i:i + WINDOW]) for i in range(len(weight))]
    surge = min(SURGE, max(sums, default=0))
    out: list[str] = []
    begin, done = None, 0
    for i, total in enumerate([*sums, 0]):
        if begin is None and i < len(weight) and total >= surge and weight[i]:
            begin = i
            while begin > done and weight[begin - 1]:
                begin -= 1
        elif begin is not None and not total:
            out.extend(line for line, _ in kept[begin:i])
            begin, done = None, i
    return " ".join(out)


@pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return pages.select("page_id", "url", _main_text("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
