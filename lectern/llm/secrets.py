"""Secret scans by assignment-aware lexing.

Source and configuration text is read as statements `name op value`.  A value is one or more terms joined by `+`: quoted
literals, bare literals or references to other names.  Literals are kept per name, so a constant that reaches a
sensitive name through other names is found where it was written.  A statement may begin inside the value of another
one (`name: type = value`, `a = b = value`, `word: name=value`); the outer name then refers to it.  A literal is reported when the sensitivity of the
name times the strength of the literal reaches `THRESHOLD`.

Kinds of spans, in this order: `assign`, `access` and `hex` are fixed patterns over the whole text, leftmost and without
overlap per kind; `named` is a literal written under a sensitive name, `flow` one that reaches such a name by reference.
Literals that a span of the first kinds holds already are not repeated.  Positions are code points, ends exclusive.

A null text counts as an empty one: no spans.  Repeated rows are scanned one by one, an empty table gives an empty
result, other columns take no part.  A text is held by one task as it is by its row; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructType

KINDS = ("assign", "access", "hex", "named", "flow")
MASK = "[REDACTED]"
THRESHOLD = 0.5

# The patterns of the first three kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

#: Sensitivity of a name by its parts; a pair counts when both parts occur.
SENSITIVE = {
    ("password",): 1.0, ("passwd",): 1.0, ("passphrase",): 1.0, ("pwd",): 0.9, ("pass",): 0.7, ("secret",): 1.0,
    ("token",): 0.9, ("apikey",): 1.0, ("credential",): 0.9, ("credentials",): 0.9, ("bearer",): 0.9, ("auth",): 0.7,
    ("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("signing", "key"): 1.0,
    ("encryption", "key"): 1.0, ("account", "key"): 0.9, ("connection", "string"): 0.8,
}
#: Parts that tell that a name is about a secret rather than the secret itself.
ABOUT = {"count", "length", "len", "limit", "max", "min", "hint", "policy", "url", "uri", "path", "file", "name", "id",
         "type", "field", "label", "expiry", "ttl", "version", "regex", "pattern", "prompt", "page", "reset"}
PLACEHOLDER = re.compile(
    r"(?i)change_?me|example|placeholder|your[_-]|x{4,}|\*{3,}|\.{3,}|^(none|null|true|false|todo|test)|^[<$%{]|[>}]$")

_DIGEST = StructType().add("n_assign", LongType()).add("n_access", LongType()).add("n_hex", LongType()).add(
    "base_sha256", StringType()).add("spans", StringType())
_TARGET = re.compile(
    r"""(?<![\w.$-])(?:(?:\d[\w.]*+)?-+)*+["'`]?([A-Za-z_][\w.-]*+)["'`]?[ \t]*(?::=|=>|[:=])(?![=/])[ \t]*""")
_TERM = re.compile(
    r'''"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|`(?P<b>[^`\n]*)`|\$\{?(?P<v>[A-Za-z_][\w.-]*)\}?|(?P<w>[^\s"'`,;(){}\[\]<>]+)''')
_JOIN = re.compile(r"[ \t]*\+[ \t]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_][\w.-]*\Z")
#: The rest of a bracketed type, as in `key: Optional[str] = "..."`.
_TYPE_ARGUMENTS = re.compile(r"""[\[<][^\n=:"'`]*[\]>][ \t]*=(?![=>])[ \t]*""")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    value: int  #: where the secret itself starts


def sensitivity(name: str) -> float:
    parts = {p.lower() for p in _PARTS.findall(name)}
    best = max((w for key, w in SENSITIVE.items() if parts.issuperset(key)), default=0.0)
    return best * 0.3 if parts & ABOUT else best


def strength(literal: str) -> float:
    """0 to 1: the information of the literal's own characters, less for prose and placeholders."""
    n = len(literal)
    if n < 8 or PLACEHOLDER.search(literal):
        return 0.0
    counts = Counter(literal)
    bits = sum(c * math.log2(n / c) for c in counts.values())
    kinds = sum((any(map(str.islower, counts)), any(map(str.isupper, counts)), any(map(str.isdigit, counts)),
                 any(not c.isalnum() and not c.isspace() for c in counts)))
    prose = 0.3 if any(map(str.isspace, counts)) or not any(map(str.isdigit, counts)) and kinds < 3 else 1.0
    return min(1.0, bits / 32) * prose


def _target_name(text: str, m: re.Match) -> str:
    """The name of a target; a Java option such as `-Dpwd=...` sets `pwd`."""
    at = m.start(1)
    option = text[max(0, at - 2):at].strip(" \t\n\"'`") == "-" and m[1][0] == "D"
    return m[1][1:] if option and len(m[1]) > 1 else m[1]


def statements(text: str) -> Iterator[tuple[str, int, list[tuple[int, int]], list[str | int]]]:
    """(name, its place, spans of its literals, what it refers to) of each statement in order.

    A reference is a name, or the place of the statement that begins in a bare term of the value, as in typed
    declarations, chained assignments and `word: name=value`.  That statement reads the rest of the value.
    """
    targets = list(_TARGET.finditer(text))
    quoted = bare = 0  # ends of the last quoted and the last bare term
    for i, m in enumerate(targets):
        if m.start() < quoted:
            continue
        literals, refs, at, later = [], [], m.end(), i + 1
        while True:
            if at < bare and text[at] != "$":
                kind, start, end = "w", at, bare
            elif t := _TERM.match(text, at):
                kind, (start, end) = t.lastgroup, t.span(t.lastgroup)
            else:
                break
            if kind == "w":
                bare = at = end
                while later < len(targets) and targets[later].start() < start:
                    later += 1
                inner = targets[later] if later < len(targets) and targets[later].start() < at else None
                while end > start and text[end - 1] in ".:!?":
                    end -= 1
                if inner:
                    refs.append(inner.start(1))
                    if end > start and not _only_inner(text, start, at, inner):
                        literals.append((start, end))
                    break
                if typed := _TYPE_ARGUMENTS.match(text, at):
                    at = typed.end()
                    continue
                if _NAME.match(text, start, end):
                    refs.append(text[start:end])
                if end > start:
                    literals.append((start, end))
            elif kind == "v":
                refs.append(t["v"])
                at = t.end()
            else:
                literals.append((start, end))
                quoted = at = t.end()
            if not (j := _JOIN.match(text, at)):
                break
            at = j.end()
        if literals or refs:
            yield _target_name(text, m), m.start(1), literals, refs


def _only_inner(text: str, start: int, end: int, inner: re.Match) -> bool:
    """Whether a bare term is the inner statement's name or text, and not a value that happens to hold an operator."""
    if inner.start() != start:
        return False
    if inner.end(1) == end:  # a type or a chained name, with the operator after a blank
        return text[inner.end():inner.end() + 1] in tuple("\"'`")
    return inner.end() < end and sensitivity(_target_name(text, inner)) >= THRESHOLD


def lexed(text: str) -> dict[tuple[int, int], int]:
    """Literals that belong to sensitive names: span -> kind.  A literal inside another one is not repeated."""
    own: dict[str | int, list[tuple[int, int]]] = {}
    uses: dict[str | int, list[str | int]] = {}
    names = {}
    for name, place, literals, refs in statements(text):
        names[name] = sensitivity(name) if name not in names else names[name]
        for key in (name, place):
            own.setdefault(key, []).extend(literals)
            uses.setdefault(key, []).extend(refs)
    reached: dict[tuple[int, int], dict[int, float]] = {}

    def tell(key: str | int, kind: int, weight: float) -> None:
        for span in own.get(key, ()):
            kinds = reached.setdefault(span, {})
            kinds[kind] = max(weight, kinds.get(kind, 0.0))

    # Names send their weight along references, the heaviest first.  What two names have reached is passed by: all behind
    # it has been reached by these two, at least one of them another name than itself.
    sources: dict[str | int, list[str]] = {}
    for name in sorted((n for n, weight in names.items() if weight >= THRESHOLD), key=lambda n: -names[n]):
        tell(name, 3, names[name])
        todo = [name]
        while todo:
            for key in uses.get(todo.pop(), ()):
                met = sources.setdefault(key, [])
                if key in own and key != name and len(met) < 2 and name not in met:
                    if not met:
                        tell(key, 4, names[name])
                    met.append(name)
                    todo.append(key)
    found: dict[tuple[int, int], int] = {}
    covered = 0
    # A literal inside another one is no stronger and, up to the place of a placeholder, one as well: none is read twice.
    most, upto, within = 1.0, 0, 0
    for start, end in sorted(reached, key=lambda s: (s[0], -s[1])):
        kinds = reached[start, end]
        if end <= covered or end <= within and start <= upto and most * max(kinds.values()) < THRESHOLD:
            continue
        literal = text[start:end]
        hit = PLACEHOLDER.search(literal)
        most, upto, within = (0.0, start + hit.start(), end) if hit else (strength(literal), end, end)
        if strong := [k for k, weight in kinds.items() if weight * most >= THRESHOLD]:
            found[start, end] = min(strong)
            covered = end
    return found


def scan(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    assigns = "=" in text or ":" in text
    spans = [Span(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    spans += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    if assigns:
        spans += [Span(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
        if more := lexed(text):
            inside = [False] * (len(text) + 1)
            for s in spans:
                inside[s.start:s.end] = [True] * (s.end - s.start)
            spans += [Span(a, k, b, a) for (a, b), k in more.items() if not all(inside[a:b])]
    return sorted(spans)


def digest(spans: list[Span]) -> tuple[int, int, int, str, str]:
    base = [s for s in spans if s.kind < 3]
    told = [",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in group) for group in (base, spans)]
    count = Counter(s.kind for s in base)
    return count[0], count[1], count[2], hashlib.sha256(told[0].encode()).hexdigest(), told[1]


def redacted(text: str | None) -> str | None:
    """The text with each secret replaced by `MASK`; overlapping secrets become one."""
    spans = sorted((s.value, s.end) for s in scan(text))
    if not spans:
        return text
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


@pandas_udf(_DIGEST)
def _digests(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([digest(scan(t)) for t in texts],
                        columns=_DIGEST.names, dtype=object)


@pandas_udf(StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return pd.Series([redacted(t) for t in texts], dtype=object)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, their digest and all spans of every document."""
    return docs.select("doc_id", _digests("text").alias("found")).select("doc_id", "found.*")


def without_secrets(docs: DataFrame) -> DataFrame:
    """All documents with their secrets masked; n_chars, where present, follows the text."""
    out = docs.withColumn("text", _redact("text"))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
