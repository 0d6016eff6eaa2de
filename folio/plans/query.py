"""Search strings to Column predicates and scores.

Terms may have a field prefix (ti au abs cat co jr all), which holds for the
next word, quoted phrase or group. ANDNOT and AND bind closest, then OR; terms
side by side are joined by AND. Matching is by whole words without case;
categories match as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text of each field, and its weight in scores.
FIELDS: dict[str, tuple[Column | Callable[[], Column], int]] = {
    "ti": (lambda: F.col("title"), 3),
    "au": (lambda: F.array_join("authors", " "), 1),
    "abs": (lambda: F.col("abstract"), 1),
    "co": (lambda: F.col("comment"), 1),
    "jr": (lambda: F.col("journal_ref"), 1),
}
_TOKEN = re.compile(r'\s*(?:(ti|au|abs|cat|co|jr|all):(?=\S)|(\()|(\))|"([^"]*)"|([^\s()"]+))', re.I)


@dataclass(frozen=True)
class Term:
    field: str
    text: str


def parse(query: str):
    """A tree of Term and (operator, left, right)."""
    tokens = [m for m in _TOKEN.finditer(query)]
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def word() -> str | None:
        t = peek()
        return t.group(5) if t else None

    def atom(field: str):
        nonlocal at
        t = peek()
        if t is None or t.group(3):
            raise ValueError("a term is missing")
        at += 1
        if t.group(1):
            return atom(t.group(1).lower())
        if t.group(2):
            inner = side_by_side(field)
            if peek() is None or not peek().group(3):
                raise ValueError("a closing parenthesis is missing")
            at += 1
            return inner
        return Term(field, t.group(4) if t.group(4) is not None else t.group(5))

    def chain(operators: tuple[str, ...], below, field: str):
        nonlocal at
        left = below(field)
        while word() in operators:
            operator = word()
            at += 1
            left = (operator, left, below(field))
        return left

    def conjunction(field: str):
        return chain(("AND", "ANDNOT"), atom, field)

    def disjunction(field: str):
        return chain(("OR",), conjunction, field)

    def side_by_side(field: str):
        left = disjunction(field)
        while peek() is not None and not peek().group(3):
            left = ("AND", left, disjunction(field))
        return left

    if not tokens:
        raise ValueError("the query is empty")
    tree = side_by_side("all")
    if peek() is not None:
        raise ValueError("a parenthesis is closed that wasn't opened")
    return tree


def _normal(x: Column) -> Column:
    """Lower-case words between single spaces, one at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _needle(text: str) -> str:
    return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "


def _lowered(field: str) -> Column:
    return F.lower(F.coalesce(FIELDS[field][0](), F.lit("")))


def _pattern(text: str) -> str:
    """Matches the words of text in a lower-case text, with anything but letters and digits between them; '' if there are none.

    The first word stands in front of the test of what is before it, so that a scan of a text stops at its first letter only.
    """
    words = _needle(text).split()
    edge, rest = r"[\p{L}\p{N}]", "".join(rf"[^\p{{L}}\p{{N}}]+{w}" for w in words[1:])
    return rf"{words[0]}(?<!{edge}{words[0]}){rest}(?!{edge})" if words else ""


def predicate(tree) -> Column:
    if isinstance(tree, tuple):
        operator, left, right = tree
        a, b = predicate(left), predicate(right)
        return a | b if operator == "OR" else a & ~b if operator == "ANDNOT" else a & b
    in_category = F.exists("categories", lambda c: F.lower(c) == tree.text.lower())
    pattern = _pattern(tree.text)
    if tree.field == "cat":
        return in_category
    if not pattern:
        return F.lit(False)
    hit = lambda f: _lowered(f).rlike(pattern)
    return reduce(lambda a, b: a | b, map(hit, FIELDS)) | in_category if tree.field == "all" else hit(tree.field)


def _positive(tree) -> list[Term]:
    if isinstance(tree, Term):
        return [tree]
    operator, left, right = tree
    return _positive(left) + ([] if operator == "ANDNOT" else _positive(right))


def score(tree) -> Column:
    """Weighted occurrences of the positive terms in the fields they ask for."""
    total = F.lit(0).cast("bigint")
    for term in _positive(tree):
        pattern = _pattern(term.text)
        for f in FIELDS if term.field == "all" else [term.field] if term.field in FIELDS else []:
            if pattern:
                total = total + F.regexp_count(_lowered(f), F.lit(pattern)).cast("bigint") * FIELDS[f][1]
    return total
