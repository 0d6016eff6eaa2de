"""Places of regular expression matches, in code points, with built-in functions only.

Spark gives the matches of a pattern and, by splitting, the text between
them; the running sum of both lengths is where each match begins. Running
sums and maxima are taken in blocks of blocks, so that no array grows element
by element beyond a block: work is linear in the matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:long,end:long>>"
_FOUND = "array<struct<m:string,start:int,end:int>>"
_BLOCK = 64
_PIECE = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, op: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each int value, op over all values before it, from 0."""

    def folded(x: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, zero, lambda s, v: F.struct(op(s["at"], v).cast("int").alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def of(x: Column, levels: int) -> Column:
        zero = F.lit(0)
        if levels == 1:
            return folded(x, zero)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda i: F.slice(x, i * _BLOCK + 1, F.lit(_BLOCK)))
        total = lambda b: F.aggregate(b, zero, lambda a, v: op(a, v).cast("int"))
        long = lambda b: F.flatten(F.zip_with(b, let(F.transform(b, total), lambda t: of(t, levels - 1)), folded))
        return F.when(F.size(x) <= _BLOCK, folded(x, zero)).otherwise(let(blocks, long))

    return let(values, lambda x: of(x, levels))


def plus(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, start, end>> of the leftmost non-overlapping matches; the pattern must not match the empty string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("m")), lambda x: x["m"].isNotNull())

    def placed(pairs: Column) -> Column:
        before = scan(F.transform(pairs, lambda x: F.length(x["p"]) + F.length(x["m"])), plus)
        start = lambda x, at: at + F.length(x["p"])
        return F.zip_with(pairs, before, lambda x, at: F.struct(x["m"].alias("m"), start(x, at).alias("start"), (start(x, at) + F.length(x["m"])).alias("end")))

    return let(pairs, placed)


def none() -> Column:
    return F.array().cast(_FOUND)


def found_if(test: Column, text: Column, pattern: str) -> Column:
    """matches(), worked out only where a cheap test says that there may be some."""
    return F.when(test, matches(text, pattern)).otherwise(none())


def kinds(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))


def in_order(spans: Column, order: list[str]) -> Column:
    """Spans by start, then kind as listed, then end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in order]), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def free_of(spans: Column, others: Column, name: str = "kind") -> Column:
    """array<struct<name, start, end>> of the spans that overlap none of the others, by end.

    Of spans by their ends and others by their starts, the furthest end of the
    others so far tells whether a span is free.
    """
    event = lambda s, at, own: F.struct(at.cast("int").alias("at"), F.lit(own).alias("own"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), (s[name] if own else F.lit(None)).cast("string").alias("name"))
    events = F.array_sort(F.concat(F.transform(others, lambda s: event(s, s["start"], 0)), F.transform(spans, lambda s: event(s, s["end"] - 1, 1))))

    def kept(events: Column) -> Column:
        reach = scan(F.transform(events, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(0)), F.greatest)
        free = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), lambda x: (x["e"]["own"] == 1) & (x["r"] <= x["e"]["start"]))
        return F.transform(free, lambda x: F.struct(x["e"]["name"].alias(name), x["e"]["start"].cast("long").alias("start"), x["e"]["end"].cast("long").alias("end")))

    return let(events, kept)


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with spans (by start) replaced by the label of their kind; of spans that overlap, by the first one's."""

    def joined(x: Column) -> Column:
        reach = scan(F.transform(x["s"], lambda s: s["end"].cast("int")), F.greatest)
        fresh = F.filter(F.zip_with(x["s"], reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), lambda y: y["s"]["start"] >= y["r"])
        block = lambda a: F.floor(a / _PIECE).cast("int")
        part = lambda a, b: F.substring(F.array_join(F.slice(x["c"], block(a) + 1, block(b) - block(a) + 1), ""), (a % _PIECE + 1).cast("int"), (b - a).cast("int"))
        done = F.transform(fresh, lambda y: F.concat(part(y["r"], y["s"]["start"]), label(y["s"]["kind"])))
        return F.concat(F.array_join(done, ""), part(F.array_max(F.transform(x["s"], lambda s: s["end"])), x["n"]))

    # A long text is taken in pieces: to find a place costs the piece, not the text before it.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.struct(spans.alias("s"), pieces.alias("c"), F.length(text).alias("n")), joined)).otherwise(text)
