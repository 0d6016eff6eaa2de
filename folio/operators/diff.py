"""Two copies of a set of texts: what is missing, extra or drifted, and how drifted ones differ line by line."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, state, left_sha, right_sha of the keys of both sides, each at most once a side.

    States: missing (left only), extra (right only), drifted and same. Only
    keys and digests are shuffled. A null text is like no other but null.
    """
    side = lambda df, s: df.select(F.col(key).alias(f"{s}_key"), F.sha2(F.col(text).cast("binary"), 256).alias(f"{s}_sha"), F.lit(True).alias(f"{s}_there"))
    both = side(left, "left").join(side(right, "right"), F.col("left_key") == F.col("right_key"), "full")
    state = F.when(F.col("right_there").isNull(), "missing").when(F.col("left_there").isNull(), "extra").when(F.col("left_sha").eqNullSafe(F.col("right_sha")), "same").otherwise("drifted")
    return both.select(F.coalesce("left_key", "right_key").alias(key), state.alias("state"), "left_sha", "right_sha")


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing series, by patience sorting: each value goes on the first pile whose top isn't smaller."""
    tops, ends, before = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1], ends[pile : pile + 1] = [v], [i]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _anchors(a: list[int], b: list[int], i: int, x: int, j: int, y: int) -> list[tuple[int, int]]:
    """Pairs of places of lines that are there once in a[i:x] and once in b[j:y]; if none is, the first of a line in both, the second of it, and so on."""
    in_a, in_b = Counter(a[i:x]), Counter(b[j:y])
    at = {b[k]: k for k in range(j, y) if in_b[b[k]] == 1}
    once = [(k, at[a[k]]) for k in range(i, x) if in_a[a[k]] == 1 and a[k] in at]
    if once:
        return once
    places = defaultdict(deque)
    for k in range(j, y):
        places[b[k]].append(k)
    return [(k, places[a[k]].popleft()) for k in range(i, x) if places.get(a[k])]


def common_lines(a: list[int], b: list[int], anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, ascending on both sides.

    Equal lines at both ends of a stretch are taken; a longest ascending series
    of its anchors parts the rest into stretches, in which lines that are
    unique there are the anchors; where none are, equal lines by their turn.
    """
    out, stack = [], [(0, len(a), 0, len(b), anchors)]
    while stack:
        i, x, j, y, known = stack.pop()
        while i < x and j < y and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < x and j < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            out.append((x, y))
        if i == x or j == y:
            continue
        known = _anchors(a, b, i, x, j, y) if known is None else [p for p in known if i <= p[0] < x and j <= p[1] < y]
        kept = [known[k] for k in increasing([q for _, q in known])]
        out += kept
        for (p, q), (r, t) in zip([(i - 1, j - 1), *kept], [*kept, (x, y)] if kept else []):
            stack.append((p + 1, r, q + 1, t, None))
    return sorted(out)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            a, b, anchors = (batch.column(c)[k].as_py() for c in (1, 2, 3))
            pairs = common_lines(a, b, sorted((x["a"], x["b"]) for x in anchors or []))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()], pa.string()), pa.array([[x for x, _ in pairs]], pa.list_(pa.int32())), pa.array([[y for _, y in pairs]], pa.list_(pa.int32()))], ["key", "in_left", "in_right"])


def line_edits(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, op (- or +), line (from 1, of the side it is on), content: what turns a left text into the right one.

    Lines that are unique on both sides are anchors, found by a join of line
    hashes; a longest series of anchors that ascends on both sides stays, grows
    over equal neighbours, and parts what is left, where the same is done
    again. All other lines of the left go, all others of
    the right come. Keys that are on one side only, or whose texts are equal,
    have no rows; a null text has no lines. Keys must be unique in each side.
    """
    lines = lambda df, s: df.select(F.col(key).cast("string").alias("key"), F.split(F.coalesce(text, F.lit("")), "\n").alias(f"{s}_lines"), F.col(text).isNull().alias(f"{s}_null"))
    both = lines(left, "left").join(lines(right, "right"), "key")
    both = both.select("key", *[F.when(F.col(f"{s}_null"), F.array().cast("array<string>")).otherwise(F.col(f"{s}_lines")).alias(s) for s in ("left", "right")]).where(F.col("left") != F.col("right"))
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    both = both.select("key", "left", "right", hashes("left").alias("a"), hashes("right").alias("b"))
    once = lambda c, n: both.select("key", F.posexplode(c).alias(n, "h")).groupBy("key", "h").agg(F.min(n).alias(n), F.count("*").alias("c")).where("c = 1").drop("c")
    anchors = once("a", "a").join(once("b", "b"), ["key", "h"]).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("anchors"))  # at most the lines of a text
    pairs = both.select("key", "a", "b").join(anchors, "key", "left").mapInArrow(_matched, "key string, in_left array<int>, in_right array<int>")
    found = both.select("key", "left", "right").join(pairs, "key")

    def rest(c: str, op: str) -> DataFrame:
        every = F.sequence(F.lit(0), F.size(c) - 1)
        gone = F.when(F.size(c) > 0, F.array_except(every, F.col(f"in_{c}"))).otherwise(F.array().cast("array<int>"))
        rows = F.transform(gone, lambda i: F.struct((i + 1).alias("line"), F.get(F.col(c), i).alias("content")))
        return found.select("key", F.lit(op).alias("op"), F.explode(rows).alias("x")).select("key", "op", "x.line", "x.content")

    return rest("left", "-").union(rest("right", "+"))
