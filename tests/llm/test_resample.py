"""Importance resampling against a plain version, for features of one and more words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import resample  # noqa: E402

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def plain(rows, target, n=1, buckets=10_000, percent=10, min_words=20):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for x in texts for f in features(x, n)[0]) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in rows:
        found, words = features(text, n)
        weight = sum(gain(at(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((-r[3], r[0]) for r in out if r[4] >= min_words)
    ranks = {k: i + 1 for i, k in enumerate(able[: percent * len(able) // 100])}
    return sorted((*r[:4], ranks.get((-r[3], r[0])) if r[4] >= min_words else None) for r in out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, block long")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    text = lambda: " ".join(r.choice(["The", "the", "of", "é", "naïve", "x1", "你好", *"abcdefgh"]) + r.choice(["", ",", "-q", "\x7f"]) for _ in range(r.randint(0, 60)))
    return [(i, text()) for i in range(150)] + [(200, None), (201, ""), (202, " ,.\n"), (203, "la " * 40_000), (204, text()), (205, "q" * 100_000)]


@pytest.mark.parametrize("n, buckets, block", [(1, 10_000, 100_000), (1, 7, 500), (2, 1000, 3000), (3, 50, 900)])
def test_against_plain(spark, rows, n, buckets, block):
    target = ["the of é x1 a b", None, "", "The NAÏVE a a a b, q", "the of é x1 a b"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(frame(spark, rows).repartition(3), table, n=n, buckets=buckets, percent=30, block=block)
    assert sorted(map(tuple, got.collect())) == plain(rows, target, n, buckets, 30)


def test_repeated_rows_ties_and_empty_tables(spark):
    twice = [(i % 20, "a b c d " * 6 + "e" * (i % 20)) for i in range(40)]
    none = spark.createDataFrame([], "item_id long, text string")
    got = sorted(map(tuple, resample.resample(frame(spark, twice), none, percent=50).collect()))
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, 21)) and [r[:4] for r in got] == [r[:4] for r in plain(twice, [])]
    assert resample.resample(frame(spark, []), none).collect() == []
    assert len(resample.resample(frame(spark, [(None, None), (None, "a " * 30)]), none, percent=100).where("rank = 1").collect()) == 1


def test_drawn_keeps_rows_as_they_were(spark, rows):
    table = spark.createDataFrame([(0, "the of x1")], "item_id long, text string")
    got = {tuple(r) for r in resample.drawn(frame(spark, rows), table, percent=20).collect()}
    want = {r[0] for r in plain(rows, ["the of x1"], percent=20) if r[4]}
    assert got == {(i, t, "x", 1) for i, t in rows if i in want}


def test_numbers_of_sorted_rows(spark):
    from pyspark.sql import functions as F

    from folio.llm.common import numbered

    r = random.Random(2)
    values = [r.choice([1, 1, 1, 2, 5, 9]) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(5)
    got = sorted(map(tuple, numbered(df, F.col("v").asc(), F.col("i").asc(), running="v").select("place", "i", "v", "before").collect()))
    order = sorted(range(300), key=lambda i: (values[i], i))
    assert got == [(p, i, values[i], sum(values[j] for j in order[:p])) for p, i in enumerate(order)]
