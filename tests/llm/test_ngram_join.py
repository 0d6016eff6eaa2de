import random

import pandas as pd
import pytest

pytest.importorskip("folio.llm.ngram_join")

from folio.llm.components import components  # noqa: E402
from folio.llm.ngram_join import jaccard_components, keep_first  # noqa: E402
from tests.llm import brute  # noqa: E402


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, **options).collect()}


def rows_with_copies():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(3)) for _ in range(150)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = text(40), []
    for _ in range(20):
        base = text(r.choice([1, 3, 4, 6, 12, 40, 120, 300]))
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(text(60) + passage + text(60))) for i in range(45)]
    near = text(100)
    for i in range(60):
        w = list(near)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(100)] = r.choice(vocabulary)
        rows.append((1000 + i, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, "A b"), (2003, "a  B\n"), (2004, "x " * 500), (2005, "x x x x x")]


def test_against_brute_force(spark):
    rows = rows_with_copies()
    want = brute.components(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, hot=3) == want


def test_smallest_table(spark):
    t = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(int(i), x) for i, x in zip(t.doc_id, t.text)]
    assert run(spark, rows) == brute.components(rows)


def test_awkward_tables(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (5, "A b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_components(df).collect()) == [(-1, -1), (-1, -1), (3, 3), (3, 3), (5, 3)]
    assert sorted(r["doc_id"] or -1 for r in keep_first(df).collect()) == [-1, -1, 3]


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
