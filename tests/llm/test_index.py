"""A positional index that is kept: asked by several benchmarks, opened again by its path."""

import random
from pathlib import Path

import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import decontam  # noqa: E402
from folio.llm.common import shared_dir  # noqa: E402

COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def answer(df, columns=COLUMNS):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def batches(index):
    return {kind: len(list(Path(index.path, kind).glob("batch=*"))) for kind in ("counts", "terms", "postings")}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(f"i{k}", prose(n)) for k, n in enumerate((40, 25, 13, 8, 3, 30))]
    docs = [(k, prose(60)) for k in range(12)] + [(20 + k, f"{prose(15)} {t} {prose(15)}") for k, (_, t) in enumerate(items)] + [(40, None), (41, "")]
    make = lambda part: spark.createDataFrame(part, "item_id string, text string")
    return spark.createDataFrame(docs, "doc_id long, text string"), make(items[:3]), make(items[3:]), make(items)


def test_second_benchmark_and_reopening(spark, tables):
    docs, first, second, both = tables
    index = decontam.PositionalIndex(docs)
    assert answer(decontam.contamination(docs, first, index=index)) == answer(decontam.contamination(docs, first))
    held = batches(index)
    assert held == {"counts": 1, "terms": 1, "postings": 1}
    # The same benchmark again reads no document: nothing is added.
    assert answer(decontam.contamination(docs, first, index=index)) == answer(decontam.contamination(docs, first))
    assert batches(index) == held
    assert answer(decontam.contamination(docs, second, index=index)) == answer(decontam.contamination(docs, second))
    again = decontam.PositionalIndex(docs, path=index.path)
    held = batches(index)
    assert answer(decontam.contamination(docs, both, index=again)) == answer(decontam.contamination(docs, both))
    assert batches(again) == held
    near = ("n_near", "n_near_items", "near_items_sha256", "near_contaminated")
    assert answer(decontam.proximity(docs, both, index=again), near) == answer(decontam.proximity(docs, both), near)
    index.drop()
    assert not Path(index.path).exists()


def test_empty_benchmark_then_items(spark, tables):
    docs, first, _, _ = tables
    index = decontam.PositionalIndex(docs)
    assert all(a[1:4] == (0, 0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855") for a in answer(decontam.contamination(docs, first.where("false"), index=index)).values())
    assert answer(decontam.contamination(docs, first, index=index)) == answer(decontam.contamination(docs, first))
    index.drop()


def test_tables_go(spark, tables):
    docs, first, _, _ = tables
    before = {p.name for p in Path(shared_dir(spark)).glob("folio-*")}
    decontam.contamination(docs, first)
    # The answer's own table is left.
    assert len({p.name for p in Path(shared_dir(spark)).glob("folio-*")} - before) == 1


def test_reach_is_checked(spark, tables):
    docs, first, _, _ = tables
    with pytest.raises(ValueError):
        decontam.PositionalIndex(docs, side=5).phrases(first)
