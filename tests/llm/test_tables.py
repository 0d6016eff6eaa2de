"""Tables that are written on the way go when the steps that read them are over."""

import random
from pathlib import Path

import pytest

pytest.importorskip("folio.llm.ngram_join")

from pyspark.sql import functions as F  # noqa: E402

from folio.llm import ngram_join  # noqa: E402
from folio.llm.common import drop, shared_dir  # noqa: E402
from folio.llm.components import components  # noqa: E402
from tests.llm import brute  # noqa: E402
from tests.llm.test_ngram_join import rows_with_copies, run  # noqa: E402


def left(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("folio-*")}


def test_op1_leaves_what_its_result_reads(spark):
    before = left(spark)
    df = spark.createDataFrame(rows_with_copies(), "doc_id long, text string")
    out = ngram_join.jaccard_components(df)
    assert len(left(spark) - before) == 2
    n = out.count()
    drop(out)
    assert n == df.count() and left(spark) == before
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    components(links).collect()
    assert len(left(spark) - before) == 1


def test_shingles_that_are_hot_over_many_batches_only(spark, monkeypatch):
    """A shingle in few rows of every batch is counted by partial sums; the result is the same."""
    monkeypatch.setattr(ngram_join, "OFTEN", 3)
    monkeypatch.setattr(ngram_join, "DEALT", 8)
    r = random.Random(11)
    text = lambda n: [r.choice("abcdefgh") + r.choice("klmnop") + r.choice("qrstuv") for _ in range(n)]
    passage, rows = text(8), []
    for i in range(400):
        w = text(30)
        if i % 10 == 0:
            w[5:5] = passage
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[10 * i + 1][1] + " end") for i in range(20)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        data = df.select("doc_id", F.col("text").cast("binary").alias("data"))
        sets = ngram_join._sets(data, 4, 0.9, 8)
        assert sets.where(F.array_max("heavy_rows") > 8).count() == 0
        assert ngram_join._heavy(sets, 8).count() >= 3
        assert run(spark, rows, hot=8, sketch=0.9) == run(spark, rows) == brute.components(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
