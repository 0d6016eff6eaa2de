"""Boilerplate of a host so large that its lines stand in a small share of the documents."""

import pytest

pytest.importorskip("folio.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from folio.llm import quality  # noqa: E402


def test_hot_line_of_a_hot_host_is_boilerplate(spark):
    hot, own = " ".join(f"hot{c}" for c in "abcdefghijkl"), [F.concat(F.lit(c), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")) for c in "pqrstuvwxyzo"]
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") < 1200, hot + "\n").otherwise(""), F.concat_ws(" ", *own)).alias("text"), F.lit("h").alias("source"))
    got = quality.quality(docs).groupBy(F.col("n_boilerplate_words").alias("n")).agg(F.count("*").alias("c"), F.max("doc_id").alias("last")).collect()
    assert {r["n"]: (r["c"], r["last"]) for r in got} == {12: (1200, 1199), 0: (28_800, 29_999)}
