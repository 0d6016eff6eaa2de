"""What a Python worker keeps for one step doesn't stay for the others."""

import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import bpe, ngram_join, quality
from folio.llm.queries import tokenizer


def _held(spark):
    """Encoders that the workers of four tasks hold."""

    def run(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([bpe.load.cache_info().currsize + bpe.chunk_codec.cache_info().currsize], pa.int64())], ["id"])

    return spark.range(8, numPartitions=4).mapInArrow(run, "id long").agg(F.max("id")).first()[0]


def test_steps_let_the_encoders_tables_go(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of a text number ', id) AS text", "'h' AS source").repartition(4)
    for step in (lambda: ngram_join._sets(ngram_join.documents(docs).select("doc_id", F.col("text").cast("binary").alias("data")), 5, 0.25, 32), lambda: quality.base_rules(docs)):
        bpe.encode_documents(docs, tokenizer()).collect()
        assert _held(spark) > 0
        for _ in range(3):  # so that every worker has had a task
            step().collect()
        assert _held(spark) == 0
