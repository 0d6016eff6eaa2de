"""Suggestions from a large vocabulary, through an index of words with letters taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters at the beginning of a word of which some are taken out.
PREFIX = 10


def _without_one(words: Column) -> Column:
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))))


def keys(word: Column, distance: int = 2, prefix: int = PREFIX) -> Column:
    """The first letters of a word with up to ``distance`` of them taken out, each once.

    Two words within that many edits share a key: what an edit touches, or
    moves out of one of the prefixes, is at most one letter of either prefix.
    """
    level = F.array(F.substring(word, 1, prefix))
    out = level
    for _ in range(distance):
        level = F.array_distinct(_without_one(level))
        out = F.array_union(out, level)
    return out


def index(vocabulary: DataFrame, distance: int = 2) -> DataFrame:
    """key, known, weight of a vocabulary (word, weight)."""
    return vocabulary.select(F.col("word").alias("known"), "weight", F.explode(keys(F.col("word"), distance)).alias("key"))


def nearest(words: DataFrame, vocabulary: DataFrame, distance: int = 2, limit: int = 3) -> DataFrame:
    """word, known, distance, rank (from 0): the known words within ``distance`` edits; nearest first, then by weight, then by letters.

    Both sides meet by equal keys, each pair is verified once, and pairs whose
    lengths differ too much never are. A word is at most once in words and in
    vocabulary; null words have no neighbours; the empty word has short ones.
    """
    sought = words.where("word is not null").select("word", F.explode(keys(F.col("word"), distance)).alias("key"))
    # A word has dozens of keys, which Spark doesn't foresee: what it takes for a small table may be too large to be sent whole.
    met = sought.hint("merge").join(index(vocabulary, distance), "key").where(F.abs(F.length("word") - F.length("known")) <= distance)
    pairs = met.select("word", "known", "weight").distinct().withColumn("distance", F.levenshtein("word", "known")).where(F.col("distance") <= distance)
    # Spark cuts each word's neighbours to the best few in tasks, before they are shuffled.
    order = Window.partitionBy("word").orderBy(F.col("distance").asc(), F.col("weight").desc(), F.col("known").asc())
    best = pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    return best.select("word", "known", "distance", (F.col("nth") - 1).alias("rank"))


def words_of(texts: DataFrame, column: str = "text", least: int = 4) -> DataFrame:
    """word, n (texts that hold it): lower-cased runs of a to z of ``least`` letters and more."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))
    return texts.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
