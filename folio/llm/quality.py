"""Quality rules: counts within a document, then cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents that
hold a line are counted over the whole corpus. Lines above the limits are
boilerplate and removed, and a document that then is depleted is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, packed, release, slices, unpacked, without_lines

SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACE = "\x20\t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A line is boilerplate when it stands in over MIN_DOCS distinct documents of a host and in over MIN_SHARE of them,
#: or in over MANY_DOCS, whatever the host's size; that decides in hosts of over MANY_DOCS / MIN_SHARE documents only.
MIN_DOCS, MIN_SHARE, MANY_DOCS = 20, 0.05, 1000
#: A document is depleted when under KEPT_SHARE of its words, or under MIN_WORDS words, are left.
KEPT_SHARE, MIN_WORDS = 0.3, 10
SALTS = 16


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words inside windows of width words that are found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    # Exact ranks of windows: pair the rank of the part so far with the next word, and rank again.
    rank = ids
    for k in range(1, width):
        rank = np.unique(rank[: len(words) - k] * (len(known) + 1) + ids[k:], return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _document(text: str) -> tuple:
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def line_hash(line: Column) -> Column:
    """White-space runs, case and the digits of numbers don't make lines differ."""
    return F.xxhash64(F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))), "[0-9]+", "0"))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key, the counts of the contract, base_failed, and for each line with a word its number, hash and number of words. No shuffle."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), line_hash(x).alias("h"), F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))), lambda s: s["w"] > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("lines", lines).withColumn("text_key", F.xxhash64("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            found = [_document(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
            failed = pc.or_(pc.less(columns[0], 10), pc.greater(pc.multiply(columns[4], 100), pc.multiply(columns[0], 20)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(3), *columns, failed], ["doc_id", "host", "text_key", "lines", *names, "base_failed"])

    return rows.select("doc_id", "host", "text", "lines", "text_key").mapInArrow(run, "doc_id long, host string, text_key long, lines array<struct<i:int,h:long,w:int>>, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean")


def boilerplate(base: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """host, h of lines above the limits. Documents with the same text in a host are one document."""
    distinct = base.groupBy("host", "text_key").agg(F.first(F.array_distinct(F.transform("lines", lambda s: s["h"]))).alias("hs"))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("n_docs")).select(F.col("host").alias("of"), "n_docs")
    counts = distinct.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where((F.col("n") > F.col("n_docs") * min_share) | (F.col("n") > many_docs)).select("host", "h")


def quality(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, kept_share: float = KEPT_SHARE, min_words: int = MIN_WORDS, many_docs: int = MANY_DOCS) -> DataFrame:
    """One row per document: doc_id, text_key, the contract's counts, base_failed, n_boilerplate_words, removed_lines (numbers from 0, ascending; null if none), kept.

    A null text has no words and fails the base rules; a null source is a
    host of its own; repeated rows are one document for the line counts and
    give repeated results; an empty table gives none.
    """
    base = cut(base_rules(docs))
    bad = cut(boilerplate(base, min_docs, min_share, many_docs))
    # A hot line meets its one row in SALTS parts.
    lines = base.select("doc_id", "text_key", "host", F.explode("lines").alias("l")).select("doc_id", "text_key", "host", "l.h", "l.i", "l.w", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).alias("salt"))
    salted = bad.select(F.col("host").alias("of"), F.col("h").alias("bad_h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("bad_salt"))
    hit = lines.join(salted, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("bad_h")) & (F.col("salt") == F.col("bad_salt")), "left_semi")
    removed = hit.groupBy("doc_id", "text_key", "host").agg(F.sort_array(F.collect_set(F.struct("i", "w"))).alias("r_lines"))
    removed = removed.select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), F.col("host").alias("r_host"), "r_lines")
    joined = base.join(removed, base["doc_id"].eqNullSafe(F.col("r_id")) & (base["text_key"] == F.col("r_key")) & base["host"].eqNullSafe(F.col("r_host")), "left")
    gone = F.coalesce(F.aggregate("r_lines", F.lit(0).cast("long"), lambda a, s: a + s["w"]), F.lit(0).cast("long"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    verdict = ~F.col("base_failed") & ~((F.col("n_boilerplate_words") > 0) & ((left < F.col("n_words") * kept_share) | (left < min_words)))
    return joined.withColumn("n_boilerplate_words", gone).select("doc_id", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_boilerplate_words", F.col("r_lines.i").alias("removed_lines"), verdict.alias("kept"))


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, boilerplate lines removed from their texts, n_chars to match; other columns as they are, whatever their names."""
    good = quality(docs, **limits).where("kept").select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), F.col("host").alias("g_host"), F.col("removed_lines").alias("gone")).dropDuplicates(["g_id", "g_key", "g_host"])
    rows = packed(docs)
    same = rows["id"].eqNullSafe(F.col("g_id")) & (rows["text_key"] == F.col("g_key")) & rows["row.source"].cast("string").eqNullSafe(F.col("g_host"))
    return unpacked(rows.join(good, same), without_lines(F.col("text"), F.col("gone")), F.col("gone").isNotNull())
