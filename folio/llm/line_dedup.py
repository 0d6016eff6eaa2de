"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A run is a series of successive lines (blank ones don't count) with at least
``min_words`` words, or of ``max_lines`` lines. For every line, the shortest
run that begins there and the shortest that ends there are the windows. The
least line hash of a window is its fingerprint: equal runs have it at the
same place, so no repeat is missed. Fingerprints at one place only are
dropped; the windows of the others are joined by content to their first
occurrence in the order of (doc_id, line). A window that stood earlier is a later repeat;
windows that overlap extend each other to both sides, and the lines they
cover are deleted. The first occurrence of every line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, drop, packed, unpacked, without_lines

MIN_WORDS, MAX_LINES = 50, 8
SALTS = 16


def _zero() -> Column:
    return F.lit(0)


def _windows(h: Column, w: Column, min_words: int, max_lines: int) -> Column:
    """array<bigint> of the windows that begin or end at each line: place, counted over non-blank lines from 0, times (max_lines + 1), plus length."""

    def grow(i: Column, step: int) -> Column:
        # Lines that a window takes from line i on, going forth or back; 0 if the text ends before.
        def more(s: Column, k: Column) -> Column:
            at = i + k * step
            open_ = (s["words"] < min_words) & (s["n"] == k) & (at >= 0) & (at < F.size(h))
            return F.struct(F.when(open_, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(open_, s["words"] + F.coalesce(F.get(w, at), _zero())).otherwise(s["words"]).alias("words"))

        return F.aggregate(F.sequence(_zero(), F.lit(max_lines - 1)), F.struct(_zero().alias("n"), _zero().alias("words")), more, lambda s: F.when((s["words"] >= min_words) | (s["n"] == max_lines), s["n"]).otherwise(0))

    # One number a window: numbers are told apart by a hash set, structs by comparing each with each.
    number = lambda at, n: F.when(n > 0, at.cast("long") * (max_lines + 1) + n)
    each = F.sequence(_zero(), F.size(h) - 1)
    forth = F.transform(each, lambda i: number(i, grow(i, 1)))
    back = F.transform(F.transform(each, lambda i: F.struct(i.alias("i"), grow(i, -1).alias("n"))), lambda s: number(s["i"] - s["n"] + 1, s["n"]))
    return F.when(F.size(h) > 0, F.array_distinct(F.filter(F.concat(forth, back), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<bigint>"))


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.split(text, "\n").alias("lines"))
    words = lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda t: t != ""))
    norm = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))))
    found = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), norm(x).alias("h"), words(x).alias("w"))), lambda s: s["w"] > 0)
    return rows.withColumn("l", found).select("doc_id", "text_key", F.transform("l", lambda s: s["i"]).alias("at_line"), F.transform("l", lambda s: s["h"]).alias("h"), F.transform("l", lambda s: s["w"]).alias("w"))


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """doc_id, text_key, and the numbers (from 0) of the lines to delete, ascending."""
    # A document that is there twice row for row counts once.
    lines = _lines(docs).dropDuplicates(["doc_id", "text_key"])

    def window(x: Column) -> Column:
        # All that is needed of a window, so that no array is carried along with what is exploded.
        at, n = F.floor(x / (max_lines + 1)).cast("int"), F.pmod(x, F.lit(max_lines + 1)).cast("int")
        part = F.slice("h", at + 1, n)
        mark = F.array_min(part)
        return F.struct(at.alias("at"), F.get("at_line", at).alias("a"), F.get("at_line", at + n - 1).alias("b"), mark.alias("mark"), (at + F.array_position(part, mark).cast("int") - 1).alias("mark_at"), F.xxhash64(part, F.reverse(part)).alias("content"))

    found = lines.select("doc_id", "text_key", "at_line", "h", _windows(F.col("h"), F.col("w"), min_words, max_lines).alias("s"))
    windows = cut(found.select("doc_id", "text_key", F.explode(F.transform("s", window)).alias("x")).select("doc_id", "text_key", "x.*"))
    # Fingerprints at one place only are dropped; the windows of the others are compared.
    spot = F.struct("doc_id", "text_key", "mark_at")
    marks = windows.groupBy("mark").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where(~F.col("lo").eqNullSafe(F.col("hi"))).select("mark")
    met = cut(windows.join(marks, "mark", "left_semi"))
    drop(windows)
    place = F.struct("doc_id", "text_key", "at")
    first = met.groupBy("mark", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    salt = F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS))
    first = first.select(F.col("mark").alias("f_mark"), F.col("content").alias("f_content"), "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("f_salt"))
    later = met.withColumn("salt", salt).join(first, (F.col("mark") == F.col("f_mark")) & (F.col("content") == F.col("f_content")) & (F.col("salt") == F.col("f_salt"))).where(~place.eqNullSafe(F.col("first")))
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("a", "b")), lambda s: F.sequence(s["a"], s["b"])))))
    return later.groupBy("doc_id", "text_key").agg(covered.alias("drop"))


def _kept(docs: DataFrame, min_words: int, max_lines: int) -> DataFrame:
    """The packed documents with gone, the numbers of the lines to delete (null if none)."""
    later = later_runs(docs, min_words, max_lines).select(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key"), F.col("drop").alias("gone"))
    rows = packed(docs)
    return rows.join(later, rows["id"].eqNullSafe(F.col("d_id")) & (rows["text_key"] == F.col("d_key")), "left")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """The documents with later repeated runs deleted from their texts, n_chars to match; other columns as they are, whatever their names.

    A null text stays null and an empty one empty; documents of which nothing
    is left keep an empty text. Of equal rows, none is earlier than the other,
    so all keep the same text. An empty table gives an empty table. Work is
    linear in a text's lines; ids must be numbers.
    """
    return unpacked(_kept(docs, min_words, max_lines), without_lines(F.col("text"), F.col("gone")), F.col("gone").isNotNull())


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed (lines), n_bytes_kept, kept_sha256."""
    out = _kept(docs.select("doc_id", "text"), min_words, max_lines)
    out = out.select("id", "gone", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("gone"))).alias("kept"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.octet_length("kept").cast("long").alias("n_bytes_kept"), F.sha2("kept", 256).alias("kept_sha256"))
