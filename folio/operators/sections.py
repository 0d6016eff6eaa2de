"""Sections of rendered pages: every block of text with the headings it stands under."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OPENS, _CLOSES, _TAGS = r"(?i)<(h[1-6]|p|li)\b", r"(?i)</(h[1-6]|p|li)>", r"<[^>]*>"


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, level (1 to 6 of a heading, null of text), content without tags, of headings, paragraphs and list items.

    A block ends at the first end of a block, or where the next one begins;
    blocks without content are left out.
    """
    parts = F.split(F.regexp_replace(html, _OPENS, "\x01<$1"), "\x01")
    rows = pages.select(key, F.posexplode(parts).alias("pos", "b")).where("pos > 0")
    own = F.substring_index(F.regexp_replace("b", _CLOSES, "\x02"), "\x02", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(own, _TAGS, " "), r"[\x20\x09-\x0D]+", " "))
    rows = rows.select(key, "pos", F.regexp_extract("b", "^<[hH]([1-6])", 1).try_cast("int").alias("level"), plain.alias("content"))
    return rows.where(F.col("content") != "")


def sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, section (from 0: what stands before any heading), level, heading, path (headings it is in, outermost first, joined by ' > '), n_blocks, n_chars.

    A running count of headings is the section; for each level the last
    heading counts unless one of a higher level came after it. Pages must be
    unique; a null page has no sections.
    """
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks(pages, key, html).withColumn("section", F.count("level").over(order).cast("int"))
    for n in range(1, 7):
        rows = rows.withColumn(f"_h{n}", F.last(F.when(F.col("level") == n, F.struct(F.col("pos").alias("pos"), F.col("content").alias("heading"))), ignorenulls=True).over(order))
    names = []
    for n in range(1, 7):
        higher = [F.col(f"_h{m}.pos") for m in range(1, n)]
        open_ = F.lit(True) if not higher else F.coalesce(F.col(f"_h{n}.pos") > F.greatest(F.lit(-1), *higher), F.lit(False))
        names.append(F.when(open_, F.col(f"_h{n}.heading")))
    path = F.array_join(F.filter(F.array(*names), lambda x: x.isNotNull()), " > ")
    rows = rows.withColumn("path", path)
    text = F.col("level").isNull()
    return rows.groupBy(key, "section").agg(F.max("level").alias("level"), F.max(F.when(~text, F.col("content"))).alias("heading"), F.max("path").alias("path"), F.count(F.when(text, 1)).alias("n_blocks"), F.coalesce(F.sum(F.when(text, F.length("content"))), F.lit(0)).cast("long").alias("n_chars"))
