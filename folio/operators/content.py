"""Reading: two sources of renderings, cleaning, slices and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import html, render
from folio.schema import CONTENT_FIELDS, MIRROR, NATIVE, PDF_URL


def with_rendering(papers: DataFrame, native: DataFrame, mirror: DataFrame) -> DataFrame:
    """Papers with source, html and error. The mirror serves what the native source answers with 3xx, 4xx or not at all; a 5xx is an error."""
    n = native.select(F.col("base_id").alias("n_id"), F.col("status").alias("n_status"), F.col("html").alias("n_html"))
    m = mirror.select(F.col("base_id").alias("m_id"), F.col("status").alias("m_status"), F.col("html").alias("m_html"))
    both = papers.join(n, F.col("base_id") == F.col("n_id"), "left").join(m, F.col("base_id") == F.col("m_id"), "left")
    ok = lambda s: F.coalesce(F.col(s).between(200, 299), F.lit(False))
    broken = lambda s: F.coalesce(F.col(s) >= 500, F.lit(False))
    source = F.when(ok("n_status"), F.lit(NATIVE)).when(broken("n_status"), F.lit(None)).when(ok("m_status"), F.lit(MIRROR))
    error = F.when(ok("n_status"), F.lit(None)).when(broken("n_status"), F.lit("unavailable")).when(ok("m_status"), F.lit(None)).when(broken("m_status"), F.lit("unavailable")).otherwise(F.lit("html_unavailable"))
    text = F.when(F.col("source") == NATIVE, F.col("n_html")).when(F.col("source") == MIRROR, F.col("m_html"))
    return both.withColumn("source", source).withColumn("error", error).withColumn("html", text).drop("n_id", "n_status", "n_html", "m_id", "m_status", "m_html")


def unavailable(papers: DataFrame, native: DataFrame, mirror: DataFrame) -> DataFrame:
    """id and message of papers with no rendering. No rendering is read for that: its status will do."""
    rows = with_rendering(papers.select("id", "base_id"), native, mirror).where("error = 'html_unavailable'")
    return rows.select("id", F.concat(F.lit("HTML content not available for paper '"), F.col("id"), F.lit(f"'. The PDF is available at {PDF_URL}"), F.col("base_id")).alias("message"))


def cleaned(rendered: DataFrame) -> DataFrame:
    """raw (head cut) and body (cleaned too) of html."""
    return rendered.withColumn("raw", html.strip_head(F.col("html"))).withColumn("body", html.strip_noise(F.col("raw")))


def read(rendered: DataFrame, start: Column | int = 0, max_characters: Column | int = 100_000) -> DataFrame:
    """CONTENT rows of papers with a rendering. The body is sliced after cleaning."""
    col = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("bigint")
    rows = cleaned(rendered.where("html is not null")).withColumn("start", col(start)).withColumn("_max", col(max_characters))
    rows = rows.withColumn("content", html.piece(F.col("body"), F.col("start"), F.col("_max")))
    rows = rows.withColumn("truncated", html.truncated(F.col("start"), F.col("content"), F.col("body")))
    rows = rows.withColumn("total_characters", F.length("raw").cast("bigint")).withColumn("body_characters", F.length("body").cast("bigint"))
    return rows.withColumn("paper_id", F.col("id")).select(*CONTENT_FIELDS)


def chunks(rendered: DataFrame, size: int) -> DataFrame:
    """Every slice of every body: id, start, content, truncated."""
    bodies = cleaned(rendered.where("html is not null")).select("id", "body")
    starts = bodies.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.length("body").cast("bigint") - 1, F.lit(0).cast("bigint")), F.lit(size).cast("bigint"))))
    part = html.piece(F.col("body"), F.col("start"), F.lit(size))
    return starts.select("id", "start", part.alias("content"), html.truncated(F.col("start"), part, F.col("body")).alias("truncated"))


def as_text(contents: DataFrame) -> DataFrame:
    return contents.select("paper_id", render.content(F.struct(*CONTENT_FIELDS)).alias("text"))
