"""Search with category filter, order and paging."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import render
from folio.plans.query import parse, predicate, score
from folio.schema import PAPER_FIELDS

SORTS = ("relevance", "submitted", "updated")


def matching(papers: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Papers that match; the category holds besides the whole query."""
    found = papers.where(predicate(parse(query)))
    return found if category is None else found.where(F.array_contains("categories", category))


def scored(found: DataFrame, query: str, sort_by: str = "relevance") -> DataFrame:
    """With _score, where the order asks for it: a column, as sorting by an expression would work it out for every comparison."""
    if sort_by != "relevance":
        return found
    return found.withColumn("_score", score(parse(query)))


def order_by(sort_by: str = "relevance", sort_order: str = "descending") -> list[Column]:
    """Sort columns of scored(), with ties settled: by date for relevance, then by id."""
    turn = (lambda c: c.desc()) if sort_order == "descending" else (lambda c: c.asc())
    if sort_by == "submitted":
        return [turn(F.col("published")), F.col("id").asc()]
    if sort_by == "updated":
        return [turn(F.col("updated")), F.col("id").asc()]
    return [turn(F.col("_score")), F.col("published").desc(), F.col("id").asc()]


def page(papers: DataFrame, query: str, category: str | None = None, max_results: int = 10, sort_by: str = "relevance", sort_order: str = "descending", start: int = 0) -> DataFrame:
    """One page in order; Spark keeps the top rows of every task only."""
    found = scored(matching(papers, query, category), query, sort_by)
    return found.orderBy(*order_by(sort_by, sort_order)).offset(start).limit(max_results)


def total(papers: DataFrame, query: str, category: str | None = None) -> DataFrame:
    return matching(papers, query, category).agg(F.count("*").alias("total_results"))


def envelope(papers: DataFrame, query: str, category: str | None = None, max_results: int = 10, sort_by: str = "relevance", sort_order: str = "descending", start: int = 0) -> DataFrame:
    """One row: total_results, start, papers (array in order); also for a page past the end.

    Runs at once, as one job that scans the papers once: all matching rows are
    counted by an observed metric on their way to the top rows of every task.
    Only the page's max_results rows are gathered.
    """
    session = papers.sparkSession
    counted = Observation()
    found = matching(papers, query, category).observe(counted, F.count(F.lit(1)).alias("total_results"))
    # A limit of no rows would run no job, so nothing would be counted.
    top = scored(found, query, sort_by).orderBy(*order_by(sort_by, sort_order)).offset(start).limit(max(1, max_results))
    rows = top.select(*PAPER_FIELDS)
    taken = rows.collect()[:max_results]
    try:
        n = counted.get["total_results"]
    except Py4JJavaError:
        # Spark knew from the plan that the page is empty, and left out the scan with its metric.
        n = total(papers, query, category).head()[0]
    schema = T.StructType([T.StructField("total_results", T.LongType()), T.StructField("start", T.LongType()), T.StructField("papers", T.ArrayType(rows.schema))])
    return session.createDataFrame([(n, start, taken)], schema)


def as_text(found: DataFrame) -> DataFrame:
    return found.select(render.search(F.col("papers"), F.col("total_results"), F.col("start")).alias("text"))
