"""A search's total and page from one job."""

import pytest
from pyspark.sql import functions as F

from folio.operators import search
from folio.schema import PAPER_FIELDS


@pytest.fixture(scope="module")
def papers(spark):
    text = {f: F.lit(None).cast("string") for f in PAPER_FIELDS}
    text |= {"id": F.format_string("2401.%05d", "n"), "title": F.when(F.col("n") % 3 == 0, "deep nets").otherwise("shallow nets"), "abstract": F.repeat(F.lit("deep "), (F.col("n") % 7).cast("int")), "authors": F.array(F.lit("A B")), "categories": F.array(F.lit("cs.CL")), "published": F.format_string("2024-01-%02dT00:00:00Z", F.col("n") % 28 + 1)}
    return spark.range(500).withColumnRenamed("id", "n").repartition(7).select(*[text[f].alias(f) for f in PAPER_FIELDS])


@pytest.mark.parametrize("options", [{}, {"start": 160}, {"start": 5000}, {"sort_by": "submitted", "sort_order": "ascending"}, {"max_results": 0}, {"max_results": 50, "start": 150}])
def test_total_and_page_are_those_of_two_jobs(papers, options):
    row = search.envelope(papers, "ti:deep", **options).head()
    assert row["total_results"] == search.total(papers, "ti:deep").head()[0] == 167
    assert row["start"] == options.get("start", 0)
    assert [p["id"] for p in row["papers"]] == [p["id"] for p in search.page(papers, "ti:deep", **options).collect()]


@pytest.mark.parametrize("query, n", [("ti:deep", 167), ("ti:absent", 0), ("nets", 500)])
def test_tables_without_rows_and_without_matches(papers, query, n):
    assert search.envelope(papers, query).head()["total_results"] == n
    empty = search.envelope(papers.where("id is null"), query).head()
    nothing = search.envelope(papers.sparkSession.createDataFrame([], papers.schema), query).head()
    assert [empty["total_results"], empty["papers"], nothing["total_results"], nothing["papers"]] == [0, [], 0, []]


def test_one_job(spark, papers, tmp_path):
    papers.write.parquet(str(tmp_path / "papers"))
    stored = spark.read.schema(papers.schema).parquet(str(tmp_path / "papers"))
    spark.sparkContext.setJobGroup("one-search", "")
    try:
        search.envelope(stored, "ti:deep AND nets", sort_by="relevance")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-search")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
