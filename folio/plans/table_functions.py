"""The catalogue's calls as SQL table functions over the views papers, categories and bodies.

Their bodies are plain selects, so a call with a column (LATERAL) becomes a
join that Spark plans like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import content
from folio.schema import PAPER_FIELDS

_BASE = r"regexp_replace({}, 'v[0-9]+$', '')"


def _columns(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def register(spark: SparkSession, papers: DataFrame, categories: DataFrame, native: DataFrame | None = None, mirror: DataFrame | None = None) -> None:
    """Temporary views and functions of this session.

    list_categories(grp): the taxonomy, or one group of it.
    get_metadata(ids): papers of up to ten identifiers, each once, with place (of the first identifier that asks for it, from 0).
    missing_papers(ids): place, id and reason of identifiers that aren't there.
    read_paper(paper_id, first, characters): the CONTENT row of a paper that has a rendering.
    """
    papers.createOrReplaceTempView("papers")
    categories.createOrReplaceTempView("categories")
    make = lambda name, given, columns, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE({columns}) RETURN {body}")
    make("list_categories", "wanted STRING DEFAULT NULL", _columns(categories, ["ord", "code", "name", "grp"]), "SELECT ord, code, name, grp FROM categories WHERE wanted IS NULL OR grp = wanted")
    asked = f"(SELECT min(pos) AS place, {_BASE.format('id')} AS key FROM (SELECT posexplode(ids) AS (pos, id)) GROUP BY {_BASE.format('id')})"
    fields = ", ".join(f"p.{c}" for c in PAPER_FIELDS)
    make("get_metadata", "ids ARRAY<STRING>", f"place INT, {_columns(papers, PAPER_FIELDS)}", f"SELECT a.place, {fields} FROM papers p JOIN {asked} a ON p.base_id = a.key WHERE size(ids) <= 10")
    make("missing_papers", "ids ARRAY<STRING>", "place INT, id STRING, reason STRING", f"SELECT a.pos, a.id, 'not_in_arxiv' FROM (SELECT posexplode(ids) AS (pos, id)) a LEFT ANTI JOIN papers p ON p.base_id = {_BASE.format('a.id')} WHERE size(ids) <= 10")
    if native is None or mirror is None:
        return
    bodies = content.cleaned(content.with_rendering(papers, native, mirror).where("html IS NOT NULL"))
    bodies.select("base_id", F.col("id").alias("paper_id"), "title", "source", "pdf_url", "abstract_url", "body", F.length("raw").cast("bigint").alias("total_characters"), F.length("body").cast("bigint").alias("body_characters")).createOrReplaceTempView("bodies")
    piece = "substring(body, CAST(first + 1 AS INT), CAST(characters AS INT))"
    make(
        "read_paper", "asked STRING, first BIGINT DEFAULT 0, characters BIGINT DEFAULT 100000",
        "paper_id STRING, title STRING, content STRING, source STRING, truncated BOOLEAN, start BIGINT, total_characters BIGINT, body_characters BIGINT, pdf_url STRING, abstract_url STRING",
        f"SELECT paper_id, title, {piece}, source, first + length({piece}) < body_characters, first, total_characters, body_characters, pdf_url, abstract_url FROM bodies WHERE base_id = {_BASE.format('asked')} AND first >= 0 AND characters >= 1",
    )
