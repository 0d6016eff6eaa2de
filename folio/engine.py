"""The six calls of the catalogue over DataFrames, with checked input and typed errors."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from folio.operators import categories as cat
from folio.operators import content, lookup, search
from folio.plans import table_functions
from folio.schema import CATEGORIES, CODES, GROUPS
from folio.sources import corpus


class CatalogueError(Exception):
    """A failure that a caller can act on; reason is one of schema.ERRORS."""

    def __init__(self, reason: str, message: str, **data):
        super().__init__(message)
        self.reason, self.data = reason, data


@dataclass(frozen=True)
class Config:
    delay_ms: int = 3_000
    html_timeout_ms: int = 30_000
    api_timeout_ms: int = 15_000
    base_url: str = "https://export.arxiv.org/api"

    @classmethod
    def from_env(cls, prefix: str = "FOLIO_") -> Config:
        """Values of FOLIO_DELAY_MS and so on; those that aren't set keep their defaults."""
        given = {k: os.environ.get(prefix + k.upper()) for k in cls.__dataclass_fields__}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v is not None})


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass
class Engine:
    """papers needs the PAPER columns and base_id for reading; renderings: base_id, status, html."""

    spark: SparkSession
    papers: DataFrame
    native: DataFrame | None = None
    mirror: DataFrame | None = None
    config: Config = field(default_factory=Config)

    def _options(self, query, category, max_results, sort_by, sort_order, start) -> dict:
        query = query.strip()
        _check(1 <= len(query) <= 1000, "query must have 1 to 1000 characters")
        _check(not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f]", query), "query contains control characters")
        _check(1 <= max_results <= 50, "max_results must be 1 to 50")
        _check(0 <= start <= 10_000, "start must be 0 to 10000")
        _check(sort_by in search.SORTS, "sort_by must be relevance, submitted or updated")
        _check(sort_order in ("ascending", "descending"), "sort_order must be ascending or descending")
        if category is not None and category not in CODES:
            probe = self.spark.createDataFrame([(category,)], "probe string")
            row = cat.rejections(probe, corpus.categories(self.spark)).head()
            raise CatalogueError("unknown_category", row["message"], category=category)
        return {"query": query, "category": category, "max_results": max_results, "sort_by": sort_by, "sort_order": sort_order, "start": start}

    def search(self, query: str, category: str | None = None, max_results: int = 10, sort_by: str = "relevance", sort_order: str = "descending", start: int = 0) -> DataFrame:
        """One row: total_results, start, papers. No match isn't an error."""
        return search.envelope(self.papers, **self._options(query, category, max_results, sort_by, sort_order, start))

    def search_text(self, *args, **options) -> DataFrame:
        return search.as_text(self.search(*args, **options))

    def get_metadata(self, paper_ids: str | list[str]) -> DataFrame:
        """One row: papers, totalSucceeded, not_found."""
        ids = [paper_ids] if isinstance(paper_ids, str) else list(paper_ids)
        _check(1 <= len(ids) <= 10 and all(ids), "paper_ids must be 1 to 10 identifiers")
        requests = self.spark.createDataFrame(list(enumerate(ids)), "ord int, id string")
        if lookup.found(self.papers, requests).isEmpty():
            raise CatalogueError("no_match", f"No papers found for {', '.join(ids)}.", ids=ids)
        return lookup.envelope(self.papers, requests)

    def metadata_text(self, paper_ids: str | list[str]) -> DataFrame:
        return lookup.as_text(self.get_metadata(paper_ids))

    def read_paper(self, paper_id: str, max_characters: int = 100_000, start: int = 0) -> DataFrame:
        """The CONTENT row of one paper."""
        _check(bool(paper_id) and max_characters >= 1 and start >= 0, "paper_id, max_characters >= 1 and start >= 0 are needed")
        request = self.spark.createDataFrame([(0, paper_id)], "ord int, id string")
        wanted = self.papers.join(lookup.found(self.papers, request).select("id"), "id", "left_semi")
        if wanted.isEmpty():
            raise CatalogueError("no_match", f"Paper '{paper_id}' was not found.", paper_id=paper_id)
        rendered = content.with_rendering(wanted, self.native, self.mirror)
        status = rendered.select("error").head()["error"]
        if status == "html_unavailable":
            raise CatalogueError(status, content.unavailable(wanted, self.native, self.mirror).head()["message"], paper_id=paper_id)
        if status:
            raise CatalogueError(status, f"The rendering of '{paper_id}' is unavailable for now.", paper_id=paper_id)
        return content.read(rendered, start, max_characters)

    def list_categories(self, group: str | None = None) -> DataFrame:
        _check(group is None or group in GROUPS, f"group must be one of {', '.join(GROUPS)}")
        return cat.listing(corpus.categories(self.spark), group)

    def resource(self, uri: str) -> DataFrame:
        """scheme://categories or scheme://paper/identifier as one row of JSON."""
        if re.fullmatch("[a-z]+://categories", uri):
            return self.spark.createDataFrame(CATEGORIES, "ord int, code string, name string, grp string").selectExpr("to_json(struct(transform(sort_array(collect_list(struct(ord, code, name, grp))), x -> struct(x.code, x.name, x.grp AS `group`)) AS categories)) AS json")
        found = re.fullmatch("[a-z]+://paper/(.+)", uri)
        _check(bool(found), f"unknown resource {uri}")
        rows = lookup.found(self.papers, self.spark.createDataFrame([(0, found[1])], "ord int, id string"))
        if rows.isEmpty():
            raise CatalogueError("no_match", f"Paper '{found[1]}' was not found.", paper_id=found[1])
        return lookup.as_json(rows.limit(1)).select("json")

    def register(self) -> None:
        """Temporary views papers and categories for SQL, and the calls as table functions (see ``table_functions``)."""
        table_functions.register(self.spark, self.papers, corpus.categories(self.spark), self.native, self.mirror)
