"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import html, render
from folio.functions import text as T
from folio.operators import categories as cat
from folio.operators import content, lookup, queue, search
from folio.plans import sql
from folio.schema import GROUPS, PAPER_FIELDS
from folio.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, statement: str | None):
    def add(f):
        QUERIES[name] = f
        if statement:
            ORACLE_SQL[name] = statement
        return f

    return add


_papers = corpus.papers_of_documents
P = sql.PAPERS

# --- categories ---------------------------------------------------------------

query("categories_scan", f"WITH {sql.CATS} SELECT ord, code, name, grp FROM cats")(lambda s, d: corpus.categories(s))
query("categories_by_group", f"WITH {sql.CATS} SELECT ord, code, name, grp FROM cats WHERE grp = 'econ'")(lambda s, d: cat.listing(corpus.categories(s), "econ"))
query("category_group", f"WITH {P}, {sql.CATS} SELECT doc_id, code AS category, grp FROM papers JOIN cats ON primary_category = code")(lambda s, d: _papers(s, d).select("doc_id", F.col("primary_category").alias("category"), T.group_of(F.col("primary_category")).alias("grp")))
query("categories_grouped", f"WITH {sql.CATS} SELECT grp, min(ord)::int AS first, count(*) AS n, string_agg(code, ' ' ORDER BY ord) AS codes FROM cats GROUP BY grp")(lambda s, d: cat.grouped(corpus.categories(s)).withColumn("codes", F.array_join("codes", " ")))
query("categories_header", f"WITH {sql.CATS} SELECT count(*) AS total, count(DISTINCT grp) AS groups, 'Showing 155 categories across {len(GROUPS)} groups:' AS header FROM cats")(lambda s, d: cat.header(corpus.categories(s)))
query("category_distinct", f"WITH {P}, {sql.CATS} SELECT count(DISTINCT c) AS used, (SELECT count(DISTINCT code) FROM cats) AS known FROM (SELECT unnest(categories) AS c FROM papers)")(
    lambda s, d: _papers(s, d).select(F.explode("categories").alias("c")).agg(F.count_distinct("c").alias("used")).crossJoin(corpus.categories(s).agg(F.count_distinct("code").alias("known")))
)
query("categories_text", f"""WITH {sql.CATS}, sections AS (SELECT min(ord) AS o, '## ' || grp || chr(10) || string_agg(code || ' — ' || name, chr(10) ORDER BY ord) AS t FROM cats GROUP BY grp)
SELECT 'Showing 155 categories across {len(GROUPS)} groups:' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY o) AS text FROM sections""")(lambda s, d: cat.as_text(corpus.categories(s)))

_PROBES = "probes AS (SELECT DISTINCT source AS probe FROM documents UNION ALL SELECT unnest(['cs.INVALID', 'foo.BAR', 'math.XX', 'cs.AI', 'quantph', '.x', 'CS.ai', 'hep'])),"


def _probes(s: SparkSession, d: str) -> DataFrame:
    own = s.createDataFrame([(x,) for x in ("cs.INVALID", "foo.BAR", "math.XX", "cs.AI", "quantph", ".x", "CS.ai", "hep")], "probe string")
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("probe")).distinct().union(own)


_MET = f"""{_PROBES} {sql.CATS}, met AS (SELECT probe, code, ord, split_part(t, '.', 1) <> '' AND (starts_with(lower(code), split_part(t, '.', 1) || '.') OR lower(code) = split_part(t, '.', 1)) AS same,
  levenshtein(t, lower(code)) AS dist FROM (SELECT DISTINCT probe, lower(trim(probe)) AS t FROM probes) p, cats WHERE t <> ''),
ranked AS (SELECT probe, code, same, bool_or(same) OVER (PARTITION BY probe) AS any_same, row_number() OVER (PARTITION BY probe, same ORDER BY ord) AS by_ord, row_number() OVER (PARTITION BY probe ORDER BY dist, ord) AS by_dist FROM met),
suggested AS (SELECT probe, 'prefix' AS kind, (by_ord - 1)::int AS rank, code FROM ranked WHERE same AND by_ord <= 5 UNION ALL SELECT probe, 'distance', (by_dist - 1)::int, code FROM ranked WHERE NOT any_same AND by_dist <= 5)"""
query("suggest_prefix", f"WITH {_MET} SELECT * FROM suggested WHERE kind = 'prefix'")(lambda s, d: cat.suggestions(_probes(s, d), corpus.categories(s)).where("kind = 'prefix'"))
query("suggest_edit_distance", f"WITH {_MET} SELECT * FROM suggested WHERE kind = 'distance'")(lambda s, d: cat.suggestions(_probes(s, d), corpus.categories(s)).where("kind = 'distance'"))
query("category_valid", f"WITH {_PROBES} {sql.CATS} SELECT probe FROM probes WHERE probe IN (SELECT code FROM cats)")(lambda s, d: cat.valid(_probes(s, d), corpus.categories(s)))
query("category_invalid", f"""WITH {_MET} SELECT probe, 'Unknown category ''' || probe || '''.' || coalesce(' Did you mean: ' || (SELECT string_agg(code, ', ' ORDER BY rank) FROM suggested s WHERE s.probe = p.probe) || '?', ' Use list_categories to list valid codes.') AS message
FROM (SELECT DISTINCT probe FROM probes) p WHERE probe NOT IN (SELECT code FROM cats)""")(lambda s, d: cat.rejections(_probes(s, d), corpus.categories(s)))

# --- projections ----------------------------------------------------------------

query("id_normalize", f"WITH {P} SELECT doc_id, id, regexp_replace(id, 'v[0-9]+$', '') AS base_id, regexp_replace(abstract_url, '^https?://arxiv.org/abs/', '') AS from_url FROM papers")(
    lambda s, d: _papers(s, d).select("doc_id", "id", T.strip_version(F.col("id")).alias("base_id"), T.extract_id(F.col("abstract_url")).alias("from_url"))
)
query("text_squeeze", f"WITH {P} SELECT doc_id, title, md5(abstract) AS abstract_md5, length(abstract) AS n FROM papers")(lambda s, d: _papers(s, d).select("doc_id", "title", F.md5("abstract").alias("abstract_md5"), F.length("abstract").cast("bigint").alias("n")))
query("primary_category", f"WITH {P} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN primary_category WHEN doc_id % 3 = 1 THEN categories[1] ELSE '' END AS category FROM papers")(
    lambda s, d: _papers(s, d).select("doc_id", T.primary_category(F.when(F.col("doc_id") % 3 == 0, F.col("primary_category")), F.when(F.col("doc_id") % 3 < 2, F.col("categories"))).alias("category"))
)


def _links(s: SparkSession, d: str) -> DataFrame:
    link = lambda href, rel, title: F.struct(href.alias("_href"), F.lit(rel).alias("_rel"), F.lit(title).alias("_title"))
    own = F.array(link(F.concat(F.lit("x:"), "id"), "alternate", "page"), link(F.concat(F.lit("y:"), "id"), "related", "pdf"), link(F.concat(F.lit("z:"), "id"), "alternate", "pdf"))
    rows = _papers(s, d).select("doc_id", "id", F.when(F.col("doc_id") % 2 == 0, own).alias("links"))
    return rows.select("doc_id", T.abstract_url(F.col("links"), F.col("id")).alias("abstract_url"), T.pdf_url(F.col("links"), F.col("id")).alias("pdf_url"))


query("paper_links", f"WITH {P} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x:' || id ELSE abstract_url END AS abstract_url, CASE WHEN doc_id % 2 = 0 THEN 'y:' || id ELSE pdf_url END AS pdf_url FROM papers")(_links)
query("optional_fields", f"WITH {P} SELECT doc_id, nullif(comment, '') AS comment, nullif(journal_ref, '') AS journal_ref, nullif(doi, '') AS doi FROM papers")(lambda s, d: _papers(s, d).select("doc_id", *[T.optional(F.col(c)).alias(c) for c in ("comment", "journal_ref", "doi")]))

# --- search -----------------------------------------------------------------------


def _ranked(page: DataFrame, keys, start: int = 0) -> DataFrame:
    """The rank of a page's rows; a page has max_results rows at most."""
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*keys)) + start)
    return ranked.select(F.col("rank").cast("bigint").alias("rank"), "id", "title", "published", "updated")


def _search(name: str, text: str, where: str, score: str = "0", category: str | None = None, **options) -> None:
    by, order, start = options.get("sort_by", "submitted"), options.get("sort_order", "descending"), options.get("start", 0)
    run = lambda s, d: _ranked(search.page(_papers(s, d), text, category, sort_by=by, sort_order=order, start=start), search.order_by(by, order), start)
    query(name, sql.page(where, score, by, order, start))(run)


_search("search_basic", "ti:the", f"{sql.has('ti', 'the')} AND list_contains(categories, 'cs.AI')", category="cs.AI")
_search("search_ti", "ti:the", sql.has("ti", "the"))
_search("search_au", 'au:"Author 7"', sql.has("au", "author 7"))
_search("search_abs", "abs:license", sql.has("abs", "license"))
_search("search_cat", "cat:cs.cl", sql.in_cat("cs.CL"))
_search("search_co", "co:characters", sql.has("co", "characters"))
_search("search_jr", "jr:src3", sql.has("jr", "src3"))
_search("search_all", "all:src3", sql.anywhere("src3"))
_search("search_and", "ti:the AND abs:of", f"{sql.has('ti', 'the')} AND {sql.has('abs', 'of')}")
_search("search_or", "ti:que OR ti:der", f"{sql.has('ti', 'que')} OR {sql.has('ti', 'der')}")
_search("search_andnot", "abs:the ANDNOT jr:journal", f"{sql.has('abs', 'the')} AND NOT {sql.has('jr', 'journal')}")
_search("search_parens", "(ti:que OR ti:der) AND co:characters", f"({sql.has('ti', 'que')} OR {sql.has('ti', 'der')}) AND {sql.has('co', 'characters')}")
_search("search_bare_terms", "the and", f"{sql.anywhere('the')} AND {sql.anywhere('and')}")
_search("search_category", "the OR que", f"({sql.anywhere('the')} OR {sql.anywhere('que')}) AND list_contains(categories, 'math.AG')", category="math.AG")
_search("search_sort_relevance", "the of", f"{sql.anywhere('the')} AND {sql.anywhere('of')}", f"({sql.points('all', 'the')} + {sql.points('all', 'of')})", sort_by="relevance")
_search("search_sort_submitted_desc", "ti:the", sql.has("ti", "the"), sort_by="submitted")
_search("search_sort_submitted_asc", "ti:the", sql.has("ti", "the"), sort_by="submitted", sort_order="ascending")
_search("search_sort_updated", "ti:the", sql.has("ti", "the"), sort_by="updated")
_search("search_page2", "abs:the", sql.has("abs", "the"), f"({sql.points('abs', 'the')})", sort_by="relevance", start=10)

query("search_total", f"WITH {P} SELECT count(*) AS total_results FROM papers WHERE {sql.has('abs', 'the')}")(lambda s, d: search.total(_papers(s, d), "abs:the"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("total_results", "start", F.size("papers").cast("bigint").alias("n"), F.array_join(F.col("papers.id"), " ").alias("ids"))


_ENVELOPE = "WITH {p}, found AS (SELECT *, row_number() OVER (ORDER BY {keys}) AS r FROM papers WHERE {where}) SELECT count(*) AS total_results, {start}::bigint AS start, count(*) FILTER (r > {start} AND r <= {end}) AS n, coalesce(string_agg(id, ' ' ORDER BY r) FILTER (r > {start} AND r <= {end}), '') AS ids FROM found"
query("search_envelope", _ENVELOPE.format(p=P, keys=f"{sql.points('abs', 'the')} DESC, published DESC, id", where=sql.has("abs", "the"), start=5, end=15))(lambda s, d: _flat(search.envelope(_papers(s, d), "abs:the", start=5)))
query("search_past_end", _ENVELOPE.format(p=P, keys="published DESC, id", where=sql.in_cat("cs.CL"), start=9000, end=9010))(lambda s, d: _flat(search.envelope(_papers(s, d), "cat:cs.CL", start=9000, sort_by="submitted")))
query("search_text", f"""WITH {P}, found AS (SELECT *, row_number() OVER (ORDER BY updated DESC, id) AS r, count(*) OVER () AS total FROM papers WHERE {sql.has('ti', 'the')})
SELECT 'Found ' || max(total) || ' papers (offset 0, showing 1-' || count(*) || '):' || chr(10) || chr(10) || string_agg({sql.paper_text()}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS text FROM found WHERE r <= 10""")(
    lambda s, d: search.as_text(search.envelope(_papers(s, d), "ti:the", sort_by="updated"))
)
query("format_paper", f"WITH {P} SELECT id, {sql.paper_text()} AS text FROM papers")(lambda s, d: _papers(s, d).select("id", render.paper(F.struct(*PAPER_FIELDS)).alias("text")))

# --- lookup -------------------------------------------------------------------------

_ID_OF = "'24' || lpad((o_custkey % 12 + 1)::varchar, 2, '0') || '.' || lpad(o_custkey::varchar, 5, '0') || CASE WHEN o_orderkey % 3 = 0 THEN 'v1' ELSE '' END"
_REQ = f"req AS (SELECT o_orderkey AS ord, {_ID_OF} AS id, '24' || lpad((o_custkey % 12 + 1)::varchar, 2, '0') || '.' || lpad(o_custkey::varchar, 5, '0') AS key FROM orders)"


def _requests(s: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    base = F.concat(F.lit("24"), F.lpad((c % 12 + 1).cast("string"), 2, "0"), F.lit("."), T.five_digits(c))
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ord"), F.concat(base, F.when(F.col("o_orderkey") % 3 == 0, F.lit("v1")).otherwise(F.lit(""))).alias("id"))


_FEW = [(0, "2403.00002"), (1, "9999.99999"), (2, "2401.00000v7"), (3, "2403.00002v1"), (4, "9999.99999")]
_FEW_SQL = "req(ord, id, key) AS (VALUES (0, '2403.00002', '2403.00002'), (1, '9999.99999', '9999.99999'), (2, '2401.00000v7', '2401.00000'), (3, '2403.00002v1', '2403.00002'), (4, '9999.99999', '9999.99999'))"
_few = lambda s: s.createDataFrame(_FEW, "ord bigint, id string")

query("lookup_found", f"WITH {P}, {_REQ} SELECT o.ord, p.id, p.title, p.doi FROM papers p JOIN (SELECT key, min(ord) AS ord FROM req GROUP BY key) o ON p.base_id = o.key")(lambda s, d: lookup.found(_papers(s, d), _requests(s, d)).select("ord", "id", "title", "doi"))
query("lookup_missing", f"WITH {P}, {_REQ} SELECT ord, id, 'not_in_arxiv' AS reason FROM req WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.base_id = req.key)")(lambda s, d: lookup.missing(_papers(s, d), _requests(s, d)))
query("lookup_summary", f"WITH {P}, {_REQ} SELECT count(*) AS requested, count(DISTINCT base_id) AS succeeded, count(*) FILTER (base_id IS NULL) AS not_found FROM req LEFT JOIN papers ON base_id = key")(lambda s, d: lookup.summary(_papers(s, d), _requests(s, d)))
query("lookup_text", f"""WITH {P}, {_FEW_SQL}, found AS (SELECT p.*, o.ord FROM papers p JOIN (SELECT key, min(ord) AS ord FROM req GROUP BY key) o ON p.base_id = o.key), lost AS (SELECT * FROM req WHERE key NOT IN (SELECT base_id FROM papers))
SELECT 'Found ' || (SELECT count(*) FROM found) || ' of ' || ((SELECT count(*) FROM found) + (SELECT count(*) FROM lost)) || ' papers.' || chr(10) || chr(10) || (SELECT string_agg({sql.paper_text()}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) FROM found)
|| chr(10) || chr(10) || chr(10) || 'Not found:' || chr(10) || (SELECT string_agg('- ' || id || ' (not_in_arxiv)', chr(10) ORDER BY ord) FROM lost) AS text""")(lambda s, d: lookup.as_text(lookup.envelope(_papers(s, d), _few(s))))
_JSON = " || ".join(["'{'", *[f"""'"{f}":' || {x} || ','""" for f, x in (("id", "to_json(id)"), ("title", "to_json(title)"), ("authors", "to_json(authors)"), ("abstract", "to_json(abstract)"), ("primary_category", "to_json(primary_category)"), ("categories", "to_json(categories)"), ("published", "to_json(published)"), ("updated", "to_json(updated)"))], *[f"""coalesce('"{f}":' || to_json({f}) || ',', '')""" for f in ("comment", "journal_ref", "doi")], """'"pdf_url":' || to_json(pdf_url) || ',"abstract_url":' || to_json(abstract_url) || '}'"""])
query("paper_resource_json", f"WITH {P} SELECT id, {_JSON} AS json FROM papers")(lambda s, d: lookup.as_json(_papers(s, d)))
query("uri_route", f"WITH {P} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN id END AS paper_id FROM papers")(
    lambda s, d: _papers(s, d).select("doc_id", lookup.paper_of_uri(F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("corpus://paper/")).otherwise(F.lit("corpus://categories/")), "id")).alias("paper_id"))
)

# --- reading ------------------------------------------------------------------------

R = f"{P}, {sql.RENDERINGS}"
RB = f"{R}, {sql.BODIES}"


def _rendered(s: SparkSession, d: str) -> DataFrame:
    return content.with_rendering(_papers(s, d), *corpus.renderings_of_pages(s, d))


query("content_fallback", f"WITH {R} SELECT id, source, error, length(html) AS n FROM rendered")(lambda s, d: _rendered(s, d).select("id", "source", "error", F.length("html").cast("bigint").alias("n")))
query("html_unavailable", f"WITH {R} SELECT id, 'HTML content not available for paper ''' || id || '''. The PDF is available at https://arxiv.org/pdf/' || base_id AS message FROM rendered WHERE error = 'html_unavailable'")(lambda s, d: content.unavailable(_papers(s, d), *corpus.renderings_of_pages(s, d)))


def _heads(variant: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.replace("html", F.lit("<article"), F.lit(variant)).alias("h"))
        cut = html.strip_head(F.col("h"))
        return pages.select("page_id", F.length(cut).cast("bigint").alias("n"), F.md5(cut).alias("md5"))

    return run


for _name, _variant in (("html_strip_article", "<article"), ("html_strip_main", '<div class="ltx_page_main"'), ("html_strip_head", "<section")):
    query(_name, f"SELECT page_id, length(c) AS n, md5(c) AS md5 FROM (SELECT page_id, {sql.head_cut('h')} AS c FROM (SELECT page_id, replace(html, '<article', {sql.q(_variant)}) AS h FROM pages))")(_heads(_variant))
query("html_clean", f"WITH {RB} SELECT id, md5(body) AS md5 FROM bodies")(lambda s, d: content.cleaned(_rendered(s, d).where("html is not null")).select("id", F.md5("body").alias("md5")))
query("html_lengths", f"WITH {RB} SELECT id, length(raw) AS total_characters, length(body) AS body_characters, (1000 * length(body)) // length(raw) AS permille FROM bodies")(
    lambda s, d: content.cleaned(_rendered(s, d).where("html is not null")).select("id", F.length("raw").cast("bigint").alias("total_characters"), F.length("body").cast("bigint").alias("body_characters"), F.expr("1000L * length(body) div length(raw)").alias("permille"))
)
_SLICE = "substring(body, (st + 1)::int, 300)"
_SLICES = f"sliced AS (SELECT *, length(body) AS b, {_SLICE} AS part FROM (SELECT *, (doc_id * 97) % 2500 AS st FROM bodies))"


def _sliced(s: SparkSession, d: str) -> DataFrame:
    return content.read(_rendered(s, d), F.col("doc_id") * 97 % 2500, 300)


query("content_slice", f"WITH {RB}, {_SLICES} SELECT id AS paper_id, st AS start, part AS content, st + length(part) < b AS truncated FROM sliced")(lambda s, d: _sliced(s, d).select("paper_id", "start", "content", "truncated"))
query("content_chunks", f"WITH {RB} SELECT id, st AS start, substring(body, (st + 1)::int, 700) AS content, st + length(substring(body, (st + 1)::int, 700)) < length(body) AS truncated FROM (SELECT *, unnest(range(0, greatest(length(body), 1), 700)) AS st FROM bodies)")(lambda s, d: content.chunks(_rendered(s, d), 700))
_SHOWN = f"{sql.number('st')} || '–' || {sql.number('st + length(part) - 1')} || ' of ' || {sql.number('b')} || ' body characters'"
_NOTICE = f"CASE WHEN st >= b AND b > 0 THEN '[Offset ' || {sql.number('st')} || ' is past end of body (' || {sql.number('b')} || ' characters). Use start=0 to read from the beginning.]' WHEN st + length(part) < b THEN '[Truncated: showing chars ' || {_SHOWN} || '. Call again with start=' || (st + length(part)) || ' to continue.]' WHEN st > 0 THEN '[Showing chars ' || {_SHOWN} || ' (final chunk).]' END"
query("content_notice", f"WITH {RB}, {_SLICES} SELECT id AS paper_id, {_NOTICE} AS notice FROM sliced")(lambda s, d: _sliced(s, d).select("paper_id", render.notice(F.col("start"), F.length("content").cast("bigint"), F.col("body_characters")).alias("notice")))
_PAGE = f"SELECT id AS paper_id, title, part AS content, source, st + length(part) < b AS truncated, st AS start, length(raw) AS total_characters, b AS body_characters, pdf_url, abstract_url FROM sliced"
query("read_paper_page", f"WITH {RB}, {_SLICES} {_PAGE}")(_sliced)
query("read_paper_text", f"""WITH {RB}, {_SLICES} SELECT id AS paper_id, '# ' || title || chr(10) || 'arXiv:' || id || ' | Source: ' || source || ' | Raw HTML: ' || length(raw) || ' chars | Body: ' || b || ' chars' || CASE WHEN st + length(part) < b THEN ' (truncated)' ELSE '' END || chr(10)
|| 'Abstract: ' || abstract_url || chr(10) || 'PDF: ' || pdf_url || coalesce(chr(10) || chr(10) || {_NOTICE}, '') || chr(10) || chr(10) || part AS text FROM sliced""")(lambda s, d: content.as_text(_sliced(s, d)))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Search, look up and read: the first 400 characters of every readable paper with a common word in its title."""
    hits = search.matching(_papers(s, d), "ti:the OR ti:la OR ti:der").select("doc_id", "base_id", *PAPER_FIELDS)
    return content.read(content.with_rendering(hits, *corpus.renderings_of_pages(s, d)), 0, 400)


query("search_then_read", f"WITH {RB}, sliced AS (SELECT *, length(body) AS b, 0::bigint AS st, substring(body, 1, 400) AS part FROM bodies WHERE {sql.has('ti', 'the')} OR {sql.has('ti', 'la')} OR {sql.has('ti', 'der')}) {_PAGE}")(flagship)

# --- requests and responses -----------------------------------------------------------

_ENC = "replace(replace(url_encode({}), '%3A', ':'), '%2C', ',')"
for _c, _p in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
    _ENC = f"replace({_ENC}, '{_c}', '{_p}')"
query("api_url", f"WITH {P} SELECT doc_id, 'https://x.org/query?search_query=' || {_ENC.format(chr(40) + chr(39) + 'ti:(' + chr(39) + ' || title || ' + chr(39) + ')*!~ a,b & c' + chr(39) + chr(41))} || '&start=' || (doc_id % 50) || '&max_results=10' AS url FROM papers")(
    lambda s, d: _papers(s, d).select("doc_id", T.api_url("https://x.org", {"search_query": F.concat(F.lit("ti:("), "title", F.lit(")*!~ a,b & c")), "start": F.col("doc_id") % 50, "max_results": F.lit(10)}).alias("url"))
)
query("query_validate", "SELECT doc_id, length(t) BETWEEN 1 AND 1000 AND NOT contains(t, chr(1)) AS valid FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN doc_id % 5 = 0 THEN chr(1) ELSE '' END AS t FROM documents)")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.valid_query(F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit("\x01")).otherwise(F.lit("")))).alias("valid"))
)
_STATUSES = "list_value(200, 204, 301, 400, 404, 429, 500, 503)[event_id % 8 + 1]"
_TYPES = "list_value('application/atom+xml', 'text/html', 'application/xml; charset=utf-8', 'text/plain', 'TEXT/XML')[event_id % 5 + 1]"
_BODIES = "CASE WHEN event_id % 3 = 0 THEN 'Rate exceeded.' ELSE props END"
query("status_classify", f"""SELECT *, outcome = 'ServiceUnavailable' AS retried FROM (SELECT event_id, substring({_BODIES}, 1, 500) AS preview, CASE WHEN NOT xml AND {_BODIES} LIKE '%Rate exceeded%' THEN 'RateLimited' WHEN NOT xml THEN 'SerializationError' WHEN st BETWEEN 200 AND 299 THEN 'Ok' WHEN st BETWEEN 500 AND 599 THEN 'ServiceUnavailable' WHEN st = 429 THEN 'RateLimited' ELSE 'InvalidRequest' END AS outcome
FROM (SELECT *, {_STATUSES} AS st, event_id % 5 IN (0, 2, 4) AS xml FROM events))""")(lambda s, d: _responses(s, d))


def _responses(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    events = s.read.parquet(f"{d}/events.parquet")
    body = F.when(i % 3 == 0, F.lit("Rate exceeded.")).otherwise(F.col("props"))
    outcome = T.classify_response(pick([200, 204, 301, 400, 404, 429, 500, 503], 8), pick(["application/atom+xml", "text/html", "application/xml; charset=utf-8", "text/plain", "TEXT/XML"], 5), body)
    return events.select("event_id", F.substring(body, 1, 500).alias("preview"), outcome.alias("outcome")).withColumn("retried", T.is_transient(F.col("outcome")))


_NOW = 1_705_881_600_000  # 2024-01-22T00:00:00Z
_VALUES = ["0", "2", " 60 ", "Mon, 22 Jan 2024 00:00:09 GMT", "Sun, 21 Jan 2024 23:59:00 GMT", "soon", ""]
query("retry_after", "SELECT event_id, ms AS wait_ms, least(greatest(coalesce(ms, 5000), 0), 30000)::bigint AS cooldown_ms FROM (SELECT event_id, list_value(0, 2000, 60000, 9000, 0, NULL, NULL)[event_id % 7 + 1]::bigint AS ms FROM events)")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", T.retry_after_ms(F.element_at(F.array(*[F.lit(v) for v in _VALUES]), (F.col("event_id") % 7 + 1).cast("int")), F.lit(_NOW).cast("bigint")).alias("wait_ms")).withColumn("cooldown_ms", T.cooldown_ms(F.col("wait_ms")))
)


def _arrivals(s: SparkSession, d: str) -> DataFrame:
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), t.alias("t"), "event_type", "user_id")


_Q = """SELECT id, g + max(t - g) OVER (ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS dispatched, g + max(t - g) OVER (ORDER BY t, id ROWS UNBOUNDED PRECEDING) - t AS waited
FROM (SELECT *, coalesce(sum(gap) OVER (ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS g FROM (SELECT event_id AS id, epoch_us(ts) // 1000 AS t, {} AS gap FROM events {}))"""
_done = lambda df: df.select("id", "dispatched", "waited")
query("queue_dispatch", _Q.format("300000", ""))(lambda s, d: _done(queue.dispatch(_arrivals(s, d), F.lit(300_000))))
query("queue_cooldown", _Q.format("CASE WHEN event_type = 'error' THEN 900000 ELSE 100000 END", ""))(lambda s, d: _done(queue.dispatch(_arrivals(s, d), queue.gaps(F.col("event_type") == "error", 100_000, F.lit(900_000)))))
query("queue_cancelled", _Q.format("300000", "WHERE event_type <> 'signup'"))(lambda s, d: _done(queue.dispatch(_arrivals(s, d).where("event_type <> 'signup'"), F.lit(300_000))))
_QU = _Q.replace("ORDER BY t, id", "PARTITION BY u ORDER BY t, id").replace("SELECT event_id AS id", "SELECT user_id AS u, event_id AS id")
query("queue_by_user", _QU.format("86400000", ""))(lambda s, d: _done(queue.dispatch(_arrivals(s, d), F.lit(86_400_000), ["user_id"])))

# --- feeds ------------------------------------------------------------------------------

_ENTRY = '<entry><id>http://arxiv.org/abs/{0}</id><title> A  title\n{0} </title><summary>Text.</summary><published>2024-01-22T00:00:00Z</published><updated>2024-01-22T00:00:00Z</updated><author><name>Alice</name></author><author><name>Bob</name></author><category term="cs.AI"/><category term="cs.LG"/>{1}</entry>'
_FEED = '<feed xmlns:opensearch="o" xmlns:arxiv="a"><opensearch:totalResults>{1}</opensearch:totalResults><opensearch:startIndex>0</opensearch:startIndex>{0}</feed>'
_RICH = '<arxiv:primary_category term="cs.LG"/><arxiv:comment>10 pages</arxiv:comment><link href="http://x/pdf" title="pdf" rel="related"/><link href="http://x/abs" rel="alternate"/>'
FEEDS = [_FEED.format(_ENTRY.format("2401.12345v1", _RICH), 1), _FEED.format("", 0), _FEED.format(_ENTRY.format("2401.99999v1", "") + _ENTRY.format("2401.00007v2", _RICH), 2), "not a feed"]


@query("atom_parse", """SELECT * FROM (VALUES (1, '2401.12345v1', 'A title 2401.12345v1', 'Alice, Bob', 'cs.LG', 'cs.AI, cs.LG', '10 pages', 'http://x/pdf', 'http://x/abs'),
(2, '2401.99999v1', 'A title 2401.99999v1', 'Alice, Bob', 'cs.AI', 'cs.AI, cs.LG', NULL, 'https://arxiv.org/pdf/2401.99999v1', 'https://arxiv.org/abs/2401.99999v1'),
(2, '2401.00007v2', 'A title 2401.00007v2', 'Alice, Bob', 'cs.LG', 'cs.AI, cs.LG', '10 pages', 'http://x/pdf', 'http://x/abs')) t(total_results, id, title, authors, primary_category, categories, comment, pdf_url, abstract_url)""".replace("(1,", "(1::bigint,").replace("(2,", "(2::bigint,"))
def atom_parse(s: SparkSession, d: str) -> DataFrame:
    papers = corpus.read_feeds(s.createDataFrame([(x,) for x in FEEDS], "xml string"))
    return papers.select("total_results", "id", "title", F.array_join("authors", ", ").alias("authors"), "primary_category", F.array_join("categories", ", ").alias("categories"), "comment", "pdf_url", "abstract_url")


def _feeds(s: SparkSession, d: str) -> DataFrame:
    """A feed of one entry for each paper; every seventh is an answer of another kind. Optional elements are left out where null."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    element = lambda tag, c: F.coalesce(F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")), F.lit(""))
    each = lambda xs, before, after: F.array_join(F.transform(xs, lambda x: F.concat(F.lit(before), x, F.lit(after))), "")
    i = F.col("doc_id")
    entry = F.concat(
        element("id", F.concat(F.lit("http://arxiv.org/abs/"), "id")),
        element("title", F.concat(F.lit("\n  "), escaped(F.col("title")))), element("summary", F.concat(escaped(F.col("abstract")), F.lit(" \n"))),
        each("authors", "<author><name>", "</name></author>"), each("categories", '<category term="', '"/>'),
        element("published", F.col("published")), element("updated", F.col("updated")),
        F.when(i % 5 != 0, F.concat(F.lit('<arxiv:primary_category term="'), "primary_category", F.lit('"/>'))).otherwise(F.lit("")),
        element("arxiv:comment", F.col("comment")), element("arxiv:journal_ref", escaped(F.col("journal_ref"))), element("arxiv:doi", F.col("doi")),
        F.when(i % 3 == 0, F.concat(F.lit('<link href="http://x/'), i, F.lit('" title="pdf" rel="related"/>'))).otherwise(F.lit("")),
    )
    feed = F.concat(F.lit('<feed xmlns:opensearch="o" xmlns:arxiv="a"><opensearch:totalResults>'), i % 50 + 1, F.lit("</opensearch:totalResults><opensearch:startIndex>0</opensearch:startIndex><entry>"), entry, F.lit("</entry></feed>"))
    return _papers(s, d).select(F.when(i % 7 != 0, F.col("base_id")).alias("base_id"), F.when(i % 7 == 0, F.lit("Rate exceeded.")).otherwise(feed).alias("xml"))


query("atom_documents", f"""WITH {P} SELECT (doc_id % 50 + 1)::bigint AS total_results, id, trim(title) AS title, abstract, array_to_string(authors, ', ') AS authors, primary_category, array_to_string(categories, ', ') AS categories, published, updated, comment, journal_ref, doi,
CASE WHEN doc_id % 3 = 0 THEN 'http://x/' || doc_id ELSE pdf_url END AS pdf_url, abstract_url FROM papers WHERE doc_id % 7 <> 0""")(
    lambda s, d: corpus.read_feeds(_feeds(s, d)).select("total_results", "id", "title", "abstract", F.array_join("authors", ", ").alias("authors"), "primary_category", F.array_join("categories", ", ").alias("categories"), "published", "updated", "comment", "journal_ref", "doi", "pdf_url", "abstract_url")
)
query("resource_list", "SELECT 'corpus://categories' AS uri, 'Categories' AS name, 'application/json' AS mime_type")(lambda s, d: s.createDataFrame([("corpus://categories", "Categories", "application/json")], "uri string, name string, mime_type string"))

from folio.plans import corpora  # noqa: E402, F401  its queries are registered when it is imported
