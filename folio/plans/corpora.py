"""Queries over feed files, a large vocabulary and two copies of the same texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.versions import version_key
from folio.operators import diff, links, rules, sections, vocabulary
from folio.plans import sql, table_functions
from folio.plans.registry import ORACLE_SQL, RB, P, _feeds, query
from folio.sources import corpus, feed_source, scratch

# --- feed files -----------------------------------------------------------------


def _feed_files(s: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(s, "feeds")
    feed_source.write_feeds(_feeds(s, d), path)
    return feed_source.read_feed_files(s, path)


def _as_papers(feeds: DataFrame) -> DataFrame:
    joined = [F.array_join(c, ", ").alias(c) for c in ("authors", "categories")]
    return corpus.read_feeds(feeds).select("total_results", "id", "title", "abstract", joined[0], "primary_category", joined[1], "published", "updated", "comment", "journal_ref", "doi", "pdf_url", "abstract_url")


#: As many identifiers as one request may ask for; some are of answers that are no feed, one isn't there.
WANTED = [f"24{i % 12 + 1:02d}.{i:05d}" for i in (3, 7, 10, 11, 50, 77, 101, 130, 190, 99_999)]

query("feed_files_scan", ORACLE_SQL["atom_documents"])(lambda s, d: _as_papers(_feed_files(s, d)))
query("feed_files_lookup", ORACLE_SQL["atom_documents"] + f" AND base_id IN ({', '.join(map(repr, WANTED))})")(lambda s, d: _as_papers(_feed_files(s, d).where(F.col("base_id").isin(WANTED))))
query("feed_files_range", f"WITH {P} SELECT base_id, count(*) AS n FROM papers WHERE doc_id % 7 <> 0 AND base_id >= '2403' AND base_id < '2407' GROUP BY base_id")(
    lambda s, d: _feed_files(s, d).where("base_id >= '2403' AND base_id < '2407'").groupBy("base_id").agg(F.count("*").alias("n"))
)

# --- suggestions from a large vocabulary ------------------------------------------

#: A word in so many documents is known; words in one document are sought.
KNOWN = 20


def _suggested(s: SparkSession, d: str) -> DataFrame:
    words = scratch.table(vocabulary.words_of(s.read.parquet(f"{d}/documents.parquet")))
    known = words.where(F.col("n") >= KNOWN).select("word", F.col("n").alias("weight"))
    return vocabulary.nearest(words.where("n = 1").select("word"), known)


query("suggest_words", f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM documents) GROUP BY word),
met AS (SELECT a.word, b.word AS known, b.n, levenshtein(a.word, b.word) AS distance FROM w a, w b WHERE a.n = 1 AND b.n >= {KNOWN} AND abs(length(a.word) - length(b.word)) <= 2)
SELECT word, known, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, known) - 1 AS rank FROM met WHERE distance <= 2) WHERE rank < 3""")(_suggested)

# --- two copies of the same pages ---------------------------------------------------

_BLOCKS = "(</p>|</li>|</div>|<br>)"


def _copies(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Page texts, a numbered block element a line, as two sources have them: each lacks a third of the pages, and of every fourth page the second has lines left out and others changed."""
    pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.transform(F.split(F.regexp_replace("html", _BLOCKS, "$1\n"), "\n"), lambda x, k: F.concat(k.cast("string"), F.lit(" "), x)).alias("lines"))
    i = F.col("page_id")
    changed = F.filter(F.transform("lines", lambda x, k: F.when(k % 7 != 3, F.when(k % 5 == 4, F.concat(x, F.lit(" (mirror)"))).otherwise(x))), lambda x: x.isNotNull())
    text = lambda lines: F.array_join(lines, "\n").alias("text")
    return pages.where(i % 3 != 0).select("page_id", text(F.col("lines"))), pages.where(i % 3 != 1).select("page_id", text(F.when(i % 4 == 0, changed).otherwise(F.col("lines"))))


_COPIES = rf"""lines AS (SELECT page_id, list_transform(string_split(regexp_replace(html, '{_BLOCKS}', '\1' || chr(10), 'g'), chr(10)), lambda x, k: (k - 1) || ' ' || x) AS l FROM pages),
each AS (SELECT page_id, l, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS k FROM lines),
changed AS (SELECT page_id, string_agg(CASE WHEN k % 5 = 4 THEN x || ' (mirror)' ELSE x END, chr(10) ORDER BY k) AS t FROM each WHERE k % 7 <> 3 GROUP BY page_id),
a AS (SELECT page_id, array_to_string(l, chr(10)) AS t FROM lines WHERE page_id % 3 <> 0),
b AS (SELECT l.page_id, CASE WHEN l.page_id % 4 = 0 THEN c.t ELSE array_to_string(l, chr(10)) END AS t FROM lines l LEFT JOIN changed c ON l.page_id = c.page_id WHERE l.page_id % 3 <> 1)"""
query("mirror_diff", f"WITH {_COPIES} SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' WHEN a.t = b.t THEN 'same' ELSE 'drifted' END AS state, sha256(a.t) AS left_sha, sha256(b.t) AS right_sha FROM a FULL JOIN b ON a.page_id = b.page_id")(
    lambda s, d: diff.compare(*_copies(s, d), "page_id", "text")
)
# The SQL knows which lines were left out and changed; the operator finds them from the texts.
query("mirror_line_edits", f"""WITH {_COPIES}, touched AS (SELECT * FROM each WHERE page_id % 3 = 2 AND page_id % 4 = 0)
SELECT page_id::varchar AS key, '-' AS op, (k + 1)::int AS line, x AS content FROM touched WHERE k % 7 = 3 OR k % 5 = 4
UNION ALL SELECT page_id::varchar, '+', (k + 1 - (k + 4) // 7)::int, x || ' (mirror)' FROM touched WHERE k % 7 <> 3 AND k % 5 = 4""")(lambda s, d: diff.line_edits(*_copies(s, d), "page_id", "text"))

# --- rules over lines -----------------------------------------------------------------

RULES = {
    "license": ("license", "[Ll]icense[a-z]*"), "license_name": ("license", "[A-Z][A-Za-z]+ [Ll]icense"), "mail": ("@", "[A-Za-z0-9.]+@[A-Za-z0-9.]+"), "access_key": ("AKIA", "AKIA[A-Z0-9]+"),
    "password": ("password", "password[ :='\"]+[A-Za-z0-9]+"), "address": ("http", "https?://[a-z.]+"),
}
_RULES = "(VALUES " + ", ".join(f"('{name}', '{pattern.replace(chr(39), chr(39) * 2)}')" for name, (_, pattern) in RULES.items()) + ") r(rule, p)"
query("line_findings", f"""SELECT doc_id, line::int AS line, rule, regexp_extract(x, p) AS match FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), {_RULES} WHERE regexp_matches(x, p)""")(
    lambda s, d: rules.findings(s.read.parquet(f"{d}/documents.parquet"), RULES)
)

# --- walks along links ------------------------------------------------------------------

_HOST, _HREF, _TITLE = "^[a-z]+://([^/]+)", 'href="(/[^"]*)"', "<title>([^ <]*)"
STEPS = 3


def _links(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Links from hosts to what their pages link to, and from a title's first word, as a path, to the same. Roots are the hosts."""
    pages = s.read.parquet(f"{d}/pages.parquet")
    out = pages.select(F.regexp_extract("url", _HOST, 1).alias("host"), F.concat(F.lit("/"), F.regexp_extract("html", _TITLE, 1)).alias("title"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("dst"))
    return out.select(F.col("host").alias("src"), "dst").union(out.select("title", "dst")), pages.select(F.regexp_extract("url", _HOST, 1).alias("root"))


def _walked(s: SparkSession, d: str) -> DataFrame:
    return links.walk(*_links(s, d), scratch.table, most=STEPS)


_WALK = f"""RECURSIVE p AS (SELECT regexp_extract(url, '{_HOST}', 1) AS host, '/' || regexp_extract(html, '{_TITLE}', 1) AS title, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS dst FROM pages),
e AS (SELECT host AS src, dst FROM p UNION SELECT title, dst FROM p),
w(root, node, depth) AS (SELECT DISTINCT regexp_extract(url, '{_HOST}', 1), regexp_extract(url, '{_HOST}', 1), 0 FROM pages UNION SELECT root, e.dst, depth + 1 FROM w JOIN e ON w.node = e.src WHERE depth < {STEPS}),
walked AS (SELECT root, node, min(depth)::int AS depth FROM w GROUP BY ALL)"""
query("link_walk", f"WITH {_WALK} SELECT * FROM walked")(_walked)
query("link_reach", f"WITH {_WALK} SELECT root, count(*) - 1 AS n_nodes, max(depth) AS depth FROM walked GROUP BY root")(lambda s, d: links.reach(_walked(s, d)))

# --- sections -------------------------------------------------------------------------

#: Headings that the pages lack, before an advertisement, the lead and the footer.
_ADDED = [('<div class="ad">', '<h3>Notice</h3><div class="ad">'), ("<p><b>", "<h2>Lead</h2><p><b>"), ("<footer>", "<h1>Foot</h1><p>")]


def _pages(s: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    for old, new in _ADDED:
        html = F.replace(html, F.lit(old), F.lit(new))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", html.alias("html"))


_WITH = "html"
for _old, _new in _ADDED:
    _WITH = f"replace({_WITH}, '{_old}', '{_new}')"
_PARTS = f"string_split(regexp_replace({_WITH}, '(?i)<(h[1-6]|p|li)\\b', chr(1) || '<\\1', 'g'), chr(1))"
_LAST = "last_value(CASE WHEN level = {0} THEN {1} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos)"
query("page_sections", rf"""WITH b AS (SELECT page_id, unnest({_PARTS}) AS b, generate_subscripts({_PARTS}, 1) AS pos FROM pages),
c AS (SELECT page_id, pos, try_cast(nullif(regexp_extract(b, '^<[hH]([1-6])', 1), '') AS int) AS level, trim(regexp_replace(regexp_replace(split_part(regexp_replace(b, '(?i)</(h[1-6]|p|li)>', chr(2), 'g'), chr(2), 1), '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS content FROM b WHERE pos > 1),
n AS (SELECT *, count(level) OVER (PARTITION BY page_id ORDER BY pos)::int AS section, {", ".join(f"{_LAST.format(n, 'pos')} AS p{n}, {_LAST.format(n, 'content')} AS h{n}" for n in (1, 2, 3))} FROM c WHERE content <> ''),
p AS (SELECT *, array_to_string(list_filter([h1, CASE WHEN p2 > coalesce(p1, -1) THEN h2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN h3 END], lambda x: x IS NOT NULL), ' > ') AS path FROM n)
SELECT page_id, section, max(level) AS level, max(content) FILTER (level IS NOT NULL) AS heading, max(path) AS path, count(*) FILTER (level IS NULL) AS n_blocks, coalesce(sum(length(content)) FILTER (level IS NULL), 0)::bigint AS n_chars FROM p GROUP BY page_id, section""")(lambda s, d: sections.sections(_pages(s, d)))

# --- SQL table functions ------------------------------------------------------------------


def _called(statement: str):
    """The statement with the catalogue's functions at hand."""

    def run(s: SparkSession, d: str) -> DataFrame:
        papers = corpus.papers_of_documents(s, d)
        table_functions.register(s, papers, corpus.categories(s), *corpus.renderings_of_pages(s, d))
        return s.sql(statement)

    return run


_ASKED = "array(" + ", ".join(f"'{i}v1'" for i in [*WANTED[:8], WANTED[0], WANTED[-1]]) + ")"
_IN = ", ".join(f"({k}, '{i}')" for k, i in enumerate([*WANTED[:8], WANTED[0], WANTED[-1]]))
query("sql_get_metadata", f"WITH {P}, a(place, key) AS (SELECT min(k), i FROM (VALUES {_IN}) v(k, i) GROUP BY i) SELECT place, id, title, doi FROM papers JOIN a ON base_id = key")(_called(f"SELECT place, id, title, doi FROM get_metadata({_ASKED})"))
query("sql_missing_papers", f"WITH {P} SELECT k AS place, i || 'v1' AS id, 'not_in_arxiv' AS reason FROM (VALUES {_IN}) v(k, i) WHERE i NOT IN (SELECT base_id FROM papers)")(_called(f"SELECT * FROM missing_papers({_ASKED})"))
query("sql_read_paper", f"WITH {RB} SELECT id AS paper_id, title, substring(body, 101, 300) AS content, source, 100 + length(substring(body, 101, 300)) < length(body) AS truncated, 100::bigint AS start, length(raw) AS total_characters, length(body) AS body_characters, pdf_url, abstract_url FROM bodies")(
    _called("SELECT r.* FROM papers p, LATERAL read_paper(p.id, 100, 300) r")
)
query("sql_papers_by_group", f"WITH {P}, {sql.CATS} SELECT grp, count(*) AS n FROM papers JOIN cats ON primary_category = code WHERE grp IN ('math', 'econ') GROUP BY grp")(
    _called("SELECT c.grp, count(*) AS n FROM papers p JOIN (SELECT * FROM list_categories('math') UNION ALL SELECT * FROM list_categories('econ')) c ON p.primary_category = c.code GROUP BY c.grp")
)

# --- versions ---------------------------------------------------------------------------

_VERSION_OF = "(doc_id % 3) || '.' || (doc_id % 11) || '.' || (doc_id % 7 + 8) || CASE WHEN doc_id % 4 = 0 THEN '-rc.' || (doc_id % 13) ELSE '' END"


def _versions(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", F.expr(_VERSION_OF).alias("version")).withColumn("key", version_key(F.col("version")))


query("version_newest", f"""SELECT source, version, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY split_part(version, '.', 1)::int DESC, split_part(version, '.', 2)::int DESC, split_part(split_part(version, '-', 1), '.', 3)::int DESC, contains(version, '-'), split_part(version, '-', 2) DESC, doc_id DESC) AS r
FROM (SELECT doc_id, source, {_VERSION_OF} AS version FROM documents)) WHERE r = 1""")(lambda s, d: _versions(s, d).groupBy("source").agg(F.max_by(F.struct("version", "doc_id"), F.struct("key", "doc_id")).alias("x")).select("source", "x.version", "x.doc_id"))
query("version_rank", f"""SELECT doc_id, version, dense_rank() OVER (PARTITION BY source ORDER BY split_part(version, '.', 1)::int DESC, split_part(version, '.', 2)::int DESC, split_part(split_part(version, '-', 1), '.', 3)::int DESC, contains(version, '-'), split_part(version, '-', 2) DESC) AS rank
FROM (SELECT doc_id, source, {_VERSION_OF} AS version FROM documents)""")(lambda s, d: _ranked_versions(_versions(s, d)))


def _ranked_versions(rows: DataFrame) -> DataFrame:
    """The rank of each row's version in its source, newest first. Only distinct versions are ranked, so a source of many rows isn't sorted in one task."""
    own = rows.groupBy("source", "key").agg(F.lit(1)).select(F.col("source").alias("of"), F.col("key").alias("k"))
    ranks = own.select("of", "k", F.dense_rank().over(Window.partitionBy("of").orderBy(F.col("k").desc())).alias("rank"))
    return rows.join(ranks, F.col("source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("k"))).select("doc_id", "version", "rank")
