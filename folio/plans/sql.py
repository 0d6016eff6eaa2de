"""The same results in plain SQL, to hold the queries against."""

from __future__ import annotations

from folio import schema

_SPACE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
q = lambda s: "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


CODES = "[" + ", ".join(q(c[1]) for c in schema.CATEGORIES) + "]"
CATS = "cats(ord, code, name, grp) AS (VALUES " + ", ".join(f"({o}, {q(c)}, {q(n)}, {q(g)})" for o, c, n, g in schema.CATEGORIES) + ")"
_BASE_ID = "'24' || lpad(({0} % 12 + 1)::varchar, 2, '0') || '.' || lpad({0}::varchar, 5, '0')"
_DAY = "strftime(date '2020-01-01' + (({0})::int), '%Y-%m-%d') || 'T00:00:00Z'"
_N = len(schema.CATEGORIES)
PAPERS = f"""papers AS (
  SELECT *, {q(schema.PDF_URL)} || id AS pdf_url, {q(schema.ABSTRACT_URL)} || id AS abstract_url FROM (
    SELECT d.doc_id, {_BASE_ID.format("d.doc_id")} AS base_id, {_BASE_ID.format("d.doc_id")} || 'v' || (d.doc_id % 3 + 1) AS id,
      substring({squeeze("split_part(text, chr(10), 1)")}, 1, 120) AS title,
      ['Author ' || (d.doc_id % 97), 'Author ' || (d.doc_id % 31)] AS authors, {squeeze("text")} AS abstract,
      {CODES}[d.doc_id % {_N} + 1] AS primary_category,
      CASE WHEN d.doc_id % {_N} = (d.doc_id * 7 + 3) % {_N} THEN [{CODES}[d.doc_id % {_N} + 1]]
           ELSE [{CODES}[d.doc_id % {_N} + 1], {CODES}[(d.doc_id * 7 + 3) % {_N} + 1]] END AS categories,
      {_DAY.format("(d.doc_id * 37) % 1500")} AS published, {_DAY.format("(d.doc_id * 37) % 1500 + d.doc_id % 5")} AS updated,
      CASE WHEN d.doc_id % 4 <> 0 THEN n_chars || ' characters' END AS comment,
      CASE WHEN quality = 1 THEN 'Journal ' || source END AS journal_ref,
      CASE WHEN toxic = 0 THEN '10.1234/' || d.doc_id END AS doi
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""


def words(x: str) -> str:
    return rf"' ' || trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


TEXTS = {"ti": "title", "au": "array_to_string(authors, ' ')", "abs": "abstract", "co": "comment", "jr": "journal_ref"}


def has(field: str, phrase: str) -> str:
    return f"contains({words(TEXTS[field])}, ' {phrase} ')"


def in_cat(code: str) -> str:
    return f"len(list_filter(categories, lambda c: lower(c) = '{code.lower()}')) > 0"


def anywhere(phrase: str, code: str | None = None) -> str:
    return "(" + " OR ".join([*(has(f, phrase) for f in TEXTS), in_cat(code or phrase)]) + ")"


def hits(field: str, phrase: str) -> str:
    text, sought = f"replace({words(TEXTS[field])}, ' ', '  ')", " " + phrase.replace(" ", "  ") + " "
    return f"((length({text}) - length(replace({text}, '{sought}', ''))) // {len(sought)})"


def points(field: str, phrase: str) -> str:
    if field == "all":
        return " + ".join(points(f, phrase) for f in TEXTS)
    return f"{3 if field == 'ti' else 1} * {hits(field, phrase)}"


FIELDS = ", ".join(schema.PAPER_FIELDS)
ORDERS = {"submitted": "published", "updated": "updated"}


def page(where: str, score: str = "0", by: str = "relevance", order: str = "descending", start: int = 0, n: int = 10) -> str:
    turn = "DESC" if order == "descending" else "ASC"
    keys = f"{ORDERS[by]} {turn}, id" if by in ORDERS else f"{score} {turn}, published DESC, id"
    return f"WITH {PAPERS} SELECT * FROM (SELECT row_number() OVER (ORDER BY {keys}) AS rank, id, title, published, updated FROM papers WHERE {where}) WHERE rank > {start} AND rank <= {start + n}"


def paper_text(p: str = "") -> str:
    day = lambda x: f"nullif(split_part({x}, 'T', 1), '')"
    cats = "array_to_string(list_filter(list_concat([primary_category], list_filter(categories, lambda c: c <> primary_category)), lambda c: c <> ''), ', ')"
    dates = f"CASE WHEN {day('published')} <> {day('updated')} THEN {day('published')} || ' (updated ' || {day('updated')} || ')' ELSE coalesce({day('published')}, {day('updated')}) END"
    meta = f"array_to_string(list_filter(['arXiv:' || id, {cats}, {dates}], lambda c: c IS NOT NULL AND c <> ''), ' | ')"
    lines = f"['**' || title || '**', {meta}, array_to_string(authors, ', '), '', abstract, chr(10) || 'Comment: ' || nullif(comment, ''), 'Journal: ' || nullif(journal_ref, ''), 'DOI: ' || nullif(doi, ''), 'Published: ' || published || ' | Updated: ' || updated, 'Abstract: ' || abstract_url, 'PDF: ' || pdf_url]"
    return f"array_to_string(list_filter({lines}, lambda c: c IS NOT NULL), chr(10))"


_NOISY = """replace(replace(replace(html, '<p>', '<p class="ltx_para" id="p1">'), '<h1>', '<h1 class="ltx_title ltx_title_section" id="h">'), '</p>', '</p><br class="ltx_break"/><br/>')"""
RENDERINGS = f"""native AS (SELECT {_BASE_ID.format("page_id")} AS base_id, CASE WHEN page_id % 11 = 0 THEN 503 WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status, {_NOISY} AS html FROM pages WHERE page_id % 3 <> 0),
mirror AS (SELECT {_BASE_ID.format("page_id")} AS base_id, CASE WHEN page_id % 13 = 0 THEN 307 ELSE 200 END AS status, {_NOISY} AS html FROM pages WHERE page_id % 3 <> 1),
rendered AS (SELECT p.*, CASE WHEN n.status BETWEEN 200 AND 299 THEN 'arxiv_html' WHEN n.status >= 500 THEN NULL WHEN m.status BETWEEN 200 AND 299 THEN 'ar5iv' END AS source,
  CASE WHEN n.status BETWEEN 200 AND 299 THEN n.html WHEN n.status >= 500 THEN NULL WHEN m.status BETWEEN 200 AND 299 THEN m.html END AS html,
  CASE WHEN n.status BETWEEN 200 AND 299 THEN NULL WHEN n.status >= 500 THEN 'unavailable' WHEN m.status BETWEEN 200 AND 299 THEN NULL WHEN m.status >= 500 THEN 'unavailable' ELSE 'html_unavailable' END AS error
  FROM papers p LEFT JOIN native n ON p.base_id = n.base_id LEFT JOIN mirror m ON p.base_id = m.base_id)"""


def head_cut(h: str) -> str:
    article = rf"regexp_extract({h}, '(?is)<article\b[^>]*>')"
    main = rf"""regexp_extract({h}, '(?i)<div\s+class="ltx_page_main"')"""
    rest = f"substring({h}, instr({h}, '</head>') + 7)"
    return rf"""CASE WHEN {article} <> '' THEN substring({h}, instr({h}, {article})) WHEN {main} <> '' THEN substring({h}, instr({h}, {main}))
      WHEN instr({h}, '</head>') > 0 THEN substring({rest}, 1 + length(regexp_extract(substring({rest}, 1, 200), '(?i)^\s*<body[^>]*>'))) ELSE {h} END"""


def noise_cut(b: str) -> str:
    # No lookahead here: structural classes are marked first.
    tok = "ltx_(?:section|subsection|subsubsection|paragraph|subparagraph|appendix|bibliography|abstract|acknowledgements?|title|part|chapter)"
    marked = rf"""regexp_replace({b}, '(\s+)([cC][lL][aA][sS][sS])="([lL][tT][xX]_[^"]*\b{tok}\b[^"]*|{tok}\b[^"]*)"', '\1\2=' || chr(1) || '"\3"', 'g')"""
    stripped = rf"""regexp_replace(regexp_replace({marked}, '(?i)\s+class="ltx_[^"]*"', '', 'g'), '(?i)\s+id="[^"]*"', '', 'g')"""
    return rf"""replace(regexp_replace({stripped}, '(?i)(?:<br\s*/?>\s*)' || '{{2,}}', '<br>' || chr(10), 'g'), chr(1), '')"""


BODIES = f"""bodies AS (SELECT *, {noise_cut("raw")} AS body FROM (SELECT *, {head_cut("html")} AS raw FROM rendered WHERE html IS NOT NULL))"""


def number(x: str) -> str:
    """With separators between thousands."""
    return f"format('{{:,}}', ({x})::bigint)"
