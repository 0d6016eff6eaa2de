"""Column expressions over renderings: cutting the head, cleaning, slicing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names that mark the structure of a paper.
STRUCTURAL = "section|subsection|subsubsection|paragraph|subparagraph|appendix|bibliography|abstract|acknowledgements?|title|part|chapter"


def strip_head(h: Column) -> Column:
    """From the article, else the main division, else behind the head and a body tag in its next 200 characters."""
    article = F.regexp_instr(h, F.lit(r"(?i)<article\b[^>]*>"))
    main = F.regexp_instr(h, F.lit(r'(?i)<div\s+class="ltx_page_main"'))
    head = F.locate("</head>", h)
    rest = F.substring(h, head + 7, F.length(h))
    body = F.length(F.regexp_extract(F.substring(rest, F.lit(1), F.lit(200)), r"(?i)^\s*<body[^>]*>", 0))
    return F.when(article > 0, F.substring(h, article, F.length(h))).when(main > 0, F.substring(h, main, F.length(h))).when(head > 0, F.substring(rest, body + 1, F.length(h))).otherwise(h)


def strip_noise(h: Column) -> Column:
    """Generated classes go unless they mark structure, ids go, runs of breaks become one."""
    no_class = F.regexp_replace(h, rf'(?i)\s+class="(?!(?-i)[^"]*\bltx_(?:{STRUCTURAL})\b)ltx_[^"]*"', "")
    no_id = F.regexp_replace(no_class, r'(?i)\s+id="[^"]*"', "")
    return F.regexp_replace(no_id, r"(?i)(?:<br\s*/?>\s*){2,}", "<br>\n")


def piece(text: Column, start: Column, size: Column) -> Column:
    return F.substring(text, start.cast("int") + 1, size.cast("int"))


def truncated(start: Column, part: Column, body: Column) -> Column:
    return start + F.length(part) < F.length(body)
