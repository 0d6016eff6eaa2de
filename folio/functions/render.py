"""Text forms of results, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = "\n\n---\n\n"


def _segments(*parts: Column) -> Column:
    return F.array_compact(F.array(*[F.nullif(p, F.lit("")) for p in parts]))


def paper(p: Column) -> Column:
    """One paper (struct) as text."""
    others = F.filter(p["categories"], lambda c: c != p["primary_category"])
    cats = F.array_join(F.filter(F.concat(F.array(p["primary_category"]), others), lambda c: c != ""), ", ")
    day = lambda x: F.nullif(F.split_part(x, F.lit("T"), F.lit(1)), F.lit(""))
    published, updated = day(p["published"]), day(p["updated"])
    dates = F.when(published.isNotNull() & updated.isNotNull() & (published != updated), F.concat(published, F.lit(" (updated "), updated, F.lit(")"))).otherwise(F.coalesce(published, updated))
    meta = F.array_join(_segments(F.concat(F.lit("arXiv:"), p["id"]), cats, dates), " | ")
    line = lambda head, x: F.concat(F.lit(head), F.nullif(x, F.lit("")))
    lines = F.array(
        F.concat(F.lit("**"), p["title"], F.lit("**")), meta, F.array_join(p["authors"], ", "), F.lit(""), p["abstract"],
        line("\nComment: ", p["comment"]), line("Journal: ", p["journal_ref"]), line("DOI: ", p["doi"]),
        F.concat(F.lit("Published: "), p["published"], F.lit(" | Updated: "), p["updated"]),
        F.concat(F.lit("Abstract: "), p["abstract_url"]), F.concat(F.lit("PDF: "), p["pdf_url"]),
    )
    return F.array_join(F.array_compact(lines), "\n")


def search(papers: Column, total: Column, start: Column) -> Column:
    n = F.size(papers)
    past = F.concat(F.lit("Offset "), start, F.lit(" exceeds total results ("), total, F.lit("). Last valid page starts at "), F.greatest(total - 1, F.lit(0).cast("bigint")), F.lit("."))
    none = F.lit("No papers found. Try broader search terms, remove field prefixes (ti:, au:), or check category codes with list_categories.")
    found = F.concat(F.lit("Found "), total, F.lit(" papers (offset "), start, F.lit(", showing "), start + 1, F.lit("-"), start + n, F.lit("):\n\n"), F.array_join(F.transform(papers, paper), RULE))
    return F.when(n > 0, found).when((total > 0) & (start >= total), past).otherwise(none)


def lookup(papers: Column, not_found: Column) -> Column:
    missing = F.transform(not_found, lambda x: F.concat(F.lit("- "), x["id"], F.lit(" ("), x["reason"], F.lit(")"), F.coalesce(F.concat(F.lit(": "), x["detail"]), F.lit(""))))
    parts = F.array(
        F.concat(F.lit("Found "), F.size(papers), F.lit(" of "), F.size(papers) + F.size(not_found), F.lit(" papers.")),
        F.when(F.size(papers) > 0, F.array_join(F.transform(papers, paper), RULE)),
        F.when(F.size(not_found) > 0, F.concat(F.lit("\nNot found:\n"), F.array_join(missing, "\n"))),
    )
    return F.array_join(F.array_compact(parts), "\n\n")


def notice(start: Column, size: Column, body: Column) -> Column:
    """The line that tells which part of a body is shown, or null."""
    n = lambda x: F.format_number(x, 0)
    end = start + size
    shown = lambda head, tail: F.concat(F.lit(head), n(start), F.lit("–"), n(end - 1), F.lit(" of "), n(body), F.lit(" body characters"), tail)
    return (
        F.when((start >= body) & (body > 0), F.concat(F.lit("[Offset "), n(start), F.lit(" is past end of body ("), n(body), F.lit(" characters). Use start=0 to read from the beginning.]")))
        .when(end < body, shown("[Truncated: showing chars ", F.concat(F.lit(". Call again with start="), end, F.lit(" to continue.]"))))
        .when(start > 0, shown("[Showing chars ", F.lit(" (final chunk).]")))
    )


def content(c: Column) -> Column:
    head = F.concat(F.lit("arXiv:"), c["paper_id"], F.lit(" | Source: "), c["source"], F.lit(" | Raw HTML: "), c["total_characters"], F.lit(" chars | Body: "), c["body_characters"], F.lit(" chars"), F.when(c["truncated"], F.lit(" (truncated)")).otherwise(F.lit("")))
    lines = F.array(F.concat(F.lit("# "), c["title"]), head, F.concat(F.lit("Abstract: "), c["abstract_url"]), F.concat(F.lit("PDF: "), c["pdf_url"]), F.concat(F.lit("\n"), notice(c["start"], F.length(c["content"]), c["body_characters"])), F.lit(""), c["content"])
    return F.array_join(F.array_compact(lines), "\n")
