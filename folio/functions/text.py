"""Column expressions over identifiers, text and feed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.schema import ABSTRACT_URL, PDF_URL, PHYSICS

_SPACE = r"[\s   -     　﻿]+"


#: A white-space run that isn't a single space already, which most are. Printable ASCII is told apart before the long class is looked at.
_ANY = f"[[^!-~]&&{_SPACE[:-1]}]"
_TO_SQUEEZE = f"[[^ -~]&&{_SPACE[:-1]}]{_ANY}*| {_ANY}+"


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, _TO_SQUEEZE, " "))


def extract_id(x: Column) -> Column:
    return F.regexp_replace(x, r"^https?://arxiv\.org/abs/", "")


def strip_version(x: Column) -> Column:
    return F.regexp_replace(x, r"v\d+\z", "")


def five_digits(number: Column) -> Column:
    """At least five digits; longer numbers stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0"))


def group_of(code: Column) -> Column:
    archive = F.substring_index(code, ".", 1)
    return F.when(archive.isin(PHYSICS), F.lit("physics")).otherwise(archive)


def optional(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def primary_category(primary: Column, terms: Column) -> Column:
    return F.coalesce(primary, F.get(terms, F.lit(0)), F.lit(""))


def first_link(links: Column, field: str, value: str, default: Column) -> Column:
    return F.coalesce(F.get(F.filter(links, lambda x: x[field] == value), F.lit(0))["_href"], default)


def abstract_url(links: Column, paper_id: Column) -> Column:
    return first_link(links, "_rel", "alternate", F.concat(F.lit(ABSTRACT_URL), paper_id))


def pdf_url(links: Column, paper_id: Column) -> Column:
    return first_link(links, "_title", "pdf", F.concat(F.lit(PDF_URL), paper_id))


def encode_parameter(x: Column) -> Column:
    """Percent-encoding that leaves colons and commas readable."""
    out = F.url_encode(x)
    for coded, plain in (("+", "%20"), ("%3A", ":"), ("%2C", ","), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def api_url(base: str, parameters: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f"{name}="), encode_parameter(value.cast("string"))) for name, value in parameters.items()]
    return F.concat(F.lit(f"{base}/query?"), F.concat_ws("&", *parts))


def valid_query(x: Column) -> Column:
    """Trimmed, 1 to 1000 characters, no control characters but tab, line feed and carriage return."""
    trimmed = F.regexp_replace(F.regexp_replace(x, "^" + _SPACE, ""), _SPACE + r"\z", "")
    return F.coalesce(F.length(trimmed).between(1, 1000) & trimmed.rlike(r"^[^\x00-\x08\x0B\x0C\x0E-\x1F]*\z"), F.lit(False))


def classify_response(status: Column, content_type: Column, body: Column) -> Column:
    """The content type is looked at first, then the status."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    is_xml = kind.contains("application/xml") | kind.contains("text/xml") | kind.contains("application/atom+xml")
    return (
        F.when(~is_xml & F.coalesce(body, F.lit("")).contains("Rate exceeded"), F.lit("RateLimited"))
        .when(~is_xml, F.lit("SerializationError"))
        .when(status.between(200, 299), F.lit("Ok"))
        .when(status.between(500, 599), F.lit("ServiceUnavailable"))
        .when(status == 429, F.lit("RateLimited"))
        .otherwise(F.lit("InvalidRequest"))
    )


def is_transient(outcome: Column) -> Column:
    return outcome.isin("ServiceUnavailable", "Timeout")


COOLDOWN_CAP_MS, COOLDOWN_DEFAULT_MS = 30_000, 5_000


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Seconds, or a date (as in HTTP), to milliseconds from now; null if neither."""
    v = F.trim(value)
    bare = F.regexp_replace(v, r"^[A-Za-z]{3}, | GMT\z", "")
    at = F.unix_millis(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss")))
    return F.when(v.rlike(r"^\d{1,15}\z"), v.try_cast("bigint") * 1000).when(at.isNotNull(), F.greatest(at - now_ms, F.lit(0).cast("bigint")))


def cooldown_ms(wait_ms: Column) -> Column:
    wait = F.coalesce(wait_ms, F.lit(COOLDOWN_DEFAULT_MS).cast("bigint"))
    return F.least(F.greatest(wait, F.lit(0).cast("bigint")), F.lit(COOLDOWN_CAP_MS).cast("bigint"))
