"""Batch lookup by identifier, and the resource form of one paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import render
from folio.functions.text import strip_version
from folio.schema import PAPER_FIELDS


def _requests(requests: DataFrame) -> DataFrame:
    """ord, id, key of the requested identifiers, whatever their version."""
    return requests.select("ord", F.col("id").alias("requested"), strip_version(F.col("id")).alias("key"))


def _keyed(papers: DataFrame) -> DataFrame:
    return papers.withColumn("_key", strip_version(F.col("id")))


def found(papers: DataFrame, requests: DataFrame) -> DataFrame:
    """Papers asked for, once each, with the place (ord) of the first request."""
    wanted = _requests(requests).groupBy("key").agg(F.min("ord").alias("ord"))
    return _keyed(papers).join(wanted, F.col("_key") == F.col("key")).select("ord", *PAPER_FIELDS)


def missing(papers: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests without a paper; repeated requests stay repeated."""
    left = _requests(requests).join(_keyed(papers).select("_key"), F.col("_key") == F.col("key"), "left_anti")
    return left.select("ord", F.col("requested").alias("id"), F.lit("not_in_arxiv").alias("reason"))


def summary(papers: DataFrame, requests: DataFrame) -> DataFrame:
    """requested, succeeded, not_found in one row."""
    base = _requests(requests).join(_keyed(papers).select("_key").distinct(), F.col("_key") == F.col("key"), "left")
    return base.agg(F.count("*").alias("requested"), F.count_distinct("_key").alias("succeeded"), F.count_if(F.col("_key").isNull()).alias("not_found"))


def envelope(papers: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: papers, totalSucceeded, not_found. For requests as few as a user sends at once."""
    got = found(papers, requests).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*PAPER_FIELDS).alias("p")))), lambda x: x["p"]).alias("papers"))
    not_found = F.struct("ord", "id", "reason", F.lit(None).cast("string").alias("detail"))
    rest = missing(papers, requests).agg(F.transform(F.sort_array(F.collect_list(not_found)), lambda x: F.struct(x["id"].alias("id"), x["reason"].alias("reason"), x["detail"].alias("detail"))).alias("not_found"))
    return got.crossJoin(rest).select("papers", F.size("papers").cast("bigint").alias("totalSucceeded"), "not_found")


def as_text(envelopes: DataFrame) -> DataFrame:
    return envelopes.select(render.lookup(F.col("papers"), F.col("not_found")).alias("text"))


def as_json(papers: DataFrame) -> DataFrame:
    """id and the paper as JSON; absent fields are left out."""
    return papers.select("id", F.to_json(F.struct(*PAPER_FIELDS)).alias("json"))


def paper_of_uri(uri: Column) -> Column:
    """The identifier in scheme://paper/identifier, or null."""
    return F.nullif(F.regexp_extract(uri, r"^[a-z]+://paper/(.+)\z", 1), F.lit(""))
