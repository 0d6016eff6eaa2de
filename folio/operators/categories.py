"""The taxonomy: listing, grouping, membership and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing(categories: DataFrame, group: str | None = None) -> DataFrame:
    return categories if group is None else categories.where(F.col("grp") == group)


def grouped(categories: DataFrame) -> DataFrame:
    """grp, first (place of its first category), n, codes in order."""
    codes = F.transform(F.sort_array(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"])
    return categories.groupBy("grp").agg(F.min("ord").alias("first"), F.count("*").alias("n"), codes.alias("codes"))


def header(categories: DataFrame) -> DataFrame:
    counts = categories.agg(F.count("*").alias("total"), F.count_distinct("grp").alias("groups"), F.min("grp").alias("g"))
    one = F.concat(F.lit("Showing "), F.col("total"), F.lit(' categories in group "'), F.col("g"), F.lit('":'))
    return counts.select("total", "groups", F.when(F.col("groups") == 1, one).otherwise(F.concat(F.lit("Showing "), F.col("total"), F.lit(" categories across "), F.col("groups"), F.lit(" groups:"))).alias("header"))


def as_text(categories: DataFrame) -> DataFrame:
    """The whole listing as one text; the taxonomy is a constant of 155 rows."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "code", "name"))), lambda x: F.concat(x["code"], F.lit(" — "), x["name"]))
    sections = categories.groupBy("grp").agg(F.min("ord").alias("first"), F.concat(F.lit("## "), F.col("grp"), F.lit("\n"), F.array_join(lines, "\n")).alias("section"))
    body = sections.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "section"))), lambda x: x["section"]), "\n\n").alias("body"))
    return header(categories).crossJoin(body).select(F.concat("header", F.lit("\n\n"), "body").alias("text"))


def valid(probes: DataFrame, categories: DataFrame) -> DataFrame:
    return probes.join(categories.select("code"), probes["probe"] == F.col("code"), "left_semi")


def suggestions(probes: DataFrame, categories: DataFrame, limit: int = 5) -> DataFrame:
    """probe, kind (prefix or distance), rank, code: categories of the probe's archive, else the nearest by edit distance.

    Every distinct probe meets the 155 rows of the taxonomy, a constant, and
    keeps limit of them.
    """
    p = probes.select(F.col("probe"), F.lower(F.trim("probe")).alias("typed")).where("typed <> ''").distinct()
    met = p.crossJoin(F.broadcast(categories.select("ord", "code")))
    archive, code = F.substring_index("typed", ".", 1), F.lower("code")
    near = met.withColumn("same", (archive != "") & (code.startswith(F.concat(archive, F.lit("."))) | (code == archive))).withColumn("distance", F.levenshtein("typed", code))
    best = lambda keep, first: F.slice(F.array_sort(F.collect_list(F.when(keep, F.struct(first.alias("k"), F.col("ord").alias("ord"), F.col("code").alias("code"))))), 1, limit)
    per = near.groupBy("probe").agg(best(F.col("same"), F.lit(0)).alias("by_prefix"), best(F.lit(True), F.col("distance")).alias("by_distance"))
    chosen = per.select("probe", F.when(F.size("by_prefix") > 0, F.lit("prefix")).otherwise(F.lit("distance")).alias("kind"), F.posexplode(F.when(F.size("by_prefix") > 0, F.col("by_prefix")).otherwise(F.col("by_distance"))).alias("rank", "s"))
    return chosen.select("probe", "kind", "rank", "s.code")


def rejections(probes: DataFrame, categories: DataFrame, limit: int = 5) -> DataFrame:
    """Probes that aren't in the taxonomy, with the message a user gets."""
    bad = probes.select("probe").distinct().join(categories.select("code"), F.col("probe") == F.col("code"), "left_anti")
    hints = suggestions(bad, categories, limit).groupBy("probe").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]), ", ").alias("codes"))
    hint = F.coalesce(F.concat(F.lit(" Did you mean: "), F.col("codes"), F.lit("?")), F.lit(" Use list_categories to list valid codes."))
    return bad.join(hints, "probe", "left").select("probe", F.concat(F.lit("Unknown category '"), F.col("probe"), F.lit("'."), hint).alias("message"))
