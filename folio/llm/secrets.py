"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong patterns report by themselves. Weak candidates (short access
identifiers, high-entropy strings, endpoints) mean nothing alone: they are
joined within a scope, and reported only where complementary parts co-occur:
an identifier with a secret, or a secret with an endpoint. The interval join
cuts a document into bins as wide as the scope; a part meets the nearest
parts of its own and the two neighbouring bins, so no list of all pairs of a
document is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, documents, span_digest
from folio.llm.spans import found_if, free_of, in_order, kinds

#: Fixed patterns of the contract.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?)([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Weak parts, of our own.
WEAK_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,15}+(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]++"
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
#: Which parts make a credential together; a strong part may complete a weak one.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
SCOPE = 400


def _row_values(text: Column) -> dict[str, Column]:
    # The pattern keeps group 2 after its head; group 2 of 6 characters or more.
    assign = found_if(text.rlike(r"[:=]"), text, ASSIGN)
    long_enough = lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 6
    return {
        "assign": F.filter(assign, long_enough),
        "access": found_if(text.contains("AKIA"), text, ACCESS),
        "hex": found_if(text.rlike(r"[0-9a-f]{24}"), text, HEX),
        "weak_id": found_if(text.rlike(r"A(?:KIA|SIA|IDA|ROA)[A-Z0-9]{8}"), text, WEAK_ID),
        "weak_secret": found_if(text.rlike(r"[A-Za-z0-9+/]{32}"), text, WEAK_SECRET),
        "endpoint": found_if(text.contains("://"), text, ENDPOINT),
    }


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts of (doc_id, text_key, kind, start, end) with a complementary part within scope characters.

    All parts but the weak one itself count. Distance is between starts.
    """
    role = reduce(lambda w, k: w.when(F.col("kind") == k, F.lit(ROLE[k])), KINDS[1:], F.when(F.col("kind") == KINDS[0], F.lit(ROLE[KINDS[0]])))
    parts = parts.withColumn("role", role).withColumn("bin", F.floor(F.col("start") / scope))
    bins = parts.groupBy("doc_id", "text_key", "role", "bin").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    bins = bins.select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key"), F.col("role").alias("b_role"), "lo", "hi", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("b_bin"))
    weak = parts.where(F.col("kind").isin("weak_id", "weak_secret", "endpoint"))
    complement = ((F.col("role") == "secret") & F.col("b_role").isin("id", "endpoint")) | (F.col("role").isin("id", "endpoint") & (F.col("b_role") == "secret"))
    # The nearest start of a bin before is its last, of a bin behind its first; of the own bin any is near enough.
    near = F.when(F.col("start") > F.col("hi"), F.col("start") - F.col("hi")).when(F.col("start") < F.col("lo"), F.col("lo") - F.col("start")).otherwise(0) <= scope
    return weak.join(bins, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")) & (F.col("bin") == F.col("b_bin")) & complement & near, "left_semi").select("doc_id", "text_key", "kind", "start", "end")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all), n_linked.

    Null and empty texts have no spans; repeated rows give repeated results;
    equal spans of two kinds are both reported; an empty table gives none.
    Work is linear in a text's matches; ids must be numbers.
    """
    rows = documents(docs).withColumn("text_key", F.xxhash64("text"))
    rows = rows.select("doc_id", "text_key", *[kinds(v, k).alias(k) for k, v in _row_values(F.col("text")).items()])
    strong = in_order(F.concat("assign", "access", "hex"), KINDS)
    weak = F.concat("weak_id", "weak_secret", "endpoint")
    # A weak part inside a strong span is the same find.
    outside = F.when(F.size(weak) > 0, free_of(weak, F.concat("assign", "access", "hex"))).otherwise(weak)
    rows = rows.select("doc_id", "text_key", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), strong.alias("base"), outside.alias("weak"))
    rows = cut(rows)  # spans alone; they are read three times
    parts = rows.where(F.size("weak") > 0).select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("s")).select("doc_id", "text_key", "s.kind", "s.start", "s.end").distinct()
    linked = _linked(parts, scope).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    linked = linked.select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"), "linked")
    # Few documents have weak parts: the others need no join.
    with_parts = rows.where(F.size("weak") > 0).join(linked, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")), "left").drop("l_id", "l_key")
    none = F.lit(None).cast("array<struct<kind:string,start:long,end:long>>")
    out = rows.where(F.size("weak") == 0).withColumn("linked", none).unionByName(with_parts)
    linked_ = F.coalesce("linked", F.array().cast("array<struct<kind:string,start:long,end:long>>"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"), span_digest(in_order(F.concat("base", linked_), KINDS)).alias("spans"), F.size(linked_).cast("long").alias("n_linked"))
