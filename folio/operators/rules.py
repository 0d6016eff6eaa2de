"""Many patterns over the lines of texts in one pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shared(rules: dict[str, tuple[str, str]]) -> dict[str, list[str]]:
    """Names of rules by the literal that every match of theirs holds."""
    out: dict[str, list[str]] = {}
    for name, (literal, _) in rules.items():
        out.setdefault(literal.lower(), []).append(name)
    return out


def findings(texts: DataFrame, rules: dict[str, tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), rule, match (the first of the rule in the line) for rules of name: (literal, pattern).

    A literal is something that every match holds, whatever its case; patterns
    are regular expressions. A text that holds none of the literals is told by
    one alternation of all of them and goes no further, and so is a line; only
    rules that share a literal found in a line are tried on it. The literals
    are part of the plan, no text meets a table of rules. Null texts have no
    findings; repeated rows give repeated findings.
    """
    if not rules:
        return texts.select(key, F.lit(1).alias("line"), F.lit("").alias("rule"), F.lit("").alias("match")).limit(0)
    any_literal = "(?i)" + "|".join(re.escape(x) for x in sorted(_shared(rules)))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("x"))), lambda s: s["x"].rlike(any_literal))
    some = texts.where(F.col(text).rlike(any_literal)).select(key, F.explode(lines).alias("l")).select(key, "l.line", "l.x")

    def tried(literal: str, names: list[str]) -> Column:
        hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_substr("x", F.lit(rules[n][1])).alias("match")) for n in names])
        return F.when(F.col("x").rlike("(?i)" + re.escape(literal)), F.filter(hits, lambda h: h["match"].isNotNull())).otherwise(F.array().cast("array<struct<rule:string,match:string>>"))

    found = some.select(key, "line", F.explode(F.concat(*[tried(*x) for x in _shared(rules).items()])).alias("f"))
    return found.select(key, "line", "f.rule", "f.match")
