"""Columns whose names an operator might use itself come through unchanged."""

import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import decontam, line_dedup, ngram_join, pii, quality  # noqa: E402

NAMES = ["_id", "_key", "_tk", "_text_key", "_bad_id", "_gone", "_left", "_host", "_copy_id", "id", "row", "text_key", "gone", "g_id", "w_id", "a.b", "h", "n", "token"]


@pytest.mark.parametrize("stage", ["rules", "lines", "near", "clean", "sanitise"])
def test_other_columns_stay(spark, stage):
    line = "one two three four five six seven eight nine ten eleven twelve"
    texts = [f"{line} {i}\nmore words of document number {i} with a mail x{i}@y.org in it, and others {i * 7}" for i in range(6)] + [None]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c}-{i}" for c in NAMES]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in NAMES))
    bench = spark.createDataFrame([(1, "not in any of these documents at all")], "item_id long, text string")
    run = {"rules": quality.apply_rules, "lines": line_dedup.dedup_lines, "near": ngram_join.keep_first, "clean": lambda d: decontam.clean(d, bench), "sanitise": pii.sanitise}[stage]
    out = run(docs)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    found = {r["doc_id"]: r for r in out.collect()}
    assert len(found) >= (6 if stage == "rules" else 1)
    for i, r in found.items():
        assert list(r)[5:] == [f"{c}-{i}" for c in NAMES] and r["lang"] == "en"


def test_lines_between_the_removed_ones(spark):
    from pyspark.sql import functions as F

    from folio.llm.common import without_lines

    cases = [("a\nb\nc", [0]), ("a\nb\nc", [1]), ("a\nb\nc", [2]), ("a\nb\nc", [0, 1, 2]), ("\na\n\n", [1]), ("x", [0])]
    df = spark.createDataFrame(cases, "t string, g array<int>")
    got = [r[0] for r in df.select(without_lines(F.col("t"), F.col("g"))).collect()]
    assert got == ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in cases]
