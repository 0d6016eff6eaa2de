"""Single facts about the catalogue's calls, on small hand-made tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from folio import schema
from folio.engine import CatalogueError, Config, Engine
from folio.functions import html, render
from folio.functions import text as T
from folio.operators import categories as cat
from folio.operators import content, queue
from folio.plans.query import Term, parse
from folio.sources import corpus
from folio.streaming.queue import dispatch_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def text_of(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).head()["x"]


PAPER = ("2401.12345v1", "Attention in Graphs", ["Alice", "Bob"], "Text about experts.", "cs.CL", ["cs.AI", "cs.CL"], "2024-01-22T00:00:00Z", "2024-01-23T00:00:00Z", "10 pages", None, None, "https://arxiv.org/pdf/2401.12345v1", "https://arxiv.org/abs/2401.12345v1", "2401.12345")
OTHER = ("2401.00001v2", "Mixture models", ["Carol"], "Mixture of experts.", "math.ST", ["math.ST"], "2023-01-01T00:00:00Z", "2023-01-01T00:00:00Z", None, "Nature 2024", "10.1/x", "p", "a", "2401.00001")


@pytest.fixture(scope="module")
def engine(spark):
    papers = spark.createDataFrame([PAPER, OTHER], schema.PAPER + ", base_id string")
    native = spark.createDataFrame([("2401.12345", 404, "gone")], "base_id string, status int, html string")
    mirror = spark.createDataFrame([("2401.12345", 200, "<html><head></head><body>" + "abcdefghij" * 10)], "base_id string, status int, html string")
    return Engine(spark, papers, native, mirror)


def test_taxonomy(spark):
    assert len(schema.CATEGORIES) == len(schema.CODES) == 155
    assert [sum(c[3] == g for c in schema.CATEGORIES) for g in schema.GROUPS] == [40, 3, 4, 32, 51, 10, 9, 6]
    table = corpus.categories(spark)
    assert [tuple(r) for r in table.orderBy("ord").collect()] == schema.CATEGORIES
    assert cat.header(cat.listing(table, "econ")).head()["header"] == 'Showing 3 categories in group "econ":'


def test_suggestions(spark):
    probes = spark.createDataFrame([("cs.INVALID",), ("",), ("foo.BAR",)], "probe string")
    out = cat.rejections(probes, corpus.categories(spark)).collect()
    found = {r["probe"]: r["message"] for r in out}
    assert found["cs.INVALID"] == "Unknown category 'cs.INVALID'. Did you mean: cs.AI, cs.AR, cs.CC, cs.CE, cs.CG?"
    assert "Did you mean" in found["foo.BAR"] and found[""].endswith("Use list_categories to list valid codes.")


def test_parser():
    t = Term
    assert parse("mixture of experts") == ("AND", ("AND", t("all", "mixture"), t("all", "of")), t("all", "experts"))
    assert parse('au:bengio AND ti:"deep nets" ANDNOT cat:cs.AI') == ("ANDNOT", ("AND", t("au", "bengio"), t("ti", "deep nets")), t("cat", "cs.AI"))
    assert parse("ti:(a OR b) c") == ("AND", ("OR", t("ti", "a"), t("ti", "b")), t("all", "c"))
    assert parse("a OR b AND c") == ("OR", t("all", "a"), ("AND", t("all", "b"), t("all", "c")))
    for bad in ("", "(a", "a)", "a AND", "()"):
        with pytest.raises(ValueError):
            parse(bad)


def test_search(engine):
    row = engine.search("experts").head()
    assert (row["total_results"], [p["id"] for p in row["papers"]]) == (2, ["2401.12345v1", "2401.00001v2"])
    assert engine.search("mixture", sort_by="submitted").head()["total_results"] == 1
    assert engine.search("experts", category="cs.AI").head()["papers"][0]["id"] == PAPER[0]
    assert engine.search("journal ANDNOT nature").head()["total_results"] == 0
    assert engine.search_text("experts", start=5).head()["text"] == "Offset 5 exceeds total results (2). Last valid page starts at 1."
    assert engine.search_text("zzz").head()["text"].startswith("No papers found.")
    with pytest.raises(CatalogueError, match="Did you mean: cs.") as e:
        engine.search("x", category="cs.INVALID")
    assert e.value.reason == "unknown_category"
    for bad in ({"query": " "}, {"query": "x" * 1001}, {"query": "a\x01"}, {"query": "a", "max_results": 51}, {"query": "a", "start": -1}, {"query": "a", "sort_by": "date"}):
        with pytest.raises(ValueError):
            engine.search(**bad)


def test_top_k_plan(engine):
    from folio.operators.search import page

    plan = page(engine.papers, "experts", sort_by="submitted", start=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_lookup(engine):
    row = engine.get_metadata(["2401.12345", "9999.99999", "9999.99999"]).head()
    assert (row["totalSucceeded"], [x["id"] for x in row["not_found"]]) == (1, ["9999.99999"] * 2)
    assert engine.metadata_text(["2401.12345", "9999.99999"]).head()["text"].endswith("\n\n\nNot found:\n- 9999.99999 (not_in_arxiv)")
    with pytest.raises(CatalogueError) as e:
        engine.get_metadata("9999.99999")
    assert e.value.reason == "no_match"
    for bad in ([], [""], ["1"] * 11):
        with pytest.raises(ValueError):
            engine.get_metadata(bad)


def test_read(engine):
    row = engine.read_paper("2401.12345v2", max_characters=20, start=30).head()
    assert (row["content"], row["truncated"], row["source"], row["body_characters"]) == ("abcdefghij" * 2, True, "ar5iv", 100)
    assert engine.read_paper("2401.12345", 50, 50).head()["truncated"] is False
    assert engine.read_paper("2401.12345", start=9999).head()["content"] == ""
    with pytest.raises(CatalogueError, match="/pdf/2401.00001") as e:
        engine.read_paper("2401.00001")
    assert e.value.reason == "html_unavailable"


def test_server_error_is_no_reason_for_the_mirror(spark, engine):
    native = spark.createDataFrame([("2401.12345", 503, "")], "base_id string, status int, html string")
    row = content.with_rendering(engine.papers, native, engine.mirror).where("base_id = '2401.12345'").head()
    assert (row["source"], row["error"]) == (None, "unavailable")


def test_resources(engine):
    assert json.loads(engine.resource("corpus://paper/2401.12345").head()["json"])["comment"] == "10 pages"
    listed = json.loads(engine.resource("corpus://categories").head()["json"])["categories"]
    assert len(listed) == 155 and listed[0] == {"code": "cs.AI", "name": "Artificial Intelligence", "group": "cs"}
    with pytest.raises(ValueError):
        engine.resource("corpus://else")
    engine.register()
    assert engine.spark.sql("SELECT count(*) AS n FROM papers p JOIN categories c ON p.primary_category = c.code").head()["n"] == 2


def test_heads(spark):
    cut = lambda v: text_of(spark, html.strip_head, v)
    assert cut("<html><body>Paper content</body></html>") == "<html><body>Paper content</body></html>"
    assert cut("a<ARTICLE class='x'>b") == "<ARTICLE class='x'>b" and cut("a<article2>b") == "a<article2>b"
    assert cut('x<div  class="ltx_page_main">y') == '<div  class="ltx_page_main">y'
    assert cut("<head></head>\n <BODY id='1'>z") == "z" and cut("</HEAD>q") == "</HEAD>q"
    assert cut("</head>" + " " * 250 + "<body>z") == " " * 250 + "<body>z"


def test_noise(spark):
    cut = lambda v: text_of(spark, html.strip_noise, v)
    assert cut('<p class="ltx_text" id="a">x<br class="ltx_break"/>\n<br/>y') == "<p>x<br>\ny"
    kept = '<section class="ltx_section"><h2 class="ltx_title ltx_title_section">'
    assert cut(kept) == kept and cut('<a class="ltx_title_section">') == "<a>" and cut('<a class="ad">') == '<a class="ad">'


def test_notices(spark):
    n = lambda *v: one(spark, render.notice(*[F.lit(x) for x in v]))
    assert n(0, 20_000, 50_000) == "[Truncated: showing chars 0–19,999 of 50,000 body characters. Call again with start=20000 to continue.]"
    assert n(200_000, 50_000, 250_000) == "[Showing chars 200,000–249,999 of 250,000 body characters (final chunk).]"
    assert n(9_999, 0, 50).startswith("[Offset 9,999 is past end of body (50 characters).") and n(0, 50, 50) is None


def test_paper_text(spark):
    empty = spark.createDataFrame([("x", "T", [], "A", "", [], "", "", None, None, None, "p", "a")], schema.PAPER)
    assert empty.select(render.paper(F.struct(*schema.PAPER_FIELDS)).alias("t")).head()["t"].split("\n")[1] == "arXiv:x"
    full = spark.createDataFrame([PAPER[:-1]], schema.PAPER).select(render.paper(F.struct(*schema.PAPER_FIELDS)).alias("t")).head()["t"].split("\n")
    assert full[1] == "arXiv:2401.12345v1 | cs.CL, cs.AI | 2024-01-22 (updated 2024-01-23)" and full[3] == "" and full[6] == "Comment: 10 pages"


def test_feeds(spark):
    bad = spark.createDataFrame([("<feed><entry></feed>",), (None,), ("<html/>",)], "xml string")
    assert [r["ok"] for r in corpus.parse_feed(bad).collect()] == [False, False, False]
    assert corpus.read_feeds(bad).collect() == []


def test_responses(spark):
    kind = lambda *v: one(spark, T.classify_response(F.lit(v[0]), F.lit(v[1]), F.lit(v[2])))
    assert kind(200, "text/plain", "Rate exceeded.") == "RateLimited" and kind(503, "text/html", "x") == "SerializationError"
    assert kind(503, "application/xml", "") == "ServiceUnavailable" and kind(429, "text/xml", "") == "RateLimited" and kind(400, "application/atom+xml", "") == "InvalidRequest"


def test_squeeze(spark):
    assert text_of(spark, T.squeeze, "  a \n﻿ b ") == "a b"
    assert text_of(spark, T.encode_parameter, "ti:a b,(c)'!~*&") == "ti:a%20b,(c)'!~*%26"


def test_queue_against_simulation(spark):
    calls = [(i, (i * 7919) % 5000, i % 4 == 0) for i in range(300)]
    df = spark.createDataFrame(calls, "id long, t long, throttled boolean")
    got = {r["id"]: r["dispatched"] for r in queue.dispatch(df, queue.gaps(F.col("throttled"), 10, F.lit(45)), chunk_ms=400).collect()}
    free, want = -(10**9), {}
    for i, t, hold in sorted(calls, key=lambda c: (c[1], c[0])):
        want[i] = max(free, t)
        free = want[i] + (45 if hold else 10)
    assert got == want


def test_queue_stream(spark, tmp_path):
    name = "queue_out"
    rows = [("h", 1, 0, True, 2000, False), ("h", 2, 5, False, 0, True), ("h", 3, 10, False, 0, False), ("k", 4, 10, False, 0, False)]
    columns = "host string, id long, t long, throttled boolean, cooldown_ms long, cancelled boolean"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    q = dispatch_stream(stream, 100).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        time.sleep(0)
        assert {(r["id"], r["dispatched"]) for r in spark.table(name).collect()} == {(1, 0), (3, 2000), (4, 10)}
    finally:
        q.stop()


def test_config(monkeypatch):
    monkeypatch.setenv("FOLIO_DELAY_MS", "50")
    assert Config.from_env() == Config(delay_ms=50)


def test_other_queries_stand_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "folio", tmp_path / "folio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q) and 'pipeline' not in q and 'op4_token_counts' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
