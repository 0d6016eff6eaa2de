"""Numbers of six and seven digits keep identifiers apart."""

from folio.plans import registry
from folio.sources import corpus

LONG = [7, 10005, 100053, 1000000, 1000012, 1000024]


def test_ids_of_long_numbers(spark, tmp_path):
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put([(i, "a title", "s", 7) for i in LONG], "doc_id long, text string, source string, n_chars long", "documents")
    put([(LONG[0], 1, 0)], "doc_id long, quality int, toxic int", "labels")
    put([(i, "<p>x</p>") for i in LONG], "page_id long, html string", "pages")
    put([(k, i) for k, i in enumerate([*LONG, 1000036])], "o_orderkey long, o_custkey long", "orders")
    papers = {r["doc_id"]: r["base_id"] for r in corpus.papers_of_documents(spark, str(tmp_path)).collect()}
    assert len(set(papers.values())) == len(LONG)
    assert papers[7] == "2408.00007" and papers[1000012] == "2405.1000012"
    native, mirror = corpus.renderings_of_pages(spark, str(tmp_path))
    pages = [r["base_id"] for r in native.select("base_id").union(mirror.select("base_id")).distinct().collect()]
    assert sorted(pages) == sorted(papers.values())
    found = registry.QUERIES["lookup_found"](spark, str(tmp_path)).collect()
    assert sorted(r["id"].split("v")[0] for r in found) == sorted(papers.values())
    missing = registry.QUERIES["lookup_missing"](spark, str(tmp_path)).collect()
    assert [r["ord"] for r in missing] == [len(LONG)]
