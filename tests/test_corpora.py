"""Feed files as a source, suggestions from a vocabulary, and differences of two copies."""

import random

import pytest

from folio.operators import diff, vocabulary
from folio.plans import corpora
from folio.plans.registry import _feeds
from folio.sources import feed_source, scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark):
    path = scratch.folder(spark, "feeds")
    feed_source.write_feeds(_feeds(spark, SF), path, shards=8)
    return path


def test_filters_reach_the_reader(spark, files):
    every = {r["base_id"]: r["xml"] for r in feed_source.read_feed_files(spark, files, 8).where("base_id is not null").collect()}
    assert len(every) > 100
    for where in (f"base_id = '{corpora.WANTED[0]}'", "base_id in ({})".format(", ".join(map(repr, corpora.WANTED))), "base_id >= '2404' and base_id < '2406.0001'", "base_id like '2402%'", "base_id = 'x'"):
        df = feed_source.read_feed_files(spark, files, 8).where(where)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" in plan and "Filter (" not in plan.replace("PushedFilters", "")
        want = spark.createDataFrame(list(every.items()), "base_id string, xml string").where(where)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_folders_without_wanted_feeds_are_no_partitions(files):
    reader = feed_source.FeedReader({"path": files, "shards": "8"})
    few = feed_source.FeedReader({"path": files, "shards": "8"})
    one = feed_source.EqualTo(("base_id",), corpora.WANTED[0])
    other = feed_source.StringStartsWith(("xml",), "<")
    assert list(few.pushFilters([one, other])) == [other]
    assert len({p.path.split("/")[-2] for p in few.partitions()}) == 1 < len({p.path.split("/")[-2] for p in reader.partitions()})


def test_limits_blocks_and_empty_folders(spark, files):
    assert feed_source.read_feed_files(spark, files, 8, limit=3).count() == 3
    reader = feed_source.FeedReader({"path": files, "shards": "8"})
    from pyarrow import fs

    for part in reader.partitions():
        system = fs.FileSystem.from_uri(files)[0]
        assert list(reader._feeds(system, part.path, 100)) == list(reader._feeds(system, part.path))
    path = scratch.folder(spark, "none")
    feed_source.write_feeds(spark.createDataFrame([], "base_id string, xml string"), path)
    assert feed_source.read_feed_files(spark, path).collect() == []


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_neighbours_against_brute_force(spark, distance):
    r = random.Random(distance)
    word = lambda: "".join(r.choice("abcé😀") for _ in range(r.randint(0, 14)))
    known = {word(): r.randint(1, 3) for _ in range(150)} | {"x" * 9 + w: 1 for w in ("aaaa", "aaab", "aabb", "zaaa")}
    words = {word() for _ in range(80)} | {"x" * 8 + "aaaa", "x" * 9 + "aazz", ""}
    want = set()
    for w in words:
        near = sorted((d, -n, v) for v, n in known.items() if (d := _edits(w, v)) <= distance)
        want |= {(w, v, d, k) for k, (d, _, v) in enumerate(near[:3])}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    table = spark.createDataFrame(list(known.items()), "word string, weight long")
    assert {tuple(x) for x in vocabulary.nearest(df, table, distance).collect()} == want
    assert vocabulary.nearest(df, table.limit(0)).collect() == []


def test_neighbours_send_no_side_whole(spark, tmp_path):
    spark.range(2000).selectExpr("concat('word', id) AS word", "id AS weight").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")  # a few KB, over 50 keys a word
    found = vocabulary.nearest(words.select("word"), words)
    planned = lambda: found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in planned() and "SortMergeJoin" in planned()
    assert found.where("rank = 0 AND word = known AND distance = 0").count() == 2000


def _applied(left, edits):
    gone = {line for op, line, _ in edits if op == "-"}
    kept = [x for k, x in enumerate(left, 1) if k not in gone]
    for line, content in sorted((line, c) for op, line, c in edits if op == "+"):
        kept.insert(line - 1, content)
    return kept


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1]) if x != y else last + 1
    return row[-1]


def test_edit_scripts_make_the_other_text(spark):
    r = random.Random(7)
    pairs = []
    for k in range(60):
        a = [f"line {r.randint(0, 30 if k % 2 else 1000)}" for _ in range(r.randint(0, 25))]
        b = [x for x in a if r.random() < 0.8]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), r.choice(["new", f"new {r.randint(0, 99)}", *(a or ["x"])]))
        pairs.append((str(k), "\n".join(a), "\n".join(b)))
    pairs += [("null", None, "a"), ("same", "a\nb", "a\nb"), ("empty", "", "a\n"), ("moved", "a\nb\nc\nd\ne", "e\na\nb\nc\nd")]
    left = spark.createDataFrame([(k, a) for k, a, _ in pairs] + [("left", "x")], "key string, t string")
    right = spark.createDataFrame([(k, b) for k, _, b in pairs] + [("right", "x")], "key string, t string")
    found = {}
    for x in diff.line_edits(left, right, "key", "t").collect():
        found.setdefault(x["key"], []).append((x["op"], x["line"], x["content"]))
    assert "left" not in found and "right" not in found and "same" not in found
    for k, a, b in pairs:
        a, b = [] if a is None else a.split("\n"), b.split("\n")
        assert _applied(a, found.get(k, [])) == b
        if len(set(a)) == len(a) and k.isdigit() and int(k) % 2 == 0 and len(set(b)) == len(b):
            assert len(found.get(k, [])) == len(a) + len(b) - 2 * _common(a, b)  # no shorter script where lines are unique
    assert len(found["moved"]) == 2


def test_states_of_two_copies(spark):
    side = lambda rows: spark.createDataFrame(rows, "id long, t string")
    got = {r["id"]: r["state"] for r in diff.compare(side([(1, "a"), (2, "b"), (3, None), (5, "x"), (6, None)]), side([(1, "a"), (2, "c"), (3, None), (4, "y"), (6, "")]), "id", "t").collect()}
    assert got == {1: "same", 2: "drifted", 3: "same", 4: "extra", 5: "missing", 6: "drifted"}


def test_rules_against_a_plain_loop(spark):
    import re

    from folio.operators import rules

    texts = [None, "", "no\nLicense here\n", "MIT License, GPL license a@b.c\nAKIAXY12\npassword= x1", "LICENSE\nlicence", "a@b@c\n\nhttp://x.org http://y.org"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, match string")
    want = sorted((i, k, name, m[0]) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"), 1) for name, (_, p) in corpora.RULES.items() if (m := re.search(p, x)))
    assert len(want) >= 7 and sorted(map(tuple, rules.findings(df, corpora.RULES).collect())) == want
    assert rules.findings(df, {}).collect() == [] and rules.findings(df.limit(0), corpora.RULES).collect() == []
    plan = rules.findings(df, corpora.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_walks_end_in_cycles(spark):
    from folio.operators import links

    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "d"), ("x", "x"), (None, "a"), ("d", None), ("y", "d")]
    df = spark.createDataFrame(edges, "src string, dst string")
    roots = spark.createDataFrame([("a",), ("x",), ("a",), ("alone",), (None,)], "root string")
    want = {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "x", 0), ("alone", "alone", 0)}
    found = links.walk(df, roots, scratch.table)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert {tuple(r) for r in links.reach(found).collect()} == {("a", 3, 3), ("x", 0, 0), ("alone", 0, 0)}
    assert {tuple(r) for r in links.walk(df, roots, scratch.table, most=1).collect()} == {x for x in want if x[2] < 2}
    assert links.walk(df, roots.limit(0), scratch.table).collect() == []


def test_sections_stand_under_their_nearest_headings(spark):
    from folio.operators import sections

    page = "<p>before</p><h1>A</h1><p>one <b>two</b></p><h3>deep</h3><li>x<li>y</li><H2 class='k'>B</H2><p> </p><h3>C</h3><p>z</p><h1>D</h1><p>end"
    df = spark.createDataFrame([(1, page, 0), (2, None, 0), (3, "", 0), (4, "<h2>only</h2>", 0), (5, "no blocks", 0)], "page_id long, html string, pos int")
    got = sorted(map(tuple, sections.sections(df).collect()))
    assert got == [
        (1, 0, None, None, "", 1, 6), (1, 1, 1, "A", "A", 1, 7), (1, 2, 3, "deep", "A > deep", 2, 2), (1, 3, 2, "B", "A > B", 0, 0),
        (1, 4, 3, "C", "A > B > C", 1, 1), (1, 5, 1, "D", "D", 1, 3), (4, 1, 2, "only", "only", 0, 0),
    ]


def test_table_functions_give_the_calls_rows(spark):
    from folio.engine import CatalogueError, Engine
    from folio.sources import corpus

    engine = Engine(spark, corpus.papers_of_documents(spark, SF), *corpus.renderings_of_pages(spark, SF))
    engine.register()
    ids = ["2403.00002", "9999.99999", "2401.00000v7", "2403.00002v1"]
    row = engine.get_metadata(ids).head()
    listed = "array(" + ", ".join(map(repr, ids)) + ")"
    found = spark.sql(f"SELECT * FROM get_metadata({listed}) ORDER BY place").collect()
    assert [r["id"] for r in found] == [p["id"] for p in row["papers"]] and [r["title"] for r in found] == [p["title"] for p in row["papers"]]
    assert [(r["id"], r["reason"]) for r in spark.sql(f"SELECT * FROM missing_papers({listed})").collect()] == [(x["id"], x["reason"]) for x in row["not_found"]]
    assert sorted(map(tuple, spark.sql("SELECT * FROM list_categories('econ')").collect())) == sorted(map(tuple, engine.list_categories("econ").collect()))
    assert spark.sql("SELECT * FROM list_categories()").count() == 155
    read = 0
    for paper in engine.papers.select("id").limit(12).collect():
        try:
            want = engine.read_paper(paper["id"], 50, 30).head().asDict()
        except CatalogueError:
            continue
        got = spark.sql(f"SELECT * FROM read_paper('{paper['id']}', 30, 50)").head().asDict()
        assert got == {k: want[k] for k in got}
        read += 1
    assert read >= 3 and spark.sql("SELECT * FROM read_paper('2403.00002', -1, 5)").collect() == []
    plan = spark.sql("SELECT r.* FROM papers p, LATERAL read_paper(p.id, 0, 9) r")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_versions_in_order(spark):
    from pyspark.sql import functions as F

    from folio.functions.versions import version_key

    order = ["0.0.9", "0.1.0-alpha", "0.1.0-beta", "0.1.0", "0.9.0", "0.10.0-rc.1", "0.10.0", "1.0.0", "10.0.0"]
    df = spark.createDataFrame([(v,) for v in [*order[::-1], "", "1.0", "x", None]], "v string").withColumn("k", version_key(F.col("v")))
    assert [r["v"] for r in df.where("k is not null").orderBy("k").collect()] == order and df.where("k is null").count() == 4
