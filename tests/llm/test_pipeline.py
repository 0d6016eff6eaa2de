import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from folio.llm import quality  # noqa: E402
from tests.llm import brute  # noqa: E402
from tests.llm.test_line_dedup import plain  # noqa: E402

SF = "/root/testdata/sf0.01"


def keep_rules(rows):
    """rows: id, text, host. The rules over Python lists."""
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower())
    words = lambda x: len(brute.WORD.findall(x))
    hosts, seen = defaultdict(set), Counter()
    for _, t, h in rows:
        if t not in hosts[h]:
            hosts[h].add(t)
            seen.update({(h, norm(x)) for x in t.split("\n") if words(x)})
    out = []
    for i, t, h in rows:
        hot = {x for x in t.split("\n") if seen[h, norm(x)] > max(quality.MIN_DOCS, quality.MIN_SHARE * len(hosts[h]))}
        gone, n = sum(words(x) for x in t.split("\n") if x in hot), words(t)
        if not brute.quality(t)[5] and not (gone and (n - gone < n * quality.KEPT_SHARE or n - gone < quality.MIN_WORDS)):
            out.append((i, "\n".join(x for x in t.split("\n") if x not in hot)))
    return out


def test_whole_pipeline(spark, tmp_path):
    table = pd.read_parquet(f"{SF}/documents.parquet").head(400)
    table.loc[:149, "source"] = "one"
    table.loc[:59, "text"] = "All rights are reserved by the owner of this page.\n" + table.text[:60]
    table.to_parquet(tmp_path / "documents.parquet")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    bench.to_parquet(tmp_path / "benchmark.parquet")
    rows = keep_rules(list(zip(table.doc_id, table.text, table.source)))
    rows = list(plain(rows).items())
    parent = {}
    sets = [(i, brute.shingles(t, 5)) for i, t in rows]
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for k, (a, sa) in enumerate(sets):
        for b, sb in sets[:k]:
            if sa and sb and 100 * len(sa & sb) >= 80 * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    rows = [(i, t) for i, t in rows if find(i) == i]
    found = brute.contamination(rows, list(zip(bench.item_id, bench.text)))
    rows = [(i, t) for i, t in rows if not found[i][4]]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    want = {i: brute.sha(" ".join(map(str, library.encode(t, add_special_tokens=False).ids))) for i, t in rows}
    got = {x["doc_id"]: x["ids_sha256"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 200 < len(got) < 400 and got == want
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert first.columns == list(table.columns)
