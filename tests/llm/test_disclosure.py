"""Disclosing terms past the entity's own line: elsewhere in the corpus, on neighbouring lines, and on copied lines."""

import random

import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import pii  # noqa: E402

R = random.Random(6)
FILLER = ["".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(40)]


def line(*x):
    return " ".join([*R.sample(FILLER, 6), *x])


def test_terms_are_spans_wherever_they_stand(spark):
    texts = {i: line("reach", "x") for i in range(100, 300)}
    texts |= {i: line("Zorblax", "reach", "me@here.org") for i in range(4)}
    # On the line before or after, with an empty line between.
    texts |= {10 + i: f"{line()}\n{line('Quimby')}\n\nyou@there.org\n{line()}" for i in range(4)}
    # The same line in other surroundings.
    texts |= {20 + i: f"{line()}\nWrite to Fennimore at they@where.org\n{line()}" for i in range(4)}
    elsewhere = {50: line("zorblax"), 51: f"{line()}\n{line('Quimby')}", 52: f"x\n\nFennimore {line()}"}
    texts |= elsewhere
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}

    def named(i):
        spans = [s.split(":") for s in found[i].split(",") if s]
        return {texts[i][int(a) : int(b)].lower() for k, a, b in spans if k == "term"}

    for i in range(4):
        assert "zorblax" in named(i) and "quimby" in named(10 + i) and "fennimore" in named(20 + i)
    assert [named(i) for i in (50, 51, 52)] == [{"zorblax"}, {"quimby"}, {"fennimore"}]
    assert not any(named(i) for i in range(100, 300))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(name not in clean[i].lower() for i, name in ((50, "zorblax"), (51, "quimby"), (52, "fennimore")))
    assert clean[100] == texts[100]
