import itertools
import random

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("folio.llm.chat")

from folio.llm import chat  # noqa: E402
from folio.llm.common import cut  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def best_path(model, blocks):
    """All paths of one conversation, scored one by one; the best."""
    e, step = chat._emissions(model, blocks), np.array(model["next"])
    score = lambda p: model["first"][p[0]] + sum(e[i][r] for i, r in enumerate(p)) + sum(step[a][b] for a, b in zip(p, p[1:]))
    return max(itertools.product(range(3), repeat=len(blocks)), key=score)


def test_split_viterbi_finds_the_best_path(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    r = random.Random(2)
    rows = [(c, t, r.choice(chat.ROLES), " ".join("x" * r.randint(1, 4) for _ in range(r.choice([2, 9, 40]))) + r.choice(["", "?"])) for c in range(6) for t in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    chunks = chat.chunked(df).cache()
    model = chat.train(chunks)
    got = {}
    for x in chat.parse(chunks, model).collect():
        got.setdefault(x["conv_id"], {})[x["turn"]] = x["role"]
    whole = {}
    for x in chunks.collect():
        assert len(x["blocks"]) <= 3
        whole.setdefault(x["conv_id"], []).extend(x["blocks"])
    for conv, blocks in whole.items():
        blocks = sorted(blocks, key=lambda b: b["turn"])
        assert [got[conv][b["turn"]] for b in blocks] == [chat.ROLES[k] for k in best_path(model, blocks)]


def test_one_conversation_over_many_parts(spark, monkeypatch):
    """Turns without numbers or with equal ones in one conversation: parts and chunks stay small, no transition is lost."""
    monkeypatch.setattr(chat, "CHUNK", 4)
    r = random.Random(5)
    rows = [(None, r.choice([None, 7, i]), r.choice(chat.ROLES), f"{'w ' * r.randint(1, 30)}{i % 50}") for i in range(600)]
    rows += rows[:20] + [(1, 0, "user", "a")] * 30
    # Small ranges would be put together at run time.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = cut(chat.chunked(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = chunks.collect()
    assert sum(len(x["blocks"]) for x in got) == len(rows) and max(len(x["blocks"]) for x in got) <= 4
    assert len({x["part"] for x in got if x["conv_id"] is None}) > 1
    lists = {}
    for x in sorted(got, key=lambda x: (x["part"], x["chunk"])):
        lists.setdefault(x["conv_id"], []).extend(x["blocks"])
    turns = [-1 if b["turn"] is None else b["turn"] for b in lists[None]]
    assert turns == sorted(turns)
    model = chat.train(chunks)
    first, step = np.full(3, 0.5), np.full((3, 3), 0.5)
    for blocks in lists.values():
        roles = [chat.ROLES.index(b["role"]) for b in blocks]
        first[roles[0]] += 1
        for a, b in zip(roles, roles[1:]):
            step[a, b] += 1
    assert np.allclose(model["first"], np.log(first / first.sum())) and np.allclose(model["next"], np.log(step / step.sum(axis=1, keepdims=True)))
    # The same texts in one list, by Viterbi from end to end.
    want = []
    for conv, blocks in lists.items():
        whole = [{"start": (np.array(model["first"]) + chat._emissions(model, b)[0]).tolist(), "steps": chat._matrix(model, b).ravel().tolist()} for b in ([x] for x in blocks)]
        want += [(conv, b["turn"], chat.ROLES[k]) for b, k in zip(blocks, chat._ends(whole))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((x["conv_id"], x["turn"], x["role"]) for x in chat.parse(chunks, model).collect()), key=key) == sorted(want, key=key)


def test_no_block_is_parsed_by_a_model_that_saw_its_label(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.format_conversations(df).withColumnRenamed("role", "found")
    joined = df.join(got, ["conv_id", "turn"])
    assert joined.count() == df.count()
    assert joined.where("role = found").count() >= 0.85 * df.count()


def test_held_out_accuracy(spark):
    table = pd.read_parquet("/root/testdata/sf0.01/conversations.parquet")
    df = spark.createDataFrame(table)
    model = chat.train(chat.chunked(df.where("conv_id % 2 = 0")))
    held = df.where("conv_id % 2 = 1")
    got = chat.parse(chat.chunked(held.drop("role")), model).withColumnRenamed("role", "found")
    joined = held.join(got, ["conv_id", "turn"])
    assert joined.count() == held.count()
    assert joined.where("role = found").count() >= 0.85 * joined.count()


def test_raw_transcripts_with_markers(spark):
    text = "System: be brief\nUser: what is x?\nAssistant: it is\ny and z.\n\nHuman: thanks"
    blocks = chat.blocks_of_transcripts(spark.createDataFrame([(1, text), (2, None)], "conv_id long, text string"))
    labelled = spark.createDataFrame([(c, t, r, f"{r}: {'w ' * n}") for c in range(20) for t, (r, n) in enumerate([("system", 3), ("user", 5), ("assistant", 6), ("user", 2)])], SCHEMA)
    out = sorted((x["turn"], x["role"], x["rendered"]) for x in chat.parse(chat.chunked(blocks), chat.train(chat.chunked(labelled))).collect())
    assert [r for _, r, _ in out] == ["system", "user", "assistant", "user"]
    assert out[2][2] == "<|assistant|>\nit is\ny and z.\n<|end|>"


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (None, 0, "user", "a"), (1, 0, "other", ""), (1, 0, "user", "b"), (1, 0, "user", "b")]
    assert len(chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()) == 5
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
