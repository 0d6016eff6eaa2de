"""The conversation trie against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import trie  # noqa: E402

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, seq string, depth string, node string"


def plain(rows, every=1, heads=1):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - c % every, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        below = [out[c] for c in children[k]]
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(built[c]) == len(k))
        out[k] = (min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), sum(b[5] for b in below) or 1, own_saved + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.prefix_trie(df, **options).select(COLUMNS).collect()), key=repr)


def made(seed=4):
    r = random.Random(seed)
    turn = lambda: (r.choice(["user", "assistant", "", None]), r.choice(["a", "b", "é😀", "", None, "long " * 9]))
    rows = []
    for c in range(60):
        rows += [(c, t if r.random() < 0.9 else None, *turn()) for t in range(r.randint(1, 7))]
    shared = [turn() for _ in range(40)]
    for c in range(100, 130):  # copies and near copies, deep; some are beginnings of others
        n = r.randint(30, 40)
        rows += [(c, t, *x) for t, x in enumerate(shared[:n] + ([turn()] if c % 3 else []))]
    rows += [(200, 1, "user", "same")] * 3 + [(201, 1, "user", "same"), (None, 1, "user", "lost"), (-7, 0, "user", "minus"), (205, None, None, None)]
    return rows


@pytest.mark.parametrize("every, heads, local", [(1, 1, 100), (5, 9, 20_000), (5, 9, 60)])
def test_against_plain(spark, every, heads, local):
    rows = made()
    assert run(spark, rows, every=every, heads=heads, local=local) == plain(rows, every, heads)


def test_large_groups_of_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(3000) for t in range(2)] + [(5000, t, "user", f"u{t % 7}") for t in range(4000)]
    assert run(spark, rows, local=50) == plain(rows)


def test_empty_table_texts_and_turnless(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []
    df = spark.createDataFrame([(1, 1, "user", "a", "", "", ""), (2, 1, "user", "a", "", "", ""), (2, 2, None, "b", "", "", "")], SCHEMA)
    got = sorted((r["conv_id"], r["depth"], r["role"], r["text"]) for r in trie.prefix_trie(df, texts=True).collect())
    assert got == [(1, 0, None, None), (1, 1, "user", "a"), (2, 2, "", "b")]
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)  # its base isn't there, its own turns are skipped
    assert run(spark, [(c, 1, "user", "x")], every=5, heads=9) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_quicksort_of_a_deep_bucket():
    items = [(c, 1, f"e{c}", [(7, 1)] * (c + 1)) for c in range(3000)]
    found = trie.quicksort(items, 1, -1)
    assert len(found) == 3000 and found[0][:7] == [0, 1, -1, 3000, 1, 1, sum(range(3000))]
