"""Packing: pieces against the library, whole results, and packings as good as plain best fit and its bound."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import bpe, packing  # noqa: E402

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, gid string, piece long")


def held(rows, capacity):
    """Pieces fill their sequences without gaps or overlaps."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(TOKENIZER), random.Random(6)
    word = lambda: "".join(r.choice("thinesoaré你İΣ🙂") if r.random() < 0.03 else r.choice("thineso") for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", "'s", "42", " <|endoftext|> "])
    texts = [None, "", " \n", "one", "q" * 3000, *[" ".join(word() for _ in range(r.randint(0, 120))) for _ in range(80)], "la " * 20_000, " ".join(word() for _ in range(31))]
    rows = [(i if i % 9 else 7, t) for i, t in enumerate(texts)] + [(None, "null id"), (7, "one"), (7, "one")]
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            own = ids[k : k + 64]
            want[i, k // 64, k, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))] += 1
    for group in (packing.GROUP, 16):
        out = packing.pack(frame(spark, rows).repartition(3), TOKENIZER, capacity=64, group=group).collect()
        assert Counter(tuple(r)[:5] for r in out) == want
        used, tokens = held(out, 64), sum(r["length"] for r in out)
        assert used <= -(-tokens // 64) * 1.1 + 2
    assert packing.pack(frame(spark, []), TOKENIZER).collect() == []


def test_evolution_keeps_every_item_and_meets_the_bound():
    r = random.Random(3)
    for lengths, capacity in (([r.randint(1, 100) for _ in range(300)], 100), ([60] * 40 + [45] * 30, 100), ([r.choice([34, 33, 51, 26, 23]) for _ in range(200)], 100), ([5], 10)):
        found, solved = packing.evolve(lengths, [], capacity, 20, 6, 1)
        plain = packing.fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, [], [], capacity)
        for p in found:
            assert sorted(i for b in p.bins for i in b) == list(range(len(lengths)))
            assert all(sum(lengths[i] for i in b) + f == capacity for b, f in zip(p.bins, p.free))
        bound = packing.lower_bound(lengths, capacity)
        assert bound <= len(found[0].bins) <= len(plain.bins) and solved == (len(found[0].bins) == bound)
    assert packing.lower_bound([60] * 40 + [45] * 30, 100) == 40 + 14  # two of 45 make 90: the sum of what is beside the large ones counts


def test_crossover_injects_whole_bins():
    r, lengths = random.Random(1), [r for r in range(10, 60)]
    a, b = (packing.evolve(lengths, [], 100, 0, 2, s)[0][-1] for s in (1, 2))
    child = packing.crossover(a, b, lengths, 100, r)
    assert sorted(i for x in child.bins for i in x) == list(range(len(lengths)))
    assert sum(sorted(x) in [sorted(y) for y in a.bins] for x in child.bins) >= 1


def test_islands_and_levels(spark):
    r = random.Random(9)
    sizes = [r.choice([501, 334, 667, 251, 126, 999, 500]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "gid long, length long")
    rows = packing.places(df, 1000, group=64).collect()
    assert sorted(x["gid"] for x in rows) == list(range(700))
    used = held([{"sequence_id": x["sequence_id"], "offset": x["offset"], "length": sizes[x["gid"]]} for x in rows], 1000)
    whole = packing.fit(sorted(range(700), key=lambda i: -sizes[i]), sizes, [], [], 1000)
    assert used <= len(whole.bins) + 3


def test_ids_in_blocks_are_the_encoders():
    own = packing.chunk_ids(TOKENIZER)
    for text in ("Hello, World's 42nd é <|endoftext|> x", "İΣ 你好", "a" * 5000):
        got = b"".join(own.blocks(text))
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == bpe.load(TOKENIZER).encode(text)
