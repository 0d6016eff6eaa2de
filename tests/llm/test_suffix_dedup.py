import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("folio.llm.suffix_dedup")

from folio.llm import suffix_dedup  # noqa: E402
from folio.llm.common import text_groups  # noqa: E402
from folio.llm.suffix_dedup import dedup_bytes  # noqa: E402
from tests.llm import brute  # noqa: E402


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dedup_bytes(df).collect()}


def test_against_brute_force(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (395, 399, 400, 401, 424, 450, 700, 1500)]
    rows = []
    for i in range(60):
        parts = [word(r.randint(0, 500))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.choice([0, 0, 0, r.randint(0, 60)])
            parts += [p[a : len(p) - r.choice([0, 0, r.randint(0, 60)])], word(r.randint(0, 300))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "z" * 1500), (103, "ab" * 400), (104, rows[3][1]), (105, rows[3][1]), (106, word(399)), (107, passages[2]), (108, "z" * 399 + "y" + "z" * 399)]
    # Chains: strings repeated by different partners side by side.
    chain = word(2000)
    rows += [(200 + k, word(40) + chain[k * 30 : k * 30 + 405] + word(40)) for k in range(20)]
    want = brute.repeats(rows)
    assert sum(v[1] > 0 for v in want.values()) > 40
    assert run(spark, rows) == want


def test_awkward_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, "q" * 500), (1, "q" * 500), (None, "short")])[1][1] == 500


def test_passages_against_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 8)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (50, 51, 52, 60, 90, 200)]
    rows = []
    for i in range(50):
        words = text(r.randint(0, 120))
        for p in r.sample(passages, r.randint(0, 2)):
            words += [*p[r.choice([0, 0, 1, 9]) :], *text(r.randint(0, 60))]
        rows.append((i, "".join(w + r.choice([" ", " ", "\n", " \t"]) for w in words)))
    rows += [(100, None), (101, "x " * 120), (102, rows[3][1]), (103, " ".join(passages[1]))]
    want = brute.passages(rows)
    assert 20 < sum(v > 0 for v in want.values()) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["n_passage_words"] for x in dedup_bytes(df).collect()} == want


def test_long_texts_in_blocks(monkeypatch):
    r = random.Random(13)
    line = "".join(r.choice("abc ") for _ in range(5000)).encode()
    whole = [tuple(map(int, x)) for p in suffix_dedup.anchors(line) for x in zip(*p)]
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 700)
    parts = [tuple(map(int, x)) for p in suffix_dedup.anchors(line) for x in zip(*p)]
    strings = lambda rows: {(h, first + i, most - i) for h, _, most, least, first, _ in rows for i in range(most - least + 1)}
    assert len(parts) > len(whole) and strings(parts) == strings(whole)


def test_five_megabytes_in_one_text(spark):
    r = random.Random(14)
    long = "".join(r.choice("abcdefgh ") for _ in range(5_000_000))
    got = run(spark, [(1, long), (2, long[1_000_000:1_000_500]), (3, "q" * 300)])
    assert [got[i][1:3] for i in (1, 2, 3)] == [(500, 1), (500, 1), (0, 0)]


class Steps:
    """Stands for a table: hands out the function that a step runs in its tasks."""

    def select(self, *_):
        return self

    where = select

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def texts_at_random(seed):
    r = random.Random(seed)
    # No white space where texts meet, empty texts, words and strings that only two texts together would have.
    return [b"", b"", *("".join(r.choice("abc  é") for _ in range(r.choice([0, 1, 30, 399, 400, 401, 900]))).strip().encode() for _ in range(400)), b""]


def test_short_texts_are_hashed_together(monkeypatch):
    made = []

    class Counted(suffix_dedup.ByteHashes):
        def __init__(self, data):
            made.append(len(data))
            super().__init__(data)

    monkeypatch.setattr(suffix_dedup, "ByteHashes", Counted)
    texts = texts_at_random(15)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["doc_id", "text_key", "data"])
    step = suffix_dedup._anchor_rows(Steps(), suffix_dedup.WIDTH, suffix_dedup.GRAM, suffix_dedup.PASSAGE)
    assert sum(b.num_rows for b in step(iter([batch]))) > 400
    assert sum(made) >= sum(map(len, texts)) - 4000 and len(made) < 10


def test_joined_texts_have_the_anchors_of_each():
    texts = texts_at_random(16)
    starts = [sum(map(len, texts[:i])) for i in range(len(texts) + 1)]
    for anchors in (suffix_dedup.anchors, lambda data, bounds=None: suffix_dedup.word_anchors(data, 20, bounds=bounds)):
        each = [(*map(int, x[:4]), int(x[4]) + s, int(x[5]) + s) for t, s in zip(texts, starts) for p in anchors(t) for x in zip(*p)]
        joined = [tuple(map(int, x)) for p in anchors(b"".join(texts), bounds=np.array(starts)) for x in zip(*p)]
        assert len(each) > 400 and joined == each


def test_groups_of_slices():
    texts = [b"ab", b"", b"c" * 50, b"def", b"", b"g" * 9, b"h"]
    column = pa.array([b"skipped", *texts, b"skipped"], pa.binary()).slice(1, len(texts))
    got = list(text_groups(column, 10))
    assert b"".join(g[2].tobytes() for g in got) == b"".join(texts) and [t for i, j, d, b in got for t in (d.tobytes()[x:y] for x, y in zip(b, b[1:]))] == texts
    assert [g[0] for g in got[1:]] == [g[1] for g in got[:-1]] and (got[0][0], got[-1][1]) == (0, len(texts))
    assert all(j == i + 1 or len(d) <= 10 for i, j, d, _ in got)
    assert list(text_groups(pa.array([], pa.binary()))) == [] and [g[:2] for g in text_groups(pa.array([b"", b""], pa.binary()))] == [(0, 2)]


def test_runs_stay_in_their_texts():
    spans = [(0, 0, 5), (0, 5, 9), (2, 0, 3), (2, 4, 6), (0, 20, 30), (2, 5, 8), (3, 0, 2)]
    rows, first, last = (np.array(x) for x in zip(*spans))
    of, begin, end = suffix_dedup._runs(rows, suffix_dedup._span(first, last, True), np.array([30, 0, 8, 2]))
    assert [list(zip(begin[a:b].tolist(), end[a:b].tolist())) for a, b in zip(of, of[1:])] == [[(0, 9), (20, 30)], [], [(0, 3), (4, 8)], [(0, 2)]]
    of, begin, end = suffix_dedup._runs(rows[:0], first[:0], np.array([4, 0]))
    assert of.tolist() == [0, 0, 0] and not len(begin) and not len(end)


def test_repeated_rows_at_borders(spark):
    # The context of a row that stands twice is handed on twice; that alone must not make its strings repeated ones.
    r = random.Random(17)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = text(450)
    rows = [(1, text(300) + shared + text(300)), (2, text(300) + shared[:430] + text(300)), (3, text(300) + shared[20:] + text(300)), (4, text(100) + shared[:399])]
    long = [(9, text(600) + shared[10:445] + text(90))]
    want = brute.repeats(rows + long * 2)
    assert run(spark, rows + long * 2) == want and want[1][1] > 400
