"""Near matches against a plain version, and passages with a word put in, left out or replaced."""

import random

import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import decontam  # noqa: E402
from tests.llm import brute  # noqa: E402


def common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = best[:]
        for j, y in enumerate(b):
            best[j + 1] = last[j] + 1 if x == y else max(last[j + 1], best[j])
    return best[-1]


def plain(docs, items, window=13, slop=2):
    out = {}
    for i, text in docs:
        w, near, found = (text or "").split(), set(), set()
        for item, t in items:
            v = (t or "").split()
            n = min(window, len(v))
            k = min(slop, (n - 1) // 6)
            for s in range(len(v) - n + 1) if v else ():
                fits = lambda a, b: b - a <= n + k and common(w[a:b], v[s : s + n]) >= n - k  # noqa: B023, E731
                for a in range(len(w)):
                    for b in range(a + n - k, min(a + n + k, len(w)) + 1):
                        if fits(a, b) and not fits(a + 1, b) and not fits(a, b - 1):
                            near |= set(range(a, b))
                            found.add(str(item))
        out[i] = (len(near), len(found), brute.sha(",".join(sorted(found))))
    return out


def collected(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_proximity(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    prose = lambda n: r.choices(vocabulary, k=n)
    items = [(k, " ".join(prose(n))) for k, n in enumerate((39, 20, 13, 9, 4))] + [(90, None), (91, ""), (92, "la " * 15), (93, "ab cd " * 9)]

    def edited(words, kind, step):
        out = []
        for i, w in enumerate(words):
            hit = i % step == step // 2
            out += [w, *prose(1)] if hit and kind == "in" else [] if hit and kind == "out" else prose(1) if hit and kind == "other" else [w]
        return out

    docs = [(0, None), (1, ""), (2, "la " * 20), (3, "ab x cd " * 9), (4, " ".join(prose(80)))]
    for n in range(5):
        for kind in ("same", "in", "out", "other"):
            docs += [(len(docs) + j, " ".join(prose(12) + edited(items[n][1].split(), kind, step) + prose(12))) for j, step in enumerate((12, 5, 3))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    columns = ("n_near", "n_near_items", "near_items_sha256")
    assert collected(decontam.proximity(table, bench), *columns) == want
    assert collected(decontam.proximity(table, bench, terms_per_pass=60), *columns) == want
    exact = collected(decontam.contamination(table, bench), "n_hit")
    # A word in every twelve changed: no exact hit of the longest item, but a near one.
    for i in (8, 11, 14):
        assert exact[i] == (0,) and want[i][0] > 30, i
    assert all(exact[i][0] <= want[i][0] for i in want)
