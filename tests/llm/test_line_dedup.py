import random
import re

import pytest

pytest.importorskip("folio.llm.line_dedup")

from folio.llm.line_dedup import MAX_LINES, MIN_WORDS, dedup_lines, line_report  # noqa: E402

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(rows):
    """All runs with enough words (or lines), in order; those seen before go."""
    seen, out, places = set(), {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        full = [(k, SPACE.sub(" ", x).strip().lower(), len([w for w in SPACE.split(x) if w])) for k, x in enumerate(lines)]
        full = [x for x in full if x[2]]
        gone = set()
        for a in range(len(full)):
            for b in range(a + 1, min(len(full), a + 2 * MAX_LINES) + 1):
                run = full[a:b]
                if sum(x[2] for x in run) >= MIN_WORDS or len(run) >= MAX_LINES:
                    key = tuple(x[1] for x in run)
                    if key in seen and places[key] != (i, a):
                        gone |= {x[0] for x in run}
                    elif key not in seen:
                        seen.add(key)
                        places[key] = (i, a)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_against_plain_version(spark):
    r = random.Random(4)
    line = lambda n: " ".join(r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(n))
    pool = [line(n) for n in (60, 20, 20, 20, 30, 5, 5, 5, 12, 49, 50, 51)]
    shared = [line(3) for _ in range(10)]
    rows = []
    for i in range(40):
        parts = [line(r.randint(1, 15)) for _ in range(r.randint(0, 3))]
        at = r.randrange(len(pool))
        parts += pool[at : at + r.randint(1, 4)] + [line(4)]
        if i % 5 == 0:
            parts += shared[: r.randint(6, 10)] + ["", line(2)]
        rows.append((i, "\n".join(parts)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "\n".join([pool[0].upper()] * 3)), (94, " ".join(["w"] * 5000))]
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars long, lines string").repartition(3)
    got = {x["doc_id"]: x for x in dedup_lines(df).collect()}
    want = plain(rows)
    assert {i: (x["text"] or "") for i, x in got.items()} == want
    assert all(got[i]["n_chars"] == len(want[i]) for i, _ in rows) and got[90]["text"] is None
    assert sum(want[i] != (t or "") for i, t in rows) > 15
    report = {x["doc_id"]: x["n_bytes_kept"] for x in line_report(df).collect()}
    assert report == {i: len(want[i].encode()) for i in want}


def test_awkward_tables(spark):
    schema = "doc_id long, text string"
    assert line_report(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(1, "w " * 60), (1, "w " * 60), (None, None)], schema)
    assert sorted(x["n_bytes_kept"] for x in line_report(same).collect()) == [0, 120, 120]
