"""Terms against a plain version, on tables with copies, near copies and repeated rows; long texts of many lines."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import line_dedup, pii  # noqa: E402

WORD = re.compile(r"[^\W_]{3,}")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def plain_terms(rows):
    """Disclosing terms for texts whose only entities are e-mail addresses."""
    rows = set(rows)
    n_t, near, seen = Counter(), defaultdict(dict), defaultdict(dict)
    for i, text in rows:
        n_t.update([*(w.lower() for w in WORD.findall(text)), ""])
        mails = [(m.start(), m.end(), m[0].lower()) for m in MAIL.finditer(text)]
        words = [(m.start(), None, m[0].lower()) for m in WORD.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in mails)]
        events = sorted([(a, e, None) for a, _, e in mails] + words, key=lambda x: x[0])
        for k, (_, e, _w) in enumerate(events):
            if e:
                around = [(a, w) for a, x, w in events[max(0, k - pii.NEAR) : k + pii.NEAR + 1] if x is None]
                context = tuple(w for _, w in around)
                for a, w in around:
                    near[e, w][i, text, a] = 1
                    seen[e, w].setdefault((i, text), set()).add(context)
    n, n_e = sum(n_t.values()), Counter()
    for e in {k[0] for k in near}:
        n_e[e] = len({p for (x, _), places in near.items() if x == e for p in places})
    out = set()
    for (e, w), places in near.items():
        docs = {min(c, key=hash) for c in seen[e, w].values()}
        pmi = math.log(len(places) * n / (n_t[w] * n_e[e]))
        if len(docs) >= pii.SUPPORT and len(places) >= n_t[w] * pii.SHARE and pmi >= math.log(n / n_e[e]) * pii.DISCLOSURE:
            out.add(w)
    return out


def made():
    r = random.Random(11)
    filler = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    line = lambda *x: " ".join([*r.sample(filler, 30), *x, *r.sample(filler, 30)])
    rows = [(i, line("common")) for i in range(200)]
    rows += [(300 + i, line("Zorblax", "me@here.org")) for i in range(3)]  # in three documents: disclosing
    alone = line(*["Quimby", "you@there.org"] * 5)  # five times in one document: not
    copy = line("Fennimore", "they@where.org")  # a document and its copies: not
    rows += [(400, alone), *[(410 + i, copy) for i in range(4)], (420, line("zorblax")), (430, line("common", "me@here.org"))]
    return rows


def spans(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = defaultdict(set)
    for x in pii.personal_data(docs).collect():
        out[x["doc_id"]].add((x["spans"], x["clean_sha256"]))
    return out


def test_terms_as_the_plain_version_finds_them(spark):
    rows = made()
    want = plain_terms(rows)
    assert want == {"zorblax"}
    scanned = pii._scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["term"] for r in pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"), scanned).collect()}
    assert got == want


def test_repeated_rows_change_nothing(spark):
    rows = made()
    once = spans(spark, rows)
    assert any(":term:" in s or s.startswith("term:") or ",term:" in s for v in once.values() for s, _ in v)
    assert spans(spark, rows * 3) == once
    assert spans(spark, rows + [rows[200]] * 7) == once


def test_lines_of_one_long_text(spark):
    """200,000 lines in one text, some of them repeated, within the time of a linear pass."""
    r = random.Random(5)
    lines = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 9999)) for _ in range(4)) for _ in range(200_000)]
    lines[150_000:150_040] = lines[1000:1040]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    row = line_dedup.line_report(docs).head()
    assert (row["n_lines"], row["n_removed"]) == (200_000, 40) and time.time() - began < 120
