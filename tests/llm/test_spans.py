"""Spans of long texts, and linked secrets against a plain version."""

import random
import re

import pytest

pytest.importorskip("folio.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from folio.llm import pii, secrets, spans  # noqa: E402
from tests.llm import brute  # noqa: E402

R = random.Random(21)


def test_scan_over_many_blocks(spark):
    for n in (0, 1, 63, 64, 65, 4096, 4097, 30_000):
        df = spark.createDataFrame([([i * 7 % 11 for i in range(n)],)], "x array<int>")
        row = df.select(spans.scan(F.col("x"), spans.plus).alias("s"), spans.scan(F.col("x"), F.greatest).alias("m")).head()
        total = top = 0
        for i in range(n):
            assert (row["s"][i], row["m"][i]) == (total, top)
            total, top = total + i * 7 % 11, max(top, i * 7 % 11)
        assert len(row["s"]) == n


def linked(text, scope=secrets.SCOPE):
    strong = brute.secrets(text)
    weak = [(k, *m.span()) for k in ("weak_id", "weak_secret", "endpoint") for m in re.finditer(getattr(secrets, k.upper()), text)]
    weak = [w for w in weak if not any(s[1] < w[2] and w[1] < s[2] for s in strong)]
    fits = lambda a, b: "secret" in (a, b) and a != b
    role = secrets.ROLE
    return strong + [w for w in weak if any(o != w and fits(role[w[0]], role[o[0]]) and abs(o[1] - w[1]) <= scope for o in strong + weak)]


def test_linked_secrets_against_plain_version(spark):
    key = lambda: "".join(R.choice("ABCDEFabcdef0123456789") for _ in range(36)) + "Zz9"
    parts = [lambda: "AKIA" + "".join(R.choice("ABCDEF12") for _ in range(10)), key, lambda: "https://db.example.org/" + R.choice("abc"), lambda: "password=hunter22", lambda: "AKIA" + "Z" * 16, lambda: "0f" * 13]
    texts = [" ".join(x for _ in range(R.randint(1, 6)) for x in (R.choice(parts)(), "x" * R.choice([1, 200, 350, 380, 399, 400, 401, 420, 800]))) for _ in range(150)]
    texts += ["", key() + " " + "AKIAABCDEFGH12", f"{key()} {'y' * 359} AKIAABCDEFGH12", f"{key()} {'y' * 360} AKIAABCDEFGH12"]
    want = {i: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(linked(t), key=lambda s: (s[1], secrets.KINDS.index(s[0])))) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum("weak" in v or "endpoint" in v for v in want.values()) > 40
    assert got == want


def test_very_long_texts(spark):
    # 5 MB in one line, 200,000 lines, and 40,000 matches: linear, so a minute is plenty.
    words = " ".join("".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(800_000))
    mails = " ".join(f"some word{i} m{i}@x.org and token=abcdef{i}" for i in range(40_000))
    rows = [(1, words + " me@here.org"), (2, "\n".join(f"line {i} 1.2.3.4" for i in range(200_000))), (3, mails)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["base_sha256"]) for r in pii.personal_data(docs).collect()}
    for i, t in rows:
        found = brute.personal(t)
        assert got[i] == (sum(s[0] == "email" for s in found), sum(s[0] == "ip" for s in found), brute.spans_sha(found, pii.KINDS))
    assert {r["doc_id"]: r["n_assign"] for r in secrets.secrets(docs).collect()}[3] == 40_000


def test_sanitised_text(spark):
    texts = ["😀 a.b@c.de and +1 (988) 555-2485 é", "1.2.3.4", "no", None, "x@y.z"]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert [out[i]["text"] for i in range(5)] == ["😀 <EMAIL> and <PHONE> é", "<IP>", "no", None, "<EMAIL>"]
    assert out[0]["n_chars"] == len(out[0]["text"]) and out[2]["n_chars"] == 2
    digests = {r["doc_id"]: r["clean_sha256"] for r in pii.personal_data(docs).collect()}
    assert digests == {i: brute.sha(out[i]["text"] or "") for i in range(5)}
