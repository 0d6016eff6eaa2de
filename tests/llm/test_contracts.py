"""Each query's operator against the plain versions, on the smallest table and on awkward rows."""

import random

import pandas as pd
import pytest

pytest.importorskip("folio.llm.queries")

from folio.llm import bpe, decontam, pii, quality, secrets, tokens  # noqa: E402
from tests.llm import brute  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
AWKWARD = [None, "", " \n\t ", "one", "a b c", "İstanbul ΑΣ Σ x 你好 it's 42 <|endoftext|> z", "x" * 5000, "la " * 3000, "AKIA" + "A" * 16 + " secret: 'abc' token==abcdef PASSWORD = \"hunter22\" secret=token:abcdefgh " + "0f" * 20, "mail a.b@c.de.f, 1.2.3.4.5 256.1.1.1 007.0.0.1 4111 1111 1111 1111 +1 (988) 555-2485 ++1.2 +49 30 1234567-8 " + "1 " * 9000, "a@b.com%x@y.org.@z.de a@b a@b.c..d@e.f " + "7" * 60_000 + " " + "q" * 60_000 + "1.2.3.4" * 3, "é" * 70 + "😀 +1 (988) 555-2485 password=😀secret12"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", s, len(t or ""), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kind string")


@pytest.fixture(scope="module")
def rows():
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    out = [(int(i), t, s) for i, t, s in zip(table.doc_id, table.text, table.source)]
    return out + [(10_000 + i, t, None) for i, t in enumerate(AWKWARD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_quality_base(docs, rows):
    got = by_id(quality.quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality(t) for i, t, _ in rows}


def test_quality_rejects_depleted_and_keeps_clean(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    hot = " ".join(word() for _ in range(30))
    own = [" ".join(word() for _ in range(40)) for _ in range(60)]
    rows = [(i, f"{hot}\n{t}" if i % 2 else t, "h") for i, t in enumerate(own)] + [(100 + i, f"{hot}\nonly {word()} {word()}", "h") for i in range(3)]
    got = by_id(quality.quality(frame(spark, rows)), "kept", "n_boilerplate_words")
    assert all(got[i] == (True, 30 if i % 2 else 0) for i in range(60))
    assert all(got[100 + i] == (False, 30) for i in range(3))


def test_tokens_and_bpe(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    got = by_id(tokens.token_counts(docs, TOKENIZER, limit=100), "n_bytes", "n_tokens", "over_limit")
    assert got == {i: (len((t or "").encode()), len(want[i]), len(want[i]) > 100) for i, t, _ in rows}
    got = by_id(bpe.encode_documents(docs, TOKENIZER), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == {i: (len(v), brute.sha(" ".join(map(str, v))), brute.sha(library.decode(v, skip_special_tokens=False))) for i, v in want.items()}


def test_prefix_counts_and_stream():
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(TOKENIZER), bpe.load(TOKENIZER), random.Random(3)
    for _ in range(60):
        w = "".join(r.choice("thinesoar") for _ in range(r.randint(1, 25)))
        assert list(own.prefix_counts(w)) == [len(library.encode(w[:k], add_special_tokens=False).ids) for k in range(len(w) + 1)]
    for w in ("a" * 3000, "".join(r.choice("inthea") for _ in range(4000))):
        assert [own.vocab[t] for t in own.stream(w)] == library.encode(w, add_special_tokens=False).ids


def test_limits_from_prefix_tables(spark):
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(TOKENIZER), random.Random(4)
    word = lambda: "".join(r.choice("thinesoar") for _ in range(r.randint(1, 12)))
    texts = ["", " ".join(word() for _ in range(40)), "q" * 90, "".join(word() for _ in range(30)), "a1b2,c3d4" * 20, "one <|endoftext|> two " * 9, "你好 x " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    stored = tokens.prefix_tables(df, TOKENIZER)
    for limit in (0, 1, 5, 17):
        got = by_id(tokens.token_counts(df, TOKENIZER, limit=limit), "n_tokens", "words_within", "bytes_within")
        assert got == by_id(stored.select("doc_id", tokens.within(stored.counts, limit).alias("w")).select("doc_id", "w.words", "w.bytes").join(df.selectExpr("doc_id", "text"), "doc_id").withColumn("n_tokens", _lit_counts(texts, n)), "n_tokens", "words", "bytes")
        # One word without spaces: the prefix itself can be held against the library.
        for i in (2, 3):
            assert got[i][1:] == (int(n(texts[i]) <= limit), 0 if n(texts[i]) <= limit else max(k for k in range(len(texts[i]) + 1) if n(texts[i][:k]) <= limit))


def _lit_counts(texts, n):
    from pyspark.sql import functions as F

    return F.element_at(F.array(*[F.lit(n(t)) for t in texts]), (F.col("doc_id") + 1).cast("int"))


def test_long_texts_in_blocks_of_tokens():
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(TOKENIZER), random.Random(5)
    text = " ".join("".join(r.choice("thinesoaré你") for _ in range(r.randint(1, 9))) for _ in range(60_000)) + " " + "".join(r.choice("inthea") for _ in range(20_000))
    ids = library.encode(text, add_special_tokens=False).ids
    want = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))
    assert bpe.chunk_codec(TOKENIZER).document(text) == want
    assert tokens.prefix_counter(TOKENIZER).count(text, 5)[0] == len(ids)


def test_decoder_holds_back_unfinished_characters():
    own = bpe.load(TOKENIZER)
    for text in ("hello wörld", "你好 😀 x", ""):
        decoder = bpe.Decoder(own, "text")
        parts = [decoder.feed(i) for i in own.encode(text)]
        assert "".join(parts) + decoder.finish() == "".join(c + " " for c in text.split())


def test_secrets(docs, rows):
    got = by_id(secrets.secrets(docs), "n_assign", "n_access", "n_hex", "base_sha256")
    for i, t, _ in rows:
        want = brute.secrets(t)
        n = [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert got[i] == (*n, brute.spans_sha(want, secrets.KINDS)), t


def test_weak_secrets_need_a_complement(spark):
    weak, ident = "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MEFCQ0RFRkdISUo0", "AKIAABCDEFGH12"
    rows = [(1, f"id {ident} and {weak}", "a"), (2, f"only {weak}", "a"), (3, f"only {ident}", "a"), (4, f"{ident} {'x ' * 400} {weak}", "a"), (5, f"https://db.example.org/x {weak}", "a"), (6, "https://db.example.org/x", "a")]
    got = by_id(secrets.secrets(frame(spark, rows)), "n_linked")
    assert got == {1: (2,), 2: (0,), 3: (0,), 4: (0,), 5: (2,), 6: (0,)}


def test_personal_data(docs, rows):
    got = by_id(pii.personal_data(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    for i, t, _ in rows:
        want = brute.personal(t)
        n = [sum(s[0] == k for s in want) for k in pii.KINDS[:4]]
        assert got[i] == (*n, brute.spans_sha(want, pii.KINDS)), t


def test_disclosing_terms(spark):
    r = random.Random(5)
    filler = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    line = lambda *x: " ".join([*r.sample(filler, 6), *x])
    rows = [(i, line("Zorblax", "reach", "me@here.org"), "s") for i in range(4)] + [(100 + i, line("reach", "x"), "s") for i in range(200)]
    out = {x["doc_id"]: x for x in pii.personal_data(frame(spark, rows)).collect()}
    for i in range(4):
        text = rows[i][1]
        spans = [s.split(":") for s in out[i]["spans"].split(",")]
        named = {text[int(a) : int(b)] for k, a, b in spans if k == "term"}
        assert "Zorblax" in named and "reach" not in named
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(frame(spark, rows)).collect()}
    assert "Zorblax" not in clean[0] and "<EMAIL>" in clean[0] and clean[100] == rows[4][1]


def test_decontamination(spark, docs, rows):
    bench = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    items = [(int(i), t) for i, t in zip(bench.item_id, bench.text)] + [(900, None), (901, ""), (902, "A b, c"), (903, "la " * 30), (904, "la " * 30)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination([(i, t) for i, t, _ in rows], items)
    assert sum(v[1] > 0 for v in want.values()) > 3
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontam.contamination(docs, table), *columns) == want
    assert by_id(decontam.contamination(docs, table, terms_per_pass=300), *columns) == want
    left = {r["doc_id"] for r in decontam.clean(docs, table).collect()}
    assert left == {i for i, v in want.items() if not v[4]}


@pytest.mark.parametrize("run", [quality.quality, secrets.secrets, pii.personal_data, lambda d: tokens.token_counts(d, TOKENIZER), lambda d: bpe.encode_documents(d, TOKENIZER)])
def test_empty_tables_and_repeated_rows(spark, run):
    assert run(frame(spark, [])).collect() == []
    same = frame(spark, [(7, "token=abcdef12 1.2.3.4", "s"), (7, "token=abcdef12 1.2.3.4", "s"), (None, None, None)])
    assert len(run(same).collect()) == 3
