import random

import pytest

from folio.llm import bpe, tokens
from tests.llm import brute

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_words_within_the_lookahead(library):
    own, r = bpe.WordBpe(TOKENIZER), random.Random(8)
    for _ in range(3000):
        w = "".join(r.choice("thinesoarlq" + "é你" * (r.random() < 0.1)) for _ in range(r.randint(1, 10)))
        want = library.encode(w, add_special_tokens=False).ids
        for x in own.pretokens(w):
            assert own._within(x) == tuple(own.stream(x))
        assert own.encode(w) == want, w


def test_one_decoder_for_a_document(spark, library):
    # Characters of three bytes, one token a byte: the blocks of 4096 tokens end inside of them.
    texts = ["", "hello wörld", "ༀ\U00010350" * 3000, "\U00010350" * 60_000 + " end", "a <|endoftext|> b", "x 你好 y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.decoded_sha256 for x in bpe.encode_documents(df, TOKENIZER, style="text").collect()}
    own = bpe.load(TOKENIZER)
    for i, t in enumerate(texts):
        decoder = bpe.Decoder(own, "text")
        whole = "".join([decoder.feed(x) for x in library.encode(t, add_special_tokens=False).ids]) + decoder.finish()
        assert got[i] == brute.sha(whole)
        if "<|" not in t:
            assert "�" not in whole and "".join(whole.split()) == "".join(t.split())


def test_texts_are_cut_where_the_next_word_begins(spark, library):
    r = random.Random(9)
    word = lambda: "".join(r.choice("thinesoarÅİ12,.'") for _ in range(r.randint(1, 9)))
    some = lambda n, gap: gap.join(word() for _ in range(n))
    texts = ["", "one", "q" * 300, some(60, " "), some(60, "\n\t "), "İİİ " * 30, "one <|endoftext|> two " * 9, "你好 éx " * 20]
    texts += [some(40, " ") + " “you’re” é " + some(40, "  "), "it's <|endoftext|>you're " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for limit in (0, 1, 7, 40):
        for x in tokens.token_counts(df, TOKENIZER, limit=limit).collect():
            t, at = texts[x.doc_id], x.chars_within
            assert n(t[:at]) <= limit and at <= len(t)
            if x.over_limit:
                # What begins there doesn't fit whole: some longer piece has more tokens, and no word ends before that.
                assert at < len(t) and not t[at].isspace()
                words = sum(1 for _ in _words(library, t[:at]))
                # In lower case İ is two characters, which are parts of two words.
                assert words == x.words_within or "İ" in t and words == x.words_within - 1
            else:
                assert at == len(t)


def _words(library, text):
    own = bpe.load(TOKENIZER)
    for i, part in enumerate(own.segments(text)):
        if i % 2:
            yield part
        else:
            yield from own.library_pretokens(part)
