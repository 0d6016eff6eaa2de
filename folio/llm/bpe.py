"""BPE with word ends as a bounded-lookahead transducer, and its decoder.

The encoder runs over the byte symbols of a word from left to right. For
every prefix it keeps one thing, the last token of that prefix's encoding: a
token may follow another only if the merge list splits their concatenation
into just these two, and exactly one such token exists for every prefix. Any
token of a longer word that covers the present end starts at most
``lookahead`` symbols back, so a token on which the encodings of the last
``lookahead`` prefixes agree is final: it is emitted and forgotten. Memory
thus depends on the merge list, not on the word.

The same table of last tokens gives the exact token count of every prefix
(see ``tokens.py``).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folio.llm.common import KEPT, documents, slices

END = "</w>"
_NEVER = 1 << 30
#: The file's own pre-tokeniser pattern, a fixed value.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts without these characters need no Unicode normalisation but lower-casing.
_GAP = re.compile("[\x20\t\n\r]")
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-˿]")


def _byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


SYMBOLS = _byte_symbols()
BYTE_OF = {s: b for b, s in enumerate(SYMBOLS)}


def text_blocks(text: str, size: int = 1 << 17) -> Iterator[str]:
    """The text in blocks that end before white space, so that no word and no special string is cut."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Kept:
    """A bounded table of what is frequent: whenever ``young`` is full, what wasn't asked for since it began is dropped."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordBpe:
    """One vocabulary file; caches are bounded and may be dropped at any time."""

    def __init__(self, path: str, cache_size: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lookahead = self.sufficient_lookahead()
        self.cache_size = cache_size
        self._fits: dict[str, dict[str, bool]] = {}
        self._histories: dict[str, tuple[bool, list, list]] = {}
        #: Tokens by their symbols: nodes of further symbols, the open token that ends here, the closing one.
        self._trie: list = [{}, None, None]
        for t in self.vocab:
            closing = t.endswith(END) and len(t) > len(END)
            node = self._trie
            for symbol in t[: -len(END)] if closing else t:
                node = node[0].setdefault(symbol, [{}, None, None])
            node[1 + closing] = t
        self._words, self._tables = Kept(2 * cache_size), Kept(3 * cache_size)
        self._library = None

    def sufficient_lookahead(self) -> int:
        """Symbols after which a decision can't change any more, if the frontier agrees: the longest token that merges can build."""
        return max((len(a) + len(b) - (len(END) if b.endswith(END) else 0) for a, b in self.ranks), default=1)

    # --- which tokens may follow each other -----------------------------------

    @staticmethod
    def _symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def _edges(self, token: str) -> tuple[bool, list[tuple[int, str]], list[tuple[int, str]]]:
        """Whether the merges build the token from its symbols, and how its left and right ends grow: (rank of the merge, symbol then at the end)."""
        found = self._histories.get(token)
        if found is None:
            symbols = self._symbols(token)
            lefts, rights = [(-1, symbols[0])], [(-1, symbols[-1])]
            while len(symbols) > 1:
                rank, at = min((self.ranks.get(p, _NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:])))
                if rank == _NEVER:
                    break
                symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
                if at == 0:
                    lefts.append((rank, symbols[0]))
                if at == len(symbols) - 1:
                    rights.append((rank, symbols[-1]))
            found = self._histories[token] = (len(symbols) == 1, lefts, rights)
        return found

    def _follows(self, left: str, right: str) -> bool:
        """Whether the merge list splits left + right into just these: no merge across the border may come before those that change its two sides."""
        built, lefts, _ = self._edges(right)
        if not built or not left:
            return built
        rights, i, j = self._edges(left)[2], 0, 0
        while True:
            next_left = rights[i + 1][0] if i + 1 < len(rights) else _NEVER
            next_right = lefts[j + 1][0] if j + 1 < len(lefts) else _NEVER
            across = self.ranks.get((rights[i][1], lefts[j][1]), _NEVER)
            if across < next_left and across <= next_right and across < _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    # --- the transducer ------------------------------------------------------

    def _advance(self, word: str, lasts: list[str], base: int, start: int) -> str:
        """Enter the tokens that begin at start into the table of last tokens. Returns the closing token, if it begins here.

        Only one token can end a prefix, so an entry that is there stays.
        """
        left, end, n = lasts[start - base], start - base, len(word) - base
        (further, token, closing), known = self._trie, self._fits.get(left)
        if known is None:
            if len(self._fits) > self.cache_size:
                self._fits.clear()
            known = self._fits[left] = {}
        for symbol in word[start:] if n - end <= self.lookahead else word[start : start + self.lookahead]:
            node = further.get(symbol)
            if node is None:
                return ""
            end += 1
            further, token, closing = node
            if token is not None and not lasts[end]:
                ok = known.get(token)
                if ok is None:
                    ok = known[token] = self._follows(left, token)
                if ok:
                    lasts[end] = token
        if end == n:
            if closing is not None:
                ok = known.get(closing)
                if ok is None:
                    ok = known[closing] = self._follows(left, closing)
                if ok:
                    return closing
        return ""

    def fits(self, left: str, right: str) -> bool:
        """Whether right may follow left; left '' is the start of a word."""
        known = self._fits.setdefault(left, {})
        if right not in known:
            known[right] = self._follows(left, right)
        return known[right]

    def stream(self, word: str, flush_every: int = 64) -> Iterator[str]:
        """Tokens of one word, each as soon as it is stable."""
        n = len(word)
        if not n:
            return
        ahead = min(n, self.lookahead)
        lasts, base, final = [""] * (ahead + 1), 0, ""
        for start in range(n):
            final = self._advance(word, lasts, base, start)
            if final:
                break
            if n > ahead:
                lasts.append("")
                if start % flush_every == flush_every - 1 and start - base > 2 * self.lookahead:
                    stable, cut = self._stable(lasts, base, start)
                    yield from stable
                    lasts, base = lasts[cut - base :], cut
        yield from self._back(lasts, base, n - len(final) + len(END))
        yield final

    @staticmethod
    def _back(lasts: list[str], base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(lasts[end - base])
            end -= len(lasts[end - base])
        return out[::-1]

    def _stable(self, lasts: list[str], base: int, end: int) -> tuple[list[str], int]:
        """Tokens on which the encodings of all prefixes of the frontier agree, and where they end."""
        common: set[int] | None = None
        for p in range(end - self.lookahead + 1, end + 1):
            seen = {p}
            while p > base:
                p -= len(lasts[p - base])
                seen.add(p)
            common = seen if common is None else common & seen
        cut = max(common or {base})
        return self._back(lasts, base, cut), cut

    def _within(self, word: str) -> tuple[str, ...]:
        """Tokens of a word that is no longer than the lookahead, so that nothing is stable before its end.

        The longest token that may follow is tried first. As only one token can
        end a prefix, a place from which there is no way on is never tried again.
        """
        n, at, left, blocked = len(word), 0, "", set()
        way: list[tuple[int, str, list[str]]] = []
        options = self._starting(word, 0)
        while True:
            known = self._fits.get(left)
            if known is None:
                if len(self._fits) > self.cache_size:
                    self._fits.clear()
                known = self._fits[left] = {}
            while options:
                token = options.pop()
                ok = known.get(token)
                if ok is None:
                    ok = known[token] = self._follows(left, token)
                if ok:
                    end = at + len(token)
                    if end > n:
                        return (*[t for _, t, _ in way], token)
                    if end not in blocked:
                        way.append((at, token, options))
                        at, left, options = end, token, self._starting(word, end)
                        break
            else:
                blocked.add(at)
                at, _, options = way.pop()
                left = way[-1][1] if way else ""

    def _starting(self, word: str, at: int) -> list[str]:
        """Tokens that begin at this place, shorter ones first; only a closing one may end the word."""
        (further, token, closing), found = self._trie, []
        for symbol in word[at:]:
            node = further.get(symbol)
            if node is None:
                return found
            further, token, closing = node
            if token is not None:
                found.append(token)
        if token is not None:
            found.pop()
        if closing is not None:
            found.append(closing)
        return found

    def word(self, word: str) -> tuple[str, ...]:
        found = self._words.get(word)
        if found is None:
            found = self._within(word) if 0 < len(word) <= self.lookahead else tuple(self.stream(word))
            if len(word) <= 64:
                self._words.put(word, found)
        return found

    def prefix_counts(self, word: str) -> array:
        """Exact token count of every prefix of a word, each taken as a word of its own: one pass over the table of last tokens."""
        n = len(word)
        lasts, opened, closed = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            left = lasts[start]
            if start:
                opened[start] = opened[start - len(left)] + 1
            known = self._fits.get(left)
            if known is None:
                if len(self._fits) > self.cache_size:
                    self._fits.clear()
                known = self._fits[left] = {}
            further, count, end = self._trie[0], opened[start] + 1, start
            # Tokens end within the lookahead, as the tree of tokens has no longer ones.
            for symbol in word[start:] if n - start <= self.lookahead else word[start : start + self.lookahead]:
                node = further.get(symbol)
                if node is None:
                    break
                end += 1
                further, token, closing = node
                if token is not None and not lasts[end]:
                    ok = known.get(token)
                    if ok is None:
                        ok = known[token] = self._follows(left, token)
                    if ok:
                        lasts[end] = token
                if closing is not None and not closed[end]:
                    ok = known.get(closing)
                    if ok is None:
                        ok = known[closing] = self._follows(left, closing)
                    if ok:
                        closed[end] = count
        return array("i", closed)

    def prefix_table(self, word: str) -> array:
        """prefix_counts, kept for short words."""
        found = self._tables.get(word)
        if found is None:
            found = self.prefix_counts(word)
            if len(word) <= 64:
                self._tables.put(word, found)
        return found

    # --- texts ---------------------------------------------------------------

    @property
    def library(self):
        """The tokenizers library, for normalising unusual characters."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def segments(self, text: str) -> list[str]:
        """A text cut at special strings; these stand at odd places."""
        return self._specials.split(text) if self._specials and "<|" in text else [text]

    def chunks(self, text: str) -> list[str] | None:
        """White-space separated chunks after normalisation, or None if the text needs the library's normaliser."""
        return None if _UNUSUAL.search(text) else text.lower().split()

    def pretokens(self, chunk: str) -> list[str]:
        return ["".join([SYMBOLS[b] for b in w.encode()]) for w in PRETOKENS.findall(chunk)]

    def library_pretokens(self, text: str) -> list[str]:
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def library_places(self, text: str) -> list[int]:
        """Where the library's pre-tokens begin in the text as it was before normalisation."""
        from tokenizers import PreTokenizedString

        split = PreTokenizedString(text)
        split.normalize(self.library.normalizer.normalize)
        self.library.pre_tokenizer.pre_tokenize(split)
        return [place[0] for _, place, _ in split.get_splits("original", "char")]

    def parts(self, text: str) -> Iterator[tuple[str, list[str], str]]:
        """('special', [string]), ('chunks', white-space separated chunks) or ('words', pre-tokens), and the piece of the text
        that they are made of, a block at a time; the pieces make up the text."""
        for block in text_blocks(text):
            for i, part in enumerate(self.segments(block)):
                if i % 2:
                    yield "special", [part], part
                elif (chunks := self.chunks(part)) is None:
                    yield "words", self.library_pretokens(part), part
                else:
                    yield "chunks", chunks, part

    def encode(self, text: str) -> list[int]:
        return list(self.ids(text))

    def ids(self, text: str) -> Iterator[int]:
        """Token ids, each as soon as it is stable."""
        for kind, items, _ in self.parts(text):
            for item in items:
                if kind == "special":
                    yield self.special[item]
                else:
                    yield from self.word_ids([item] if kind == "words" else self.pretokens(item))

    def word_ids(self, words: Iterable[str]) -> Iterator[int]:
        for word in words:
            for token in self.word(word) if len(word) <= 64 else self.stream(word):
                yield self.vocab[token]


class Decoder:
    """Incremental decoder, one for a document. ``tokens``: token names joined by a space, what a file without a decoder asks for.
    ``text``: bytes to text by a UTF-8 state machine that holds back unfinished characters; word ends become spaces.

    What tokens stand for as bytes doesn't depend on what came before
    (``raw``), so it may be kept; only ``push`` has a state.
    """

    def __init__(self, bpe: WordBpe, style: str = "tokens"):
        self.bpe, self.style, self.started = bpe, style, False
        self.gap = b" " if style == "tokens" else b""
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def raw(self, ids: Iterable[int]) -> bytes:
        names = [self.bpe.names[i] for i in ids]
        if self.style == "tokens":
            return " ".join(names).encode()
        return b"".join(map(self._bytes, names))

    def _bytes(self, name: str) -> bytes:
        if name in self.bpe.special:
            return name.encode()
        ends = name.endswith(END) and len(name) > len(END)
        return bytes([BYTE_OF[c] for c in (name[: -len(END)] if ends else name)]) + b" " * ends

    def push(self, raw: bytes) -> str:
        """The text that is certain after these bytes of one token or more."""
        out, self.started = (self.gap if self.started else b"") + raw, True
        return self.utf8.decode(out)

    def feed(self, token_id: int) -> str:
        return self.push(self.raw([token_id]))

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One copy of a vocabulary for each Python worker."""
    return WordBpe(path)


class ChunkCodec:
    """Ids of white-space separated chunks and the bytes that they stand for, kept for frequent chunks in bounded tables that
    later tasks find; a document's bytes go through one decoder."""

    def __init__(self, bpe: WordBpe, style: str = "tokens", size: int = 250_000):
        self.bpe, self.style, self.kept = bpe, style, Kept(size)
        self.raw = Decoder(bpe, style).raw

    def _of(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), self.raw(ids)

    def chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        found = self.kept.get(chunk)
        if found is None:
            found = self._of(list(self.bpe.word_ids(self.bpe.pretokens(chunk))))
            self.kept.put(chunk, found)
        return found

    def _long(self, words: Iterable[str], size: int = 4096) -> Iterator[tuple[int, bytes, bytes]]:
        """Words of any length, a few thousand tokens at a time."""
        ids = self.bpe.word_ids(words)
        while some := list(islice(ids, size)):
            yield self._of(some)

    def _found(self, text: str) -> Iterator[list[tuple[int, bytes, bytes]]]:
        make = self.chunk
        for kind, items, _ in self.bpe.parts(text):
            if kind == "special":
                yield [self._of([self.bpe.special[items[0]]])]
            elif kind == "words":
                yield from ([x] for x in self._long(items))
            elif max(map(len, items), default=0) <= 64:
                get = self.kept.young.get
                yield [get(c) or make(c) for c in items]
            else:
                for c in items:
                    yield from [[make(c)]] if len(c) <= 64 else ([x] for x in self._long(self.bpe.pretokens(c)))

    def document(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digests of the ids joined by a space and of the decoded text; both are fed block by block."""
        n, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.bpe, self.style)
        for found in self._found(text):
            if found := [x for x in found if x[0]]:
                ids.update((b" " if n else b"") + b" ".join([x[1] for x in found]))
                n += sum([x[0] for x in found])
                decoded.update(decoder.push(decoder.gap.join([x[2] for x in found])).encode())
        decoded.update(decoder.finish().encode())
        return n, ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def chunk_codec(path: str, style: str = "tokens") -> ChunkCodec:
    """One for each Python worker, so that later tasks find frequent chunks."""
    return ChunkCodec(load(path), style)


KEPT.extend((load.cache_clear, chunk_codec.cache_clear))


def encode_documents(docs: DataFrame, path: str, style: str = "tokens") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (of what the decoder makes of the ids, in its style).

    A null text is empty: no tokens and the digests of the empty string.
    Repeated rows give repeated results; an empty table gives none. Documents
    never leave their task, so nothing is shuffled. A long text is taken in
    blocks of 0.1 MB that end at white space, and a longer word streams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(path, style)
        for batch in slices(batches):
            rows = [codec.document(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of every document, for further use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, 100):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")
