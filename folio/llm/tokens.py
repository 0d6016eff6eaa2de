"""Token counts of every prefix by dynamic programming.

A word's table holds the exact count of each of its prefixes
(``WordBpe.prefix_counts``: one pass, no prefix is encoded). The count at the
end of a word is the last entry; counts of words add up, so the count of any
prefix of a text is that of the words before it and one entry of a table.
Limits and budgets are answered from the tables. The tables of short words
are kept from text to text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.bpe import PRETOKENS, Kept, WordBpe, load
from folio.llm.common import KEPT, documents, slices


class PrefixCounter:
    """Counts from the tables of words; sums are kept for frequent chunks."""

    def __init__(self, bpe: WordBpe, size: int = 400_000):
        self.bpe, self.kept = bpe, Kept(size)

    def chunk(self, chunk: str) -> tuple[int, int]:
        """Words of a white-space separated chunk, and the count at its end."""
        found = self.kept.get(chunk)
        if found is None:
            words, table = self.bpe.pretokens(chunk), self.bpe.prefix_table
            found = len(words), sum([table(w)[-1] for w in words])
            if len(chunk) <= 64:
                self.kept.put(chunk, found)
        return found

    def _steps(self, text: str) -> Iterator[tuple[str, list[str], str, list[tuple[int, int]]]]:
        """Parts of a text with the words and the count that each item adds."""
        make, table = self.chunk, self.bpe.prefix_table
        for kind, items, part in self.bpe.parts(text):
            if kind == "special":
                yield kind, items, part, [(1, 1)]
            elif kind == "words":
                yield kind, items, part, [(1, table(w)[-1]) for w in items]
            else:
                get = self.kept.young.get
                yield kind, items, part, [get(c) or make(c) for c in items]

    def count(self, text: str, budget: int) -> tuple[int, int, int, int]:
        """Tokens of the text, and its longest prefix within a budget: whole words (special strings are words), bytes of the
        next word, and where that word begins in the text (at its end, if all fits).

        Every word has a token at least, so the prefix ends in the word where
        the sum passes the budget; inside a word counts may fall again.
        """
        total = words = at = 0
        place = None
        for kind, items, part, found in self._steps(text):
            n = sum([f[1] for f in found])
            if place is None and total + n <= budget:
                words += sum([f[0] for f in found])
                at += len(part)
            elif place is None:
                more, rest, inside = self._place(kind, items, part, found, budget - total)
                place = words + more, rest, at + inside
            total += n
        return total, *(place or (words, 0, len(text)))

    def _place(self, kind: str, items: list[str], part: str, found: list[tuple[int, int]], left: int) -> tuple[int, int, int]:
        """Words of a part within what is left, bytes of the next one, and where that one begins in the part."""
        words = k = 0
        for w, n in found:
            if n > left:
                break
            words, left, k = words + w, left - n, k + 1
        if kind == "special":
            return words, 0, 0
        own = 0
        for word in [items[k]] if kind == "words" else self.bpe.pretokens(items[k]):
            table = self.bpe.prefix_table(word)
            if table[-1] > left:
                break
            words, left, own = words + 1, left - table[-1], own + 1
        within = max(i for i, n in enumerate(table) if n <= left)
        if kind == "words":
            return words, within, self.bpe.library_places(part)[k]
        rest = part.split(None, k)[k]
        begin = next(islice(PRETOKENS.finditer(items[k]), own, None)).start()
        # A character may have more than one in lower case.
        ends = list(accumulate(len(c.lower()) for c in rest[: begin + 1]))
        return words, within, len(part) - len(rest) + bisect_right(ends, begin)

    def table(self, text: str) -> Iterator[list[int]]:
        """The count of every prefix, word by word: after each byte of the word; a special string has one entry."""
        spent = 0
        for kind, items, _ in self.bpe.parts(text):
            for item in items:
                for w in [item] if kind != "chunks" else self.bpe.pretokens(item):
                    own = [1] if kind == "special" else self.bpe.prefix_table(w)[1:]
                    yield [spent + n for n in own]
                    spent += own[-1] if own else 0


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One for each Python worker."""
    return PrefixCounter(load(path))


KEPT.append(prefix_counter.cache_clear)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit, words_within and bytes_within (whole words within the limit, and bytes of the next), chars_within.

    chars_within is a place in the text as it is, in code points: all before it
    has no more tokens than the limit, and it is where the next word begins
    (or the character that this word has a part of in lower case only).

    A null text is empty: 0 bytes, 0 tokens. Repeated rows give repeated
    results; an empty table gives none. No shuffle. A long text is taken in
    blocks of 0.1 MB that end at white space; a long word needs some 20 bytes
    of memory for each of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [counter.count(t, limit) for t in texts]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[0] > limit for f in found], pa.bool_()), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit", "words_within", "bytes_within", "chars_within"])

    return documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, words_within long, bytes_within long, chars_within long")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, counts: for every word the exact token count after each of its bytes, to be stored and asked about any limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in slices(batches, 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(counter.table(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.list_(pa.int32())))], ["doc_id", "counts"])

    return documents(docs).mapInArrow(run, "doc_id long, counts array<array<int>>")


def within(counts: Column, budget: int) -> Column:
    """struct<words, bytes> of the longest prefix within a budget, from a stored table."""
    words = F.size(F.filter(counts, lambda w: F.element_at(w, -1) <= budget))
    inside = F.array_max(F.transform(F.get(counts, words), lambda n, i: F.when(n <= budget, i + 1).otherwise(0)))
    return F.struct(words.cast("long").alias("words"), F.coalesce(inside, F.lit(0)).cast("long").alias("bytes"))
