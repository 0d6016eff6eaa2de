"""Exact removal of long repeated byte strings, by prefix doubling over anchored positions.

Positions get ranks of growing length, and a position that is unique at one
length is never looked at again. A rank is the 64-bit hash of its bytes, so
ranking needs a hash shuffle and no global sort; results are exact but for
collisions of these hashes.

1. Length 100. In every string of ``width`` bytes, the 100-byte string with
   the least hash is its anchor: equal strings have equal anchors at equal
   offsets, so only anchors are ranked, about one position in 150. Anchors
   found once are dropped with all strings that they stand for.
2. The whole context of an anchor, that is all strings that have it. Where
   all contexts of a rank are alike, all their strings are repeated. This
   settles the inside of copies.
3. Contexts that differ meet the borders of repeats. Their offsets are dealt
   out to cells of 25: the bytes that all strings of a cell share (its core),
   then the bytes that any of them has (its hull) are ranked. No string with
   a unique core is repeated; all strings of a repeated hull are.
4. What is left, at the borders, is ranked at the full width.

Only one context of each kind is looked at in 3 and 4, and copies were
counted before, so large groups of copies cost no more than small ones. A
rank is counted with partial sums and its row is written to a table; Spark can
then split the rows of a hot rank when they are joined to it.

Passages of ``passage`` words go the same way with words for bytes (white
space between them doesn't count), anchors of 13 words, and no cells, as an
anchor stands for some 39 offsets at most. They are reported, not removed.

Short texts are hashed many at once. A long one is taken in blocks of 4 MB: a border splits a context in two, and both
halves are ranked as contexts of their own, so nothing is lost there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ByteHashes, Hashes, cut, drop, mix, ranges, slices, text_groups, word_places

WIDTH, GRAM, CELL = 400, 100, 25
#: Words of a passage, and of the string that anchors it.
PASSAGE, PASSAGE_GRAM = 51, 13
_BLOCK, _WORD_BLOCK = 1 << 22, 1 << 19
_LOW = np.uint64((1 << 24) - 1)
_BY_WORD = np.uint64(0x5851F42D4C957F2D)
_HALF = (1 << 32) - 1


def _least(ranks: np.ndarray, windows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of the least rank of each of these windows of k ranks: (places, first window, last window) where it changes."""
    keys = (ranks & ~_LOW) | np.arange(len(ranks), dtype=np.uint64)
    # Minima of doubling lengths, two of which cover a window.
    size = 1
    while 2 * size <= k:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    of = (np.minimum(keys[windows], keys[windows + (k - size)]) & _LOW).astype(np.int64)
    changes = np.flatnonzero(of[1:] != of[:-1])
    first = np.concatenate(([0], changes + 1))
    return of[first], windows[first], windows[np.concatenate((changes, [len(of) - 1]))]


def _windows(bounds: np.ndarray, width: int, start: int, end: int) -> np.ndarray:
    """Where the windows begin, from start to end, that lie in one of the texts between bounds; counted from start."""
    low, high = np.maximum(bounds[:-1], start), np.minimum(bounds[1:] - width + 1, end)
    return ranges(low - start, np.maximum(high - low, 0))


def _bounds(data: bytes | np.ndarray) -> np.ndarray:
    return np.array([0, len(data)])


def anchors(data: bytes | np.ndarray, width: int = WIDTH, gram: int = GRAM, bounds: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Of every anchor: hash, hash of the context, largest and least offset of its strings (anchor minus start), where the context begins and ends.

    bounds: where texts begin, and the last ends, if data has several one after the other; no string crosses these.
    """
    bounds = _bounds(data) if bounds is None else bounds
    for s in range(0, len(data) - width + 1, _BLOCK):
        own = data[s : s + _BLOCK + width - 1]
        windows = _windows(bounds, width, s, s + len(own) - width + 1)
        if len(windows):
            hashes = ByteHashes(own)
            ranks = hashes.unmixed(gram)
            at, first, last = _least(ranks, windows, width - gram + 1)
            yield mix(ranks[at]), hashes.of(first, last + width), at - first, at - last, first + s, last + width + s


def _words(data: np.ndarray, bounds: np.ndarray, passage: int) -> Iterator[tuple[np.ndarray, np.ndarray, Hashes, np.ndarray, np.ndarray]]:
    """Of every block of words, those of its last passages included: where they begin and end, hashes of series of them,
    which of them begin a passage that lies in one text, and for each text how many of its words come before the block."""
    starts, ends = word_places(data, bounds)
    of_texts = np.searchsorted(starts, bounds)
    for s in range(0, len(starts) - passage + 1, _WORD_BLOCK):
        to = min(len(starts), s + _WORD_BLOCK + passage - 1)
        windows = _windows(of_texts, passage, s, to - passage + 1)
        if len(windows):
            base = starts[s]
            values = ByteHashes(data[base : ends[to - 1]]).of(starts[s:to] - base, ends[s:to] - base)
            yield starts[s:to], ends[s:to], Hashes(values), windows, s - of_texts


def word_anchors(data: bytes | np.ndarray, passage: int = PASSAGE, gram: int = PASSAGE_GRAM, bounds: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """As anchors(), of the strings of ``passage`` words; offsets are words, where a context begins and ends are bytes."""
    raw = np.frombuffer(data, np.uint8)
    for starts, ends, hashes, windows, _ in _words(raw, _bounds(raw) if bounds is None else bounds, passage):
        ranks = hashes.unmixed(gram)
        at, first, last = _least(ranks, windows, passage - gram + 1)
        yield mix(ranks[at]) ^ _BY_WORD, hashes.of(first, last + passage), at - first, at - last, starts[first], ends[last + passage - 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers below 2^31 as one long."""
    return high.astype(np.int64) << 32 | low.astype(np.int64)


def _unpair(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pairs >> 32, pairs & _HALF


def _span(first: np.ndarray, last: np.ndarray, by_word: bool | np.ndarray) -> np.ndarray:
    """Where a span begins and ends as one long; below 0 for passages of words."""
    return _pair(first, last) ^ -np.asarray(by_word).astype(np.int64)


def _from_span(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _unpair(np.where(spans < 0, ~spans, spans))


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _table(batch: pa.RecordBatch, names: list[str], rows: np.ndarray, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """These columns at these rows, and more columns."""
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in names), *more.values()], [*names, *more])


def _joined(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def _anchor_rows(docs: DataFrame, width: int, gram: int, passage: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            for i, _, data, bounds in text_groups(batch.column("data")):
                for by_word in (False, True) if passage else (False,):
                    for h, context, most, least, first, last in word_anchors(data, passage, bounds=bounds) if by_word else anchors(data, width, gram, bounds):
                        row = np.searchsorted(bounds, first, "right") - 1
                        parts.append((i + row, h, context, _pair(most, least), _span(first - bounds[row], last - bounds[row], by_word)))
            if parts:
                rows, h, context, reach, span = _joined(parts)
                yield _table(batch, _KEY, rows, {"h": _signed(h), "context": _signed(context), "reach": pa.array(reach), "span": pa.array(span)})

    return docs.select(*_KEY, "data").mapInArrow(run, "doc_id long, text_key long, h long, context long, reach long, span long")


_KEY = ["doc_id", "text_key"]
#: Of a context: its document, place, anchor, hash, offsets, and whether it is the only one of its kind.
_CONTEXT = [*_KEY, "span", "h", "context", "reach", "once"]
_CONTEXT_TYPES = "doc_id long, text_key long, span long, h long, context long, reach long, once boolean"


def _same(left: DataFrame, right: DataFrame, *key: str) -> tuple[DataFrame, Column]:
    """right with other names for the key, and the condition that it equals left's; ids may be null."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in key})
    on = left["doc_id"].eqNullSafe(renamed["_doc_id"])
    for k in key:
        on = on if k == "doc_id" else on & (left[k] == renamed[f"_{k}"])
    return renamed, on


def _context_bytes(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The bytes of the contexts in edges, taken from their documents; a repeated row gives its contexts each time."""
    found = edges.groupBy(*_KEY).agg(F.collect_list(F.struct(*_CONTEXT[2:])).alias("anchors"))
    texts = docs.select(*_KEY, "data")
    wanted, on = _same(texts, found, *_KEY)
    joined = texts.join(wanted, on).select(*_KEY, "data", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts_, lists = batch.column("data").to_pylist(), batch.column("anchors")
            rows, found_ = np.repeat(np.arange(len(lists)), _longs(pc.list_value_length(lists))), lists.flatten().flatten()
            first, last = _from_span(_longs(found_[0]))
            data = [texts_[r][a:b] for r, a, b in zip(rows.tolist(), first.tolist(), last.tolist())]
            out = _table(batch, _KEY, rows, dict(zip(_CONTEXT[2:], found_)) | {"data": pa.array(data, pa.binary())})
            for s in range(0, len(data), 100_000):
                yield out.slice(s, 100_000)

    return joined.mapInArrow(run, f"{_CONTEXT_TYPES}, data binary")


def _cells(contexts: DataFrame, width: int, cell: int) -> DataFrame:
    """A row for each context and cell of its offsets: hash of the core, hash of the hull (null if the cell is cut short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            parts = []
            all_most, all_least = _unpair(_longs(batch.column("reach")))
            for i, j, data, bounds in text_groups(batch.column("data")):
                from_, to = all_least[i:j] // cell, all_most[i:j] // cell
                row, k = np.repeat(np.arange(j - i), to - from_ + 1), ranges(from_, to - from_ + 1)
                most, least = all_most[i:j][row], all_least[i:j][row]
                # A string of offset o is at base - o here.
                hashes, base = ByteHashes(data), bounds[row] + most
                low, high = np.maximum(k * cell, least), np.minimum(k * cell + cell - 1, most)
                core = hashes.of(base - k * cell, base - k * cell - cell + 1 + width)
                whole = (low == k * cell) & (high == k * cell + cell - 1)
                hull = np.where(whole, hashes.of(np.where(whole, base - high, 0), np.where(whole, base - low + width, 0)), np.uint64(0))
                parts.append((i + row, k, low, high, core, hull))
            if parts:
                rows, k, low, high, core, hull = _joined(parts)
                yield _table(batch, _CONTEXT, rows, {"k": pa.array(k.astype(np.int32)), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32)), "core": _signed(core), "hull": pa.array(hull.view(np.int64), mask=hull == 0)})

    rows = contexts.where("span >= 0").select(*_CONTEXT, "data")
    return rows.mapInArrow(run, f"{_CONTEXT_TYPES}, k int, low int, high int, core long, hull long")


_STRING = [*_KEY, "h", "context", "once"]
_STRING_TYPES = "doc_id long, text_key long, h long, context long, once boolean, o int, rank long, span long"


def _strings(contexts: DataFrame, open_cells: DataFrame, width: int) -> DataFrame:
    """Hashes at the full width of the offsets of open cells."""
    key = [*_KEY, "span"]
    # A repeated row has its cells several times.
    found = open_cells.groupBy(*key).agg(F.collect_set(F.struct("low", "high")).alias("cells"))
    rows = contexts.where("span >= 0").select(*_CONTEXT, "data")
    wanted, on = _same(rows, found, *key)
    joined = rows.join(wanted, on).select(*_CONTEXT, "data", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            parts = []
            most, (first, _) = _unpair(_longs(batch.column("reach")))[0], _from_span(_longs(batch.column("span")))
            for i, j, data, bounds in text_groups(batch.column("data")):
                lists = batch.column("cells").slice(i, j - i)
                low, high = map(_longs, lists.flatten().flatten())
                row = np.repeat(np.repeat(np.arange(j - i), _longs(pc.list_value_length(lists))), high - low + 1)
                o = ranges(low.astype(np.int64), high.astype(np.int64) - low + 1)
                at = most[i:j][row] - o
                begin = first[i:j][row] + at
                parts.append((i + row, o, ByteHashes(data).of(bounds[row] + at, bounds[row] + at + width), _span(begin, begin + width, False)))
            if parts:
                rows_, o, rank, span = _joined(parts)
                yield _table(batch, _STRING, rows_, {"o": pa.array(o.astype(np.int32)), "rank": _signed(rank), "span": pa.array(span)})

    return joined.mapInArrow(run, _STRING_TYPES)


def _passages(contexts: DataFrame, passage: int) -> DataFrame:
    """Hashes of all strings of ``passage`` words in the contexts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            parts = []
            most, (first, _) = _unpair(_longs(batch.column("reach")))[0], _from_span(_longs(batch.column("span")))
            for i, j, data, bounds in text_groups(batch.column("data")):
                for starts, ends, hashes, windows, earlier in _words(data, bounds, passage):
                    begin, end = starts[windows], ends[windows + passage - 1]
                    row = np.searchsorted(bounds, begin, "right") - 1
                    shift = first[i:j][row] - bounds[row]
                    parts.append((i + row, most[i:j][row] - windows - earlier[row], hashes.of(windows, windows + passage), _span(begin + shift, end + shift, True)))
            if parts:
                rows_, o, rank, span = _joined(parts)
                yield _table(batch, _STRING, rows_, {"o": pa.array(o.astype(np.int32)), "rank": _signed(rank), "span": pa.array(span)})

    rows = contexts.where("span < 0").select(*_CONTEXT, "data")
    return rows.mapInArrow(run, _STRING_TYPES)


def _twice(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that two contexts have at least, as a table of their own: their sums are partial, and a join to it can be split."""
    return cut(rows.groupBy(*key).agg((F.min("context") != F.max("context")).alias("twice")).where("twice").select(*key))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, cell: int = CELL, passage: int = PASSAGE) -> DataFrame:
    """doc_id, text_key, span (see _span) of spans that cover all bytes of repeated strings (of words: all words of repeated passages); spans may overlap.

    docs: doc_id, text_key, data. passage = 0: no passages.
    """
    if not gram + cell < width:
        raise ValueError("width must exceed gram + cell")
    if passage and passage < PASSAGE_GRAM:
        raise ValueError(f"passage must be {PASSAGE_GRAM} words or more, or 0")
    found = cut(_anchor_rows(docs, width, gram, passage))
    ranks = cut(found.groupBy("h").agg(F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("alike")).where("n > 1").select("h", "alike"))
    twice = cut(found.join(ranks, "h"))
    drop(found, ranks)
    span = [*_KEY, "span"]
    inside = twice.where("alike").select(*span)

    # Contexts that differ: one of each kind goes on, and a kind found twice is settled.
    differ = twice.where(~F.col("alike"))
    kind = ["h", "context", "reach"]
    kinds = cut(differ.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct(*span)).alias("one")))
    settled = differ.join(kinds.where("n > 1").select(*kind), kind, "left_semi").select(*span)
    edges = kinds.select("one.*", *kind, (F.col("n") == 1).alias("once"))
    contexts = cut(_context_bytes(docs, edges))
    own = cut(_cells(contexts, width, cell))
    cells = cut(own.join(_twice(own, "h", "k", "core"), ["h", "k", "core"], "left_semi"))
    hulls = _twice(cells.where("hull is not null"), "h", "k", "hull")
    begin = F.shiftright("span", 32) + F.shiftright("reach", 32)
    covered = cells.where("once").join(hulls, ["h", "k", "hull"], "left_semi").select(*_KEY, F.shiftleft(begin - F.col("high"), 32).bitwiseOR(begin - F.col("low") + width).alias("span"))
    # Borders: a cell of one context is open; those that share its core must be ranked with it.
    open_cells = cut(cells.join(hulls, ["h", "k", "hull"], "left_anti").where("once").select("h", "k", "core").distinct())
    sides = cells.join(open_cells, ["h", "k", "core"], "left_semi")
    strings = _strings(contexts, sides, width)
    if passage:
        strings = strings.unionByName(_passages(contexts, passage))
    strings = cut(strings)
    border = strings.where("once").join(_twice(strings, "h", "o", "rank"), ["h", "o", "rank"], "left_semi").select(*span)
    spans = cut(inside.unionByName(settled).unionByName(covered).unionByName(border))
    drop(twice, kinds, contexts, own, cells, hulls, open_cells, strings)
    return spans


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("data"))


def _runs(rows: np.ndarray, spans: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows (texts of these sizes) that overlap or touch, as one: where each row's runs are, their begins and ends."""
    # The texts lie one after the other with a gap, so that runs of two don't touch.
    base = np.cumsum(sizes + 1) - (sizes + 1)
    first, last = (x + base[rows] for x in _from_span(spans))
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate(([True] * bool(len(first)), first[1:] > last[:-1])))
    begin, end = first[new], last[np.concatenate((new[1:], [len(first)])).astype(np.int64) - 1] if len(new) else last
    of = np.searchsorted(base, begin, "right") - 1
    return np.searchsorted(of, np.arange(len(sizes) + 1)), begin - base[of], end - base[of]


def dedup_bytes(docs: DataFrame, width: int = WIDTH, with_data: bool = False, passage: int = PASSAGE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (and kept, the bytes left, if asked for).

    Every byte is removed that lies in a string of width bytes which starts
    anywhere else too, also in the same document. n_passage_words counts the
    words in strings of ``passage`` words that stand anywhere else too,
    whatever their length in bytes; they are reported and stay. Null texts are
    empty; texts shorter than width keep all; of repeated rows each repeats
    the others, so long ones lose all; an empty table gives none. A long text
    is hashed in blocks of 4 MB, but must fit a task's memory as bytes; ids
    must be numbers.
    """
    rows = _prepared(docs)
    spans = repeated_spans(rows, width, passage=passage).groupBy(*_KEY).agg(F.collect_set("span").alias("spans"))
    found, on = _same(rows, spans, *_KEY)
    joined = rows.join(found, on, "left").select("doc_id", "data", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"] + ["kept"] * with_data
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + ", kept binary" * with_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            texts, lists = batch.column(1).to_pylist(), batch.column(2)
            spans, owners = _longs(lists.flatten()), np.repeat(np.arange(len(lists)), _longs(pc.list_value_length(lists).fill_null(0)))
            sizes = np.array([len(t) for t in texts], np.int64)
            (of, *gone), (of_said, *said) = (_runs(owners[kind], spans[kind], sizes) for kind in (spans >= 0, spans < 0))
            gone, said = ([x.tolist() for x in runs] for runs in (gone, said))
            for i, data in enumerate(texts):
                a, b = gone[0][of[i] : of[i + 1]], gone[1][of[i] : of[i + 1]]
                left = b"".join([data[x:y] for x, y in zip([0, *b], [*a, len(data)])]) if a else data
                n_words = sum(len(data[x:y].split()) for x, y in zip(*(s[of_said[i] : of_said[i + 1]] for s in said)))
                out.append((len(data), len(data) - len(left), len(a), hashlib.sha256(left).hexdigest(), n_words, left))
            columns = [pa.array([o[k] for o in out], t) for k, t in zip(range(5 + with_data), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return joined.mapInArrow(run, kinds)
