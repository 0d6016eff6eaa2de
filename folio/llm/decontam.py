"""Benchmark decontamination with a positional inverted index.

Words of the benchmark are counted over all documents. In every window of a
benchmark item the rarest term (by that count) is its anchor. For the anchor
terms the documents give postings: term, document, position and the words
around it. A posting meets the item positions of its term; the lists of the
neighbouring terms are intersected at their offsets from there, to both sides,
and every phrase of window length in the matched run is a hit. A window holds
its own rarest term, so none is missed.

Near matches: words of a window in order, all but ``slop`` of them, within a
range of window + slop words. Of any slop + 1 words of a window one is matched,
so the postings of its slop + 1 rarest terms meet it, within the offsets that
the range allows, and none is missed either.

Counts and postings are tables of a ``PositionalIndex``. One that is kept
answers further benchmarks: the documents are read again only for words that
it hasn't counted and anchor terms that it holds no postings of.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import cut, documents, drop, drop_folder, packed, shared_dir, slices

#: Bytes of words after A-Z in lower case: digits, letters and every byte of characters past ASCII; others become spaces.
_WORD_BYTES = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
WINDOW = 13
#: Anchor terms that a task looks for at once; more of them are taken in that many more passes over the documents.
TERMS_PER_PASS = 500_000
#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 200_000
#: Bytes of anchors, as measured, up to which they are sent to the postings; beyond that Spark shuffles both.
SENT_BYTES = 32 << 20
#: Words of a window that a near match may lack, and those it may have besides; windows of under 13 words are allowed one for each six after the first.
SLOP = 2


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id (as string), item_key, words (as bytes); equal rows once."""
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), found.cast("array<binary>").alias("words"))
    return items.where(F.size("words") > 0).withColumn("item_key", F.xxhash64("words")).dropDuplicates(["item_id", "item_key"])


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n of blocks of texts."""

    def counted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["term", "n"])

    total: Counter = Counter()
    for batch in slices(batches):
        for data in batch.column(0).to_pylist():
            total.update(words(data))
            if len(total) > COUNTED_WORDS:
                yield counted(total)
                total.clear()
    yield counted(total)


def _postings(docs: DataFrame, wanted: set[bytes], side: int) -> DataFrame:
    """doc_id, row_key, n_words, postings of the wanted terms with the ``side`` words to both sides; null past the ends."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = "doc_id long, row_key long, n_words long, postings array<struct<term:binary,pos:int,around:array<binary>>>"
    posting = pa.struct([("term", pa.binary()), ("pos", pa.int32()), ("around", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, pad = shared.value, [None] * side
        for batch in slices(batches):
            counts, lists = [], []
            for data in batch.column(2).to_pylist():
                found = words(data)
                counts.append(len(found))
                at = [] if terms.isdisjoint(found) else [i for i, t in enumerate(found) if t in terms]
                wide = [*pad, *found, *pad] if at else []
                lists.append([{"term": found[i], "pos": i, "around": wide[i : i + 2 * side + 1]} for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(posting))], ["doc_id", "row_key", "n_words", "postings"])

    return docs.select("doc_id", "row_key", F.col("text").cast("binary")).mapInArrow(run, schema)


class PositionalIndex:
    """Counts and postings of terms over one table of documents.

    Its tables lie under ``path``, by default a new folder in the shared one.
    ``PositionalIndex(docs, path=...)`` of an earlier ``path`` goes on with what
    is there; ``docs`` must be the documents it was made of, and ``side`` the same.
    Words that are in reach of a posting: ``side`` to each side, so windows
    may have up to side + 1 words, and near matches up to side + 1 - 2 * slop.

    A batch of postings counts once its terms are written, after it; a batch
    that was broken off is written anew.
    """

    _KINDS = {"counts": "term binary, n long", "terms": "term binary", "postings": "doc_id long, row_key long, n_words long, postings array<struct<term:binary,pos:int,around:array<binary>>>"}

    def __init__(self, docs: DataFrame, side: int = WINDOW - 1 + 2 * SLOP, terms_per_pass: int = TERMS_PER_PASS, path: str | None = None):
        self.spark, self.side, self.terms_per_pass = docs.sparkSession, side, terms_per_pass
        self.docs = documents(docs).withColumn("row_key", F.xxhash64("text"))
        self.path = path or f"{shared_dir(self.spark)}/folio-{uuid.uuid4().hex}"
        self._scratch: list[DataFrame] = []
        self._batches = {kind: self._found(kind) if path else 0 for kind in ("counts", "terms")}

    def _found(self, kind: str) -> int:
        return self.spark.read.parquet(f"{self.path}/{kind}").agg(F.max("batch")).head()[0] + 1

    def _read(self, kind: str) -> DataFrame:
        """All batches that are whole."""
        n = self._batches["counts" if kind == "counts" else "terms"]
        if not n:
            return self.spark.createDataFrame([], self._KINDS[kind])
        paths = [f"{self.path}/{kind}/batch={k}" for k in range(n)]
        return self.spark.read.schema(self._KINDS[kind]).parquet(*paths)

    def _add(self, kind: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def counts(self, terms: DataFrame) -> DataFrame:
        """term, n over all documents (0 too) of these terms and earlier ones; only new ones are counted."""
        new = cut(terms.select("term").distinct().join(self._read("counts"), "term", "left_anti"))
        if not self._batches["counts"] or not new.isEmpty():
            # Counts of blocks, of the new terms only: Spark knows the size of their table and sends it to the tasks where it is small.
            blocks = self.docs.select(F.col("text").cast("binary")).mapInArrow(_block_counts, "term binary, n long")
            found = blocks.join(new, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
            self._add("counts", self._batches["counts"], new.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")))
            self._batches["counts"] += 1
        drop(new)
        return self._read("counts")

    def postings(self, terms: DataFrame) -> DataFrame:
        """doc_id, row_key, term, pos, around of all terms held, after those of these terms are added."""
        new = cut(terms.select("term").distinct().join(self._read("terms"), "term", "left_anti"))
        passes = -(-new.count() // self.terms_per_pass)
        if not self._batches["terms"]:
            passes = max(1, passes)  # gives the numbers of words at least
        for k in range(passes):
            part = new.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k)
            batch = self._batches["terms"]
            rows = _postings(self.docs, {bytes(r["term"]) for r in part.toLocalIterator()}, self.side)
            self._add("postings", batch, rows if batch == 0 else rows.where(F.size("postings") > 0))
            self._add("terms", batch, part)
            self._batches["terms"] += 1
        drop(new)
        p = F.col("p")
        return self._read("postings").select("doc_id", "row_key", F.explode("postings").alias("p")).select("doc_id", "row_key", p["term"].alias("term"), p["pos"].alias("pos"), p["around"].alias("around"))

    def lengths(self) -> DataFrame:
        """doc_id, row_key, n_words of every document; the first batch holds them all."""
        return self.spark.read.schema(self._KINDS["postings"]).parquet(f"{self.path}/postings/batch=0").select("doc_id", "row_key", "n_words")

    def _cut(self, rows: DataFrame) -> DataFrame:
        """A table of a benchmark's words that goes with forget()."""
        self._scratch.append(cut(rows))
        return self._scratch[-1]

    def forget(self) -> None:
        """Delete the benchmarks' own tables, once the answers are written; counts and postings stay."""
        drop(*self._scratch)
        self._scratch.clear()

    def drop(self) -> None:
        self.forget()
        drop_folder(self.spark, self.path)

    def phrases(self, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
        """doc_id, row_key, item_id, first and last word of runs of exact windows."""
        if self.side < window - 1:
            raise ValueError("the index doesn't reach far enough for this window")
        anchors = self._cut(_anchors(self._ranked(benchmark), window))
        met = self.postings(anchors).join(_sent(anchors), "term")
        # Offset-adjusted intersection: how far the words around agree, to the left and to the right.
        around = F.slice("around", self.side - window + 2, 2 * window - 1)
        agree = F.zip_with(around, F.col("terms"), lambda a, b: F.coalesce(a == b, F.lit(False)))
        met = met.withColumn("agree", agree)
        left, right = _agreeing(F.reverse(F.slice("agree", 1, window - 1)), window), _agreeing(F.slice("agree", window + 1, window - 1), window)
        met = met.withColumn("left", left).withColumn("right", right).where(F.col("left") + F.col("right") + 1 >= F.col("span"))
        return met.select("doc_id", "row_key", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"))

    def near(self, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
        """As phrases, for near matches."""
        if self.side < window - 1 + 2 * slop:
            raise ValueError("the index doesn't reach far enough for this window and slop")
        anchors = self._cut(_near_anchors(self._ranked(benchmark), window, slop))
        met = self.postings(anchors).join(_sent(anchors), "term")
        # A word of the window that isn't around the posting is lacking wherever it stands in it.
        around = F.slice("around", F.lit(self.side + 1) - F.col("place") - 2 * F.col("slop"), F.size("terms") + 4 * F.col("slop"))
        met = met.where(F.size(F.array_except("terms", around)) <= F.col("slop")).select("doc_id", "row_key", "pos", "around", "item_id", "slop", "place", "terms")
        return met.mapInPandas(_near_runs(self.side), "doc_id long, row_key long, item_id string, first int, last int")

    def _ranked(self, benchmark: DataFrame) -> DataFrame:
        """item_id, item_key, length, place, term, n of every word of the items."""
        placed = self._cut(_items(benchmark).select("item_id", "item_key", F.size("words").alias("length"), F.posexplode("words").alias("place", "term")))
        return placed.join(self.counts(placed), "term")


def _sent(anchors: DataFrame) -> DataFrame:
    """The anchors, to be sent to all tasks if their measured size allows it."""
    size = F.aggregate("terms", F.lit(100).cast("bigint"), lambda n, t: n + 16 + F.coalesce(F.length(t), F.lit(0)))
    measured = anchors.agg(F.sum(size + F.length("term") + F.length("item_id"))).head()[0] or 0
    return F.broadcast(anchors) if measured <= SENT_BYTES else anchors


def _agreeing(agree: Column, window: int) -> Column:
    """How many are true before the first that is false."""
    at = F.array_position(agree, F.lit(False)).cast("int")
    return F.when(at == 0, F.lit(window - 1)).otherwise(at - 1)


def _anchors(ranked: DataFrame, window: int) -> DataFrame:
    """term, item_id, span (words of a phrase to be found), terms (around, null past the ends) for the rarest place of every window.

    Windows slide over one item's words in order; an item is one group.
    """
    item = Window.partitionBy("item_id", "item_key").orderBy("place")
    span = F.least(F.lit(window), F.col("length"))
    rarest = F.min(F.struct("n", "term", "place")).over(item.rowsBetween(0, window - 1))
    rows = ranked.withColumn("span", span).withColumn("rarest", F.when(F.col("place") <= F.col("length") - span, rarest["place"]))
    chosen = F.array_contains(F.collect_set("rarest").over(item.rowsBetween(1 - window, 0)), F.col("place"))
    past = lambda n: F.array_repeat(F.lit(None).cast("binary"), F.greatest(F.lit(0), n))
    around = F.collect_list("term").over(item.rowsBetween(1 - window, window - 1))
    terms = F.concat(past(F.lit(window - 1) - F.col("place")), around, past(F.col("place") + window - F.col("length")))
    rows = rows.withColumn("chosen", chosen).withColumn("terms", terms)
    return rows.where(F.col("chosen") & (F.col("n") > 0)).select("term", "item_id", "span", "terms").distinct()


def _near_anchors(ranked: DataFrame, window: int, slop: int) -> DataFrame:
    """term, item_id, slop and place in the window, terms (the window) for the slop + 1 rarest places of every window; equal windows of an item once."""
    item = Window.partitionBy("item_id", "item_key").orderBy("place")
    span = F.least(F.lit(window), F.col("length"))
    few = F.least(F.lit(slop), F.floor((span - 1) / 6)).cast("int")
    inside = F.collect_list(F.struct("n", "term")).over(item.rowsBetween(0, window - 1))
    rows = ranked.select("item_id", "place", "length", span.alias("span"), few.alias("slop"), inside.alias("inside")).where(F.col("place") <= F.col("length") - F.col("span"))
    order = F.array_sort(F.transform("inside", lambda x, i: F.struct(x["n"].alias("n"), x["term"].alias("term"), i.alias("at"))))
    rows = rows.select("item_id", "slop", F.col("inside.term").alias("terms"), F.inline(F.slice(order, 1, F.col("slop") + 1)))
    return rows.where("n > 0").select("term", "item_id", "slop", F.col("at").alias("place"), "terms").distinct()


def near_ranges(words: list, window: list, slop: int, first: int, last: int) -> list[tuple[int, int]]:
    """Least ranges of words, beginning at first to last, with all but slop of the window's words in order; no longer than window + slop.

    The common subsequence is counted with one bit for each word of the window.
    """
    masks: dict = {}
    for i, w in enumerate(window):
        masks[w] = masks.get(w, 0) | 1 << i
    full, need, longest = (1 << len(window)) - 1, len(window) - slop, len(window) + slop
    out, after = [], len(words)
    for a in range(last + 1, first - 1, -1):
        if a >= len(words) or words[a] not in masks:
            continue
        bits, end = full, len(words)
        # The range from a + 1 on ends at ``after``; the one from a ends there at the latest.
        for b in range(a, min(after + 1, a + longest, len(words))):
            m = bits & masks.get(words[b], 0)
            if m:
                bits = ((bits + m) | (bits - m)) & full
                if len(window) - bits.bit_count() >= need:
                    end = b
                    break
        if end < after:
            if a <= last:
                out.append((a, end))
            after = end
    return out


def _near_runs(side: int):
    """Near matches of postings that have met windows: doc_id, row_key, item_id, first and last word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = set()
            for doc, key, pos, around, item, slop, place, terms in rows.itertuples(index=False):
                start = side - place - 2 * slop
                near = around[start : start + len(terms) + 4 * slop].tolist()
                for a, b in near_ranges(near, terms.tolist(), slop, 0, place + 2 * slop):
                    out.add((doc, key, item, pos - side + start + a, pos - side + start + b))
            yield pd.DataFrame(list(out), columns=["doc_id", "row_key", "item_id", "first", "last"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, terms_per_pass: int = TERMS_PER_PASS, index: PositionalIndex | None = None) -> DataFrame:
    """One row per document: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    Null or empty texts have no words and no hits; null or empty items have no
    windows; repeated documents give repeated rows; items with equal texts
    both count; an empty benchmark hits nothing. Ids of documents are cast to
    long. A text of any length is one task's; its words are in memory there.

    With ``index``, that one is asked and kept; else one is made for this call.
    """
    own = index or PositionalIndex(docs, window - 1, terms_per_pass)
    hits = own.phrases(benchmark, window)
    return _finished(_per_document(own.lengths(), hits, share), own, index)


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, share: int = 20, terms_per_pass: int = TERMS_PER_PASS, index: PositionalIndex | None = None) -> DataFrame:
    """One row per document: doc_id, row_key, n_words, n_near, n_near_items, near_items_sha256, near_contaminated.

    As contamination, with near matches for hits; exact hits are near matches too.
    """
    own = index or PositionalIndex(docs, window - 1 + 2 * slop, terms_per_pass)
    hits = own.near(benchmark, window, slop)
    found = _per_document(own.lengths(), hits, share)
    return _finished(found.withColumnsRenamed({"n_hit": "n_near", "n_items": "n_near_items", "items_sha256": "near_items_sha256", "contaminated": "near_contaminated"}), own, index)


def _finished(found: DataFrame, own: PositionalIndex, index: PositionalIndex | None) -> DataFrame:
    """The result as a table; an index made for it goes."""
    table = cut(found)
    if index is None:
        own.drop()
    else:
        own.forget()
    return table


def _per_document(base: DataFrame, hits: DataFrame, share: int) -> DataFrame:
    hits = hits.distinct()
    # Union of the runs of a document: a run adds what lies past the furthest end before it.
    key = ["doc_id", "row_key"]
    per_doc = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")), lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"].cast("long") - F.greatest(s["end"], r["a"].cast("long") - 1))).alias("n"), F.greatest(s["end"], r["b"].cast("long")).alias("end")))
    per_doc = per_doc.select(*[F.col(k).alias(f"h_{k}") for k in key], covered["n"].alias("h_hit"), F.size("items").cast("long").alias("h_items"), F.sha2(F.array_join("items", ","), 256).alias("h_sha"))
    joined = base.join(per_doc, base["doc_id"].eqNullSafe(F.col("h_doc_id")) & (base["row_key"] == F.col("h_row_key")), "left")
    n_hit = F.coalesce("h_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "row_key", "n_words", n_hit.alias("n_hit"), F.coalesce("h_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("h_sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns, whatever their names."""
    bad = contamination(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct()
    rows = packed(docs).select("row", "id", "text_key")
    return rows.join(bad, rows["id"].eqNullSafe(F.col("bad_id")) & (rows["text_key"] == F.col("bad_key")), "left_anti").select("row.*")
