"""Importance resampling towards a target distribution, by hashed n-grams.

Integer word dictionary: the distinct words of the corpus get ids; n-grams
are tuples of ids; each distinct tuple's bytes are put together and hashed
once, over the whole corpus; counts and gains are joined back.

Documents are coded in blocks of bounded size, each with a dictionary of its
own: a word is in a block's dictionary once, however often the texts have it.
Only these dictionaries are shuffled, so no word, document or host makes a
hot key: a word has at most one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, drop, numbered, slices

#: Characters of text in a block, over the longest n-gram's length; and blocks in a file, so that a task never holds many.
BLOCK, BLOCKS_A_FILE = 8_000_000, 8
_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b in set(_SEPARATORS) else b for b in range(256))
_CODED = "target boolean, words array<string>, grams array<array<int>>, counts array<long>, doc_ids array<long>, sizes array<long>, n_words array<long>, features binary"


class Block:
    """Texts as numbers of a block's own words and n-grams."""

    def __init__(self, n: int):
        self.n, self.words, self.tuples = n, {}, {}
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.n_words: list[int] = []
        self.held, self.features = 0, []

    def _words(self, text: str, size: int = 1 << 20) -> list[int]:
        """A text is taken a piece at a time, so that its words aren't all objects at once."""
        data, known, out, at = text.encode().translate(_TO_WORDS), self.words, [], 0
        while at < len(data):
            end = data.find(b" ", at + size) if at + size < len(data) else -1
            piece = data[at:end] if end >= 0 else data[at:]
            out.append(np.array([known.setdefault(w, len(known)) for w in piece.split()], np.int64))
            at += len(piece)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = self._words(text or "")
        found, last = [words * 2], words * 2  # even numbers are words, odd ones longer n-grams
        for _ in range(1, self.n):
            pairs = zip(last[:-1].tolist(), words[len(words) - len(last) + 1 :].tolist())
            last = np.array([2 * self.tuples.setdefault(p, len(self.tuples)) + 1 for p in pairs], np.int64)
            found.append(last)
        found = np.concatenate(found)
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.n_words.append(len(words))
        self.features.append(found.astype(np.int32))
        self.held += len(text or "") + 1

    def _grams(self) -> list[list[int]]:
        """The words of each longer n-gram; shorter ones come first."""
        out: list[list[int]] = []
        for before, word in self.tuples:
            out.append([*(out[before // 2] if before % 2 else [before // 2]), word])
        return out

    def row(self, target: bool) -> pa.RecordBatch:
        """Features are numbered anew: words first, then longer n-grams."""
        raw = np.concatenate(self.features)
        features = (raw >> 1) + (raw & 1) * len(self.words)
        counts = np.bincount(features, minlength=len(self.words) + len(self.tuples))
        data = pa.compress(features.astype(np.int32).tobytes(), "zstd", asbytes=True)
        values = [target, [w.decode() for w in self.words], self._grams(), counts, self.ids, self.sizes, self.n_words, data]
        kinds = [pa.bool_(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), *[pa.list_(pa.int64())] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _CODED.split(", ")])


def _coded(texts: DataFrame, n: int, target: bool, block: int) -> DataFrame:
    """Rows of id and text as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Block(n)
        for batch in slices(batches, 100):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now.add(doc_id, text)
                if now.held * n >= block:
                    yield now.row(target)
                    now = Block(n)
        if now.ids:
            yield now.row(target)

    return texts.mapInArrow(run, _CODED)


def _tuples(blocks: DataFrame, words: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longer n-grams as tuples of word ids: (tuple, gram, s, t), each once with its text; and (block, pos, tuple)."""
    ids = places.join(words.select("word", "word_id"), "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "word_id"))).alias("w"))
    local = blocks.select("block", "target", "grams", F.size("words").alias("n"), F.expr("slice(counts, size(words) + 1, size(grams))").alias("counts"))
    whole = local.join(ids, "block").select("block", "target", "n", "counts", F.transform("grams", lambda g: F.transform(g, lambda i: F.get(F.col("w"), i)["word_id"])).alias("g"))
    each = cut(whole.select("block", "target", "n", F.posexplode(F.arrays_zip("g", "counts")).alias("pos", "x")).select("block", "target", (F.col("pos") + F.col("n")).alias("pos"), F.col("x.g").alias("tuple"), F.col("x.counts").alias("c")))
    distinct = cut(each.groupBy("tuple").agg(*_sums("c")).withColumn("tuple_id", F.monotonically_increasing_id()))
    parts = distinct.select("tuple_id", F.posexplode("tuple").alias("i", "word_id")).join(words.select("word", "word_id"), "word_id")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    grams = parts.groupBy("tuple_id").agg(text.alias("gram")).join(distinct, "tuple_id").select("tuple", "gram", "s", "t")
    return grams, each.select("block", "pos", "tuple")


def _sums(count: str) -> list[Column]:
    """Occurrences in the documents (s) and in the target (t)."""
    return [F.sum(F.when(~F.col("target"), F.col(count)).otherwise(F.lit(0))).alias("s"), F.sum(F.when(F.col("target"), F.col(count)).otherwise(F.lit(0))).alias("t")]


def gains(features: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of rows with gram, s, t, each distinct n-gram once: at most ``buckets`` rows."""
    per = features.groupBy(_bucket(F.col("gram"), buckets).alias("bucket")).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_ = features.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c, n: F.col(c).cast("double") + F.lit(float(n))
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return per.crossJoin(F.broadcast(all_)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram.cast("binary")) % buckets


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from rows of doc_ids, sizes, n_words, features, gains."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, sizes, n_words, features, gain = (batch.column(k)[i] for k in range(5))
            sizes = sizes.values.to_numpy(zero_copy_only=False)
            own = np.frombuffer(pa.decompress(features.as_py(), int(sizes.sum()) * 4, "zstd", asbytes=True), np.int32)
            sums = np.concatenate([[0], np.cumsum(gain.values.to_numpy(zero_copy_only=False)[own] if len(own) else np.zeros(0, np.int64))])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(sizes, pa.int64()), n_words.values, pa.array(sums[ends] - sums[ends - sizes], pa.int64())], ["doc_id", "n_features", "n_words", "weight"])


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, n_words, weight (the sum of gains over its features) of every row of docs; target has texts only."""
    text = F.col("text").cast("string").alias("text")
    sources = [_coded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), n, False, block), _coded(target.select(F.lit(0).cast("long").alias("doc_id"), text), n, True, block)]
    blocks = cut(sources[0].union(sources[1]).withColumn("block", F.monotonically_increasing_id()), BLOCKS_A_FILE)
    each = blocks.select("target", F.explode(F.arrays_zip("words", F.slice("counts", 1, F.size("words")).alias("counts"))).alias("x")).select("target", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = cut(each.groupBy("word").agg(*_sums("c")).withColumn("word_id", F.monotonically_increasing_id()))
    places = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    features, tables = words.select(F.col("word").alias("gram"), "s", "t"), [blocks, words]
    if n > 1:
        grams, longer = _tuples(blocks, words, places)
        grams = cut(grams)
        features, tables = features.union(grams.select("gram", "s", "t")), [*tables, grams]
    gain = cut(gains(features, buckets))
    paid = lambda df, gram: df.withColumn("bucket", _bucket(F.col(gram), buckets)).join(F.broadcast(gain), "bucket")  # noqa: E731  at most ``buckets`` rows
    known = cut(paid(words, "word").select("word", "gain"))
    tables += [gain, known]
    back = places.join(known, "word").select("block", "pos", "gain")
    if n > 1:
        back = back.union(longer.join(paid(grams, "gram").select("tuple", "gain"), "tuple").select("block", "pos", "gain"))
    per = back.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "gain"))), lambda x: x["gain"]).alias("gains"))
    own = blocks.where(~F.col("target")).join(per, "block", "left").select("doc_ids", "sizes", "n_words", "features", F.coalesce("gains", F.array().cast("array<long>")).alias("gains"))
    out = cut(own.mapInArrow(_weighed, "doc_id long, n_features long, n_words long, weight long"))
    drop(*tables)
    return out


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank (null where it isn't drawn).

    Words are lower-cased (A-Z) runs of ASCII letters, digits and all other
    characters beyond ASCII; features are their runs of 1 to n. ``percent`` of
    the documents with at least ``min_words`` words are drawn, by weight plus
    Gumbel noise from seed and doc_id; ties go to the smaller doc_id. A null
    or empty text has no features, weight 0 and no rank. Repeated rows count,
    and are drawn, as documents of their own; a null doc_id has the noise of
    an empty string. Whatever the target holds, an empty one included, gains
    are defined; an empty docs table gives no rows. A text takes a few bytes
    of memory for each of its words in its task.
    """
    rows = weights(docs, target, n, buckets, block)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = rows.withColumn("score", F.col("weight") + noise)
    able = scored.where(F.col("n_words") >= min_words)
    many = percent * able.count() // 100
    ranked = numbered(able, F.col("score").desc(), F.col("doc_id").asc()).withColumn("rank", F.when(F.col("place") < many, F.col("place") + 1))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).union(rest.select(columns))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id was drawn."""
    chosen = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"].cast("long") == F.col("_drawn"), "left_semi")
