"""Best-fit packing of documents into sequences, by a grouping genetic algorithm on islands.

Pieces are dealt into groups of bounded size. A group's packings evolve on
several islands: crossover injects whole well-filled bins of one packing into
another, bins that held the same pieces are dissolved, and what is displaced
goes to the bins where it fits best. After a few generations the best packing
of an island migrates to the next one. Groups that reach a lower bound are
done. The emptiest bins of sixteen groups then meet in a group of the next
level, until one group is left, so parting them costs next to no sequences.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.bpe import Kept, WordBpe, load
from folio.llm.common import cut, documents, drop, numbered, slices

#: Pieces in a group, and groups that meet in one of the next level.
GROUP, MEET = 4096, 16
ISLANDS, POPULATION, GENERATIONS, ROUNDS = 2, 4, 4, 3
_STOPS = frozenset(".,;:!?")
_STATE = "group long, island int, lengths array<int>, population array<array<int>>, n_bins long, squares long, solved boolean"


# --- pieces -------------------------------------------------------------------


class ChunkIds:
    """Ids of white-space separated chunks as little-endian bytes, by the tokenizers library; kept for frequent chunks."""

    def __init__(self, bpe: WordBpe, size: int = 300_000):
        self.bpe, self.kept, self.model = bpe, Kept(size), bpe.library.model

    def words(self, words: list[str]) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for w in words for t in self.model.tokenize(w)])

    def chunk(self, chunk: str) -> bytes:
        found = self.kept.get(chunk)
        if found is None:
            if chunk[-1:] in _STOPS and chunk[:-1].isalpha():  # letters and a stop are words of their own
                found = self.chunk(chunk[:-1]) + self.chunk(chunk[-1])
            else:
                found = self.words([chunk] if chunk.isascii() and chunk.isalpha() else self.bpe.pretokens(chunk))
            if len(chunk) <= 64:
                self.kept.put(chunk, found)
        return found

    def blocks(self, text: str) -> Iterator[bytes]:
        """The ids of a text, a block of it at a time."""
        make = self.chunk
        for kind, items, _ in self.bpe.parts(text):
            if kind == "special":
                yield self.bpe.special[items[0]].to_bytes(4, "little")
            elif kind == "words":
                yield self.words(items)
            else:
                get = self.kept.young.get
                yield b"".join([get(c) or make(c) for c in items])


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """One for each Python worker."""
    return ChunkIds(load(path))


def pieces_of(text: str, ids: ChunkIds, capacity: int, end_id: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids) of a text with end_id behind it."""
    held, piece = bytearray(), 0
    for block in (*ids.blocks(text), end_id.to_bytes(4, "little")):
        held += block
        while len(held) > 4 * capacity:
            yield piece, piece * capacity, capacity, zlib.crc32(held[: 4 * capacity])
            del held[: 4 * capacity]
            piece += 1
    yield piece, piece * capacity, len(held) // 4, zlib.crc32(held)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document with end_id behind it, cut only where it is longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(path)
        for batch in slices(batches):
            rows = [(i, *p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in pieces_of(t, ids, capacity, end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- packings of one group ------------------------------------------------------


class Packing:
    """Bins of items with their free room."""

    def __init__(self, bins: list[list[int]], free: list[int]):
        self.bins, self.free = bins, free

    def rank(self, capacity: int) -> tuple[int, int]:
        """Fewer bins first; then better filled ones: the sum of squares of what they hold."""
        return len(self.bins), -sum([(capacity - f) ** 2 for f in self.free])


def fit(items: list[int], lengths: list[int], bins: list[list[int]], free: list[int], capacity: int) -> Packing:
    """Each item, in order, into the fullest of these bins that has room for it, or into a new one."""
    by_free, mask = defaultdict(list), 0  # a bit for every amount of room that a bin has
    for b, f in enumerate(free):
        by_free[f].append(b)
        mask |= 1 << f
    for i in items:
        n = lengths[i]
        roomy = mask >> n
        if roomy:
            f = n + (roomy & -roomy).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                mask ^= 1 << f
        else:
            f, b = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[b].append(i)
        free[b] = f - n
        by_free[f - n].append(b)
        mask |= 1 << (f - n)
    return Packing(bins, free)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by items of over half a bin with what can't go beside them."""
    ordered = sorted(lengths)
    sums, half = [0, *accumulate(ordered)], bisect_right(ordered, capacity // 2)
    best = -(-sums[-1] // capacity)
    for least in {0, *ordered[:half]}:
        # Items above ``most`` are alone; those of over half a bin are in bins of their own, with room for smaller ones from ``least`` on.
        most = bisect_right(ordered, capacity - least)
        room = (most - half) * capacity - (sums[most] - sums[half])
        small = sums[half] - sums[bisect_left(ordered, least)]
        best = max(best, len(ordered) - half + max(0, -(-(small - room) // capacity)))
    return best


def crossover(a: Packing, b: Packing, lengths: list[int], capacity: int, r: random.Random) -> Packing:
    """Whole well-filled bins of a, then b's bins that share no item with them; displaced items go where they fit best."""
    ranked = sorted(range(len(a.bins)), key=a.free.__getitem__)
    chosen = [x for x in ranked[: max(1, len(ranked) * 2 // 3)] if r.random() < 0.5]
    taken = {i for x in chosen for i in a.bins[x]}
    stay = [x for x in range(len(b.bins)) if taken.isdisjoint(b.bins[x])]
    kept = set(stay)
    displaced = [i for x in range(len(b.bins)) if x not in kept for i in b.bins[x] if i not in taken]
    bins = [list(a.bins[x]) for x in chosen] + [list(b.bins[x]) for x in stay]
    free = [a.free[x] for x in chosen] + [b.free[x] for x in stay]
    return fit(sorted(displaced, key=lengths.__getitem__, reverse=True), lengths, bins, free, capacity)


def mutate(p: Packing, lengths: list[int], capacity: int, r: random.Random) -> Packing:
    """The emptiest bins and a few others are dissolved; their items go where they fit best."""
    ranked = sorted(range(len(p.bins)), key=p.free.__getitem__, reverse=True)
    gone = {*ranked[: 1 + len(ranked) // 50], *r.sample(ranked, min(len(ranked), 1 + len(ranked) // 25))}
    displaced = [i for x in gone for i in p.bins[x]]
    r.shuffle(displaced)
    displaced.sort(key=lambda i: lengths[i] * r.uniform(0.9, 1.1), reverse=True)
    rest = [x for x in range(len(p.bins)) if x not in gone]
    return fit(displaced, lengths, [list(p.bins[x]) for x in rest], [p.free[x] for x in rest], capacity)


def packing_of(assignment: list[int], lengths: list[int], capacity: int) -> Packing:
    bins: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(assignment):
        bins[b].append(i)
    return Packing(list(bins.values()), [capacity - sum([lengths[i] for i in x]) for x in bins.values()])


def assignment_of(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(p.bins):
        for i in items:
            out[i] = b
    return out


def evolve(lengths: list[int], population: list[list[int]], capacity: int, generations: int, size: int, seed: int) -> tuple[list[Packing], bool]:
    """The best packings after some generations, best first, and whether the first is proven to be best. The given ones take part; without any, best fit of falling lengths and disturbed orders begin."""
    r, n, bound = random.Random(seed), len(lengths), lower_bound(lengths, capacity)
    rank = lambda p: p.rank(capacity)
    found = [packing_of(a, lengths, capacity) for a in population]
    if not population:
        found.append(fit(sorted(range(n), key=lengths.__getitem__, reverse=True), lengths, [], [], capacity))
    while len(found) < size and min(map(rank, found))[0] > bound:
        found.append(fit(sorted(range(n), key=lambda i: lengths[i] * r.uniform(0.8, 1.2), reverse=True), lengths, [], [], capacity))
    found.sort(key=rank)
    for _ in range(generations):
        if len(found[0].bins) <= bound:
            break
        parents = found[:size]
        for _ in range(size):
            a, b = r.choice(parents), r.choice(parents)
            found.append(mutate(a, lengths, capacity, r) if a is b else crossover(a, b, lengths, capacity, r))
        found = sorted(found, key=rank)[:size]
    return found[:size], len(found[0].bins) <= bound


# --- groups on islands ------------------------------------------------------------


def _islands(state: DataFrame, capacity: int, seed: int) -> DataFrame:
    """A few generations on every island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            lengths = row["lengths"]
            found, solved = evolve(lengths, row["population"], capacity, GENERATIONS, POPULATION, hash((row["group"], row["island"], seed)))
            n_bins, squares = found[0].rank(capacity)
            keep = found[:1] if solved else found
            values = [row["group"], row["island"], lengths, [assignment_of(p, len(lengths)) for p in keep], n_bins, squares, solved]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _STATE.split(", ")])

    return state.select("group", "island", "lengths", "population").mapInArrow(run, _STATE)


def _packed_groups(groups: DataFrame, capacity: int) -> DataFrame:
    """group, bins: the best packing found for each group (group, lengths, population), as the bin of every item."""
    spark = groups.sparkSession
    # One island each; groups that are solved at once, mostly by best fit, need no others.
    state = cut(_islands(groups.withColumn("island", F.lit(0)), capacity, 0))
    best, tables = [state], [state]
    for turn in range(1, ROUNDS):
        open_ = state.where("not solved")
        if open_.isEmpty():
            break
        if turn == 1:
            open_ = open_.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
            state = open_.withColumn("population", F.when(F.col("island") == 0, F.col("population")).otherwise(F.slice("population", 1, 1)))
        else:
            # Islands of a group of which one is solved end; the best packing of each moves to the next.
            left = state.groupBy("group").agg(F.max("solved").alias("over")).where("not over").select("group")
            open_ = open_.join(left, "group")
            guests = open_.select("group", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("population", 1, 1).alias("guest"))
            state = open_.join(guests, ["group", "island"]).withColumn("population", F.concat("population", "guest"))
        state = cut(_islands(state.repartition(spark.sparkContext.defaultParallelism * 4, "group", "island"), capacity, turn))
        best.append(state)
        tables.append(state)
    first = F.get("population", F.lit(0))
    out = cut(reduce(DataFrame.union, best).groupBy("group").agg(F.min_by(first, F.struct("n_bins", "squares", "island")).alias("bins")))
    drop(*tables)
    return out


def _dealt(capacity: int, last: bool):
    """Items of packed groups (group, gids, lengths, bins) as rows: group, gid, bin, offset, length, and whether the bin is among the emptiest, which go on to the next level unless it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            p = packing_of(row["bins"], row["lengths"], capacity)
            emptiest, on, room = sorted(range(len(p.bins)), key=p.free.__getitem__, reverse=True), set(), GROUP // MEET
            for b in [] if last else emptiest:
                room -= len(p.bins[b])
                if 20 * p.free[b] < capacity or room < 0:
                    break
                on.add(b)
            rows = []
            for b, items in enumerate(p.bins):
                at = 0
                for i in items:
                    rows.append((row["group"], row["gids"][i], b, at, row["lengths"][i], b in on))
                    at += row["lengths"][i]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], ["group", "gid", "bin", "offset", "length", "on"])

    return run


def places(short: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """gid, sequence_id, offset of pieces (gid, length) that are shorter than capacity."""
    items = numbered(short.select("gid", "length"), F.xxhash64("gid").asc(), F.col("gid").asc())
    items = cut(items.select(F.floor(F.col("place") / group).alias("group"), "gid", "length", F.lit(None).cast("int").alias("old")))
    level, out = 0, []
    while not items.isEmpty():
        last = items.agg(F.max("group")).head()[0] == 0
        own = items.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("gid", "length", "old"))).alias("i"))  # at most ``group`` items each
        seeds = F.when(F.get("i", F.lit(0))["old"].isNull(), F.array().cast("array<array<int>>")).otherwise(F.array(F.col("i.old")))
        own = cut(own.select("group", F.col("i.gid").alias("gids"), F.transform("i", lambda x: x["length"].cast("int")).alias("lengths"), seeds.alias("population")))
        packed = _packed_groups(own.select("group", "lengths", "population"), capacity)
        dealt = cut(own.join(packed, "group").select("group", "gids", "lengths", "bins").mapInArrow(_dealt(capacity, last), "group long, gid long, bin int, offset int, length int, on boolean"))
        drop(own, packed)
        number = F.shiftleft(F.lit(level).cast("long"), 56) + F.shiftleft(F.col("group"), 13) + F.col("bin")
        out.append(dealt.where("not on").select("gid", number.alias("sequence_id"), F.col("offset").cast("long").alias("offset")))
        # Sixteen groups meet; their bins stay told apart, so that the packing as it is takes part.
        old = ((F.col("group") % MEET) * (1 << 13) + F.col("bin")).cast("int")
        items = cut(dealt.where("on").select(F.floor(F.col("group") / MEET).alias("group"), "gid", F.col("length").cast("long").alias("length"), old.alias("old")))
        level += 1
    return reduce(DataFrame.union, out) if out else short.sparkSession.createDataFrame([], "gid long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone, a piece of one token. Repeated
    rows and rows without a doc_id are documents of their own; an empty table
    gives no rows. Long texts are encoded and cut in blocks. Pieces of full
    length are sequences by themselves and have negative numbers.
    """
    all_ = cut(pieces(docs, path, capacity, end_id).withColumn("gid", F.monotonically_increasing_id()))
    found = places(all_.where(F.col("length") < capacity), capacity, group)
    full = all_.where(F.col("length") == capacity).select("gid", (-F.col("gid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return all_.join(found.union(full), "gid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
