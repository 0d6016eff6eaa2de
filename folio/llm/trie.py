"""The trie of conversations: a node for every distinct sequence of first turns.

Turns are encoded by a dictionary of distinct (role, text). Conversations with
the same turns are one sequence with a weight. Radix partitioning from the
first turn on: a bucket of sequences is parted by their next turn, and every
part is a node and a smaller bucket. A bucket that still has many turns goes
into the next round; one that is small enough goes to one task, where multikey
quicksort finishes it; one with a single sequence is a chain, made from its
rows where they are. Sums of subtrees are taken inside buckets, and then added
up round by round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, drop, numbered

#: Turns in a bucket that one task finishes.
LOCAL = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]


# --- turns and sequences ------------------------------------------------------


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256, by which turns are told apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return own.withColumn("key", turn_key(F.col("role"), F.col("text")))


def encoded(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables: turns in order (conv_id, place, turn_id, n_bytes, before: bytes of all earlier rows), and the dictionary (key, turn_id)."""
    own = _turns(conversations).select("conv_id", "turn", "key", F.octet_length("text").cast("long").alias("n_bytes"))
    words = cut(own.select("key").distinct().withColumn("turn_id", F.monotonically_increasing_id()))
    coded = own.join(words, "key")
    return numbered(coded, F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("key").asc(), running="n_bytes").select("conv_id", "place", "turn_id", "n_bytes", "before"), words


def sequences(own: DataFrame, every: int = 1, heads: int = 1) -> tuple[DataFrame, DataFrame]:
    """Tables: turns of the sequences (seq, depth from 1, turn_id, n_bytes, tail: bytes from this turn on), and all sequences (seq, len).

    With ``every`` over 1 a conversation c is rebuilt: it begins with the first
    h turns of conversation c - c % every, and goes on after its own first h;
    h is crc32(c) % heads.
    """
    own = cut(own)
    most = heads - 1
    convs = own.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.min("before").alias("base"), F.sum("n_bytes").alias("total"))
    placed = cut(own.join(convs, "conv_id").select("conv_id", (F.col("place") - F.col("first") + 1).alias("p"), "turn_id", "n_bytes", "n", "total", (F.col("total") - F.col("before") + F.col("base")).alias("tail")))
    head = F.transform(F.sort_array(F.collect_list(F.when(F.col("p") <= most, F.struct("p", "turn_id", "n_bytes")))), lambda x: F.struct(x["turn_id"].alias("turn_id"), x["n_bytes"].alias("n_bytes")))
    known = cut(placed.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("total").alias("total"), head.alias("head")))  # at most heads - 1 turns a conversation
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n_bytes"])
    first = lambda c: F.slice(c, 1, F.col("h").cast("int"))
    other = known.select(F.col("conv_id").alias("from"), F.col("head").alias("theirs"))
    plan = known.withColumn("h", h).withColumn("from", F.col("conv_id") - F.col("conv_id") % every).join(other, "from", "left")
    plan = plan.withColumn("prefix", F.coalesce(first(F.col("theirs")), F.array().cast(plan.schema["theirs"].dataType)))
    plan = cut(plan.select("conv_id", "h", "prefix", F.size("prefix").alias("m"), (F.col("total") - size(first(F.col("head")))).alias("rest"), (F.size("prefix") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    begun = plan.select("conv_id", "prefix", "rest", F.posexplode("prefix").alias("i", "x"))
    begun = begun.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "x.turn_id", "x.n_bytes", (size(F.expr("slice(prefix, i + 1, size(prefix))")) + F.col("rest")).alias("tail"))
    gone_on = placed.join(plan.select("conv_id", "h", "m"), "conv_id").where("p > h").select("conv_id", (F.col("m") + F.col("p") - F.col("h")).alias("depth"), "turn_id", "n_bytes", "tail")
    rows = cut(begun.union(gone_on).withColumnRenamed("conv_id", "seq"))
    drop(own, placed, known)
    return rows, plan.select(F.col("conv_id").alias("seq"), F.col("len").cast("long").alias("len"))


# --- equal sequences ------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id) to (seq, first, ids): up to ``size`` decimal ids, joined by commas."""
    rows = chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
    out: list[tuple[int, int, str]] = []
    for seq, members in groupby(rows, lambda r: r[0]):
        ids = (i for _, i in members)
        for one in ids:
            some = [one, *(i for _, i in zip(range(size - 1), ids))]
            out.append((seq, one, ",".join(map(str, some))))
            if len(out) >= 500:
                yield _batch(out, ("seq", "first", "ids"), (pa.int64(), pa.int64(), pa.string()))
                out = []
    if out:
        yield _batch(out, ("seq", "first", "ids"), (pa.int64(), pa.int64(), pa.string()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, first, ids) to (seq, ends_sha256), chunk by chunk."""
    rows = chain.from_iterable(zip(b.column(0).to_pylist(), b.column(2).to_pylist()) for b in batches)
    out: list[tuple[int, str]] = []
    for seq, chunks in groupby(rows, lambda r: r[0]):
        digest, gap = hashlib.sha256(), b""
        for _, ids in chunks:
            digest.update(gap + ids.encode())
            gap = b","
        out.append((seq, digest.hexdigest()))
        if len(out) >= 5000:
            yield _batch(out, ("seq", "ends"), (pa.int64(), pa.string()))
            out = []
    if out:
        yield _batch(out, ("seq", "ends"), (pa.int64(), pa.string()))


def _batch(rows: list[tuple], names: Iterable[str], kinds: Iterable[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def distinct_sequences(rows: DataFrame, lens: DataFrame) -> DataFrame:
    """A table of the distinct sequences: seq (the smallest conversation with it), len, w (conversations) and ends, the digest of their ids.

    Sequences are told apart by two 64-bit hashes over all their turns. Ids of
    one sequence are sorted by ranges over all tasks and reach the digest in
    chunks, as it has to see them in order.
    """
    both = [F.bit_xor(F.xxhash64(F.lit(salt), "depth", "turn_id")).alias(name) for salt, name in ((1, "a"), (2, "b"))]
    signed = cut(lens.join(rows.groupBy("seq").agg(*both), "seq", "left").select(F.col("seq").alias("conv_id"), "len", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")))
    groups = cut(signed.groupBy("len", "a", "b").agg(F.min("conv_id").alias("seq"), F.count("*").alias("w")))
    members = signed.join(groups, ["len", "a", "b"]).select("seq", "conv_id")
    sorted_ = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    chunks = sorted_.mapInArrow(_chunks, "seq long, first long, ids string").repartition("seq").sortWithinPartitions("seq", "first")
    out = cut(groups.select("seq", "len", "w").join(chunks.mapInArrow(_digests, "seq long, ends string"), "seq"))
    drop(signed, groups)
    return out


# --- nodes ----------------------------------------------------------------------


class _Nodes:
    """Nodes of one bucket, in an order in which parents come first."""

    def __init__(self, parent: int):
        self.parent, self.rows, self.above = parent, [], []

    def add(self, above: int, conv: int, depth: int, w: int, turn: int, n_bytes: int, ends: str) -> int:
        self.rows.append([conv, depth, self.rows[above][0] if above >= 0 else self.parent, w, 0, 0, (w - 1) * n_bytes, ends, turn])
        self.above.append(above)
        return len(self.rows) - 1

    def summed(self) -> list[list]:
        """Children, leaves and saved bytes of subtrees."""
        for row, above in zip(reversed(self.rows), reversed(self.above)):
            row[5] = row[5] or 1
            if above >= 0:
                up = self.rows[above]
                up[4], up[5], up[6] = up[4] + 1, up[5] + row[5], up[6] + row[6]
        return self.rows


def quicksort(items: list[tuple[int, int, str, list[tuple[int, int]]]], depth: int, parent: int) -> list[list]:
    """Nodes of a bucket whose sequences share a turn at ``depth``. Items, by seq: seq, w, ends, (turn_id, n_bytes) from that turn on.

    Multikey quicksort: items are parted into those below, at and above a
    pivot's turn; those at it are a node, and go on with the next turn.
    """
    nodes, stack = _Nodes(parent), [(items, 0, -1)]
    while stack:
        some, j, above = stack.pop()
        if len(some) == 1:
            seq, w, ends, turns = some[0]
            for k in range(j, len(turns)):
                above = nodes.add(above, seq, depth + k, w, *turns[k], ends if k == len(turns) - 1 else NOTHING)
            continue
        pivot = some[len(some) // 2][3][j]
        at = [x for x in some if x[3][j] == pivot]
        ended = [x for x in at if len(x[3]) == j + 1]
        node = nodes.add(above, at[0][0], depth + j, sum([x[1] for x in at]), *pivot, ended[0][2] if ended else NOTHING)
        parts = [([x for x in some if x[3][j] < pivot], j, above), ([x for x in some if x[3][j] > pivot], j, above), ([x for x in at if len(x[3]) > j + 1], j + 1, node)]
        stack += [part for part in parts if part[0]]
    return nodes.summed()


_LOCAL_TYPES = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.bool_()]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole buckets, sorted by bucket, seq and depth: bucket, up, top, seq, w, ends (at a sequence's last turn), turn_id, n_bytes."""
    rows = chain.from_iterable(zip(*[c.to_pylist() for c in b.columns]) for b in batches)
    out: list[tuple] = []
    for _, bucket in groupby(rows, lambda r: r[0]):
        items = []
        for _, own in groupby(bucket, lambda r: r[3]):
            turns = list(own)
            items.append((turns[0][3], turns[0][4], turns[-1][5], [(t[6], t[7]) for t in turns]))
        up, top = turns[0][1], turns[0][2]
        out += [(*node, node[1] == top) for node in quicksort(items, top, up)]
        if len(out) >= 5000:
            yield _batch(out, [*_NODE, "is_top"], _LOCAL_TYPES)
            out = []
    if out:
        yield _batch(out, [*_NODE, "is_top"], _LOCAL_TYPES)


def nodes(rows: DataFrame, seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """All nodes of sequences (rows: seq, depth, turn_id, n_bytes, tail; seqs: as distinct_sequences has them)."""
    spark = rows.sparkSession
    root = seqs.agg(F.min("seq").alias("conv"), F.sum("w").alias("n")).head()
    if root["conv"] is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE))
    uppers = [spark.createDataFrame([(root["conv"], None, root["n"], 0, None)], "node long, up long, n_convs long, n_bytes long, turn_id long")]
    active, ended, done, depth = seqs.withColumn("node", F.lit(root["conv"]).cast("long")), [], [], 0
    # One round a depth, as long as a bucket of several sequences has more than ``local`` turns left.
    while True:
        ended.append(active.where(F.col("len") == depth).select("node", "ends"))
        step = cut(active.where(F.col("len") > depth).join(rows.where(F.col("depth") == depth + 1).select("seq", "turn_id", "n_bytes"), "seq"))
        left = F.sum(F.col("len") - depth)
        parts = cut(step.groupBy("node", "turn_id").agg(F.min("seq").alias("child"), F.sum("w").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), (F.count("*") == 1).alias("alone"), ((left > local) & (F.count("*") > 1)).alias("large")))
        dealt = cut(step.join(parts.select("node", "turn_id", "child", "alone", "large"), ["node", "turn_id"]).select("seq", "len", "w", "ends", "child", "alone", "large", F.col("node").alias("up")))
        drop(step)
        depth += 1
        done.append(dealt.where("not large").withColumn("top", F.lit(depth).cast("long")))
        large = parts.where("large").select(F.col("child").alias("node"), F.col("node").alias("up"), "n_convs", "n_bytes", "turn_id")
        if large.isEmpty():
            break
        uppers.append(large)
        active = dealt.where("large").select("seq", "len", "w", "ends", F.col("child").alias("node"))
    owned = reduce(DataFrame.union, done).join(rows, "seq").where(F.col("depth") >= F.col("top"))
    last = F.col("depth") == F.col("len")
    at_end = F.when(last, F.col("ends")).otherwise(F.lit(NOTHING))
    chains = owned.where("alone").select(
        F.col("seq").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("up")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("w").alias("n_convs"), (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * F.col("tail")).alias("saved_tokens"), at_end.alias("ends_sha256"), "turn_id", (F.col("depth") == F.col("top")).alias("is_top"),
    )
    shared = owned.where("not alone").select(F.col("child").alias("bucket"), "up", "top", "seq", "w", F.when(last, F.col("ends")).alias("ends"), "turn_id", "n_bytes", "depth")
    sorted_ = shared.repartition("bucket").sortWithinPartitions("bucket", "seq", "depth").drop("depth")
    kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE) + ", is_top boolean"
    below = cut(chains.union(sorted_.mapInArrow(_finished, kinds)))
    tops = cut(below.where("is_top").groupBy(F.col("parent_conv_id").alias("node"), "depth").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")))
    out, deeper = [below.select(_NODE)], None
    for d in range(len(uppers) - 1, -1, -1):
        parts = tops.where(F.col("depth") == d + 1).select("node", "c", "l", "s")
        if deeper is not None:
            parts = parts.union(deeper.select(F.col("parent_conv_id").alias("node"), F.lit(1).cast("long"), "n_leaves", "saved_tokens"))
        sums = parts.groupBy("node").agg(F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s"))
        none = F.lit(0).cast("long")
        own = uppers[d].join(sums, "node", "left").join(ended[d], "node", "left")
        deeper = cut(own.select(
            F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("c", none).alias("n_children"), F.coalesce("l", F.lit(1).cast("long")).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("s", none)).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"), "turn_id",
        ))
        out.append(deeper)
    return reduce(DataFrame.union, out)


def prefix_trie(conversations: DataFrame, every: int = 1, heads: int = 1, local: int = LOCAL, texts: bool = False) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes in its subtree), saved_tokens (over the subtree: members but one, times bytes of the last text), ends_sha256 (of the ids of members that end there), turn_id; with ``texts`` also role and text of its last turn.

    Conversations are the rows of a conv_id by turn, nulls first; rows of equal
    turn are in the order of a hash of role and text, so repeated rows stay
    and have a fixed order. A null role or text is empty; rows with a null
    conv_id belong to no conversation and are left out. Without conversations
    there are no nodes. ``every`` and ``heads``: see ``sequences``. A
    conversation or group of copies of any size is never gathered in a task;
    only the digest of a group's ids is made in one, chunk by chunk.
    """
    own, words = encoded(conversations)
    rows, lens = sequences(own, every, heads)
    found = nodes(rows, distinct_sequences(rows, lens), local)
    if texts:
        said = _turns(conversations).groupBy("key").agg(F.min("role").alias("role"), F.min("text").alias("text"))
        found = found.join(words.join(said, "key").select("turn_id", "role", "text"), "turn_id", "left")
    return found
