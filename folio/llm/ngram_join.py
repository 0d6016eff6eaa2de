"""N-gram Jaccard join: a grouped prefix join over documents' shingle sets.

Shingles are ordered by a hash; a pair above the threshold shares one of the
first ``n - ceil(t n) + 1`` shingles of both sets, the prefix. Shingles in
over ``hot`` documents come last in the order, so that long posting lists are
not joined. Only shingles below a fixed hash bound (the sketch) are counted;
a document that has too few cold ones there to fill its prefix (very short
ones, and members of large groups of near copies) is joined again, among
such documents alone, over its whole set in the order of their counts.

1. Documents with equal sets are one node, whatever their number.
2. Nodes with equal prefixes and size collapse into a group. Groups that share
   a prefix shingle are group pairs, if their sizes and the places of the
   shingle in both orders still allow the threshold.
3. Group pairs expand to members, which must share as many cold sketch
   shingles as their sizes demand; what passes is verified on whole sets.
4. Lists of the second join have no bound. Their members first meet one hub
   of each list; then only members that the links so far leave in different
   components meet each other.

So no list of all pairs of a group of copies is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import ByteHashes, cut, documents, drop, packed, release, slices, word_blocks
from folio.llm.components import components

WORDS, PERCENT = 4, 85
HOT, SKETCH = 32, 0.25
#: A shingle in so many rows of a batch of rows is counted there already; one that is in over DEALT rows by these counts is dealt out.
OFTEN, DEALT = 8, 10_000
SALTS = 64


def shingles(data: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z in lower case; of the whole sequence if there are fewer words."""
    data = data.lower()  # bytes: A-Z only
    found = [hashes.of(begin[: len(begin) - k + 1], end[k - 1 :]) for _, _, hashes, begin, end in word_blocks(data, k)]
    if found:
        return np.unique(np.concatenate(found))
    few = b" ".join(data.split())
    return ByteHashes(few).of(np.array([0]), np.array([len(few)])) if few else np.zeros(0, np.uint64)


def _need(n: Column, m: Column, percent: int) -> Column:
    """Shingles that two sets of sizes n and m must share."""
    return F.ceil((n + m) * percent / (100 + percent)).cast("long")


def _sets(docs: DataFrame, k: int, sketch: float, hot: int) -> DataFrame:
    """doc_id, sid (digest of the set, null if empty), n, m (size of the sketch), heavy and heavy_rows (on one row of a batch:
    the shingles of its sketches that stand in ``OFTEN`` of its rows or more, and in how many)."""
    bound, least = np.uint64(int(sketch * 2**64)), min(OFTEN, hot + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            out, sketches = [], []
            for part in slices([batch]):
                for f in (shingles(t, k) for t in part.column(1).to_pylist()):
                    m = int(np.searchsorted(f, bound))
                    sketches.append(f[:m])
                    out.append((hashlib.blake2b(f.tobytes(), digest_size=16).digest() if len(f) else None, len(f), m, None, None))
            if out:
                token, count = np.unique(np.concatenate(sketches), return_counts=True)
                out[0] = (*out[0][:3], token[count >= least].view(np.int64), count[count >= least])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))))], ["doc_id", "sid", "n", "m", "heavy", "heavy_rows"])

    return docs.mapInArrow(run, "doc_id long, sid binary, n long, m long, heavy array<long>, heavy_rows array<long>")


def _heavy(sets: DataFrame, least: int) -> DataFrame:
    """h_token: shingles in over ``least`` rows by the counts of batches, which add up by partial sums."""
    counted = sets.select(F.explode(F.arrays_zip("heavy", "heavy_rows")).alias("h"))
    return counted.groupBy(F.col("h.heavy").alias("h_token")).agg(F.sum("h.heavy_rows").alias("c")).where(F.col("c") > least).select("h_token")


def _sketches(docs: DataFrame, k: int, sketch: float) -> DataFrame:
    """token, doc_id, at (place in the sketch) for every shingle of the sketches."""
    bound = np.uint64(int(sketch * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [f[: np.searchsorted(f, bound)] for f in (shingles(t, k) for t in batch.column(1).to_pylist())]
            sizes = [len(f) for f in found]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]))], ["token", "doc_id", "at"])

    return docs.mapInArrow(run, "token long, doc_id long, at int")


def _prefixes(rows: DataFrame, percent: int, hot: int) -> DataFrame:
    """doc_id, n, cold (size of the cold sketch), posts (shared shingles of the prefix and their places), shared (of the cold sketch), full (posts is the whole prefix), short."""
    post = pa.struct([("token", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for n, m, found in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                found = found or []
                token = np.array([f["token"] for f in found], dtype=np.int64)
                at = np.array([f["at"] for f in found], dtype=np.int64)
                is_hot = np.array([f["df"] for f in found], dtype=np.int64) > hot
                size = n - (percent * n + 99) // 100 + 1
                rank = at - (np.cumsum(is_hot) - is_hot)
                mine = ~is_hot & (rank < size)
                posts = [{"token": t, "at": r} for t, r in zip(token[mine], rank[mine])]
                cold = m - int(is_hot.sum())
                out.append((cold, posts, token[~is_hot], len(posts) == size, cold < size))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.list_(post), pa.list_(pa.int64()), pa.bool_(), pa.bool_())))], ["doc_id", "n", "cold", "posts", "shared", "full", "short"])

    return rows.mapInArrow(run, "doc_id long, n long, cold long, posts array<struct<token:long,at:long>>, shared array<long>, full boolean, short boolean")


def _listed(posts: DataFrame) -> DataFrame:
    """token, id, n, at of (id, n, posts)."""
    return posts.select("id", "n", F.explode("posts").alias("p")).select("p.token", "id", "n", "p.at")


def _may_link(xn: str, xat: str, yn: str, yat: str, percent: int) -> Column:
    """Sizes within the threshold, and as many shingles left behind a common one as must be shared.

    The first common shingle of a pair leaves most, so a pair that may link
    passes there.
    """
    small, large = F.least(xn, yn), F.greatest(xn, yn)
    return (small * 100 >= large * percent) & (F.least(F.col(xn) - F.col(xat), F.col(yn) - F.col(yat)) >= _need(F.col(xn), F.col(yn), percent))


def _side(listed: DataFrame, p: str, *more: str) -> DataFrame:
    return listed.select("token", F.col("id").alias(p), F.col("n").alias(f"{p}n"), F.col("at").alias(f"{p}at"), *[F.col(c).alias(f"{p}{c}") for c in more])


def _pairs(listed: DataFrame, percent: int) -> DataFrame:
    """Distinct x, y that share a prefix shingle and may link."""
    met = _side(listed, "x").join(_side(listed, "y"), "token").where((F.col("x") < F.col("y")) & _may_link("xn", "xat", "yn", "yat", percent))
    return met.select("x", "y").distinct()


def _hub_pairs(listed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of every list, its least id with each other that it may link to; the table of these ids first."""
    hubs = listed.groupBy("token").agg(F.min(F.struct("id", "n", "at")).alias("h"), F.count("*").alias("c")).where("c > 1").select("token", F.col("h.id").alias("x"), F.col("h.n").alias("xn"), F.col("h.at").alias("xat"))
    hubs = cut(hubs)  # a table, so that Spark can split a long list when it meets its hub
    met = _side(listed, "y").join(hubs, "token").where((F.col("x") < F.col("y")) & _may_link("xn", "xat", "yn", "yat", percent))
    return hubs, met.select("x", "y").distinct()


def _cross_pairs(listed: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of a list that are in different components so far; the table of such lists first."""
    labelled = listed.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    mixed = cut(labelled.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token"))
    labelled = cut(labelled.join(mixed, "token", "left_semi"))
    drop(mixed)
    met = _side(labelled, "x", "root").join(_side(labelled, "y", "root"), "token").where((F.col("x") < F.col("y")) & (F.col("xroot") != F.col("yroot")) & _may_link("xn", "xat", "yn", "yat", percent))
    return labelled, met.select("x", "y").distinct()


def _whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, tokens of the wanted (doc_id, sid)."""
    ids = wanted.select(F.col("doc_id").alias("w_id"), "sid")
    joined = docs.join(ids, docs["doc_id"] == F.col("w_id")).select("doc_id", "data", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t, k) for t in batch.column(1).to_pylist()]
            # Of rows that share an id, the one that has the set.
            same = [i for i, (f, s) in enumerate(zip(found, batch.column(2).to_pylist())) if hashlib.blake2b(f.tobytes(), digest_size=16).digest() == s]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same, pa.int64())), pa.array([found[i].view(np.int64) for i in same], pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return joined.mapInArrow(run, "doc_id long, tokens array<long>").dropDuplicates(["doc_id"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose whole sets are above the threshold."""
    xs = sets.select(F.col("doc_id").alias("x"), F.col("tokens").alias("xs"))
    ys = sets.select(F.col("doc_id").alias("y"), F.col("tokens").alias("ys"))
    joined = pairs.join(xs, "x").join(ys, "y").select("x", "y", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _short_lists(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """token, id, n, at of the prefixes of short documents, over whole sets, rare shingles first; and the table of counts."""
    tokens = sets.select("doc_id", F.explode("tokens").alias("token"))
    df = cut(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    shared = tokens.join(df, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    sizes = sets.select("doc_id", F.size("tokens").cast("long").alias("n"))
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # Shingles found once come before all others and join nothing.
    once = F.col("n") - F.size("shared")
    posts = F.transform(F.slice("shared", 1, F.greatest(size - once, F.lit(0)).cast("int")), lambda s, i: F.struct(s["token"].alias("token"), (i + once).alias("at")))
    return _listed(sizes.join(shared, "doc_id").where(size > once).select(F.col("doc_id").alias("id"), "n", posts.alias("posts"))), df


def links(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, hot: int = HOT, sketch: float = SKETCH) -> tuple[DataFrame, ...]:
    """(rows: doc_id, sid, n; nodes: node, sid, n; links: a, b; links between their components: a, b; roots of components by the former).

    A node is the least doc_id of a set. Links inside a component may be left
    out where it is connected already.
    """
    data = documents(docs).select("doc_id", F.col("text").cast("binary").alias("data"))
    rows = cut(_sets(data, k, sketch, hot))
    nodes = cut(rows.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("m").alias("m")))
    # A shingle that is hot by the counts of batches needs no further count, and its rows are dealt out if they are many: at
    # most one shingle for DEALT postings is. Of any other a batch whose rows aren't counted has OFTEN - 1 at most, so a
    # count has 7 of every 10,000 rows and DEALT more.
    heavy = cut(_heavy(rows, max(hot, DEALT)))
    sketches = _sketches(data, k, sketch)
    sketches = sketches.join(heavy, sketches["token"] == heavy["h_token"], "left").withColumn("salt", F.when(F.col("h_token").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    count = F.count("*").over(Window.partitionBy("token", "salt"))
    counted = sketches.withColumn("df", F.when(F.col("h_token").isNull(), count).otherwise(F.lit(hot + 1).cast("long"))).where("df > 1")
    counted = cut(counted.select("token", "doc_id", "at", "df"))
    drop(heavy)
    lists = counted.where("doc_id is not null").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("at", "token", "df"))).alias("found"))
    all_rows = nodes.join(lists, nodes["node"] == lists["doc_id"], "left").select(F.col("node").alias("doc_id"), "n", "m", "found")
    prefixes = cut(_prefixes(all_rows, percent, hot).where("short or size(posts) > 0"))
    drop(counted)

    # Groups of equal prefixes and sizes; a prefix with a shingle of its own is a group of its own.
    key = F.when(F.col("full"), F.xxhash64("posts.token")).otherwise(F.col("doc_id"))
    keyed = prefixes.where("size(posts) > 0").withColumn("key", key)
    groups = cut(keyed.groupBy("full", "n", "key").agg(F.min("doc_id").alias("id"), F.first("posts").alias("posts")))
    members = cut(keyed.join(groups.select("full", "n", "key", "id"), ["full", "n", "key"]).select("id", "doc_id"))
    pairs = _pairs(_listed(groups), percent)
    xs, ys = members.select(F.col("id").alias("x"), F.col("doc_id").alias("a")), members.select(F.col("id").alias("y"), F.col("doc_id").alias("b"))
    between = pairs.join(xs, "x").join(ys, "y").select("a", "b")
    within = members.join(members.select("id", F.col("doc_id").alias("b")), "id").where("doc_id < b").select(F.col("doc_id").alias("a"), "b")
    candidates = between.union(within)
    side = lambda p: prefixes.select(F.col("doc_id").alias(p), F.col("n").alias(f"{p}n"), F.col("cold").alias(f"{p}c"), F.col("shared").alias(f"{p}s"))
    need = _need(F.col("an"), F.col("bn"), percent)
    least = F.greatest(F.col("ac") - (F.col("an") - need), F.col("bc") - (F.col("bn") - need))
    passed = cut(candidates.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("as", "bs")) >= least).select(F.col("a").alias("x"), F.col("b").alias("y")))
    drop(groups, members)

    short = prefixes.where("short").select("doc_id")
    wanted = passed.select(F.col("x").alias("doc_id")).union(passed.select("y")).union(short).distinct()
    sets = cut(_whole_sets(data, wanted.join(nodes.select(F.col("node").alias("doc_id"), "sid"), "doc_id"), k))
    lists, shared = _short_lists(sets.join(short, "doc_id", "left_semi"), percent)
    lists = cut(lists)
    drop(shared, prefixes)
    hubs, met = _hub_pairs(lists, percent)
    found = cut(_verified(passed.union(met).distinct(), sets, percent))
    drop(hubs, passed)
    roots = components(found)
    mixed, met = _cross_pairs(lists, roots, percent)
    across = cut(_verified(met, sets, percent))
    drop(mixed, lists, sets)
    return rows, nodes, found, across, roots


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, hot: int = HOT, sketch: float = SKETCH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), is_first (of its component).

    Two documents link when 100 * intersection >= percent * union of their
    sets. Documents without words (null and empty texts) and rows without a
    doc_id are linked with nothing; fewer than k words are one shingle; rows
    with one doc_id are one document; an empty table gives none. A long text
    is hashed in blocks; its set of 64-bit hashes must fit a task's memory.
    Sets are compared by these hashes; ids must be numbers.
    """
    rows, nodes, found, across, roots = links(docs, k, percent, hot, sketch)
    if not across.isEmpty():
        drop(roots)
        roots = components(found.union(across))
    drop(found, across)
    top = roots.select(F.col("node").alias("r_node"), "root")
    placed = cut(nodes.join(top, nodes["node"] == F.col("r_node"), "left").select(F.col("sid").alias("p_sid"), F.coalesce("root", "node").alias("component_id")))
    drop(roots, nodes)
    out = rows.join(placed, rows["sid"] == F.col("p_sid"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("is_first", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the first of their component, all columns; of rows with equal doc_id and text, one. Rows without a doc_id stay."""
    labelled = jaccard_components(docs, **options)
    copies = cut(labelled.where(~F.col("is_first")).select(F.col("doc_id").alias("copy_id")).distinct())
    drop(labelled)
    rows = packed(docs).select("row", "id", "text_key")
    left = rows.join(copies, rows["id"] == copies["copy_id"], "left_anti")
    # Repeated rows are few or none; only they are gathered by key.
    twice = cut(rows.groupBy("id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("t_id"), F.col("text_key").alias("t_key")))
    same = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key"))
    once = left.join(twice, same, "left_anti")
    first = left.join(twice, same, "left_semi").dropDuplicates(["id", "text_key"])
    return once.unionByName(first).select("row.*")
