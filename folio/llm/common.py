"""Helpers shared by the corpus operators: cutting lineage and hashing byte ranges."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MULT = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]).astype(np.int8)


#: What empties the tables that a Python worker keeps from one task to the next.
KEPT: list[Callable[[], None]] = []


def release() -> None:
    """Empty these tables, in a step that has no use for them: workers live on from step to step."""
    for clear in KEPT:
        clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one, in local mode only: other machines couldn't see it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark.sparkContext, "_folio_dir", None)
        if not where:
            where = tempfile.mkdtemp(prefix="folio-")
            spark.sparkContext._folio_dir = where
    return where.rstrip("/")


def cut(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Later jobs start from the table, so a lost executor costs its own tasks
    only, and Spark knows the table's size when it plans joins. Files of few
    rows (0: any number) keep what a task reads at once small where rows are large.
    """
    path = f"{shared_dir(df.sparkSession)}/folio-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, running: str | None = None) -> DataFrame:
    """A table of df's rows with ``place``: 0, 1, 2 and so on in this order; with ``running``, also ``before``, the sum of that column over all earlier rows.

    Rows are sorted by ranges over all tasks; a range's rows are numbered as
    they are written, and the sizes of the ranges (one row for each) are added
    up. No task sees all rows, nor all rows of a key.
    """
    at = F.monotonically_increasing_id()
    table = cut(df.orderBy(*order).withColumn("_at", at)).withColumn("_part", F.shiftright("_at", 33))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(running).alias("_sum")] if running else []
    sizes = table.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), *sums)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_sum")[: 1 + bool(running)]])
    if running:
        table = table.withColumn("_own", F.coalesce(F.sum(running).over(own), F.lit(0)))
    placed = table.join(F.broadcast(starts), F.col("_part") == F.col("_p"))  # one row for each task of the sort
    placed = placed.withColumn("place", F.col("_n_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    if running:
        placed = placed.withColumn("before", F.col("_own") + F.col("_sum_before"))
    return placed.drop("_at", "_part", "_p", "_n_before", "_sum_before", "_own")


def drop_folder(session: SparkSession, where: str) -> None:
    """Delete a folder of tables in the shared folder."""
    path = session._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more."""
    for table in tables:
        for where in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if where.rpartition("/")[2].startswith("folio-"):
                drop_folder(table.sparkSession, where)


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns, so that no name of theirs can clash with one of ours), id, text (null is empty) and text_key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def unpacked(rows: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of the packed documents as they were; where changed, the text and (if there is one) n_chars are new."""
    row = F.col("row").withField("text", F.when(changed, text).otherwise(F.col("row.text").cast("string")))
    kinds = {f.name.lower(): f.dataType for f in rows.schema["row"].dataType.fields}
    if "n_chars" in kinds:
        row = row.withField("n_chars", F.when(changed, F.length(text).cast(kinds["n_chars"])).otherwise(F.col("row.n_chars")))
    return rows.select(row.alias("row")).select("row.*")


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers (from 0, ascending): what lies between them, put together, in linear time."""
    def kept(lines: Column) -> Column:
        gaps = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
        return F.array_join(F.flatten(gaps), "\n")

    # The array of one element holds the split text, which else would be split again for each gap.
    return F.get(F.transform(F.array(F.split(text, "\n")), kept), F.lit(0))


def word_places(data: bytes | np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between ASCII white space begin and end; none goes on in the next text, where bounds say that texts begin."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[::2], edges[1::2]
    if bounds is not None:
        within = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
        split = within[(space[within] == 0) & (space[within + 1] == 0)]
        starts, ends = (np.sort(np.concatenate((x, split))) for x in (starts, ends))
    return starts, ends


def word_blocks(data: bytes, k: int, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, ByteHashes, np.ndarray, np.ndarray]]:
    """Of every block of words, k - 1 of the next one included: where its words begin and end in the text, and hashes of its
    words joined by single spaces, with their begins and ends there. Only one block is hashed at a time."""
    starts, ends = word_places(data)
    for s in range(0, len(starts) - k + 1, size):
        own = slice(s, min(len(starts), s + size + k - 1))
        sizes = ends[own] - starts[own]
        to = np.cumsum(sizes + 1) - 1
        yield starts[own], ends[own], ByteHashes(b" ".join(data[starts[s] : ends[own][-1]].split())), to - sizes, to


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 and so on, counts[0] numbers; then those of the others."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def text_groups(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of a column of bytes, few enough to be hashed at once (or one longer row): (i, j, their bytes one after the other, where each begins and, at last, all end)."""
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text; a null text is empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that a task holds little of a batch as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def span_digest(spans: Column) -> Column:
    """kind:start:end of an array of struct<kind,start,end>, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# --- hashing of byte ranges -------------------------------------------------


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = pow(_MULT, -1, 1 << 64)
_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _CACHE or len(_CACHE["up"]) < n:
        size = max(n, 1 << 16)
        _CACHE["up"], _CACHE["down"] = _powers(size, _MULT), _powers(size, _INVERSE)
    return _CACHE["up"][:n], _CACHE["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """64-bit hashes of any ranges of a series of random 64-bit values, each in constant time after one pass."""

    def __init__(self, values: np.ndarray):
        up, self.down = _power_tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def unmixed(self, width: int) -> np.ndarray:
        """Of all windows of one width what is to be mixed for hashes: enough to order them by."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


class ByteHashes(Hashes):
    """Hashes of any byte ranges of one text."""

    def __init__(self, data: bytes | np.ndarray):
        super().__init__(_TABLE[np.frombuffer(data, dtype=np.uint8)])
