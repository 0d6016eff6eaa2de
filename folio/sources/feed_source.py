"""Feed files as a data source: requests for identifiers reach the reader.

Files are dealt into folders by a hash of the identifier. The reader takes
over filters on ``base_id``: folders that can't hold a wanted identifier are
no partitions, and of the other files only wanted feeds reach Spark. Feeds are
decoded by Spark (``corpus.read_feeds``), not here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

NAME, SCHEMA, END_OF_FEED = "folio_feeds", "base_id string, xml string", "\x1e"
_ID = re.compile(r"<entry>\s*<id>\s*https?://[^<]*/abs/([^<]*?)(?:v\d+)?\s*</id>")
_TESTS = {
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v),
}


@dataclass
class FeedFile(InputPartition):
    path: str


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.shards = options["path"], int(options["shards"])
        self.limit = int(options["limit"]) if "limit" in options else None
        self.tests: list[tuple[type, object]] = []
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over all comparisons of base_id with values; nothing is left for Spark to test in those."""
        for f in filters:
            if getattr(f, "attribute", None) != ("base_id",) or not isinstance(f, (IsNotNull, *_TESTS)):
                yield f
                continue
            if isinstance(f, IsNotNull):
                self.tests.append((IsNotNull, None))
                continue
            value = frozenset(f.value) if isinstance(f, In) else f.value
            self.tests.append((type(f), value))
            if isinstance(f, (EqualTo, EqualNullSafe, In)):
                found = set(value) if isinstance(f, In) else {value}
                self.wanted = found if self.wanted is None else self.wanted & found

    def partitions(self) -> list[FeedFile]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        shards = None if self.wanted is None else {f"shard={zlib.crc32(i.encode()) % self.shards}" for i in self.wanted if i is not None}
        files = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [FeedFile(f.path) for f in files if f.is_file and re.match(r"part-", f.base_name) and (shards is None or f.path.split("/")[-2] in shards)] or [FeedFile("")]

    def _matches(self, base_id: str | None) -> bool:
        return not self.tests or base_id is not None and all(_TESTS[kind](base_id, value) for kind, value in self.tests if kind is not IsNotNull)

    def read(self, partition: FeedFile) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        left, rows = self.limit, []
        for feed in self._feeds(fs.FileSystem.from_uri(self.path)[0], partition.path) if partition.path else ():
            found = _ID.search(feed)
            base_id = found[1] if found else None
            if left != 0 and self._matches(base_id):
                rows.append((base_id, feed))
                left = left and left - 1
            if len(rows) >= 500:
                yield self._batch(rows)
                rows = []
            if left == 0:
                break
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["base_id", "xml"])

    @staticmethod
    def _feeds(system, path: str, size: int = 1 << 20) -> Iterator[str]:
        """One feed after the other; a file is never held as a whole."""
        end, rest = END_OF_FEED.encode(), b""
        with system.open_input_stream(path) as stream:
            while block := stream.read(size):
                *feeds, rest = (rest + block).split(end)
                yield from (f.decode() for f in feeds)
        if rest.strip():
            yield rest.decode()


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))


def write_feeds(feeds: DataFrame, path: str, shards: int = 16) -> None:
    """Rows of base_id (null for answers that are no feed) and xml as feed files, dealt by base_id."""
    dealt = feeds.select("xml", (F.crc32(F.col("base_id").cast("binary")) % shards).alias("shard"))
    dealt.write.partitionBy("shard").option("lineSep", END_OF_FEED).mode("overwrite").text(path)


def read_feed_files(spark: SparkSession, path: str, shards: int = 16, limit: int | None = None) -> DataFrame:
    """base_id and xml of feed files. With a limit, no file gives more than so many feeds, and all together no more."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
    source = spark.read.format(NAME).option("path", path).option("shards", shards)
    return source.load() if limit is None else source.option("limit", limit).load().limit(limit)
