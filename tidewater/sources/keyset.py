"""A table that grows at its end, read by its key: in batch by hour, as a stream from where it stopped."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_FORMAT = "%Y-%m-%dT%H:%M:%S.%f"
HOUR = timedelta(hours=1)


@dataclass
class Bucket(InputPartition):
    """Rows of the half-open hour from ``start`` whose key is over ``after`` and at most ``until``."""

    start: datetime
    after: tuple[datetime, int] | None = None
    until: tuple[datetime, int] | None = None


class _Table:
    """The Parquet files behind a source, and the names of its key: a time and an id."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.time, self.id = options["path"], options.get("time", "ingest_time"), options.get("id", "source_id")
        self.schema = schema

    def _data(self) -> ds.Dataset:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        return ds.dataset(path, filesystem=system, format="parquet")

    def _scalar(self, value: datetime, data: ds.Dataset) -> pa.Scalar:
        kind = data.schema.field(self.time).type
        return pa.scalar(value, pa.timestamp("us")).cast(pa.timestamp(kind.unit)) if kind.tz is None else pa.scalar(value, pa.timestamp("us", "UTC")).cast(kind)

    def ends(self) -> tuple[datetime, datetime, int] | None:
        """First time, last time, and the largest id of the last time; from the files' statistics and the row groups that hold the last time."""
        data = self._data()
        low = high = None
        for piece in data.get_fragments():
            for group in piece.row_groups:
                try:
                    found = group.statistics.get(self.time)
                except pa.ArrowNotImplementedError:
                    found = None
                # 96-bit times have no statistics that can be read: there the column itself is.
                found = found or pc.min_max(piece.subset(row_group_ids=[group.id]).to_table(columns=[self.time]).column(0)).as_py()
                if found["min"] is None:
                    continue
                low = found["min"] if low is None or found["min"] < low else low
                high = found["max"] if high is None or found["max"] > high else high
        if high is None:
            return None
        plain = lambda t: t.replace(tzinfo=None) if isinstance(t, datetime) else t.to_pydatetime().replace(tzinfo=None)
        ids = data.to_table(columns=[self.id], filter=pc.field(self.time) == self._scalar(plain(high), data)).column(0)
        return plain(low), plain(high), pc.max(ids).as_py()

    def rows(self, bucket: Bucket) -> Iterator[pa.RecordBatch]:
        data = self._data()
        time, key = pc.field(self.time), pc.field(self.id)
        wanted = (time >= self._scalar(bucket.start, data)) & (time < self._scalar(bucket.start + HOUR, data))
        if bucket.after:
            at = self._scalar(bucket.after[0], data)
            wanted &= (time > at) | ((time == at) & (key > bucket.after[1]))
        if bucket.until:
            at = self._scalar(bucket.until[0], data)
            wanted &= (time < at) | ((time == at) & (key <= bucket.until[1]))
        shape = to_arrow_schema(self.schema)
        for batch in data.scanner(columns=self.schema.names, filter=wanted).to_batches():
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in shape], schema=shape)

    def buckets(self, first: datetime, last: datetime) -> Iterator[datetime]:
        at = first.replace(minute=0, second=0, microsecond=0)
        while at <= last:
            yield at
            at += HOUR


class KeysetReader(DataSourceReader):
    """One task an hour; bounds on the time choose the hours."""

    def __init__(self, table: _Table):
        self.table, self.low, self.high = table, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == (self.table.time,) and isinstance(value, datetime):
                value = value.replace(tzinfo=None)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low or value, value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high or value, value)
            # Spark applies every filter once more: hours are wider than bounds.
            yield f

    def partitions(self) -> list[Bucket]:
        ends = self.table.ends()
        if ends is None:
            return [Bucket(datetime(1970, 1, 1))]
        first, last = max(ends[0], self.low or ends[0]), min(ends[1], self.high or ends[1])
        return [Bucket(b) for b in self.table.buckets(first, last)] or [Bucket(datetime(1970, 1, 1))]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        yield from self.table.rows(partition)


class KeysetStream(DataSourceStreamReader):
    """The offset is the last key that was read: a time and an id, so rows of one time that come later are not lost."""

    def __init__(self, table: _Table):
        self.table = table

    def initialOffset(self) -> dict:
        return {"time": "", "id": -1}

    def latestOffset(self) -> dict:
        ends = self.table.ends()
        return {"time": ends[1].strftime(_FORMAT), "id": ends[2]} if ends else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        if not end["time"] or start == end:
            return []
        key = lambda o: (datetime.strptime(o["time"], _FORMAT), o["id"]) if o["time"] else None
        after, until = key(start), key(end)
        first = after[0] if after else self.table.ends()[0]
        return [Bucket(b, after, until) for b in self.table.buckets(first, until[0])]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        yield from self.table.rows(partition)


class KeysetSource(DataSource):
    """Format ``keyset``: options ``path`` (a URI or path of Parquet files), ``time`` and ``id`` (columns of the key); the schema is the reader's.

    New rows must have a larger key (time, then id) than all that have been read, as those of a feed with an ingest time do. Times are read as UTC.
    """

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def reader(self, schema: StructType) -> KeysetReader:
        return KeysetReader(_Table(self.options, schema))

    def streamReader(self, schema: StructType) -> KeysetStream:
        return KeysetStream(_Table(self.options, schema))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with bounds pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeysetSource)
