"""Feeds as merged storage: batches are appended, merged in the background, and read as one table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.positions import replace_by_key

Combine = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has committed a version of the manifest in the meantime."""


class _Folder:
    """Small files of a folder, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(""))) if self.fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A file that appears as a whole; False if there is one of that name."""
        self.fs.mkdirs(self._at(""))
        part = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._at(name)) or not self.fs.rename(part, self._at(name)):
            self.fs.delete(part, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class MergedStore:
    """A table by month in segments, each a folder of files; a manifest names the segments that count.

    ``append`` adds a segment for each month of a batch. ``merge`` makes one of several segments of a month and a level, a level higher, by
    ``combine``, which must give the same rows for a merged segment as for its parts. Readers take the last manifest: they see the same
    rows before, during and after a merge. A manifest is a small file that appears as a whole under the next version number, so what dies
    before that leaves no trace but folders that ``vacuum`` removes. A commit that finds the number taken is refused.

    A month in one merged segment is read as it is; segments that may repeat each other's keys are combined as they are read. Files are dealt by month
    and bucket of ``cluster``'s first column and sorted by ``cluster``, so that row groups hold few keys and short times.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, combine: Combine, cluster: Iterable[str], month: str = "event_time", buckets: int = 8):
        self.spark, self.path, self.schema, self.combine, self.cluster, self.month, self.buckets = spark, path.rstrip("/"), schema, combine, list(cluster), month, buckets
        self.manifests = _Folder(spark, f"{self.path}/manifest")

    def manifest(self) -> dict:
        names = [n for n in self.manifests.names() if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.manifests.read(names[-1])) if names else {"version": 0, "segments": [], "batches": {}}

    def _commit(self, base: dict, segments: list[dict], batches: dict) -> None:
        version = base["version"] + 1
        if not self.manifests.create(f"{version:012d}.json", json.dumps({"version": version, "segments": segments, "batches": batches})):
            raise Conflict(f"version {version} is there already")

    def _write(self, df: DataFrame, folder: str) -> list[str]:
        """Files by month in a new folder; the months that got some."""
        placed = df.select(*self.schema.names).withColumn("year_month", F.date_format(self.month, "yyyy-MM"))
        bucket = F.pmod(F.xxhash64(self.cluster[0]), F.lit(self.buckets))
        placed.repartition("year_month", bucket).sortWithinPartitions("year_month", *self.cluster).write.partitionBy("year_month").parquet(f"{self.path}/data/{folder}")
        return [n.partition("=")[2] for n in _Folder(self.spark, f"{self.path}/data/{folder}").names() if n.startswith("year_month=")]

    def append(self, batch: DataFrame, feed: str, number: int) -> bool:
        """Add a batch of a feed; False, and nothing done, if it or a later one is there already (a batch that runs again)."""
        base = self.manifest()
        if base["batches"].get(feed, -1) >= number:
            return False
        folder = f"{feed}-{number}-{uuid.uuid4().hex}"
        found = [{"folder": folder, "month": m, "level": 0} for m in self._write(batch, folder)]
        self._commit(base, base["segments"] + found, {**base["batches"], feed: number})
        return True

    def _read(self, segments: list[dict]) -> DataFrame:
        paths = [f"{self.path}/data/{s['folder']}/year_month={s['month']}" for s in segments]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, months: Iterable[str] | None = None) -> DataFrame:
        """All rows, or those of some months (``yyyy-MM``): only their segments are opened."""
        wanted = None if months is None else set(months)
        segments = [s for s in self.manifest()["segments"] if wanted is None or s["month"] in wanted]
        alone = [s for s in segments if s["level"] > 0 and sum(t["month"] == s["month"] for t in segments) == 1]
        rest = [s for s in segments if s not in alone]
        if not rest:
            return self._read(alone)
        combined = self.combine(self._read(rest)).select(*self.schema.names)
        return self._read(alone).unionByName(combined) if alone else combined

    def merge(self, fan_in: int = 4, whole: bool = False) -> int:
        """Merge each month's segments of a level where there are ``fan_in`` of them, level by level; with ``whole`` all segments of a month. Returns the number of merges."""
        done = 0
        while True:
            base = self.manifest()
            groups: dict[tuple, list[dict]] = {}
            for s in base["segments"]:
                groups.setdefault((s["month"], 0 if whole else s["level"]), []).append(s)
            ready = [g for g in groups.values() if len(g) >= (2 if whole else fan_in) or (whole and g[0]["level"] == 0)]
            if not ready:
                return done
            taken, made = [s for g in ready for s in g], []
            levels: dict[int, list[dict]] = {}
            for g in ready:
                levels.setdefault(max(s["level"] for s in g) + 1, []).extend(g)
            for level, segments in sorted(levels.items()):
                folder = f"merged-{level}-{uuid.uuid4().hex}"
                made += [{"folder": folder, "month": m, "level": level} for m in self._write(self.combine(self._read(segments)), folder)]
            self._commit(base, [s for s in base["segments"] if s not in taken] + made, base["batches"])
            done += len(ready)

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests but the last ``keep``, and folders that none of those names; only while no batch or merge is being written. Returns the folders removed."""
        names = [n for n in self.manifests.names() if n.endswith(".json") and not n.startswith(".")]
        named = {s["folder"] for n in names[-keep:] for s in json.loads(self.manifests.read(n))["segments"]}
        data = _Folder(self.spark, f"{self.path}/data")
        gone = [n for n in data.names() if n not in named]
        for n in gone:
            data.remove(n)
        for n in names[:-keep]:
            self.manifests.remove(n)
        return len(gone)

    def feed(self, stream: DataFrame, feed: str, checkpoint: str, prepare: Combine | None = None) -> StreamingQuery:
        """Append the micro-batches of a stream until its input is read; ``prepare`` turns a batch into rows of the table."""

        def write(batch: DataFrame, number: int) -> None:
            self.append(prepare(batch) if prepare else batch, feed, number)

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def positions_store(spark: SparkSession, path: str, schema: T.StructType) -> MergedStore:
    """Fixes of which the last ingested of each vessel, time and source id counts."""
    return MergedStore(spark, path, schema, lambda df: replace_by_key(df, ["vessel_id", "event_time", "source_id"], "ingest_time"), ["vessel_id", "event_time"])


#: The state of an hour that can be merged: what is needed to go on counting.
HOURLY = T.StructType([T.StructField("vessel_id", T.LongType()), T.StructField("hour", T.TimestampType()), T.StructField("fixes", T.LongType()), T.StructField("min_lat", T.DoubleType()), T.StructField("max_lat", T.DoubleType()), T.StructField("last_id", T.LongType())])


def hourly_states(fixes: DataFrame) -> DataFrame:
    """Fixes as states by vessel and hour."""
    hour = F.date_trunc("hour", "event_time").alias("hour")
    return fixes.groupBy("vessel_id", hour).agg(F.count("*").alias("fixes"), F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.max("source_id").alias("last_id"))


def folded(states: DataFrame) -> DataFrame:
    """States of one vessel and hour as one."""
    return states.groupBy("vessel_id", "hour").agg(F.sum("fixes").alias("fixes"), F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.max("last_id").alias("last_id"))


def hourly_store(spark: SparkSession, path: str) -> MergedStore:
    """The hourly rollup: each batch appends its states, readers and merges fold them; no stream holds an aggregate."""
    return MergedStore(spark, path, HOURLY, folded, ["vessel_id", "hour"], month="hour")
