"""Exact deduplication against a persistent index of digests."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, new_path, whole_text


class DigestIndex:
    """Digests seen so far, in files at ``path`` that are bucketed and sorted by digest.

    ``add`` takes a batch of new digests, finds those that the index lacks by a sort-merge anti-join (the index side needs
    no shuffle) and appends them. Earlier batches win over later ones. The index outlives the session: opening it again
    at the same path, with the same number of buckets, goes on where it ended. One writer at a time.

    What one call feeds belongs to its run. Rows carry the attempt that wrote them, and a log beside the index names the
    attempt that finished each run. Rows of an attempt that did not finish are not seen, and when a run is done again, by its
    name, its own earlier rows are not seen either: the second attempt finds what the first one found.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        self.log = f"{self.table}_runs"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, attempt STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.log} (run STRING, attempt STRING, at BIGINT) USING parquet LOCATION '{path}-runs'")

    def finished(self) -> DataFrame:
        """``run``, ``attempt``, ``at`` of the last finished attempt of each run."""
        return self.spark.table(self.log).groupBy("run").agg(F.max_by("attempt", "at").alias("attempt"), F.max("at").alias("at"))

    def read(self, run: str | None = None, attempt: str | None = None) -> DataFrame:
        """Rows of finished runs; for an ``attempt`` at a ``run``, those of other runs and its own."""
        seen = [r["attempt"] for r in self.finished().collect() if r["run"] != run]
        return self.spark.table(self.table).filter(F.col("attempt").isin([*seen, *([attempt] if attempt else [])])).select("digest", "keep_id")

    def close(self) -> None:
        """Forget the session's tables; the files stay."""
        for table in (self.table, self.log):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def lacking(self, groups: DataFrame, run: str | None = None, attempt: str | None = None) -> DataFrame:
        """The rows of ``groups`` whose digest the index lacks."""
        return groups.hint("merge").join(self.read(run, attempt).select("digest").hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame, run: str, attempt: str) -> DataFrame:
        """Distinct ``digest`` with ``keep_id`` of a batch; appends the new ones, for ``attempt``, and returns them.

        Rows are dealt by digest into as many tasks as there are buckets, so a batch adds one sorted file to each bucket.
        """
        fresh = materialize(self.lacking(groups, run, attempt).select("digest", "keep_id", F.lit(attempt).alias("attempt")), "digest-new")
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return fresh

    def finish(self, run: str, attempt: str) -> None:
        """From now on the rows of ``attempt`` are the run's. The log's file appears as a whole or not at all."""
        self.spark.createDataFrame([(run, attempt, time.time_ns())], "run string, attempt string, at long").coalesce(1).write.insertInto(self.log)
        self.spark.catalog.refreshTable(self.log)

    def compact(self, path: str) -> DigestIndex:
        """The same index at a new path, with one file in each bucket, without rows of unfinished attempts."""
        other = DigestIndex(self.spark, path, self.buckets)
        runs = self.finished()
        seen = [r["attempt"] for r in runs.collect()]
        self.spark.table(self.table).filter(F.col("attempt").isin(seen)).repartition(self.buckets, "digest").write.insertInto(other.table)
        runs.coalesce(1).write.insertInto(other.log)
        for table in (other.table, other.log):
            self.spark.catalog.refreshTable(table)
        return other


def buckets_for(rows: int, rows_per_bucket: int = 4_000_000) -> int:
    """Buckets for an index that is expected to hold ``rows`` digests: a power of two, 8 at least."""
    return max(8, 1 << max(rows // rows_per_bucket, 1).bit_length())


def id_batches(digests: DataFrame, batches: int) -> list[DataFrame]:
    """``digests`` in ``batches`` ranges of ``doc_id``, largest ids first; rows without an id come in the last one."""
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or batches < 2:
        return [digests]
    edges = [high - (high - low) * i // batches for i in range(1, batches)]
    within = lambda below, above: (F.lit(True) if below is None else F.col("doc_id") <= below) & (F.lit(True) if above is None else F.col("doc_id") > above)
    bounds = [None, *edges]
    parts = [digests.filter(within(bounds[i], bounds[i + 1])) for i in range(len(bounds) - 1)]
    return [*parts, digests.filter(F.col("doc_id").isNull() | within(bounds[-1], None))]


def exact_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, run: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The rows enter the index in ``batches`` ranges of their ids, largest first, so that the largest id of equal texts is the
    one that the index keeps. Texts are equal when identical; null counts as empty. ``keep_id`` is the id of the
    row that stays; if the index held the text before this call, it is that earlier row's and no row of ``docs`` stays.
    ``group_size`` counts the rows of ``docs``. A null id stays only where all ids of the group are null, and then every such row
    does. Rows that repeat an id and its text are all kept or all dropped. Only digests are shuffled; other columns are not read.

    A call that dies leaves the index as it was. ``run`` names the call: done again under that name, also after it has
    finished, it gives the same result, so a job whose later steps failed can start over. Without a name each call is a run of its own.
    """
    attempt = uuid.uuid4().hex
    run = run or attempt
    digests = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(whole_text(text_col), 256)).alias("digest")), "digests")
    groups = added = None
    for batch in id_batches(digests, batches):
        counts = materialize(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "digest-groups")
        fresh = index.add(counts, run, attempt)
        groups = counts if groups is None else groups.unionByName(counts)
        added = fresh if added is None else added.unionByName(fresh)
    sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
    own = added.select("digest", F.lit(True).alias("new"))
    # The index has every digest of the call now; its side of the join needs no shuffle.
    kept_ids = sizes.hint("merge").join(index.read(run, attempt).hint("merge"), "digest").join(own, "digest", "left")
    settled = materialize(kept_ids.select("digest", "keep_id", "group_size", F.coalesce("new", F.lit(False)).alias("new")), "digest-settled")
    index.finish(run, attempt)
    # A hot digest is split by the adaptive skew join: both sides are read from files and shuffled here.
    found = digests.join(settled, "digest")
    kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def new_index(spark: SparkSession, expected_rows: int) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, new_path(spark, "digest-index"), buckets_for(expected_rows))
