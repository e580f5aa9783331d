"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialize, slices
from tidewater.llm.tokens import ENCODE_BYTES, with_end, word_tokenizer


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, first rank, last rank + 1, first sequence, offset)``.

    Pieces of the ranks [first, last) of a length go to sequences [first sequence, ...), one each, at ``offset``.
    Open sequences with the same room stand in runs of numbers, so a step fills a whole run: per length only
    few runs are cut or opened, whatever the number of pieces.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # rooms with open runs, ascending
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(room: int, start: int, n: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((start, n))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, start, n = capacity, opened, max(1, left // (capacity // length))
                opened += n
            # Each sequence takes as many as it can hold; the last few go to one sequence.
            each = room // length
            filled = min(n, left // each)
            if not filled:
                each, filled = left, 1
            for k in range(each):
                slots.append((length, rank, rank + filled, start, capacity - room + k * length))
                rank += filled
            left -= each * filled
            put(room - each * length, start, filled)
            if n > filled:
                put(room, start + filled, n - filled)
    return slots


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every whole text: ``doc_id, piece, start, length, ids_crc32, shard, turn``.

    A text longer than ``capacity`` is cut into pieces of that length, the first of which may be shorter. ``turn`` numbers the pieces of
    one length inside a task's ``shard``.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        shard = TaskContext.get().partitionId()
        turns = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                ids, offsets = with_end(*tokenizer.encode(part.column("text")), end_id)
                sizes = np.diff(offsets)
                n = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                first = sizes - (n - 1) * capacity
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[owner], capacity)
                turn = np.empty(len(owner), dtype=np.int64)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                turn[order] = turns[ordered] + np.arange(len(order)) - np.searchsorted(ordered, ordered)
                turns += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((offsets[owner] + start).tolist(), (offsets[owner] + start + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), shard, np.int32)), pa.array(turn)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "turn"],
                )

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")], T.StructField("shard", T.IntegerType()), T.StructField("turn", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: where every piece of every text goes.

    Only the histogram (at most ``capacity`` rows) reaches the driver. A piece's rank within its length is its
    turn in its shard plus the pieces of that length in the shards before, so no length gathers in one task.
    The plan's size depends on the number of lengths, not on the corpus; it is joined on length and rank, and
    broadcast up to ``broadcast_rows``. Null and empty texts are one piece with the end id alone. Repeated rows are packed each for itself; equal
    lengths are interchangeable, so which of them takes which slot depends on the order of the input files.
    """
    rows = materialize(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    counts = materialize(rows.groupBy("shard", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.select("shard", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    plan = plan_slots(histogram, capacity)
    slots = spark.createDataFrame(pa.table({c: pa.array([s[i] for s in plan], pa.int64()) for i, c in enumerate(("length", "from_rank", "to_rank", "first_sequence", "offset"))}))
    ranked = rows.join(before, ["shard", "length"]).withColumn("rank", F.col("before") + F.col("turn"))
    if len(plan) <= broadcast_rows:
        slots = F.broadcast(slots)
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
