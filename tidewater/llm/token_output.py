"""Token ids as Arrow files of equal-length sequences and masks.

A shard holds the ids of a range of documents, one after the other, cut into sequences of equal length (the last is padded).
It is an Arrow stream with a footer of batch offsets (the IPC file format) of fixed-size lists: every batch but the last has the same number
of sequences, so sequence ``i`` is found by arithmetic and read in place from a memory map. A second file has each document's
first id and number of ids in its shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialize, new_path, slices
from tidewater.llm.files import new_file, old_file
from tidewater.llm.tokens import ENCODE_BYTES, with_end, word_tokenizer


def sequence_schema(length: int, vocabulary: int) -> pa.Schema:
    """Ids take two bytes where the vocabulary allows it, masks a bit."""
    return pa.schema([("input_ids", pa.list_(pa.uint16() if vocabulary <= 1 << 16 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Appends ids to a shard, holding one batch of sequences at most."""

    def __init__(self, sink: pa.NativeFile, length: int, per_batch: int, vocabulary: int):
        self.schema = sequence_schema(length, vocabulary)
        self.kind = self.schema.field("input_ids").type.value_type.to_pandas_dtype()
        self.out = pa.ipc.new_file(sink, self.schema)
        self.length, self.room = length, length * per_batch
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            part, ids = ids[: self.room - self.n_held], ids[self.room - self.n_held :]
            self.held.append(part.astype(self.kind))
            self.n_held += len(part)
            if self.n_held == self.room:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        padded = -(-len(ids) // self.length) * self.length
        if padded:
            values, mask = np.zeros(padded, self.kind), np.zeros(padded, bool)
            values[: len(ids)], mask[: len(ids)] = ids, True
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(values), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        self.out.close()


class SequenceReader:
    """Random access to the sequences of a shard, without copies."""

    def __init__(self, source: pa.NativeFile):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._last: tuple[int, np.ndarray, pa.BooleanArray] | None = None

    def _batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if self._last is None or self._last[0] != k:
            batch = self.file.get_batch(k)
            self._last = (k, batch.column(0).values.to_numpy(zero_copy_only=True), batch.column(1).values)
        return self._last[1:]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``, both views of the file."""
        ids, mask = self._batch(i // self.per_batch)
        at = i % self.per_batch * self.length
        return ids[at : at + self.length], mask.slice(at, self.length)

    def views(self, first: int, n: int) -> Iterator[np.ndarray]:
        """Ids [first, first + n) of the shard, as views of the sequences that they lie in; all of them must be unmasked."""
        while n:
            i, at = divmod(first, self.length)
            ids, mask = self.sequence(i)
            k = min(n, self.length - at)
            if mask.slice(at, k).true_count != k:
                raise ValueError(f"sequence {i} is masked inside a document")
            yield ids[at : at + k]
            first, n = first + k, n - k

    def ids(self, first: int, n: int) -> np.ndarray:
        """The same in one array."""
        return np.concatenate([np.zeros(0, "<u4"), *self.views(first, n)]).astype("<u4")

    def crc32(self, first: int, n: int) -> int:
        """CRC of ids [first, first + n) as little-endian unsigned 32-bit integers, sequence by sequence."""
        crc = 0
        for part in self.views(first, n):
            crc = zlib.crc32(part.astype("<u4"), crc)
        return crc


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, length: int = 1024, per_batch: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all whole texts in ascending ``doc_id`` order; returns the manifest: a row per shard, ``shard`` ascending.

    Documents are dealt out by ranges of ``doc_id``, and a task encodes and writes one range. Null and empty texts have the end id
    alone; null ids come first; rows that repeat an id stand in the order of a hash of their texts, so that they may be dealt to several tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", "turn", "row"]
    ranged = rows.withColumns({"turn": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        first_doc = None
        n_docs = 0
        with new_file(folder, ".arrow") as (sink, name), new_file(folder, ".docs.arrow") as (index_sink, index_name):
            writer = SequenceWriter(sink, length, per_batch, tokenizer.tokenizer.get_vocab_size())
            index = pa.ipc.new_file(index_sink, INDEX)
            for batch in batches:
                for part in slices(batch, "text", ENCODE_BYTES):
                    ids, offsets = with_end(*tokenizer.encode(part.column("text")), end_id)
                    index.write_batch(pa.record_batch([part.column("doc_id"), pa.array(offsets[:-1] + writer.total), pa.array(np.diff(offsets))], schema=INDEX))
                    if not n_docs:
                        first_doc = part.column("doc_id")[0].as_py()
                    n_docs += part.num_rows
                    writer.add(ids)
            writer.close()
            index.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": name, "index_file": index_name, "first_doc": first_doc, "n_docs": n_docs, "n_tokens": writer.total}], schema=MANIFEST)

    shards = materialize(ranged.mapInArrow(run, "part int, file string, index_file string, first_doc long, n_docs long, n_tokens long"), "token-shards")
    # One row for each task of the writing job.
    order = Window.orderBy("part")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return shards.select((F.row_number().over(order) - 1).alias("shard"), "*", F.coalesce(before, F.lit(0)).alias("start"))


MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("index_file", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the written files: ``doc_id, start, n_tokens, ids_crc32, shard``."""
    listed = materialize(manifest, "token-manifest")
    spread = listed.repartition(max(1, min(listed.count(), 10_000)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with old_file(folder, row["file"]) as source, old_file(folder, row["index_file"]) as index_source:
                    reader, index = SequenceReader(source), pa.ipc.open_file(index_source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        first, n = docs.column("first").to_numpy(), docs.column("n_tokens").to_numpy()
                        crc = [reader.crc32(a, b) for a, b in zip(first.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(first + row["start"]), docs.column("n_tokens"), pa.array(crc, pa.int64()), pa.array(np.full(len(n), row["shard"], np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 1024) -> DataFrame:
    """Write ``docs`` to a new folder of the shared folder and read each document back from the files."""
    folder = new_path(spark, "tokens")
    return read_documents(write_tokens(docs, folder, tokenizer_path, end_id, length), folder)
