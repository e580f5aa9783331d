"""Line deduplication up to one edit, by a deletion-neighbourhood join."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialize, mix64, slices, spare_name, whole_text

#: White space that is trimmed from both ends of a line before it is compared.
_TRIM = " \t\r\v\f"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _table(base: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64, from a table that is kept by powers of two."""
    return _table(base, 1 << max(n - 1, 1).bit_length())[:n]


@dataclass
class Lines:
    """The trimmed lines of a run of texts, as ranges of code points, with sums from which the hash of any range follows."""

    text: str
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    sums: np.ndarray

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomial hash modulo 2**64 of the code points [a, b), wherever they stand."""
        return (self.sums[b] - self.sums[a]) * _powers(_INVERSE, len(self.sums))[a]


def _sums(points: np.ndarray) -> np.ndarray:
    terms = mix64(points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(points) + 1)[: len(points)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))


def lines_of(texts: list[str]) -> Lines:
    text = "\n".join(texts)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    breaks = np.flatnonzero(points == 10)
    start, end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(points)]))
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(first, start, side="right") - 1
    first_line = np.searchsorted(start, first)
    place = np.arange(len(start)) - first_line[doc]
    solid = np.append(np.flatnonzero(~np.isin(points, [ord(c) for c in _TRIM + "\n"])), len(points))
    a = solid[np.searchsorted(solid, start)]
    last = np.searchsorted(solid, end) - 1
    b = np.where(last >= 0, solid[np.maximum(last, 0)] + 1, 0)
    full = np.flatnonzero((a < end) & (b > start))
    return Lines(text, a[full], b[full], doc[full], place[full], _sums(points))


def half_keys(lines: Lines, which: np.ndarray) -> np.ndarray:
    """Four keys for each line: of its first and its second half, as a line of its own length and as one that has a letter more.

    One edit leaves one half as it is, so two lines within one edit share a key.
    """
    a, b = lines.start[which], lines.end[which]
    out = []
    for length in (b - a, b - a - 1):
        head, tail = length // 2, length - length // 2
        out.append(mix64(lines.hashes(a, a + head) ^ mix64(head.astype(np.uint64) * np.uint64(2))))
        out.append(mix64(lines.hashes(b - tail, b) ^ mix64(tail.astype(np.uint64) * np.uint64(2) + np.uint64(1))))
    return np.column_stack(out)


def deletion_keys(line: str) -> np.ndarray:
    """Hash of the line, then of the line without its first, second, ... letter."""
    sums = _sums(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
    n = len(sums) - 1
    shorter = sums[:-1] + (sums[n] - sums[1:]) * np.uint64(_INVERSE)
    return np.concatenate((mix64(sums[n:] ^ mix64(np.array([n], np.uint64))), mix64(shorter ^ mix64(np.array([n - 1], np.uint64)))))


def _digests(lines: Lines) -> np.ndarray:
    h = xxhash.xxh3_128_digest
    text = lines.text
    found = [h(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(lines.start.tolist(), lines.end.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)


def _shared_bits(docs: DataFrame, least_chars: int, log2_bits: int) -> np.ndarray:
    """A bit for each half key that two different lines share (and, rarely, for some that none do), in a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = lines_of(part.column("text").to_pylist())
                long = np.flatnonzero(lines.end - lines.start >= least_chars)
                keys = half_keys(lines, long)
                whole = lines.hashes(lines.start[long], lines.end[long])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(whole, keys.shape[1]).view(np.int64))], ["key", "line"])

    keys = docs.select("text").mapInArrow(run, "key long, line long")
    shared = keys.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b")
    bit = F.col("key").bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = shared.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))
    # At most 2**log2_bits / 64 words, in rows of many words each.
    rows = words.groupBy(F.shiftright("word", 12).alias("page")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    table = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    for row in rows.toLocalIterator():
        table[[w["word"] for w in row["words"]]] = [w["bits"] for w in row["words"]]
    return table.view(np.uint64)


def _distinct_lines(docs: DataFrame, id_type: T.DataType, bits: np.ndarray, least_chars: int) -> DataFrame:
    """A row for each distinct line: ``h1, h2, first`` (where it stands first), and ``line`` (its text) if it may have a partner."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    mask = np.uint64(len(bits) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                lines = lines_of(part.column("text").to_pylist())
                keys = half_keys(lines, np.arange(len(lines.start))) & mask
                hit = ((table[(keys >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1)).any(axis=1)
                hit &= lines.end - lines.start >= least_chars
                digests = _digests(lines)
                texts = [lines.text[a:b] if h else None for a, b, h in zip(lines.start.tolist(), lines.end.tolist(), hit.tolist(), strict=True)]
                at = pa.array(lines.doc)
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), part.column("doc_id").take(at), part.column("version").take(at), pa.array(lines.place.astype(np.int32)), pa.array(texts, pa.string())], ["h1", "h2", "doc_id", "version", "place", "line"])

    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc_id", id_type), T.StructField("version", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("line", T.StringType())])
    seen = docs.mapInArrow(run, schema)
    return seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version", "place")).alias("first"), F.max("line").alias("line"))


def _near_lines(lines: DataFrame) -> DataFrame:
    """``h1, h2`` of the lines that have an earlier line within one edit.

    All lines of a variant that lost the same letter position differ there alone; the line that is the variant itself is one
    letter off all of them. So the earliest partner in a variant's group is a minimum, and no pairs are made but one for each line and variant.
    """
    first = lines.schema["first"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "line", 1 << 18):
                each = [deletion_keys(x) for x in part.column("line").to_pylist()]
                n = np.array([len(x) for x in each])
                at = pa.array(np.repeat(np.arange(len(each)), n))
                lost = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64)), pa.array(lost.astype(np.int32)), *(part.column(c).take(at) for c in ("h1", "h2", "doc_id", "version", "place"))], ["variant", "lost", "h1", "h2", "doc_id", "version", "place"])

    maybe = lines.filter("line is not null").select("h1", "h2", "first.*", "line")
    schema = T.StructType([T.StructField("variant", T.LongType()), T.StructField("lost", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), *first.fields])
    rows = maybe.mapInArrow(run, schema).select("variant", "lost", "h1", "h2", F.struct("doc_id", "version", "place").alias("own"))
    group, same = Window.partitionBy("variant"), Window.partitionBy("variant", "lost")
    rows = rows.withColumns({"by_place": F.min("own").over(same), "whole": F.min(F.when(F.col("lost") < 0, F.col("own"))).over(group), "any": F.min("own").over(group)})
    partner = F.when(F.col("lost") < 0, F.col("any")).otherwise(F.least("by_place", "whole"))
    pairs = rows.select("h1", "h2", "own", partner.alias("partner")).filter("partner < own").select("h1", "h2", "partner").distinct()
    texts = lines.filter("line is not null")
    own = texts.select("h1", "h2", F.col("line").alias("own_line"))
    other = texts.select(F.col("first").alias("partner"), F.col("line").alias("other_line"))
    checked = pairs.join(own, ["h1", "h2"]).join(other, "partner").filter(F.levenshtein("own_line", "other_line", 1) >= 0)
    return checked.select("h1", "h2").distinct()


def kept_places(docs: DataFrame, least_chars: int = 0, log2_bits: int = 26) -> DataFrame:
    """``doc_id``, ``version`` (a hash of the text) and the sorted ``places`` of the lines that stay, for documents with any."""
    source = docs.select("doc_id", whole_text().alias("text")).withColumn("version", F.xxhash64("text"))
    bits = _shared_bits(source, least_chars, log2_bits)
    lines = materialize(_distinct_lines(source, docs.schema["doc_id"].dataType, bits, least_chars), "lines")
    near = materialize(_near_lines(lines), "near-lines")
    kept = lines.join(near, ["h1", "h2"], "left_anti").select("first.*")
    return kept.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("place")).alias("places"))


def dedup_lines(docs: DataFrame, least_chars: int = 0, log2_bits: int = 26) -> DataFrame:
    """``docs`` with the lines removed from ``text`` that occur before, exactly or up to one edit; one row per row.

    Lines are what ``\\n`` separates, compared without white space at their ends. The order is that of ``doc_id`` (null first), of a
    hash of the text among rows that share an id, and of the lines in a text. A line goes if an earlier line, kept or not, is
    equal, or if they differ by at most one inserted, deleted or replaced character (and both have ``least_chars`` characters, where a
    caller wants short lines such as "Step 1" and "Step 2" apart; by default all lines are compared). Blank lines stay. Rows with the same id and text count as one and come out alike. A null text stays null, and a text may become
    empty; all columns are kept. The table of shared half keys (2**log2_bits bits) only saves work: what it wrongly lets through is verified.
    """
    own, doc, version, stay_at = (spare_name(docs, n) for n in ("_own", "_doc", "_version", "_places"))
    kept = kept_places(docs, least_chars, log2_bits).select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("places").alias(stay_at))
    both = docs.withColumn(own, F.xxhash64(whole_text())).join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(version)), "left")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column(stay_at).to_pylist(), strict=True):
                if text:
                    stay = set(places or ())
                    text = "\n".join([x for i, x in enumerate(text.split("\n")) if i in stay or not x.strip(_TRIM)])
                texts.append(text)
            columns = [batch.column(n) for n in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.select(*names, stay_at).mapInArrow(run, docs.schema)
