"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialize, mix64, slices, spare_name

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs without ASCII white space, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash for each word."""
    if len(known) > 300_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` tokens, modulo 2**64, in about log2(size) passes over the tokens."""
    if len(tokens) < size:
        return np.zeros(0, dtype=np.uint64)
    total, covered = np.zeros(len(tokens), dtype=np.uint64), 0
    block, width, factor = tokens.copy(), 1, _BASE
    # Windows of 1, 2, 4, ... tokens are joined from two of half the size; the bits of ``size`` say which to append.
    left = size
    while left:
        if left & 1:
            n = len(tokens) - covered - width + 1
            total = total[:n] * factor + block[covered : covered + n]
            covered += width
        left >>= 1
        if left:
            n = len(block) - width
            block = block[:n] * factor + block[width : width + n]
            with np.errstate(over="ignore"):
                factor = factor * factor
            width *= 2
    return mix64(total)


def _free_windows(free: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of ``size`` tokens is free of marked ones."""
    marked = np.concatenate(([0], np.cumsum(~free)))
    return marked[size:] == marked[:-size]


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in text, place in item, length)`` of non-overlapping common runs, longest first.

    Each round looks for the longest run that is unmarked in both, by Karp-Rabin hashes at lengths that a binary search
    proposes, verifies it and marks it in both. Runs of one length are taken in the order of their places in the item, then in the text.
    Rounds end when no run of ``least`` tokens is left.
    """
    found: list[tuple[int, int, int]] = []
    free_text, free_item = np.ones(len(text), dtype=bool), np.ones(len(item), dtype=bool)

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        in_item = window_hashes(item, size)
        at_item = np.flatnonzero(_free_windows(free_item, size)) if len(in_item) else np.zeros(0, np.int64)
        in_text = window_hashes(text, size)
        at_text = np.flatnonzero(_free_windows(free_text, size)) if len(in_text) else np.zeros(0, np.int64)
        common = at_item[np.isin(in_item[at_item], in_text[at_text])] if len(at_item) and len(at_text) else np.zeros(0, np.int64)
        return common, in_item, in_text

    most = min(len(text), len(item))
    while most >= least and len(shared(least)[0]):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            if len(shared(middle)[0]):
                low = middle
            else:
                high = middle - 1
        common, in_item, in_text = shared(low)
        places = defaultdict(list)
        wanted = np.flatnonzero(np.isin(in_text, in_item[common]) & _free_windows(free_text, low))
        for at in wanted.tolist():
            places[int(in_text[at])].append(at)
        marked = False
        for i in common.tolist():
            if not free_item[i : i + low].all():
                continue
            for at in places[int(in_item[i])]:
                if free_text[at : at + low].all() and np.array_equal(text[at : at + low], item[i : i + low]):
                    free_text[at : at + low] = False
                    free_item[i : i + low] = False
                    found.append((at, i, low))
                    marked = True
                    break
        # Longest runs go first, and none is longer than this one any more.
        most = low if marked else low - 1
    return found


def seed_table(seeds: DataFrame, log2_bits: int) -> np.ndarray:
    """A bit for each hash in column ``seed``, in a table of fixed size; gathered in pages of words by Spark."""
    bit = F.col("seed").bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = seeds.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))
    pages = words.groupBy(F.shiftright("word", 12).alias("page")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    table = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    for row in pages.toLocalIterator():
        table[[w["word"] for w in row["words"]]] = [w["bits"] for w in row["words"]]
    return table.view(np.uint64)


def item_seeds(benchmark: DataFrame, least: int) -> DataFrame:
    """``item, size, repeats, seeds, windows``: each distinct text of the benchmark with ``least`` or more words, its distinct seeds, and those of its words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, "item"):
                tokens = [codes(words_of(t), known) for t in part.column("item").cast(pa.binary()).to_pylist()]
                windows = [window_hashes(t, least) for t in tokens]
                seeds = [np.unique(w) for w in windows]
                repeats = [len(w) - len(u) for w, u in zip(windows, seeds, strict=True)]
                lists = [pa.array([u.view(np.int64) for u in x], pa.list_(pa.int64())) for x in (seeds, windows)]
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.array([len(t) for t in tokens], pa.int32()), pa.array(repeats, pa.int32()), *lists], ["item", "size", "repeats", "seeds", "windows"])

    texts = benchmark.select(F.col("text").cast("string").alias("item")).filter("item is not null").distinct()
    return texts.mapInArrow(run, "item string, size int, repeats int, seeds array<long>, windows array<long>").filter(F.col("size") >= least)


def seeded_texts(texts: DataFrame, table: np.ndarray, least: int) -> DataFrame:
    """``key, text, hits``: the rows of ``texts`` with any seed whose bit is set, and those seeds."""
    shared = texts.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = shared.value, {}
        mask = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            for part in slices(batch, "text"):
                hits = []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    hashes = window_hashes(codes(words_of(text), known), least) if text else np.zeros(0, np.uint64)
                    at = hashes & mask
                    found = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                    hits.append(np.unique(hashes[found != 0]).view(np.int64))
                some = pa.array([len(h) > 0 for h in hits], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text"), pa.array(hits, pa.list_(pa.int64()))], ["key", "text", "hits"]).filter(some)

    return texts.select("key", "text").mapInArrow(run, "key binary, text string, hits array<long>")


def telling_seeds(windows: np.ndarray, texts: np.ndarray, size: int, least: int, threshold: float) -> list[int]:
    """Seeds of an item of which every text has one that covers ``threshold`` of it; ``texts`` is the number of texts that have each window's seed.

    The seeds of most texts are left out, as long as all that is left out covers less than the threshold. What a text covers lies in
    seeds that it shares, so one that has nothing but left-out seeds does not get there.
    """
    places: dict[int, list[int]] = {}
    for at, seed in enumerate(windows.tolist()):
        places.setdefault(seed, []).append(at)
    often = dict(zip(windows.tolist(), texts.tolist(), strict=True))
    free, told = np.ones(size, dtype=bool), []
    covered = 0
    for seed in sorted(places, key=lambda s: (-often[s], s)):
        span = np.unique(np.concatenate([np.arange(at, at + least) for at in places[seed]]))
        more = int(free[span].sum())
        if covered + more < threshold * size:
            free[span] = False
            covered += more
        elif often[seed]:
            told.append(seed)
    return told


def seed_pairs(texts: DataFrame, items: DataFrame, least: int, threshold: float) -> DataFrame:
    """``key, item_key`` of every text (``key, hits``) that has a telling seed of an item (``item_key, size, windows``).

    So a template that many items share makes no pairs, unless it is as long as the threshold asks for.
    """
    met = texts.select("key", F.explode("hits").alias("seed"))
    often = met.groupBy("seed").agg(F.count("*").alias("texts"))
    each = items.select("item_key", "size", F.posexplode("windows").alias("at", "seed")).join(often, "seed", "left")
    whole = each.groupBy("item_key", "size").agg(F.sort_array(F.collect_list(F.struct("at", "seed", F.coalesce("texts", F.lit(0)).alias("texts")))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("seeds").to_pylist(), batch.column("texts").to_pylist(), batch.column("size").to_pylist(), strict=True)
            told = [telling_seeds(np.array(w, dtype=np.int64), np.array(t, dtype=np.int64), n, least, threshold) for w, t, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("item_key"), pa.array(told, pa.list_(pa.int64()))], ["item_key", "telling"])

    kind = T.StructType([items.schema["item_key"], T.StructField("telling", T.ArrayType(T.LongType()))])
    chosen = whole.select("item_key", "size", F.col("all.seed").alias("seeds"), F.col("all.texts").alias("texts")).mapInArrow(run, kind)
    return met.join(chosen.select("item_key", F.explode("telling").alias("seed")), "seed").select("key", "item_key").distinct()


def covered(texts: DataFrame, benchmark: DataFrame, least: int, threshold: float, log2_bits: int) -> DataFrame:
    """``key, item, coverage, n_tiles`` for the distinct texts of ``key, text`` that cover an item to ``threshold``.

    Seeds of both sides are joined in Spark. The bit table only keeps seeds that no item has out of the shuffle; the join drops
    what it lets through. A pair has to share enough seeds for its coverage before it is tiled.
    """
    items = materialize(item_seeds(benchmark, least).withColumn("item_key", F.unhex(F.md5("item"))), "benchmark-seeds")
    table = seed_table(items.select(F.explode("seeds").alias("seed")), log2_bits)
    found = materialize(seeded_texts(texts, table, least).dropDuplicates(["key"]), "seeded-texts")
    pairs = seed_pairs(found.select("key", "hits"), items, least, threshold)
    pairs = pairs.join(found.select("key", "hits"), "key").join(items.select("item_key", "size", "repeats", "seeds"), "item_key")
    # The distinct seeds that a pair shares cover that number x least words at most, unless the item repeats itself.
    shared = F.size(F.array_intersect("hits", "seeds"))
    pairs = materialize(pairs.filter((shared + F.col("repeats")) * least >= threshold * F.col("size")).select("key", "item_key"), "seed-pairs")
    both = pairs.join(items.select("item_key", "item"), "item_key").join(found.select("key", "text"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                at, coverage, n = [], [], []
                texts, items = (part.column(c).cast(pa.binary()).to_pylist() for c in ("text", "item"))
                for i, (text, item) in enumerate(zip(texts, items, strict=True)):
                    item = codes(words_of(item), known)
                    runs = tiles(codes(words_of(text), known), item, least)
                    share = sum(r[2] for r in runs) / len(item)
                    if share >= threshold:
                        at.append(i)
                        coverage.append(share)
                        n.append(len(runs))
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key").take(rows), part.column("item").take(rows), pa.array(coverage, pa.float64()), pa.array(n, pa.int32())], ["key", "item", "coverage", "n_tiles"])

    return both.select("key", "item", "text").mapInArrow(run, "key binary, item string, coverage double, n_tiles int")


def _key(text_col: str) -> Column:
    """128 bits for each text, null for none."""
    return F.unhex(F.md5(F.col(text_col).cast("string")))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts that are equal have one key, so that copies are seeded and tiled once."""
    return docs.select(_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text")).filter("text is not null")


def matches(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, log2_bits: int = 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles``: a row for each document and benchmark item that it gives away.

    A document gives an item away if tiles of ``least`` or more common words cover ``threshold`` of the item's words, in whatever
    order. Candidates share seeds of ``least`` words; only seeds, and the texts of documents with any, are shuffled. Null and empty
    texts match nothing, and neither do items of fewer than ``least`` words: such short runs occur in clean documents, too.
    Repeated rows and repeated items give a row each. Other columns are not read.
    """
    found = materialize(covered(_keyed(docs, text_col), benchmark, least, threshold, log2_bits), "covered-items")
    named = found.join(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")), "item").select("key", "item_id", "coverage", "n_tiles")
    ids = docs.select(F.col(id_col).alias("doc_id"), _key(text_col).alias("key"))
    return ids.join(named, "key").select("doc_id", "item_id", "coverage", "n_tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, log2_bits: int = 26) -> DataFrame:
    """The rows of ``docs`` that give no benchmark item away, by the rule of ``matches``; all columns kept."""
    found = materialize(covered(_keyed(docs, "text"), benchmark, least, threshold, log2_bits).select("key").distinct(), "contaminated")
    # The planner broadcasts the keys where their files are small, and sorts both sides where they are not.
    own = F.coalesce(_key("text"), F.lit(b""))
    mark = spare_name(docs, "_contaminated")
    return docs.join(found.withColumnRenamed("key", mark), own == F.col(mark), "left_anti")
