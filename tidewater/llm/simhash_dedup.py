"""SimHash near-duplicates through pivot distance tables."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import gather, materialize, mix64, slices, spare_name
from tidewater.llm.components import connected_components

#: A-Z to a-z, byte by byte.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_BLOCK = 1 << 18
#: The bits of a byte, highest first, as the bytes of a number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(-1).view(np.uint64)
#: Pairs that are looked up in the distance table at once.
_PAIRS = 1 << 20


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of every run of ``words`` words (fewer: of all words together; none: no hash)."""
    found = text.translate(_FOLD).split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) < words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    h = xxhash.xxh64_intdigest
    return [h(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose ``counts`` hashes stand in a row: a bit is 1 if set in over half of them.

    The eight bits of a byte are counted at once, in the bytes of one 64-bit number; runs of at most 255 hashes leave no byte over.
    """
    sums = np.zeros((len(counts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), _BLOCK):
        block = np.ascontiguousarray(hashes[at : at + _BLOCK])
        own = owner[at : at + _BLOCK]
        new = np.append(True, own[1:] != own[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        first = np.flatnonzero((np.arange(len(own)) - start) % 255 == 0)
        packed = np.add.reduceat(_SPREAD[block.view(np.uint8).reshape(-1, 8)], first, axis=0)
        np.add.at(sums, own[first], packed.view(np.uint8).reshape(len(first), 64))
    return np.packbits((2 * sums > counts[:, None]).astype(np.uint8), axis=1).reshape(-1).view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: its id under the name ``doc_id``, ``fp`` (the fingerprint's 64 bits as a signed integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                each = [shingle_hashes(t or b"", words, seed) for t in part.column("text").cast(pa.binary()).to_pylist()]
                counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
                hashes = np.fromiter(itertools.chain.from_iterable(each), dtype=np.uint64, count=int(counts.sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(majority_bits(hashes, counts).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())]))


def pivots(n: int = 16) -> np.ndarray:
    """Reference fingerprints: Walsh words (bit ``b`` of word ``i`` is the parity of ``i & b``).

    Any two of them differ in 32 bits, so the distances of a chance fingerprint to them are uncorrelated, and each
    reference discards its own share of chance pairs.
    """
    if not 0 < n < 64:
        raise ValueError("between 1 and 63 references")
    index = (37 * np.arange(1, n + 1)) % 64
    parity = np.bitwise_count(index[:, None] & np.arange(64)[None, :]) & 1
    return np.packbits(parity.astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def with_distances(distinct: DataFrame, n_pivots: int) -> DataFrame:
    """``slot``, ``fp`` and ``distances``: a byte for each reference, computed once for each fingerprint."""
    refs = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column("fp").to_numpy().view(np.uint64), refs)
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("fp"), pa.array([row.tobytes() for row in table], pa.binary())], ["slot", "fp", "distances"])

    return distinct.select("slot", "fp").mapInArrow(run, "slot int, fp long, distances binary")


def may_link(table: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Positions of the pairs whose distances to every reference differ by ``max_bits`` at most; no others can be linked."""
    at = np.arange(len(left))
    for column in table.T:
        at = at[np.abs(column[left[at]] - column[right[at]]) <= max_bits]
    return at


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of all choices of ``blocks - max_bits`` of ``blocks`` runs of bits.

    ``max_bits`` differing bits leave at least that many runs untouched, so two linked fingerprints
    agree under at least one mask.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(runs, blocks - max_bits)]


def choose_blocks(n: int, max_bits: int, pair_cost: float = 0.02) -> int:
    """How many runs of bits make the least work for ``n`` fingerprints: a row for each mask, and a look at the table for each chance pair."""

    def cost(blocks: int) -> float:
        keys = math.comb(blocks, max_bits)
        agreed = 64 * (blocks - max_bits) / blocks
        return keys * (1 + pair_cost * n / 2**agreed)

    return min(range(max_bits + 1, max_bits + 9), key=cost)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def finer_masks(mask: int, max_bits: int) -> list[int]:
    """Masks that agree on one more run of the bits that ``mask`` leaves free: ``max_bits`` differing bits leave a run untouched."""
    free = [i for i in range(64) if not (mask >> i) & 1]
    runs = [free[len(free) * i // (max_bits + 1) : len(free) * (i + 1) // (max_bits + 1)] for i in range(max_bits + 1)]
    return [_signed((mask & (1 << 64) - 1) | sum(1 << i for i in run)) for run in runs]


def bucket_links(fps: np.ndarray, table: np.ndarray, ends: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that span the groups of each bucket: position of the first end, both ends. Buckets of distinct fingerprints stand in a row; ``ends`` has each row's end of bucket.

    Pairs of a bucket are looked up in the distance table, about a million at a time; what it does not discard is
    verified, and a link between groups of the bucket that are linked already is left out.
    """
    partners = ends - np.arange(len(fps)) - 1
    total = np.cumsum(partners)
    group: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := group.get(x, x)) != x:
            group[x] = group.get(up, up)
            x = up
        return x

    left, right = [], []
    start = 0
    while start < len(fps):
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + _PAIRS, side="right")), start + 1)
        n = partners[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = gather(np.arange(start, stop) + 1, n)
        at = may_link(table, i, j, max_bits)
        i, j = i[at], j[at]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                group[x] = y
                left.append(a)
                right.append(b)
        start = stop
    left, right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
    return left, fps[left], fps[right]


def buckets(distinct: DataFrame, max_bits: int, n_pivots: int, bucket_limit: int) -> list[DataFrame]:
    """Rows ``slot``, ``mask``, ``key``, ``fp``, ``distances`` whose buckets (of one slot, mask and key) hold every pair that can link.

    A bucket agrees on the bits of its mask. One over ``bucket_limit`` is cut by masks over its remaining bits, as often as
    needed, so its rows never meet in one task; the tables of the list have no bucket in common.
    """
    if bucket_limit < 1 << (max_bits + 1):
        # A larger bucket has more free bits than runs to cut them into, so every cut makes it smaller.
        raise ValueError(f"bucket_limit must be at least {1 << (max_bits + 1)}")
    spark, cut = distinct.sparkSession, ["slot", "mask", "key"]
    marks = materialize(with_distances(distinct, n_pivots), "simhash-pivots")
    largest = marks.groupBy("slot").count().agg(F.max("count")).first()[0] or 0
    masks = [_signed(m) for m in block_masks(choose_blocks(largest, max_bits), max_bits)]
    keyed = marks.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    found = []
    while True:
        sizes = keyed.groupBy(*cut).agg(F.count("*").alias("n"))
        big = materialize(sizes.filter(F.col("n") > bucket_limit), "simhash-big")
        # One for each mask at most, whatever the number of buckets.
        big_masks = [r["mask"] for r in big.select("mask").distinct().collect()]
        found.append(keyed.join(big, cut, "left_anti") if big_masks else keyed)
        if not big_masks:
            return found
        finer = spark.createDataFrame([(m, finer_masks(m, max_bits)) for m in big_masks], "mask long, more array<long>")
        keyed = keyed.join(big.select(*cut), cut, "left_semi").join(F.broadcast(finer), "mask").select("slot", "fp", "distances", F.explode("more").alias("mask"))
        keyed = materialize(keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).dropDuplicates(["slot", "mask", "fp"]), "simhash-keys")


def links(distinct: DataFrame, max_bits: int = 4, n_pivots: int = 16, bucket_limit: int = 1024) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links ``a``, ``b`` that connect every group linked at ``max_bits`` or fewer bits.

    The pivot table (distances to ``n_pivots`` references) is computed once for each fingerprint and travels with it. Pairs
    meet in buckets that agree on the bits of some mask; the table's largest coordinate difference discards
    nearly all chance pairs of a bucket, and survivors are verified.
    """
    parts = buckets(distinct.withColumn("slot", F.lit(0)), max_bits, n_pivots, bucket_limit)
    return reduce(DataFrame.unionByName, (_bucket_links(p, n_pivots, max_bits) for p in parts)).select("a", "b")


def _bucket_links(keyed: DataFrame, n_pivots: int, max_bits: int) -> DataFrame:
    """Links ``a``, ``b`` that span the groups of each bucket, with the bucket's ``slot``, ``mask`` and ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_table = np.zeros((0, 4), dtype=np.int64), np.zeros((0, n_pivots), dtype=np.int8)

        def close(n: int) -> pa.RecordBatch:
            rows = held[:n]
            starts = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))) if n else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, n))
            at, a, b = bucket_links(np.ascontiguousarray(rows[:, 3]).view(np.uint64), held_table[:n], np.repeat(starts + sizes, sizes), max_bits)
            slot, mask, key = rows[at, :3].T
            return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(mask), pa.array(key), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["slot", "mask", "key", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("slot", "mask", "key", "fp")])])
            table = np.frombuffer(b"".join(batch.column("distances").to_pylist()), dtype=np.int8).reshape(-1, n_pivots)
            held_table = np.concatenate([held_table, table])
            # The last bucket may go on in the next batch.
            last = int(np.flatnonzero((held[:, :3] == held[-1, :3]).all(axis=1))[0])
            if last:
                yield close(last)
                held, held_table = held[last:], held_table[last:]
        yield close(len(held))

    cut = ("slot", "mask", "key")
    return keyed.select(*cut, "fp", "distances").repartition(*cut).sortWithinPartitions(*cut).mapInArrow(run, "slot int, mask long, key long, a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, max_bits: int = 4, n_pivots: int = 16, bucket_limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 lower-case hex digits), ``component_id``.

    Fingerprints: A-Z are lower-cased, words are runs without ASCII white space, every run of ``words`` of them
    (repeats included) votes with its XXH64 hash; a bit is 1 if set in over half the hashes. Fingerprints link at
    ``max_bits`` or fewer differing bits; ``component_id`` is the smallest id reachable. Null, empty and blank texts
    have fingerprint zero and link like any other; ties and repeated rows fall together. Null ids get a component
    like any row but never name one unless all ids of the component are null. Other columns are not read.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, words, seed), "simhash-fp")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    rooted = _rooted(distinct, links(distinct, max_bits, n_pivots, bucket_limit))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return marks.join(named, "fp").select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def _rooted(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """One row per fingerprint: ``fp``, ``least``, ``root`` (names its component)."""
    roots = connected_components(found)
    return materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def hex16(col: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(col))), 16, "0")


def _row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows of the same id and text only, and never null: a null differs from every id, and from an empty text."""
    digest = F.coalesce(F.sha2(F.col(text_col).cast("string"), 256), F.lpad(F.lit(""), 64, "-"))
    return F.concat(digest, F.coalesce(F.concat(F.lit(" "), F.col(id_col).cast("string")), F.lit("")))


def digests_and_prints(docs: DataFrame, words: int, seed: int, prints: int) -> DataFrame:
    """``row``, ``text`` -> ``row``, ``digest`` (equal where the words are), ``fps``: ``prints`` fingerprints with seeds of their own.

    Each distinct shingle votes once: the similarity is one of distinct shingles, and a line that a text repeats does not
    settle its bits.
    """
    seeds = mix64(np.arange(1, prints + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                each = [list(dict.fromkeys(shingle_hashes(t, words, seed))) for t in texts]
                digests = [hashlib.blake2b(b" ".join(t.translate(_FOLD).split()), digest_size=16).digest() for t in texts]
                counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
                hashes = np.fromiter(itertools.chain.from_iterable(each), dtype=np.uint64, count=int(counts.sum()))
                fps = np.stack([majority_bits(mix64(hashes ^ s), counts).view(np.int64) for s in seeds], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * prints, pa.int32()), pa.array(fps.reshape(-1)))], ["row", "digest", "fps"])

    kind = T.StructType([docs.schema["row"], T.StructField("digest", T.BinaryType()), T.StructField("fps", T.ArrayType(T.LongType()))])
    return docs.select("row", F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, seed: int, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` of ``node`` whose ``text`` share ``similarity`` of their distinct shingles. Two texts without words are alike."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(t)) for c, t in (("a", "left"), ("b", "right")))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, set[int]] = (None, set())

        def shingles(node: int, text: bytes | None) -> set[int]:
            nonlocal known
            if known[0] != node:
                known = (node, set(shingle_hashes(text or b"", words, seed)))
            return known[1]

        for batch in batches:
            for part in slices(batch, "right"):
                # A node that many link to comes many times in a row: its shingles are kept from one to the next.
                x = [shingles(a, t) for a, t in zip(part.column("a").to_pylist(), part.column("left").cast(pa.binary()).to_pylist(), strict=True)]
                y = [set(shingle_hashes(t or b"", words, seed)) for t in part.column("right").cast(pa.binary()).to_pylist()]
                shared = [len(p & q) for p, q in zip(x, y, strict=True)]
                alike = [n >= similarity * (len(p) + len(q) - n) for n, p, q in zip(shared, x, y, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b`` and more) whose ends have not the same label; a node without a label is its own."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    found = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return found.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).drop("a_root", "b_root")


def cross_pairs(members: DataFrame, max_bits: int, group_limit: int = 2048) -> DataFrame:
    """All pairs ``a``, ``b`` within ``max_bits`` of one bucket whose labels differ; each pair once.

    ``members``: ``slot``, ``mask``, ``key``, ``fp``, ``node``, ``label``. A bucket over ``group_limit`` is cut into blocks, and each two
    blocks of it meet in a task of their own.
    """
    cut = ("slot", "mask", "key")
    sizes = members.groupBy(*cut).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).filter("labels > 1")
    rows = members.join(sizes, list(cut)).withColumn("blocks", F.ceil(F.col("n") / group_limit).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def run(table: pa.Table) -> pa.Table:
        fp, node, label, block = (table.column(c).to_numpy() for c in ("fp", "node", "label", "block"))
        within = table.column("low")[0] == table.column("high")[0]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, _PAIRS // max(1, len(fp)))
        for at in range(0, len(fp), step):
            i = np.arange(at, min(at + step, len(fp)))
            may = (np.bitwise_count(fp[i, None] ^ fp[None, :]) <= max_bits) & (label[i, None] != label[None, :]) & (node[i, None] < node[None, :])
            if not within:
                may &= block[i, None] != block[None, :]
            p, q = np.nonzero(may)
            left.append(node[i[p]])
            right.append(node[q])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return rows.select(*cut, "low", "high", "fp", "node", "label", "block").groupBy(*cut, "low", "high").applyInArrow(run, "a long, b long").distinct()


def text_groups(nodes: DataFrame, text_of: Callable[[DataFrame], DataFrame], words: int, seed: int, max_bits: int, similarity: float, n_pivots: int, bucket_limit: int) -> DataFrame:
    """``node``, ``root`` of the texts that are linked, whatever their number: nodes without a link are absent.

    ``nodes``: ``node``, ``fps``. A link stands between two texts of which some fingerprint is within ``max_bits`` and which share
    ``similarity`` of their distinct shingles; no other link is made, and none is lost:

    1. Each text of a fingerprint is paired with the smallest one, and each bucket of fingerprints is spanned; the pairs are held against the texts.
    2. Where a pair failed and its ends are still apart, it may have stood for others: all pairs of that bucket or
       fingerprint between texts that are still apart are held against each other.
    """
    slots = materialize(nodes.select("node", F.posexplode("fps").alias("slot", "fp")), "simhash-slots")
    groups = materialize(slots.groupBy("slot", "fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "simhash-fps")
    parts = buckets(groups, max_bits, n_pivots, bucket_limit)
    spans = reduce(DataFrame.unionByName, (_bucket_links(p, n_pivots, max_bits) for p in parts))
    rep = lambda c: groups.select("slot", F.col("fp").alias(f"{c}_fp"), F.col("rep").alias(c))
    spans = spans.withColumnsRenamed({"a": "a_fp", "b": "b_fp"}).join(rep("a"), ["slot", "a_fp"]).join(rep("b"), ["slot", "b_fp"]).filter("a <> b").select("slot", "mask", "key", "a", "b")
    same = slots.join(groups.filter("n > 1").select("slot", "fp", "rep"), ["slot", "fp"]).filter("node <> rep")
    # A fingerprint is a bucket that agrees on all bits.
    same = same.select("slot", F.lit(-1).cast("long").alias("mask"), F.col("fp").alias("key"), F.col("rep").alias("a"), F.col("node").alias("b"))
    found = spans.unionByName(same).withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    found = materialize(found, "simhash-candidates")
    pairs = materialize(found.select("a", "b").distinct(), "simhash-pairs")
    verified = _held(pairs, text_of, words, seed, similarity)
    labels = materialize(connected_components(verified), "simhash-labels")
    failed = materialize(_apart(found, labels), "simhash-failed")
    cut = ["slot", "mask", "key"]
    bad_fps = failed.filter("mask = -1").select("slot", F.col("key").alias("fp")).distinct()
    wanted = failed.select(*cut)
    for part in parts:
        wanted = wanted.unionByName(part.join(bad_fps, ["slot", "fp"], "left_semi").select(*cut))
    wanted = materialize(wanted.distinct(), "simhash-wanted")
    rows = groups.join(wanted.filter("mask = -1").select("slot", F.col("key").alias("fp"), "mask", "key"), ["slot", "fp"]).select(*cut, "fp")
    for part in parts:
        rows = rows.unionByName(part.join(wanted, cut, "left_semi").select(*cut, "fp"))
    members = rows.join(slots, ["slot", "fp"]).join(labels, "node", "left").select(*cut, "fp", "node", F.coalesce("root", "node").alias("label"))
    more = materialize(cross_pairs(materialize(members, "simhash-members"), max_bits).join(pairs, ["a", "b"], "left_anti"), "simhash-more")
    late = _held(more, text_of, words, seed, similarity)
    if late.isEmpty():
        return labels
    return materialize(connected_components(verified.unionByName(late)), "simhash-labels")


def _held(pairs: DataFrame, text_of: Callable[[DataFrame], DataFrame], words: int, seed: int, similarity: float) -> DataFrame:
    """The ``pairs`` that their texts bear out, written."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = materialize(text_of(ends), "simhash-texts")
    return materialize(similar_pairs(pairs, texts, words, seed, similarity), "simhash-verified")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42, max_bits: int = 4, similarity: float = 0.8, prints: int = 8, n_pivots: int = 16, bucket_limit: int = 1024) -> DataFrame:
    """One row of each group of near-duplicates, all columns of ``docs``.

    Two texts link if one of their ``prints`` fingerprints differs in ``max_bits`` at most and they share ``similarity`` of their distinct
    shingles of ``words`` words; every link is held against the texts themselves (``text_groups``), so a text that is like no other stays.
    Texts of equal words are one. The row with the smallest id stays, rows without an id coming last; among
    rows of one id the text's digest decides. Ids may be null or repeated: rows are told apart by id and text. Null, empty and
    blank texts are alike. An empty table gives an empty one.
    """
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("key"))
    marks = materialize(digests_and_prints(docs.select(row.alias("row"), F.col(text_col).alias("text")), words, seed, prints), "simhash-fp")
    distinct = marks.groupBy("digest").agg(F.min("row").alias("least"), F.first("fps").alias("fps")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct.select("node", "least", "fps"), "simhash-distinct")

    def text_of(some: DataFrame) -> DataFrame:
        keys = materialize(distinct.select("node", F.col("least.key").alias("key")).join(some, "node", "left_semi"), "simhash-named")
        # The planner broadcasts the keys where their files are small. Rows of one key have one text, so any of them will do.
        keyed = docs.select(_row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
        return keyed.join(keys, "key").select("node", "text").dropDuplicates(["node"])

    roots = text_groups(distinct, text_of, words, seed, max_bits, similarity, n_pivots, bucket_limit)
    kept = distinct.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    own = spare_name(docs, "_row_key")
    kept = materialize(kept.select(F.col("least.key").alias(own)), "simhash-kept")
    # The key is never null, so the join and the removal of repeated rows share one shuffle.
    return docs.withColumn(own, _row_key(id_col, text_col)).join(kept, own, "left_semi").dropDuplicates([own]).drop(own)
