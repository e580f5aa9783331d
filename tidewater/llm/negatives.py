"""Hard negatives by product quantisation with stored residual norms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize
from tidewater.llm.vectors import finite, matrix, scaled, usual_length, within

#: Scaled entries of this size and over do not take part: sums of their products would not be exact in 64 bits.
_LARGEST = 2.0**22
#: Rows and anchors that meet at once in a task.
_ROWS, _ANCHORS = 1024, 256


@dataclass(frozen=True)
class Quantiser:
    """Dimensions are cut into ``parts``, each with up to ``centroids`` integer centroids fitted to ``sample`` rows."""

    parts: int = 32
    centroids: int = 256
    sample: int = 4096
    rounds: int = 8


@dataclass(frozen=True)
class Codebook:
    edges: tuple[int, ...]
    tables: tuple[np.ndarray, ...]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each part, a byte each, and the length of what the codes leave over (rounded up)."""
        codes = np.zeros((len(x), len(self.tables)), dtype=np.uint8)
        left = np.zeros(len(x), dtype=np.int64)
        for m, table in enumerate(self.tables):
            part = x[:, self.edges[m] : self.edges[m + 1]]
            codes[:, m] = _nearest(part, table)
            left += ((part - table[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left.astype(np.float64)) * (1 + 1e-12)

    def lookup(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Inner products of the centroids of each part (rows) with the anchors (columns)."""
        return [table @ anchors[:, self.edges[m] : self.edges[m + 1]].T for m, table in enumerate(self.tables)]


def _nearest(part: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row; the bound holds for whichever is chosen, so rounding does no harm."""
    t = table.astype(np.float64)
    return np.concatenate([(-2 * part[at : at + 4096].astype(np.float64) @ t.T + (t * t).sum(1)).argmin(1) for at in range(0, len(part), 4096)]) if len(part) else np.zeros(0, np.int64)


def fit_codebook(sample: np.ndarray, quantiser: Quantiser = Quantiser()) -> Codebook:
    """Lloyd's rounds for each part from distinct sample rows; centroids are rounded to integers, so that lookups are exact."""
    dims = sample.shape[1]
    edges = tuple(dims * i // min(quantiser.parts, dims) for i in range(min(quantiser.parts, dims) + 1))
    tables = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = sample[:, a:b]
        distinct = np.unique(part, axis=0)
        table = distinct[np.linspace(0, len(distinct) - 1, min(quantiser.centroids, len(distinct))).astype(int)]
        for _ in range(quantiser.rounds if len(distinct) > quantiser.centroids else 0):
            near = _nearest(part, table)
            counts = np.bincount(near, minlength=len(table))
            sums = np.stack([np.bincount(near, part[:, j].astype(np.float64), len(table)) for j in range(b - a)], axis=1)
            table = np.where(counts[:, None] > 0, np.rint(sums / np.maximum(counts, 1)[:, None]), table).astype(np.int64)
        tables.append(table)
    return Codebook(edges, tuple(tables))


def integer_rows(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """``vec_id``, ``label`` and ``x`` (``floor(factor * c)``) of the rows that take part.

    Rows without id, label or vector, with an empty vector, with a null or non-finite entry, with a scaled entry of 2**22 or
    more, and with another length than most have are left out.
    """
    good = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(F.col(vector_col)) & within(F.col(vector_col), factor, _LARGEST))
    found = good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), scaled(F.col(vector_col), factor).cast("array<int>").alias("x"))
    return found.filter(F.size("x") == usual_length(good, vector_col))


def learn(vectors: DataFrame, quantiser: Quantiser = Quantiser()) -> Codebook | None:
    """A codebook from at most ``quantiser.sample`` rows, those of the smallest hash; None for an empty table."""
    rows = vectors.select("x", F.xxhash64("vec_id").alias("h")).orderBy("h", "x").limit(quantiser.sample).select("x").collect()
    return fit_codebook(np.array([r["x"] for r in rows], dtype=np.int64), quantiser) if rows else None


def build_index(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``vec_id``, ``label``, ``x``, ``code`` (a byte for each part) and ``left`` (the residual's length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, left = book.encode(matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], ["vec_id", "label", "x", "code", "left"])

    return vectors.select("vec_id", "label", "x").mapInArrow(run, "vec_id long, label long, x array<int>, code binary, left double")


def _first(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each owner by falling score, ties by rising id."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[rank < k]


def _bounded(book: Codebook, anchors: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Blocks of rows and anchors with lower and upper bounds of their scores.

    The lookup tables give the product of an anchor with a row's centroids; the rest of the row adds the product of the lengths
    of anchor and residual at most, by Cauchy and Schwarz. Entries are integers, so the bounds are rounded up to one.
    """
    lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
    for a in range(0, len(anchors), _ANCHORS):
        some = slice(a, a + _ANCHORS)
        tables = book.lookup(anchors[some])
        small = sum(int(np.abs(t).max(initial=0)) for t in tables) < 2**31
        tables = [np.ascontiguousarray(t, dtype=np.int32 if small else np.int64) for t in tables]
        for r in range(0, len(x), _ROWS):
            here = slice(r, r + _ROWS)
            score = np.zeros((len(codes[here]), tables[0].shape[1]), dtype=tables[0].dtype)
            for m, table in enumerate(tables):
                score += table[codes[here, m]]
            rest = np.ceil(left[here, None] * lengths[None, some]) + 1
            yield here, some, score - rest, score + rest


def nearest_alike(book: Codebook, anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor's position, row's id and score of the first ``k`` rows of each anchor's label in this block; the anchor itself is none."""
    owner = score = ids = np.zeros(0, dtype=np.int64)
    least = np.full(len(anchors["x"]), -np.inf)
    for here, some, _, upper in _bounded(book, anchors["x"], rows["x"], rows["code"], rows["left"]):
        may = (upper >= least[None, some]) & (rows["label"][here, None] == anchors["label"][None, some]) & (rows["vec_id"][here, None] != anchors["vec_id"][None, some])
        i, j = np.nonzero(may)
        i, j = i + here.start, j + some.start
        exact = np.einsum("ij,ij->i", rows["x"][i], anchors["x"][j])
        owner, score, ids = np.append(owner, j), np.append(score, exact), np.append(ids, rows["vec_id"][i])
        at = _first(owner, score, ids, k)
        owner, score, ids = owner[at], score[at], ids[at]
        full, last = np.unique(owner, return_counts=True)
        ends = np.cumsum(last) - 1
        least[full[last == k]] = score[ends[last == k]]
    return owner, ids, score


def window_negatives(book: Codebook, anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], windows: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window's position, row's id and score of the first ``k`` rows of other labels in each window of this block.

    ``windows`` has a row for each: position of its anchor, score of its positive. A row is in it if its score is at most the
    positive's and at least ``percent`` hundredths of it.
    """
    owner = score = ids = np.zeros(0, dtype=np.int64)
    high = windows[:, 1]
    low = -(-percent * high // 100)
    least = low.astype(np.float64)
    order = np.argsort(windows[:, 0], kind="stable")
    starts = np.searchsorted(windows[order, 0], np.arange(len(anchors["x"]) + 1))
    for here, some, lower, upper in _bounded(book, anchors["x"], rows["x"], rows["code"], rows["left"]):
        other = rows["label"][here, None] != anchors["label"][None, some]
        own = order[starts[some.start] : starts[min(some.stop, len(starts) - 1)]]
        turn = np.arange(len(own)) + starts[some.start] - starts[windows[own, 0]]
        found_i, found_w = [], []
        # Windows of an anchor one after the other: each turn has one window of an anchor at most.
        for t in range(int(turn.max(initial=-1)) + 1):
            w = own[turn == t]
            at = windows[w, 0] - some.start
            i, c = np.nonzero((upper[:, at] >= least[w]) & (lower[:, at] <= high[w]) & other[:, at] & (low[w] <= high[w]))
            found_i.append(i + here.start)
            found_w.append(w[c])
        if not found_i:
            continue
        i, w = np.concatenate(found_i), np.concatenate(found_w)
        exact = np.einsum("ij,ij->i", rows["x"][i], anchors["x"][windows[w, 0]])
        inside = (exact >= low[w]) & (exact <= high[w])
        owner, score, ids = np.append(owner, w[inside]), np.append(score, exact[inside]), np.append(ids, rows["vec_id"][i[inside]])
        at = _first(owner, score, ids, k)
        owner, score, ids = owner[at], score[at], ids[at]
        full, last = np.unique(owner, return_counts=True)
        ends = np.cumsum(last) - 1
        least[full[last == k]] = score[ends[last == k]]
    return owner, ids, score


def _rows(table: pa.Table) -> dict[str, np.ndarray]:
    flat = table.combine_chunks()
    column = lambda c: flat.column(c).combine_chunks() if isinstance(flat.column(c), pa.ChunkedArray) else flat.column(c)
    found = {"vec_id": column("vec_id").to_numpy(zero_copy_only=False), "label": column("label").to_numpy(zero_copy_only=False), "x": matrix(column("x"))}
    if "code" in flat.column_names:
        found["code"] = np.frombuffer(b"".join(column("code").to_pylist()), dtype=np.uint8).reshape(len(flat), -1)
        found["left"] = column("left").to_numpy(zero_copy_only=False)
    return found


def _dealt(df: DataFrame, own: int, other: int, by_rows: bool) -> DataFrame:
    """``df`` cut into ``own`` blocks whatever its values are, each given to the ``other`` blocks of the other side."""
    mine = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(own)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    return df.withColumn("block_r" if by_rows else "block_a", mine).withColumn("block_a" if by_rows else "block_r", every)


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", factor: int = 256, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80,
    quantiser: Quantiser = Quantiser(), rows_per_block: int = 8192, anchors_per_block: int = 4096,
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``. Scores are integer inner
    products with the anchor, higher first, ties by smaller id. Anchors are the rows whose id is divisible by ``every``; an anchor's
    positives are its first ``positives`` other rows of its label; the negatives of both are the first ``negatives`` rows of other labels
    whose score is at most the positive's and at least ``percent`` hundredths of it (so there are none for a negative score).

    Rows that ``integer_rows`` leaves out take no part. Anchors that repeat id, label and vector are one; other rows that repeat
    an id count each, but never as positives of an anchor of that id. An anchor or a positive without a match gives no row, and an
    empty table gives none. Other columns are not read.

    Rows carry a product code and the length of its residual. Blocks of anchors meet blocks of rows, dealt evenly whatever
    their labels are; lookup tables bound every score, what the bounds do not rule out is scored exactly, and each block
    passes on its first few of each window, so the result is that of an exact search.
    """
    vectors = materialize(integer_rows(rows, id_col, label_col, vector_col, factor), "negatives-rows")
    spark, book = rows.sparkSession, learn(vectors, quantiser)
    if book is None:
        return spark.createDataFrame([], _RESULT)
    index = materialize(build_index(vectors, book), "negatives-index")
    chosen = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "label", "x"])
    anchors = materialize(chosen.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    n, n_anchors = index.count(), anchors.count()
    wanted = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_block))
    blocks, anchor_blocks = max(1, min(wanted, n // 512)), max(1, -(-n_anchors // anchors_per_block))
    dealt = _dealt(index, blocks, anchor_blocks, True)

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r = _rows(left), _rows(right)
        owner, ids, score = nearest_alike(book, a, r, positives) if len(left) and len(right) else (np.zeros(0, np.int64),) * 3
        return pa.table({"anchor": left.column("anchor").to_numpy()[owner], "positive_id": ids, "positive_score": score})

    by_block = ("block_a", "block_r")
    near = _dealt(anchors, anchor_blocks, blocks, False).groupBy(*by_block).cogroup(dealt.groupBy(*by_block)).applyInArrow(alike, "anchor long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    near = materialize(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives")), "negatives-positives")
    asked = materialize(anchors.join(near, "anchor"), "negatives-asked")

    def mined(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r = _rows(left), _rows(right)
        each = left.column("positives").to_pylist()
        windows = np.array([(i, p["positive_score"]) for i, ps in enumerate(each) for p in ps], dtype=np.int64).reshape(-1, 2)
        places = np.array([p["place"] for ps in each for p in ps], dtype=np.int32)
        owner, ids, score = window_negatives(book, a, r, windows, negatives, percent) if len(left) and len(right) else (np.zeros(0, np.int64),) * 3
        return pa.table({"anchor": left.column("anchor").to_numpy()[windows[owner, 0]], "place": places[owner], "negative_id": ids, "negative_score": score})

    hard = _dealt(asked, anchor_blocks, blocks, False).groupBy(*by_block).cogroup(dealt.groupBy(*by_block)).applyInArrow(mined, "anchor long, place int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    named = asked.select("anchor", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p")).select("anchor", "anchor_id", "p.*")
    return hard.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
