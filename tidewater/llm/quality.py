"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import byte_view, mix64, slices

#: Byte classes that line features count.
_KINDS = {
    "upper": list(range(0x41, 0x5B)),
    "letter": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC2, 0xF5)],
    "digit": list(range(0x30, 0x3A)),
    "space": [0x20, 0x09],
    "stop": [ord(c) for c in ".,;:"],
    "symbol": [ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"],
}
_CLASS = np.zeros((256, len(_KINDS)), dtype=np.uint8)
for _k, _bytes in enumerate(_KINDS.values()):
    _CLASS[_bytes, _k] = 1
#: A value for each byte, whose sum tells words apart well enough to see repeats.
_SIGN = mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(20)
_SIGN[[0x20, 0x0A, 0x09]] = 0
_N_OWN = 11
#: Own features of a line, those of the lines before and after it, and a constant.
N_FEATURES = 3 * _N_OWN + 1


@dataclass(frozen=True)
class Model:
    """Weights (feature x state) and transition scores of the field; state 1 is good."""

    weights: np.ndarray
    transitions: np.ndarray


@dataclass(frozen=True)
class Training:
    """``documents`` bounds the labelled sample, ``lines`` the length of a document in it."""

    documents: int = 3000
    lines: int = 400
    rounds: int = 150
    rate: float = 0.1
    decay: float = 1e-3


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of documents -> features by line, bytes by line, number of lines by document. Blank lines count, too."""
    size = len(raw)
    mark = np.zeros(size + 1, dtype=bool)
    mark[1:][raw == 0x0A] = True
    mark[offsets] = True
    # An empty document has one empty line: it stands apart, as byte positions cannot show it.
    starts = np.flatnonzero(mark[:size])
    ends = np.append(starts[1:], size)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.add.reduceat(_CLASS[raw], starts, axis=0, dtype=np.int64) if size else np.zeros((0, len(_KINDS)), np.int64)
    length = (ends - starts).astype(np.float64)
    upper, letter, digit, space, stop, symbol = counts.T.astype(np.float64)
    words = space + 1
    base = np.maximum(length, 1)
    space_at = np.isin(raw, (0x20, 0x0A, 0x09))
    # Both ends of a document count as space, so that its neighbours in the buffer have no part in its features.
    before_space, after_space = np.append(True, space_at[:-1])[:size], np.append(space_at[1:], True)[-size:] if size else space_at
    before_space[offsets[:-1][offsets[:-1] < size]] = True
    after_space[offsets[1:][offsets[1:] > 0] - 1] = True
    mark_at = _CLASS[raw, 5] == 1
    # A mark alone, such as "|", stands between spaces.
    lone, ends_word = (before_space & mark_at & after_space).astype(np.int64), (mark_at & after_space).astype(np.int64)
    lone = np.add.reduceat(lone, starts) if size else np.zeros(0)
    ends_word = np.add.reduceat(ends_word, starts) if size else np.zeros(0)
    # Words that repeat the word before them.
    again = np.zeros(len(starts))
    first_byte = np.flatnonzero(~space_at & before_space)
    if len(first_byte):
        sign = np.add.reduceat(_SIGN[raw], first_byte)
        line = np.searchsorted(starts, first_byte, side="right") - 1
        same = (sign[1:] == sign[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[1:][same], minlength=len(starts))
    own = np.column_stack([
        np.minimum(np.log1p(length) / 8, 2), upper / np.maximum(letter, 1), letter / base, digit / base, symbol / base,
        np.minimum(letter / words / 10, 3), stop / words, lone / words, ends_word / words, again / words, (length < 2).astype(np.float64),
    ]) if size else np.zeros((0, _N_OWN))
    n_docs = len(offsets) - 1
    lines = np.bincount(doc, minlength=n_docs)
    empty = np.flatnonzero(lines == 0)
    if len(empty):
        at = np.searchsorted(doc, empty)
        blank = np.zeros(_N_OWN)
        blank[-1] = 1
        own, length = np.insert(own, at, blank, axis=0), np.insert(length, at, 0)
        lines[empty] = 1
    first = np.cumsum(lines) - lines
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[first + lines - 1] = 0
    return np.column_stack([own, before, after, np.ones(len(own))]), length, lines


def marginals(scores: np.ndarray, lines: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains that stand in a row.

    ``scores`` has a row for each line and a column for each state. Returns the marginals of states, the expected
    transitions summed over all chains, and the log partition function of each chain. Chains of one length class
    advance together, so the cost is one step for each line position, not for each line.
    """
    n = len(scores)
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    first, lines_sorted = first[order], lines[order]
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(lines_sorted[0]) if len(lines_sorted) else 0
    active = np.searchsorted(-lines_sorted, -np.arange(longest), side="left")  # chains longer than t
    if longest:
        alpha[first] = scores[first]
    for t in range(1, longest):
        rows = first[: active[t]] + t
        last = alpha[rows - 1]
        alpha[rows] = scores[rows] + np.logaddexp(last[:, :1] + transitions[0], last[:, 1:] + transitions[1])
    for t in range(longest - 2, -1, -1):
        rows = first[: active[t + 1]] + t
        nxt = beta[rows + 1] + scores[rows + 1]
        beta[rows] = np.logaddexp(transitions[:, 0] + nxt[:, :1], transitions[:, 1] + nxt[:, 1:])
    ends = first + lines_sorted - 1
    log_z = np.empty(len(lines))
    log_z[order] = np.logaddexp(alpha[ends, 0], alpha[ends, 1]) if longest else 0
    by_line = np.repeat(log_z, lines)
    states = np.exp(alpha + beta - by_line[:, None])
    inner = np.ones(n, dtype=bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    pair = alpha[at][:, :, None] + transitions[None] + (scores[at + 1] + beta[at + 1])[:, None, :] - by_line[at][:, None, None]
    return states, np.exp(pair).sum(axis=0), log_z


def fit(features: np.ndarray, lines: np.ndarray, labels: np.ndarray, training: Training) -> Model:
    """Gradient ascent (Adam) on the likelihood of each document's label repeated over its lines."""
    weights, transitions = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    y = np.repeat(labels, lines)
    share = np.repeat(1 / lines, lines)  # every document counts alike, however long
    balance = share
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(lines) - 1] = False
    at = np.flatnonzero(inner)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[at], y[at + 1]), 1.0)
    target = np.eye(2)[y]
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    for t in range(1, training.rounds + 1):
        states, pairs, _ = marginals(features @ weights, lines, transitions)
        grads = (features.T @ ((target - states) * balance[:, None]) / len(lines) - training.decay * weights, (observed - pairs) / max(len(at), 1) - training.decay * transitions)
        for i, (g, value) in enumerate(zip(grads, (weights, transitions), strict=True)):
            moments[2 * i] += 0.1 * (g - moments[2 * i])
            moments[2 * i + 1] += 0.001 * (g * g - moments[2 * i + 1])
            value += training.rate * (moments[2 * i] / (1 - 0.9**t)) / (np.sqrt(moments[2 * i + 1] / (1 - 0.999**t)) + 1e-8)
    return Model(weights, transitions)


def document_scores(model: Model, features: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of being good."""
    states, _, _ = marginals(features @ model.weights, lines, model.transitions)
    weight = length + 1
    first = np.cumsum(lines) - lines
    return np.clip(np.add.reduceat(states[:, 1] * weight, first) / np.add.reduceat(weight, first), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, training: Training = Training(), held_out_remainder: int = 2, folds: int = 4) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    The sample has ``training.documents`` documents at most, spread by a hash of id and text; of a document with more than
    ``training.lines`` lines, so many that stand in a row, from a place that the hash names, take part (with the features that they have in
    the whole text). Only line features of the sample reach the driver.
    """
    known = labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held_out_remainder).filter("quality in (0, 1)").select("doc_id", "quality").distinct()
    # Labels of the whole table are ranked by a hash; twice the bound, as some ids may have no document. So many rows may be broadcast.
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(2 * training.documents))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.xxhash64("doc_id", "text").alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = byte_view(part.column("text"))
                features, _, lines = line_features(raw, offsets)
                some = np.minimum(lines, training.lines)
                first = np.cumsum(lines) - lines + part.column("turn").to_numpy() % (lines - some + 1)
                flat = [features[a : a + n].astype("<f4").tobytes() for a, n in zip(first, some, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("quality").cast(pa.int32()), pa.array(flat, pa.binary())], ["turn", "quality", "features"])

    found = rows.mapInArrow(run, "turn long, quality int, features binary").orderBy("turn").limit(training.documents).collect()
    found = sorted((r["quality"], bytes(r["features"])) for r in found)
    labels_seen = {q for q, _ in found}
    if labels_seen != {0, 1}:
        # One class only, or none: the share of good labels is all that can be learned.
        good = (sum(q for q, _ in found) + 1) / (len(found) + 2)
        weights = np.zeros((N_FEATURES, 2))
        weights[-1, 1] = math.log(good / (1 - good))
        return Model(weights, np.zeros((2, 2)))
    arrays = [np.frombuffer(x, "<f4").reshape(-1, N_FEATURES).astype(np.float64) for _, x in found]
    return fit(np.concatenate(arrays), np.array([len(x) for x in arrays]), np.array([q for q, _ in found]), training)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: better) of every whole text; one row per row.

    Null texts count as empty: they are one blank line. Nothing but the text has a part in a score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = byte_view(part.column("text").fill_null(""))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(document_scores(model, *line_features(raw, offsets)))], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = byte_view(part.column("text").fill_null(""))
                yield part.filter(pa.array(document_scores(model, *line_features(raw, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, training: Training = Training()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (1 if the score reaches ``threshold``); one row per row of ``docs``."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    scored = score(docs, learn(docs, labels, training))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
