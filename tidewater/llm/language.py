"""Language identification by known words first, then by shorter and shorter character n-grams."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import byte_view, materialize, slices

_SPLIT = r"[^\p{L}]+"


@dataclass(frozen=True)
class Training:
    """``documents`` bounds the sample of each language, and so the model; what occurs ``least_count`` times in the sample is known."""

    documents: int = 2000
    least_count: int = 2
    longest: int = 5
    smoothing: float = 0.5


@dataclass
class Model:
    """Log frequencies by language of known words, and of the character n-grams of each length."""

    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: list[dict[str, tuple[float, ...]]]  # by length, from 1
    default: tuple[float, ...]
    known: dict[str, int] = field(default_factory=dict)
    rows: list[tuple[float, ...]] = field(default_factory=list)

    def word_scores(self, word: str) -> tuple[float, ...]:
        """Log frequency of a word in each language.

        A word that the table lacks falls back to the longest n-grams of which it has any known ones; their mean
        stands for it. A word without a known letter says nothing.
        """
        found = self.words.get(word)
        if found is not None:
            return found
        marked = f"^{word}$"
        for n in range(len(self.grams), 0, -1):
            table = self.grams[n - 1]
            text = word if n == 1 else marked
            seen = [s for i in range(len(text) - n + 1) if (s := table.get(text[i : i + n])) is not None]
            if seen:
                k = len(seen)
                return tuple([sum(c) / k for c in zip(*seen, strict=True)])
        return self.default

    def score_words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
            self.rows.clear()
        known, rows = self.known, self.rows
        for w in words:
            if w not in known:
                known[w] = len(rows)
                rows.append(self.word_scores(w))
        return np.array([rows[known[w]] for w in words], dtype=np.float64).reshape(-1, len(self.languages))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case runs of letters of all texts, and how many each text has."""
    clean = pc.utf8_lower(pc.replace_substring_regex(texts.fill_null(""), _SPLIT, " "))
    raw, offsets = byte_view(clean)
    inside = raw != 0x20
    before = np.append(False, inside[:-1]) if len(raw) else inside
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False) if len(raw) else inside
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    # A run of spaces stands between words: cut the buffer at both ends and take every other piece.
    bounds = np.column_stack([starts, ends]).reshape(-1)
    pieces = pa.StringArray.from_buffers(max(len(bounds) - 1, 0), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
    words = pieces.take(pa.array(np.arange(0, len(pieces), 2))) if len(bounds) else pa.array([], pa.string())
    return words, np.diff(np.searchsorted(starts, offsets))


def learn(docs: DataFrame, training: Training = Training(), held_out_remainder: int = 1, folds: int = 3) -> Model:
    """Count words and n-grams in a bounded sample of each language, taken by a hash of the row, so that copies of one text do not come in together."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held_out_remainder, F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, [{} for _ in range(training.longest)], ())
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, training.documents / n) * (1 << 20)))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text"))
    longest = training.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words first, so that the n-grams of each distinct word of a task are cut once.
        by_word: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            for part in slices(batch, "text"):
                words, n = words_of(part.column("text"))
                langs = np.repeat(np.array(part.column("lang").to_pylist(), dtype=object), n)
                for lang in set(langs.tolist()):
                    for x in words.filter(pa.array(langs == lang)).value_counts().to_pylist():
                        by_word[lang, x["values"]] += x["counts"]
        counts: dict[tuple[str, int, str], int] = defaultdict(int)
        for (lang, w), c in by_word.items():
            counts[lang, 0, w] = c
            marked = f"^{w}$"
            for k in range(1, longest + 1):
                text = w if k == 1 else marked
                for i in range(len(text) - k + 1):
                    counts[lang, k, text[i : i + k]] += c
        rows = list(counts.items())
        for at in range(0, len(rows), 100_000):
            some = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in some], pa.string()), pa.array([r[0][1] for r in some], pa.int32()), pa.array([r[0][2] for r in some], pa.string()), pa.array([r[1] for r in some], pa.int64())], ["lang", "kind", "item", "n"])

    counts = sample.mapInArrow(run, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    items = counts.groupBy("kind", "item").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")).filter(F.col("total") >= training.least_count)
    items = materialize(items, "language-counts")
    found = [items.filter(F.col("kind") == kind).orderBy("item").collect() for kind in range(longest + 1)]
    languages = sorted(sizes)

    def table(rows) -> dict[str, tuple[float, ...]]:
        sums = {lang: sum(r["by_lang"].get(lang, 0) for r in rows) for lang in languages}
        size = len(rows) + 1
        return {r["item"]: tuple([math.log((r["by_lang"].get(lang, 0) + training.smoothing) / (sums[lang] + training.smoothing * size)) for lang in languages]) for r in rows}

    return Model(languages, table(found[0]), [table(found[k]) for k in range(1, longest + 1)], (0.0,) * len(languages))


def identify(docs: DataFrame, training: Training = Training(), model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every whole text; one row per row of ``docs``.

    The words' log frequencies are averaged and the best language wins, ties going to the first in alphabetical order;
    the score is its share after a softmax over languages. A null text, one without letters and any text where nothing was
    learned get ``und`` and score 0.
    """
    model = model or learn(docs, training)
    languages = pa.array([*model.languages, "und"], pa.string())
    # Bounded by the training's table sizes; a worker loads it once and keeps the scores of the words that it has met.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words, n = words_of(part.column("text"))
                best, score = np.full(len(n), len(model.languages)), np.zeros(len(n))
                some = np.flatnonzero(n)
                if len(some) and model.languages:
                    coded = words.dictionary_encode()
                    by_word = model.score_words(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                    mean = np.add.reduceat(by_word, (np.cumsum(n) - n)[some], axis=0) / n[some, None]
                    top = mean.argmax(axis=1)
                    share = np.exp(mean - mean.max(axis=1, keepdims=True))
                    best[some] = top
                    score[some] = share[np.arange(len(top)), top] / share.sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), languages.take(pa.array(best)), pa.array(score)], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
