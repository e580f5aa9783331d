"""Mixing sources to target weights along a curriculum whose weights change with time.

Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, whole_text

#: Weight of a source at times 0 and 1 (linear between), by the source's turn: the mean over time is 1, 2, 3, repeating.
#: The first fades, the second stays, the third comes up late.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 4.5)))
_WORD = r"[^\x20\x09-\x0D]+"


def integral(knots: Sequence[tuple[float, float]]) -> float:
    """Integral over the times 0 to 1 of a weight that is linear between its knots (time, weight)."""
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))


def checked(curriculum: Sequence[Sequence[tuple[float, float]]]) -> None:
    for knots in curriculum:
        times = [t for t, _ in knots]
        if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times or min(w for _, w in knots) < 0 or integral(knots) <= 0:
            raise ValueError(f"knots must rise from time 0 to 1, with weights that are not negative and not all zero: {knots}")


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which ``share`` of a source's demand is met: the inverse of its integrated weight, a root of a square on each stretch."""
    whole, done, steps = integral(knots), 0.0, []
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        need, slope = share * whole - done, (b - a) / (t1 - t0)
        # slope/2 s^2 + a s = need, in the form that also holds for a slope of zero.
        root = F.coalesce(F.try_divide(need * 2.0, F.sqrt(F.greatest(need * (2.0 * slope) + a * a, F.lit(0.0))) + a), F.lit(0.0))
        done += (t1 - t0) * (a + b) / 2
        steps.append((done, F.least(root + t0, F.lit(float(t1)))))
    found = steps[-1][1]
    for end, value in reversed(steps[:-1]):
        found = F.when(share * whole <= end, value).otherwise(found)
    return found


def targets(sources: DataFrame, curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM, most: float = 3.0) -> DataFrame:
    """``sources`` (``source`` and its ``source_size``, a row each) with ``turn``, ``weight`` and ``target``.

    Sources take turns by code point, null last; a source's weight is the integral of its schedule. The sum of all sizes is shared
    by weight; no target exceeds ``most`` times the source's size, and what a source cannot take is shared among the others by
    weight until none is over. That is a level: sources with the smallest limits for their weight are filled first, and
    the rest share what is left. One row a source is ordered as a whole, so their number is what must fit one task.
    """
    weights = F.array(*[F.lit(integral(k)) for k in curriculum])
    turns = Window.orderBy(F.col("source").isNull(), "source")
    found = sources.withColumn("turn", ((F.row_number().over(turns) - 1) % len(curriculum)).cast("int")).withColumn("weight", F.get(weights, F.col("turn")))
    found = found.withColumn("limit", F.col("source_size") * float(most)).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    # The level if all before this source are full; once this one stays under it, so do all that follow.
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = found.withColumn("level", level)
    found = found.withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
    settled = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0))
    return found.select("source", "source_size", "turn", "weight", F.when(settled.isNull(), F.col("limit")).otherwise(settled * F.col("weight")).alias("target"))


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of id and text: rows that share it are interchangeable."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), whole_text(text_col)).cast("binary"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words of the whole text) and ``key`` (a digest of id and text, which sets the order of a source)."""
    size = F.regexp_count(whole_text(text_col), F.lit(_WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), row_key(id_col, text_col).alias("key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM, most: int = 3, rows_per_cell: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``key``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``positions``.

    A source's words lie end to end in the order of ``key``, over and over; the mix takes the first ``target`` (rounded down) of
    them, so a document is taken as a whole once for each full turn, and the last turn ends within a document at most, of which it takes
    the first words. ``taken`` counts the words taken, ``positions`` has the time (0 to 1) of each copy: the middle of a copy is a
    share of its source's demand, and the inverse of the integrated schedule says when that share is due.

    A null text has no words, a null source is one of its own. Rows of one id and text are interchangeable: each counts, and
    they lie side by side. Empty documents, and those of a source without words, take nothing and have no position. An
    empty table gives an empty result. Other columns are not read. Runs agree, whatever the partitions are.

    A source is cut by key into cells of about ``rows_per_cell`` rows, and running sums go by cell and within a cell, so no
    source meets in one task however large it is. Rows of one key are counted first and laid out afterwards.
    """
    checked(curriculum)
    rows = materialize(sized(docs, id_col, text_col, source_col), "mix-sizes")
    digits = max(2, len(f"{max(rows.count() // rows_per_cell, 1):x}") + 1)
    no_source = F.col("source").isNull()
    keyed = rows.withColumns({"name": F.coalesce("source", F.lit("")), "unnamed": no_source, "cell": F.substring("key", 1, digits)})
    groups = materialize(keyed.groupBy("name", "unnamed", "cell", "key", "doc_id", "size").agg(F.count("*").alias("n")), "mix-groups")
    cells = materialize(groups.groupBy("name", "unnamed", "cell").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "mix-cells")
    earlier = Window.partitionBy("name", "unnamed").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    totals = cells.groupBy("name", "unnamed").agg(F.sum("words").alias("source_size"))
    shared = targets(totals.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size"), curriculum, most)
    shared = shared.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source", "source_size", "turn", "target")
    cells = materialize(cells.join(shared, ["name", "unnamed"]), "mix-shares")
    within = Window.partitionBy("name", "unnamed", "cell").orderBy("key", "size", F.col("doc_id").isNull(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = groups.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))).join(cells, ["name", "unnamed", "cell"])
    laid = laid.select("doc_id", "key", "source", "size", "source_size", "turn", "target", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"), (F.col("cell_start") + F.col("before")).alias("start"))
    laid = laid.withColumn("start", F.col("start") + (F.col("i") - 1) * F.col("size")).withColumn("words", F.floor("target"))
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0))
    laid = laid.withColumn("turns", turns.cast("long")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("turns") * F.col("source_size") - F.col("start"))))
    copies = F.when(F.col("size") > 0, F.col("turns") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0))

    def position(c: Column) -> Column:
        length = F.when(c < F.col("turns"), F.col("size")).otherwise(F.col("part"))
        share = (c * F.col("source_size") + F.col("start") + length / 2.0) / F.col("words")
        chosen = time_of(share, curriculum[0])
        for i in range(1, len(curriculum)):
            chosen = F.when(F.col("turn") == i, time_of(share, curriculum[i])).otherwise(chosen)
        return chosen

    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), position)).otherwise(F.array().cast("array<double>"))
    return laid.select("doc_id", "key", "source", "size", "source_size", "target", (F.col("turns") * F.col("size") + F.col("part")).alias("taken"), positions.alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, in training order: ``position``, ``doc_id``, ``key``, ``source``, ``copy`` (from 0), ``words``.

    Copies are range-sorted by position, ties by key and copy; each task holds a stretch of the training.
    """
    words = F.when((F.col("copy") + 1) * F.col("size") <= F.col("taken"), F.col("size")).otherwise(F.col("taken") - F.col("copy") * F.col("size"))
    copies = mixed.select("doc_id", "key", "source", "size", "taken", F.posexplode("positions").alias("copy", "position"))
    return copies.select("position", "doc_id", "key", "source", "copy", words.alias("words")).orderBy("position", "key", "copy")


def mixed_texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``training_order`` with each copy's ``text``; a copy that gives only its first words has those, joined by spaces."""
    texts = docs.select(row_key(id_col, text_col).alias("key"), whole_text(text_col).alias("text")).dropDuplicates(["key"])
    copies = training_order(mixed).join(texts, "key").withColumn("found", F.expr(f"if(words < regexp_count(text, r'{_WORD}'), array_join(slice(regexp_extract_all(text, r'{_WORD}', 0), 1, cast(words AS int)), ' '), text)"))
    return copies.select("position", "doc_id", "key", "source", "copy", "words", F.col("found").alias("text")).orderBy("position", "key", "copy")
