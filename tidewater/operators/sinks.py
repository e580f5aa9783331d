"""Write semantics as DataFrame operators: upserts, replaces, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def detail_hash(lines: DataFrame, key: str) -> DataFrame:
    """One hash of all lines of a key, whatever their order."""
    others = [c for c in lines.columns if c != key]
    return lines.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row_hash(others))), ","), 256).alias("hash"))


def classify_by_hash(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``key, change``: inserted, changed or unchanged against the stored hashes."""
    before = stored.select(key, F.col("hash").alias("old_hash"))
    joined = new.join(before, key, "left")
    change = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    return joined.select(key, change.alias("change"))


def full_diff(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Like ``classify_by_hash``, with what the new set lacks as removed."""
    joined = new.select(key, F.col("hash").alias("new_hash")).join(stored.select(key, F.col("hash").alias("old_hash")), key, "full")
    change = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("new_hash").isNull(), "removed").when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    return joined.select(key, change.alias("change"))


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace stored ones of the same key."""
    return stored.join(new, list(keys), "left_anti").unionByName(new)


def insert_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows win over new ones of the same key."""
    return stored.unionByName(new.join(stored, list(keys), "left_anti"))


def latest(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of the highest order of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    return rows.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def first(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order])
    return rows.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def keep_newest(rows: DataFrame, keys: Sequence[str], n: int, *order: str) -> DataFrame:
    """The ``n`` newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    return rows.withColumn("_turn", F.row_number().over(w)).filter(F.col("_turn") <= n).drop("_turn")


def within_budget(rows: DataFrame, group: str, size: str, budget: int, *order: str) -> DataFrame:
    """Rows whose running sum of sizes, most recently used first, stays within the budget of their group."""
    w = Window.partitionBy(group).orderBy(*[F.col(order[0]).desc(), *order[1:]]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= budget).drop("_sum")


def fold_patches(events: DataFrame, key: str, order: str, fields: Sequence[str], deleted: str) -> DataFrame:
    """Live rows after all patches: of each field the last value that a patch carried; ``<field>_set`` tells which fields a patch carries.

    A carried null clears the field. A row is gone once any event deletes it.
    """
    last = [F.max_by(F.struct(F.col(f).alias("v")), F.when(F.col(f"{f}_set"), F.col(order)))["v"].alias(f) for f in fields]
    return events.groupBy(key).agg(*last, F.max(deleted).alias("_gone")).filter(~F.col("_gone")).drop("_gone")
