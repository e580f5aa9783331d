"""Sweeps of a corpus for coordinates: what looks like some, what is read, and where the detectors differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import texts
from tidewater.operators.areas import statute_readings

# Words with which notices announce coordinates.
POSITION_WORDS = ("posisjon", "koordinat")

#: A line without a degree sign, the word for degrees, or figures before a hemisphere is not read.
_SUSPECT = r"(?i)[°º]|grader|\d{4}\s*[ns]\s*-"


def evidence(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep``, ``signs`` (readings that look like coordinates), ``pairs`` (points that the coordinate reader finds), ``worded``, ``detectors``.

    The detectors are, in order: two readings or more, a pair that is read, a word that announces coordinates. Lines without any such sign are left out first. A null text has none of it.
    """
    lines = F.array_join(F.filter(F.split(text, "\n"), lambda line: line.rlike(_SUSPECT)), "\n")
    worded = F.coalesce(F.lower(text).rlike("|".join(POSITION_WORDS)), F.lit(False))
    signs = lambda t: F.size(F.filter(statute_readings(t), lambda r: r["alike"]))
    counted = F.transform(F.array(F.coalesce(lines, F.lit(""))), lambda t: F.struct(signs(t).alias("signs"), F.size(texts.all_coordinates(t)).alias("pairs")))
    # One row of counts is unnested, so that each text is walked once.
    found = docs.select(*keep, worded.alias("worded"), F.inline(counted))
    return found.withColumn("detectors", F.array(F.col("signs") >= 2, F.col("pairs") > 0, F.col("worded")))


def candidate() -> Column:
    return F.exists("detectors", lambda d: d)


def disagreement() -> Column:
    """Some detector says yes and some no."""
    return candidate() & ~F.forall("detectors", lambda d: d)


def counters(found: DataFrame, *by: str) -> DataFrame:
    """Counters of a sweep over ``evidence`` with a flag ``live``: of all, or by some columns."""
    live, some = F.col("live"), candidate()
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("pairs"))), F.lit(0))
    return found.groupBy(*by).agg(
        F.count("*").alias("scanned"), F.count_if(some).alias("candidates"), F.count_if(some & live).alias("in_force"), F.count_if(some & ~live).alias("skipped"), total(live).alias("read"), total(~live).alias("withheld"),
        F.count_if((F.col("signs") > 0) & (F.col("pairs") == 0)).alias("gaps"), F.count_if(disagreement()).alias("disagreements"),
    )
