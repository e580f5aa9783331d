"""Limits of requests as Column expressions, for requests that stand in a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import params


def refusal(days: Column, box_deg2: Column) -> Column:
    """Why a request for some days, in a box of so many square degrees or, where that is null, in all the world, is refused; else ``ok``."""
    longest = F.when(box_deg2.isNull(), params.MAX_GLOBAL_DAYS).otherwise(params.MAX_DAYS)
    return F.when(days <= 0, "bad_window").when(days > longest, "window_too_long").when(box_deg2 > params.MAX_BOX_DEG2, "bbox_too_large").otherwise("ok")


def clamped(name: str, wanted: Column) -> Column:
    """A parameter inside its limits; what is missing or no finite number is the default."""
    low, high, default = (F.lit(v) for v in params.CLAMPED[name])
    finite = wanted.isNotNull() & ~F.isnan(wanted) & (F.abs(wanted) < float("inf"))
    return F.when(finite, F.least(F.greatest(wanted, low), high)).otherwise(default)


def instant(text: Column) -> Column:
    """An ISO instant with a zone; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), text.try_cast("timestamp"))


def preset_start(now: Column, preset: Column) -> Column:
    """Start of the window before ``now`` that a preset names; null for an unknown one."""
    hours = F.element_at(F.create_map(*[F.lit(x) for pair in params.PRESETS.items() for x in pair]), preset)
    return now - F.make_dt_interval(hours=hours)
