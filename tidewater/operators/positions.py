"""Operators over vessel position fixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import geo
from tidewater.params import MAX_WINDOWS, RequestError

# Speed bands in knots by vessel type, ends included; grid and gap of the activity layer.
SPEED_BANDS = {2: (0.3, 7.5), 3: (1.0, 5.0), 4: (1.0, 5.0), 5: (1.0, 5.0), 6: (0.3, 5.0), 8: (1.0, 5.0), 10: (1.0, 5.0), 28: (0.3, 7.5), 29: (0.3, 7.5)}
GRID_LON, GRID_LAT = 0.1, 0.03
MAX_GAP_S = 1800
RUN_BAND = (0.3, 5.5)


def in_period(start: str | None, end: str | None, closed: bool, column: str = "event_time") -> Column:
    """``[start, end)``, or ``[start, end]`` where ``closed``: the two are different contracts."""
    at = F.col(column)
    out = at >= F.lit(start).cast("timestamp") if start else F.lit(True)
    if end:
        out = out & ((at <= F.lit(end).cast("timestamp")) if closed else (at < F.lit(end).cast("timestamp")))
    return out


def in_band(low: float, high: float, speed: str = "speed") -> Column:
    """A known speed inside the band, ends included; never null."""
    return F.coalesce(F.col(speed).between(low, high) & ~F.isnan(speed), F.lit(False))


def is_fishing(speed: str = "speed") -> Column:
    return in_band(*RUN_BAND, speed)


def replace_by_key(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version of each key; of equal versions the one whose hash is highest, so that every run keeps the same row."""
    newest = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.xxhash64(*sorted(rows.columns)).desc())
    return rows.withColumn("_turn", F.row_number().over(newest)).filter("_turn = 1").drop("_turn")


def arg_max(value: str, *order: str) -> Column:
    """Value at the highest order among rows where it is known."""
    return F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value)


def gap_seconds(*partition: str) -> Column:
    """Seconds since the fix before, 0 for the first."""
    w = Window.partitionBy(*partition).orderBy("event_time")
    return F.unix_timestamp("event_time") - F.unix_timestamp(F.coalesce(F.lag("event_time").over(w), F.col("event_time")))


def credit(gap: str = "gap_s", longest: int = MAX_GAP_S) -> Column:
    return F.when((F.col(gap) > 0) & (F.col(gap) <= longest), F.col(gap)).otherwise(0)


def current_registry(registry: DataFrame, flags: Sequence[str], types: Sequence[int]) -> DataFrame:
    """The newest snapshot's vessels of the wanted flags and types, with the speed band of their type."""
    newest = registry.agg(F.max("snapshot").alias("snapshot"))
    bands = [F.struct(F.lit(t).alias("type_id"), F.lit(SPEED_BANDS[t][0]).alias("band_low"), F.lit(SPEED_BANDS[t][1]).alias("band_high")) for t in types]
    dim = registry.sparkSession.range(1).select(F.inline(F.array(*bands)))
    return registry.join(F.broadcast(newest), "snapshot", "left_semi").filter(F.col("flag").isin(list(flags))).join(F.broadcast(dim), "type_id").select("vessel_id", "type_id", "flag", "name", "band_low", "band_high")


def _in_band(fixes: DataFrame, registry: DataFrame) -> DataFrame:
    return fixes.join(registry, "vessel_id").filter(F.col("speed").between(F.col("band_low"), F.col("band_high")))


def in_band_fixes(fixes: DataFrame, registry: DataFrame, *window: str) -> DataFrame:
    """One fix for each vessel and time inside the band of the vessel's type; ties go to the smallest source id.

    Fixes are dealt by vessel alone: one shuffle serves this, the gaps along a track and what is summed by vessel.
    """
    joined = _in_band(fixes, registry).select("vessel_id", "event_time", *window, "latitude", "longitude", "source_id").repartition("vessel_id")
    return joined.groupBy("vessel_id", "event_time", *window).agg(F.min_by(F.struct("latitude", "longitude"), "source_id").alias("p")).select("vessel_id", "event_time", *window, "p.latitude", "p.longitude")


def heatmap(fixes: DataFrame, registry: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``ix, iy, flag, type_id, vessels, seconds``: credited time by cell, flag and type, with the cell's number of vessels.

    Credit follows the vessel's whole track; only then are cells cut, so a regional cell equals the global one. The bbox also picks the
    candidate vessels, by the cells that it touches: they are found by a scan of the box alone, and only their fixes are shuffled.
    Fixes move once, by vessel; sums by cell and vessel move once, by cell.
    """
    cells = lambda df: df.withColumns({"ix": geo.cell_index(F.col("longitude"), GRID_LON), "iy": geo.cell_index(F.col("latitude"), GRID_LAT)})
    returned = F.lit(True)
    if bbox:
        index = geo.cell_index
        returned = F.col("ix").between(index(F.lit(bbox[0]), GRID_LON), index(F.lit(bbox[2]), GRID_LON)) & F.col("iy").between(index(F.lit(bbox[1]), GRID_LAT), index(F.lit(bbox[3]), GRID_LAT))
        # Literal bounds, a cell wider than the box, reach the scan; the cells decide.
        wide = F.col("longitude").between(bbox[0] - GRID_LON, bbox[2] + GRID_LON) & F.col("latitude").between(bbox[1] - GRID_LAT, bbox[3] + GRID_LAT)
        fixes = fixes.join(cells(_in_band(fixes.filter(wide), registry)).filter(returned).select("vessel_id").distinct(), "vessel_id", "left_semi")
    track = in_band_fixes(fixes, registry)
    credited = cells(track.withColumn("gap_s", gap_seconds("vessel_id"))).filter(returned)
    per_vessel = credited.groupBy("ix", "iy", "vessel_id").agg(F.sum(credit()).alias("seconds")).filter("seconds > 0").join(registry.select("vessel_id", "flag", "type_id"), "vessel_id")
    by_kind = per_vessel.repartition("ix", "iy").groupBy("ix", "iy", "flag", "type_id").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))
    # A vessel has one flag and type, so the cell's vessels are a sum over them.
    return by_kind.withColumn("vessels", F.sum("n").over(Window.partitionBy("ix", "iy"))).select("ix", "iy", "flag", "type_id", "vessels", "seconds")


def weights(cells: DataFrame) -> DataFrame:
    """Nested weights of each cell: flag -> type -> minutes with two decimals, without those that round to nothing."""
    minutes = (F.floor(F.col("seconds") / 60 * 100 + 0.5) / 100).alias("minutes")
    rows = cells.select("ix", "iy", "vessels", "flag", "type_id", minutes).filter("minutes > 0")
    by_flag = rows.groupBy("ix", "iy", "vessels", "flag").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("type_id").cast("string"), "minutes")))).alias("types"))
    return by_flag.groupBy("ix", "iy", "vessels").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("flag", F.to_json("types"))))).alias("weights"))


def hover_prefilter(lat: float, lon: float, radius_km: float) -> Column:
    """A generous box around the circle: latitudes, and one or two longitude ranges where it meets the date line; all of them near a pole."""
    import math

    margin = radius_km / 110.0 + GRID_LAT
    low, high = lat - margin, lat + margin
    inside = F.col("latitude").between(max(low, -90.0), min(high, 90.0))
    if high >= 89.0 or low <= -89.0:
        return inside
    wide = radius_km / (110.0 * math.cos(math.radians(max(abs(low), abs(high))))) + GRID_LON
    if wide >= 180:
        return inside
    west, east = lon - wide, lon + wide
    x = F.col("longitude")
    if west < -180:
        return inside & (x.between(-180.0, east) | x.between(west + 360, 180.0))
    if east > 180:
        return inside & (x.between(west, 180.0) | x.between(-180.0, east - 360))
    return inside & x.between(west, east)


def hover(fixes: DataFrame, registry: DataFrame, lat: float, lon: float, radius_km: float, windows: Sequence[tuple[str, str]]) -> DataFrame:
    """``vessel_id, name, flag, type_id, seconds``: credited time of cells whose centre lies in the circle, over disjoint windows.

    The gap never reaches from one window into another, and credit comes before the cut by area.
    """
    index = F.lit(None).cast("int")
    for i, (start, end) in enumerate(windows):
        index = F.when(in_period(start, end, closed=False), i).otherwise(index)
    within = fixes.withColumn("w", index).filter("w is not null")
    # Candidates come from a scan of the box around the circle; only their fixes are shuffled, once.
    near = _in_band(within.filter(hover_prefilter(lat, lon, radius_km)), registry).select("vessel_id").distinct()
    credited = in_band_fixes(within.join(near, "vessel_id", "left_semi"), registry, "w").withColumn("gap_s", gap_seconds("vessel_id", "w"))
    centre_lon = geo.cell_centre(geo.cell_index(F.col("longitude"), GRID_LON), GRID_LON)
    centre_lat = geo.cell_centre(geo.cell_index(F.col("latitude"), GRID_LAT), GRID_LAT)
    inside = credited.filter(geo.haversine_asin(F.lit(lat), F.lit(lon), centre_lat, centre_lon) <= radius_km)
    return inside.groupBy("vessel_id").agg(F.sum(credit()).alias("seconds")).filter("seconds > 0").join(registry.select("vessel_id", "name", "flag", "type_id"), "vessel_id")


def density(fixes: DataFrame, grid: float, limit: int) -> DataFrame:
    """Fixes and distinct vessels by rounded cell, densest first. Duplicates count, as this reads raw rows."""
    cells = fixes.groupBy(geo.snapped(F.col("latitude"), grid).alias("cell_lat"), geo.snapped(F.col("longitude"), grid).alias("cell_lon")).agg(F.count("*").alias("fixes"), F.countDistinct("vessel_id").alias("vessels"))
    return cells.orderBy(F.desc("fixes"), "cell_lat", "cell_lon").limit(limit)


def effort(fixes: DataFrame, longest_gap: int = MAX_GAP_S) -> DataFrame:
    """Fishing time by vessel over fixes that are already cut by area, band and period."""
    track = fixes.select("vessel_id", "event_time").distinct().withColumn("gap_s", gap_seconds("vessel_id"))
    return track.groupBy("vessel_id").agg(
        F.count("*").alias("fixes"), F.sum(credit(longest=longest_gap)).alias("fishing_seconds"), F.countDistinct(F.to_date("event_time")).alias("active_days"),
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
    )


def tracks(fixes: DataFrame, step: int) -> DataFrame:
    """The newest known values of each vessel and epoch-aligned bucket of ``step`` seconds."""
    order = ("event_time", "ingest_time", "source_id")
    bucket = F.floor(F.unix_timestamp("event_time") / step)
    return fixes.groupBy("vessel_id", bucket.alias("bucket")).agg(F.max("event_time").alias("t"), *[arg_max(c, *order) for c in ("latitude", "longitude", "speed", "heading", "course", "status")])


def asked_for(fixes: DataFrame, windows: DataFrame) -> DataFrame:
    """``fixes`` of the vessels and of the overall span of requested windows ``vessel_id, from_time, to_time``.

    The request, limited to ``params.MAX_WINDOWS`` rows, is read first, so that vessels and times are literals that reach the
    scan: files and row groups outside them are not read.
    """
    micros = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("from_time", "to_time")]
    rows = windows.select("vessel_id", *micros).limit(MAX_WINDOWS + 1).collect()
    if len(rows) > MAX_WINDOWS:
        raise RequestError("too_many_windows", f"at most {MAX_WINDOWS} windows")
    if not rows:
        return fixes.filter(F.lit(False))
    instant = lambda us: F.timestamp_micros(F.lit(us))
    span = F.col("event_time").between(instant(min(r["from_time"] for r in rows)), instant(max(r["to_time"] for r in rows)))
    return fixes.filter(F.col("vessel_id").isin(sorted({r["vessel_id"] for r in rows})) & span)


def track_windows(fixes: DataFrame, windows: DataFrame, max_points: int) -> DataFrame:
    """Thinned track of each requested window ``idx, vessel_id, from_time, to_time`` (both ends included); a window may overlap others.

    Buckets start at the window's start and are one second longer than the share, so the cap is never reached. The request list is
    limited (``asked_for``) and therefore broadcast; its vessels and overall span also cut the scan.
    """
    w = windows.withColumn("step", F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.unix_timestamp("to_time") - F.unix_timestamp("from_time")) / max_points) + 1))
    joined = asked_for(fixes, windows).join(F.broadcast(w), "vessel_id").filter(F.col("event_time").between(F.col("from_time"), F.col("to_time")))
    bucket = F.floor((F.unix_timestamp("event_time") - F.unix_timestamp("from_time")) / F.col("step"))
    order = ("event_time", "ingest_time", "source_id")
    points = joined.groupBy("idx", bucket.alias("bucket")).agg(F.max("event_time").alias("t"), *[arg_max(c, *order) for c in ("latitude", "longitude", "speed", "status")])
    return windows.select("idx", "vessel_id").join(points, "idx", "left")


def fix_windows(fixes: DataFrame, windows: DataFrame, per_vessel: int) -> DataFrame:
    """Fixes of overlapping windows: one for each vessel and time (the last ingested), the newest ``per_vessel`` of a vessel, dealt to every window that holds them.

    The request list is limited and cuts the scan, as in ``track_windows``.
    """
    joined = asked_for(fixes, windows).join(F.broadcast(windows), "vessel_id").filter(F.col("event_time").between(F.col("from_time"), F.col("to_time")))
    seen = joined.groupBy("vessel_id", "event_time").agg(*[arg_max(c, "ingest_time", "source_id") for c in ("latitude", "longitude", "speed")])
    newest = seen.withColumn("turn", F.row_number().over(Window.partitionBy("vessel_id").orderBy(F.desc("event_time")))).filter(F.col("turn") <= per_vessel)
    return newest.join(F.broadcast(windows), "vessel_id").filter(F.col("event_time").between(F.col("from_time"), F.col("to_time"))).select("idx", "vessel_id", "event_time", "latitude", "longitude", "speed")


def fishing_runs(fixes: DataFrame, key: str = "vessel_id", gap_minutes: int = 30) -> DataFrame:
    """Stretches of fishing speed: a fix out of band or without a speed ends a run, and so does a gap over ``gap_minutes``."""
    w = Window.partitionBy(key).orderBy("event_time", "source_id")
    ms = F.unix_millis("event_time")
    marked = fixes.withColumn("fishing", is_fishing()).withColumns({"before": F.lag("fishing").over(w), "gap": ms - F.lag(ms).over(w)})
    starts = F.col("fishing") & (~F.coalesce("before", F.lit(False)) | (F.col("gap") > gap_minutes * 60_000))
    runs = marked.withColumn("run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("fishing")
    return runs.groupBy(key, "run").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count("*").alias("fix_count"), F.min("event_time").alias("run_start"),
        F.max("event_time").alias("run_end"), F.avg("speed").alias("avg_knots"),
    )


def daily_rollup(fixes: DataFrame) -> DataFrame:
    """Fixes and bounding box by vessel and day."""
    return fixes.groupBy("vessel_id", F.to_date("event_time").alias("day")).agg(
        F.count("*").alias("fixes"), F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon")
    )
