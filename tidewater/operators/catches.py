"""Catch journal operators: aggregation, paging, vessel resolution, derived positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import geo
from tidewater.operators import positions as P

# Letters that have no accent to strip, and the accented ones that fold to a base letter.
PLAIN = {"ø": "o", "æ": "ae", "ð": "d", "þ": "th"}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšţťūůűźżž"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssttuuuzzz"


def by_day(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Weight in kilograms by day and species: the stated weight, else tonnes, else nothing."""
    kg = F.coalesce("weight_kg", F.col("tonnes") * 1000, F.lit(0.0))
    return entries.join(lines, "innmelding_id").groupBy("reported_date", "species").agg(F.sum(kg).alias("weight_kg"))


def day_totals(days: DataFrame) -> DataFrame:
    """A row for each day with its total and the nested list by species."""
    return days.groupBy("reported_date").agg(F.sum("weight_kg").alias("total_kg"), F.sort_array(F.collect_list(F.struct("species", "weight_kg"))).alias("catches"))


def last_location(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """The newest report of each route that has a position."""
    placed = entries.join(lines.filter("route_key IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL"), "innmelding_id")
    newest = Window.partitionBy("route_key").orderBy(F.col("reported_date").desc_nulls_last(), F.col("reported_time").desc_nulls_last(), F.desc("innmelding_id"), "line_index")
    return placed.withColumn("turn", F.row_number().over(newest)).filter("turn = 1").select("route_key", "latitude", "longitude", "reported_date", "reported_time")


def last_position(lines: DataFrame) -> DataFrame:
    """Position of a report: that of its last line that has one."""
    return lines.filter("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy("innmelding_id").agg(F.max(F.struct("line_index", "latitude", "longitude")).alias("p")).select("innmelding_id", F.col("p.latitude").alias("reported_latitude"), F.col("p.longitude").alias("reported_longitude"))


def page(entries: DataFrame, lines: DataFrame, search: str, cursor: tuple[str, int] | None, limit: int) -> DataFrame:
    """A keyset page of reports, newest first, that match in a report or line column; one row more than ``limit`` tells that there is a next page."""
    like = f"%{search}%"
    hit = F.lit(False)
    for c in ("vessel_name", "registration_mark", "species", "quality", "route_key"):
        hit = hit | F.coalesce(F.col(c).ilike(like), F.lit(False))
    found = entries.join(lines, "innmelding_id", "left").filter(hit & F.col("reported_date").isNotNull()).select(*entries.columns).dropDuplicates(["innmelding_id"])
    if cursor:
        found = found.filter((F.col("reported_date") < cursor[0]) | ((F.col("reported_date") == cursor[0]) & (F.col("innmelding_id") < cursor[1])))
    return found.orderBy(F.desc("reported_date"), F.desc("innmelding_id")).limit(limit + 1)


def normal_text(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def folded_name(text: Column) -> Column:
    """A name without accents and punctuation, and without a registration mark at its end."""
    bare = F.translate(normal_text(text), ACCENTED, UNACCENTED)
    for letter, plain in PLAIN.items():
        bare = F.replace(bare, F.lit(letter), F.lit(plain))
    spaced = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    return F.trim(F.regexp_replace(spaced, r"\s+[a-z]{1,3}\s?\d{2,6}$", ""))


def compact_mark(text: Column) -> Column:
    """A mark without separators, and without zeros between a letter and a figure; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(normal_text(text), r"[\s\-_.]", ""), r"(?<=[a-z])0+(?=\d)", "")
    return F.when(bare != "", bare)


def _fleet(vessels: DataFrame) -> DataFrame:
    strong = F.array_compact(F.array(compact_mark(F.col("registration_number")), compact_mark(F.col("call_sign")), compact_mark(F.col("mmsi"))))
    weak = F.array_compact(F.array(compact_mark(F.col("harbour_number"))))
    name, folded = normal_text(F.col("name")), folded_name(F.col("name"))
    return vessels.select("id", F.when(name != "", name).alias("name"), F.when(folded != "", folded).alias("folded"), strong.alias("strong"), F.array_distinct(F.concat(strong, weak)).alias("marks"))


def _match(reports: DataFrame, fleet: DataFrame, tag: str) -> DataFrame:
    """Adds ``<tag>_kind`` (resolved, ambiguous-name, ambiguous-mark, none) and ``<tag>_id`` to distinct (name, mark) pairs."""
    bucket = F.collect_list(F.struct("id", "marks"))
    by_name = fleet.filter("name IS NOT NULL").groupBy("name").agg(bucket.alias("named"))
    by_folded = fleet.filter("folded IS NOT NULL").groupBy("folded").agg(bucket.alias("alike"))
    by_mark = fleet.select("id", F.explode("strong").alias("mark")).groupBy("mark").agg(F.min("id").alias("hull"), F.max("id").alias("other_hull"))
    joined = reports.join(by_name, "name", "left").join(by_folded, "folded", "left").join(by_mark, "mark", "left")
    agreeing = lambda c: F.filter(c, lambda v: F.array_contains(v["marks"], F.col("mark")))
    only = lambda c: F.when(F.size(c) == 1, c[0]["id"])
    named_id = F.coalesce(only(F.col("named")), F.when(F.col("mark").isNotNull(), only(agreeing("named"))))
    alike_id = F.when(F.col("mark").isNotNull(), only(agreeing("alike"))).otherwise(only(F.col("alike")))
    has_name, alike_n = F.col("named").isNotNull(), F.coalesce(F.size("alike"), F.lit(0))
    unique_hull, shared_hull = F.col("hull") == F.col("other_hull"), F.col("hull") != F.col("other_hull")
    found = F.when(has_name, named_id).otherwise(F.coalesce(alike_id, F.when(unique_hull, F.col("hull"))))
    kind = (
        F.when(found.isNotNull(), "resolved").when(has_name, "ambiguous-name").when(F.coalesce(shared_hull, F.lit(False)), "ambiguous-mark").when(alike_n > 1, "ambiguous-name").otherwise("none")
    )
    return joined.withColumns({f"{tag}_id": found, f"{tag}_kind": kind}).drop("named", "alike", "hull", "other_hull")


def resolve_vessels(reports: DataFrame, vessels: DataFrame, active_status: int = 1) -> DataFrame:
    """``vessel_name, registration_mark`` pairs -> ``outcome`` (resolved, not-found) and ``vessel_id``.

    The active fleet decides by exact name, by folded name, then by a mark that one vessel alone has. A name that several active
    vessels bear may still be a retired hull with the stated mark that answers to it; an ambiguous mark ends the search; only where the
    active fleet knows nothing is the retired one asked in the same way.
    """
    name, folded = normal_text(F.col("vessel_name")), folded_name(F.col("vessel_name"))
    pairs = reports.select("vessel_name", "registration_mark").distinct().withColumns({"name": F.when(name != "", name), "folded": F.when(folded != "", folded), "mark": compact_mark(F.col("registration_mark"))})
    active, retired = _fleet(vessels.filter(F.col("status_id") == active_status)), _fleet(vessels.filter(F.col("status_id") != active_status))
    matched = _match(_match(pairs, active, "active"), retired, "retired")
    hulls = retired.select(F.explode("strong").alias("mark"), "id", F.col("folded").alias("hull_folded"), "marks").groupBy("mark").agg(F.min(F.struct("id", "hull_folded", "marks")).alias("hull"), F.count_distinct("id").alias("n_hulls"))
    matched = matched.join(hulls, "mark", "left")
    tail = compact_mark(F.substring(F.col("hull.hull_folded"), F.length("folded") + 2, F.lit(1000)))
    answers = (F.col("n_hulls") == 1) & ((F.col("hull.hull_folded") == F.col("folded")) | (F.col("hull.hull_folded").startswith(F.concat("folded", F.lit(" "))) & F.array_contains(F.col("hull.marks"), tail)))
    vessel = (
        F.when(F.col("active_kind") == "resolved", F.col("active_id")).when(F.col("active_kind") == "ambiguous-name", F.when(F.coalesce(answers, F.lit(False)), F.col("hull.id")))
        .when(F.col("active_kind") == "none", F.when(F.col("retired_kind") == "resolved", F.col("retired_id")))
    )
    return matched.select("vessel_name", "registration_mark", vessel.alias("vessel_id")).withColumn("outcome", F.when(F.col("vessel_id").isNotNull(), "resolved").otherwise("not-found"))


def stale(entries: DataFrame, anchors: DataFrame, params_hash: str, retry: list[str], retry_before: int) -> DataFrame:
    """Reports whose derived position is missing, from other parameters, older than the report, or worth another try."""
    joined = entries.join(anchors, "innmelding_id", "left")
    again = F.col("anchor_status").isin(retry) & (F.col("computed_at") < retry_before)
    reason = (
        F.when(F.col("computed_at").isNull(), "missing").when(F.col("params_hash") != params_hash, "parameters").when(F.col("computed_at") < F.col("updated_at"), "outdated").when(again, "retry")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL")


def anchors(reports: DataFrame, fixes: DataFrame, lookback_hours: int = 48, sanity_km: float = 100.0) -> DataFrame:
    """Derived positions of reports ``innmelding_id, vessel_id, reported_at, reported_latitude, reported_longitude``.

    The runs of the vessel's fixes in the window before the report, as one plan: range join, run walk per report, distance to the stated
    position. Status, first that holds: no-vessel, no-track, no-run, ok.
    """
    start = F.timestamp_millis(F.unix_millis("reported_at") - lookback_hours * 3_600_000)
    asked = reports.withColumn("window_from", start)
    near = asked.filter("vessel_id IS NOT NULL").select("innmelding_id", "vessel_id", "window_from", "reported_at")
    # Vessel and day are the key, so that a report meets the few days of its window and not the whole track of a busy vessel.
    days = near.withColumn("day", F.explode(F.sequence(F.to_date("window_from"), F.to_date("reported_at"))))
    inside = days.join(fixes.withColumn("day", F.to_date("event_time")), ["vessel_id", "day"]).filter(F.col("event_time").between(F.col("window_from"), F.col("reported_at")))
    one = inside.groupBy("innmelding_id", "event_time").agg(*[P.arg_max(c, "ingest_time", "source_id") for c in ("latitude", "longitude", "speed")], F.max("source_id").alias("source_id"))
    counted = one.groupBy("innmelding_id").agg(F.count("*").alias("fix_count"))
    runs = P.fishing_runs(one, "innmelding_id").join(asked.select("innmelding_id", "reported_latitude", "reported_longitude"), "innmelding_id")
    km = geo.haversine_atan2(F.col("latitude"), F.col("longitude"), F.col("reported_latitude"), F.col("reported_longitude"))
    per_report = runs.groupBy("innmelding_id").agg(F.count("*").alias("run_count"), F.min(F.round(km, 1)).alias("nearest_km"), F.count_if(km > sanity_km).alias("beyond_limit"))
    out = asked.join(counted, "innmelding_id", "left").join(per_report, "innmelding_id", "left")
    status = F.when(F.col("vessel_id").isNull(), "no-vessel").when(F.col("fix_count").isNull(), "no-track").when(F.col("run_count").isNull(), "no-run").otherwise("ok")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("innmelding_id", status.alias("status"), zero("fix_count"), zero("run_count"), "nearest_km", zero("beyond_limit"))
