"""Filters, joins, windows, rankings and set operators, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import geo, requests
from tidewater.operators import cases as K
from tidewater.operators import catches as C
from tidewater.operators import positions as P
from tidewater.operators import sinks as S
from tidewater.operators import sweeps
from tidewater.plans import ais, places
from tidewater.plans.base import query
from tidewater.sources import bridge as B

_FIX = "WITH " + B.FIXES_SQL
_FROM, _TO = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
_PERIOD = f"event_time >= TIMESTAMP '{_FROM}' AND event_time < TIMESTAMP '{_TO}'"
_JOURNAL = "WITH " + B.ENTRIES_SQL + ",\n" + B.LINES_SQL
_CLOSURE = "WITH " + B.CLOSURES_SQL
_CASES = "WITH " + B.CASES_SQL + ",\n" + B.REVISIONS_SQL


@query("flt_01", _FIX + f" SELECT source_id FROM fix WHERE {_PERIOD}")
def flt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open period."""
    return B.fixes(spark, sf_dir).filter(P.in_period(_FROM, _TO, closed=False)).select("source_id")


@query("flt_02", _FIX + " SELECT f.source_id FROM fix f, (SELECT min(event_time) AS a, max(event_time) AS b FROM fix WHERE vessel_id = 7) w WHERE f.event_time BETWEEN w.a AND w.b")
def flt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed period, whose ends are times of fixes: both of them are inside."""
    fixes = B.fixes(spark, sf_dir)
    a, b = fixes.filter("vessel_id = 7").agg(F.min("event_time"), F.max("event_time")).select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("min(event_time)", "max(event_time)")]).first()
    return fixes.filter(P.in_period(a, b, closed=True) if a else F.lit(False)).select("source_id")


@query("flt_03", _FIX + f" SELECT source_id FROM fix WHERE {ais._BBOX}")
def flt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).filter(geo.in_bbox(F.col("longitude"), F.col("latitude"), ais.BBOX)).select("source_id")


_SECOND = ((-6.0, 60.1), (-5.1, 60.2), (-5.3, 60.45), (-6.0, 60.1))


@query("flt_05", _FIX + f" SELECT source_id FROM fix WHERE {ais._ring_sql()} OR {ais._ring_sql(_SECOND)}")
def flt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside any of two outer rings."""
    return B.fixes(spark, sf_dir).filter(geo.in_any_ring(F.col("longitude"), F.col("latitude"), [ais.RING, _SECOND])).select("source_id")


@query("flt_06", _FIX + " SELECT source_id FROM fix WHERE vessel_id IN (1, 2, 3, 50, 77, 999999) AND status IN ('view', 'click', 'error')")
def flt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).filter(F.col("vessel_id").isin(1, 2, 3, 50, 77, 999_999) & F.col("status").isin("view", "click", "error")).select("source_id")


_REG = ",\n".join([B.FIXES_SQL, B.REGISTRY_SQL, ais._REG])


@query("flt_07", f"WITH {_REG} SELECT source_id, type_id FROM fix JOIN reg USING (vessel_id) WHERE speed BETWEEN low AND high")
def flt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes inside the speed band of their vessel's type."""
    joined = B.fixes(spark, sf_dir).join(ais._registry(spark, sf_dir), "vessel_id")
    return joined.filter(F.col("speed").between(F.col("band_low"), F.col("band_high"))).select("source_id", "type_id")


_HOVER_LAT, _HOVER_LON, _HOVER_KM = 60.25, 179.5, 100.0
_EDGE = "(longitude + 7e0) * 180e0 - 180e0"


@query("flt_09", f"""{_FIX}, w AS (SELECT source_id, latitude, {_EDGE} AS longitude FROM fix),
m AS (SELECT {_HOVER_KM} / 110e0 + 0.03e0 AS dlat), n AS (SELECT dlat, {_HOVER_KM} / (110e0 * cos(radians({_HOVER_LAT} + dlat))) + 0.1e0 AS dlon FROM m)
SELECT source_id FROM w, n WHERE latitude BETWEEN {_HOVER_LAT} - dlat AND {_HOVER_LAT} + dlat AND (longitude BETWEEN {_HOVER_LON} - dlon AND 180 OR longitude BETWEEN -180 AND {_HOVER_LON} + dlon - 360)""")
def flt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around a circle that reaches over the date line, over fixes all around the globe."""
    spread = B.fixes(spark, sf_dir).withColumn("longitude", (F.col("longitude") + 7.0) * 180.0 - 180.0)
    return spread.filter(P.hover_prefilter(_HOVER_LAT, _HOVER_LON, _HOVER_KM)).select("source_id")


@query("flt_10", _FIX + " SELECT source_id FROM fix WHERE speed BETWEEN 0.3 AND 5.5")
def flt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fishing speed; an unknown speed, and what is no finite number, is none."""
    fixes = B.fixes(spark, sf_dir)
    odd = fixes.withColumn("speed", F.when(F.col("status") == "error", F.lit(float("nan"))).otherwise(F.col("speed")))
    return odd.filter(P.is_fishing()).select("source_id")


@query("flt_12", "WITH " + B.FEATURES_SQL + " SELECT feature_id, name FROM feature WHERE name ILIKE 'b%'")
def flt_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix search, whatever the case."""
    return B.features(spark, sf_dir).filter(F.col("name").ilike("B".lower() + "%")).select("feature_id", "name")


@query("flt_16", _CASES + " SELECT case_id FROM cases WHERE admin_status IN ('unread', 'under_review', 'awaiting_geometry') AND assignee IN (1, 2, 3) AND NOT is_read AND (snoozed_until IS NULL OR snoozed_until <= 20)")
def flt_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread cases of some assignees, without those that still sleep."""
    awake = F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= 20)
    wanted = F.col("admin_status").isin("unread", "under_review", "awaiting_geometry") & F.col("assignee").isin(1, 2, 3)
    return B.cases(spark, sf_dir).filter(wanted & ~F.col("is_read") & awake).select("case_id")


@query("flt_19", "WITH " + B.REGISTRY_SQL + " SELECT vessel_id, type_id FROM registry WHERE snapshot = (SELECT max(snapshot) FROM registry)")
def flt_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the newest snapshot, by a scalar subquery."""
    rows = B.registry(spark, sf_dir)
    newest = rows.agg(F.max("snapshot").alias("snapshot"))  # one row
    return rows.join(F.broadcast(newest), "snapshot", "left_semi").select("vessel_id", "type_id")


@query("flt_21", _CASES + " SELECT case_id FROM cases WHERE assignee IS DISTINCT FROM CASE WHEN case_id % 3 <> 0 THEN case_id % 13 END")
def flt_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose assignee is not the stated one; a missing one on both sides is equal."""
    key = F.col("case_id")
    return B.cases(spark, sf_dir).filter(~F.col("assignee").eqNullSafe(F.when(key % 3 != 0, key % 13))).select("case_id")


@query("flt_22", _JOURNAL + " SELECT innmelding_id, reported_date FROM entry WHERE reported_date < '1996-03-15' OR (reported_date = '1996-03-15' AND innmelding_id < 9000)")
def flt_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes after a (date, id) cursor, newest first."""
    day, key = F.col("reported_date"), F.col("innmelding_id")
    return B.catch_entries(spark, sf_dir).filter((day < "1996-03-15") | ((day == "1996-03-15") & (key < 9000))).select("innmelding_id", "reported_date")


def _values(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    literal = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else f"{v}L"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({', '.join(names)})")


@query("flt_23", """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 120 AS days, o_orderkey % 3 <> 0 AS boxed, (o_orderkey % 101) * (o_orderkey % 61)::DOUBLE AS area FROM orders)
SELECT id, CASE WHEN days = 0 THEN 'bad_window' WHEN days > CASE WHEN boxed THEN 92 ELSE 31 END THEN 'window_too_long' WHEN boxed AND area > 2500 THEN 'bbox_too_large' ELSE 'ok' END AS outcome FROM r""")
def flt_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of many lengths and boxes against their limits, as columns."""
    k = F.col("o_orderkey")
    boxed = k % 3 != 0
    rows = B.table(spark, sf_dir, "orders").select(k.alias("id"), (k % 120).alias("days"), boxed.alias("boxed"), F.when(boxed, (k % 101) * (k % 61)).cast("double").alias("area"))
    return rows.select("id", requests.refusal(F.col("days"), F.col("area")).alias("outcome"))


@query("flt_24", """SELECT l_orderkey AS id, l_linenumber AS line, round(least(1e0, greatest(0.02e0, l_discount::DOUBLE)), 6) AS grid, least(120, greatest(1, l_quantity))::DOUBLE * 1e0 AS gap_minutes, least(10000e0, greatest(1e0, l_extendedprice::DOUBLE)) AS "limit" FROM lineitem""")
def flt_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted values of each line, clamped to what the service allows."""
    wanted = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_discount").cast("double").alias("grid"), F.col("l_quantity").cast("double").alias("gap_minutes"), F.col("l_extendedprice").cast("double").alias("limit"))
    used = lambda name: requests.clamped(name, F.col(name)).alias(name)
    return wanted.select("id", "line", F.round(used("grid"), 6).alias("grid"), used("gap_minutes"), used("limit"))


@query("prj_03", "WITH " + B.FEATURES_SQL + """ SELECT feature_id, name, NULL::VARCHAR AS geojson, false AS asked FROM feature UNION ALL SELECT feature_id, name, '{"type":"Point","coordinates":[' || round(lon, 6) || ',' || round(lat, 6) || ']}', true FROM feature""")
def prj_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection with and without its geometry column."""
    bare, full = (projected_features(B.features(spark, sf_dir), asked) for asked in (False, True))
    return bare.withColumn("geojson", F.lit(None).cast("string")).withColumn("asked", F.lit(False)).unionByName(full.withColumn("asked", F.lit(True)))


def projected_features(features: DataFrame, include_geojson: bool) -> DataFrame:
    """``feature_id, name``, and ``geojson`` only where asked for: else its columns are not read."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 6), F.round("lat", 6)).alias("coordinates")))
    return features.select("feature_id", "name", *([point.alias("geojson")] if include_geojson else []))


@query("jn_04", f"WITH {_REG}, m AS (SELECT vessel_id, count(*) AS fixes, round(max(speed), 6) AS fastest FROM fix GROUP BY 1) SELECT vessel_id, name, flag, type_id, fixes, fastest FROM m JOIN reg USING (vessel_id)")
def jn_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by vessel, joined with the registry only after they are aggregated."""
    per_vessel = B.fixes(spark, sf_dir).groupBy("vessel_id").agg(F.count("*").alias("fixes"), F.round(F.max("speed"), 6).alias("fastest"))
    return per_vessel.join(ais._registry(spark, sf_dir), "vessel_id").select("vessel_id", "name", "flag", "type_id", "fixes", "fastest")


@query("jn_05", f"WITH {_REG} SELECT source_id FROM fix WHERE vessel_id IN (SELECT DISTINCT vessel_id FROM registry WHERE type_id = 3)")
def jn_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = B.registry(spark, sf_dir).filter("type_id = 3").select("vessel_id")
    return B.fixes(spark, sf_dir).join(some, "vessel_id", "left_semi").select("source_id")


@query("jn_06", "WITH " + B.COMPANIES_SQL + ", " + B.ACCOUNTS_SQL + " SELECT company_id, name FROM company c WHERE EXISTS (SELECT 1 FROM account a WHERE a.company_id = c.company_id AND a.year = 1996)")
def jn_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with a report of a year."""
    return B.companies(spark, sf_dir).join(B.account_values(spark, sf_dir).filter("year = 1996"), "company_id", "left_semi").select("company_id", "name")


_RUNS = "SELECT o_custkey AS job, o_orderkey AS run_id, o_orderdate AS started FROM orders"


@query("jn_09", f"WITH r AS ({_RUNS}) SELECT job, run_id FROM r WHERE run_id NOT IN (SELECT run_id FROM (SELECT run_id, row_number() OVER (PARTITION BY job ORDER BY started DESC, run_id DESC) AS t FROM r) WHERE t <= 5)")
def jn_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs to delete: those that are not among the five newest of their job."""
    runs = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"))
    kept = S.keep_newest(runs, ["job"], 5, "started", "run_id").select("run_id")
    return runs.join(kept, "run_id", "left_anti").select("job", "run_id")


@query("jn_10", f"{_FIX}, {ais._WINDOWS_SQL} SELECT idx, source_id FROM fix JOIN win ON fix.vessel_id = win.vessel_id AND event_time BETWEEN from_time AND to_time")
def jn_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested windows and the fixes inside them; windows overlap."""
    asked = ais._windows(spark)
    cut = P.asked_for(B.fixes(spark, sf_dir), asked)
    return cut.join(F.broadcast(asked), "vessel_id").filter(F.col("event_time").between(F.col("from_time"), F.col("to_time"))).select("idx", "source_id")


@query("jn_11", f"{_FIX}, {ais._WINDOWS_SQL} SELECT win.idx, win.vessel_id, count(fix.source_id) AS fixes FROM win LEFT JOIN fix ON fix.vessel_id = win.vessel_id AND event_time BETWEEN from_time AND to_time GROUP BY 1, 2")
def jn_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of each requested window in the order of the request, empty windows included."""
    asked = ais._windows(spark)
    found = jn_10(spark, sf_dir).groupBy("idx").agg(F.count("*").alias("n"))
    return asked.select("idx", "vessel_id").join(found, "idx", "left").select("idx", "vessel_id", F.coalesce("n", F.lit(0)).alias("fixes"))


def directory_sql() -> str:
    """The rules of vessel resolution over ``report`` (name, mark) and ``directory``, as DuckDB text."""
    folding = "translate(lower(trim(coalesce({0}, ''))), '" + C.ACCENTED + "', '" + C.UNACCENTED + "')"
    for letter, plain in C.PLAIN.items():
        folding = f"replace({folding}, '{letter}', '{plain}')"
    folded = lambda c: f"trim(regexp_replace(trim(regexp_replace({folding.format(c)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '\\s+[a-z]{{1,3}}\\s?\\d{{2,6}}$', ''))"
    mark = lambda c: f"nullif(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '[\\s\\-_.]', '', 'g'), '([a-z])0+([0-9])', '\\1\\2', 'g'), '')"
    fleet = f"""SELECT id, status_id = 1 AS active, nullif(lower(trim(coalesce(name, ''))), '') AS name, nullif({folded('name')}, '') AS folded,
      [x FOR x IN [{mark('registration_number')}, {mark('call_sign')}, {mark('mmsi')}] IF x IS NOT NULL] AS strong,
      list_distinct([x FOR x IN [{mark('registration_number')}, {mark('call_sign')}, {mark('mmsi')}, {mark('harbour_number')}] IF x IS NOT NULL]) AS marks FROM directory"""
    pairs = f"SELECT DISTINCT vessel_name, registration_mark, nullif(lower(trim(coalesce(vessel_name, ''))), '') AS name, nullif({folded('vessel_name')}, '') AS folded, {mark('registration_mark')} AS mark FROM report"

    def matched(tag: str, active: str) -> str:
        return f"""{tag}_f AS (SELECT * FROM fleet WHERE active = {active}),
{tag}_n AS (SELECT name, list(id) AS ids, list({{'id': id, 'marks': marks}}) AS m FROM {tag}_f WHERE name IS NOT NULL GROUP BY name),
{tag}_a AS (SELECT folded, list(id) AS ids, list({{'id': id, 'marks': marks}}) AS m FROM {tag}_f WHERE folded IS NOT NULL GROUP BY folded),
{tag}_h AS (SELECT mark, min(id) AS lo, max(id) AS hi FROM (SELECT id, unnest(strong) AS mark FROM {tag}_f) GROUP BY mark),
{tag}_j AS (SELECT p.vessel_name, p.registration_mark, n.ids AS n_ids, a.ids AS a_ids, h.lo, h.hi, p.mark,
    [v.id FOR v IN n.m IF list_contains(v.marks, p.mark)] AS n_agree, [v.id FOR v IN a.m IF list_contains(v.marks, p.mark)] AS a_agree
  FROM pairs p LEFT JOIN {tag}_n n ON p.name = n.name LEFT JOIN {tag}_a a ON p.folded = a.folded LEFT JOIN {tag}_h h ON p.mark = h.mark),
{tag}_i AS (SELECT *, CASE WHEN n_ids IS NOT NULL THEN CASE WHEN len(n_ids) = 1 THEN n_ids[1] WHEN mark IS NOT NULL AND len(n_agree) = 1 THEN n_agree[1] END
    ELSE coalesce(CASE WHEN mark IS NOT NULL THEN CASE WHEN len(a_agree) = 1 THEN a_agree[1] END WHEN len(a_ids) = 1 THEN a_ids[1] END, CASE WHEN lo = hi THEN lo END) END AS id FROM {tag}_j),
{tag} AS (SELECT vessel_name, registration_mark, id, CASE WHEN id IS NOT NULL THEN 'resolved' WHEN n_ids IS NOT NULL THEN 'ambiguous-name' WHEN lo <> hi THEN 'ambiguous-mark' WHEN len(a_ids) > 1 THEN 'ambiguous-name' ELSE 'none' END AS kind FROM {tag}_i)"""

    return f"""fleet AS ({fleet}), pairs AS ({pairs}), {matched('act', 'true')}, {matched('ret', 'false')},
hull AS (SELECT mark, count(DISTINCT id) AS n, min(id) AS id, arg_min(folded, id) AS folded, arg_min(marks, id) AS marks FROM (SELECT unnest(strong) AS mark, id, folded, marks FROM ret_f) GROUP BY mark),
answer AS (SELECT p.vessel_name, p.registration_mark, h.id, h.n = 1 AND (h.folded = p.folded OR (starts_with(h.folded, p.folded || ' ') AND list_contains(h.marks, {mark("substr(h.folded, length(p.folded) + 2)")}))) AS answers FROM pairs p JOIN hull h ON p.mark = h.mark),
resolved AS (SELECT p.vessel_name, p.registration_mark, CASE WHEN a.kind = 'resolved' THEN a.id WHEN a.kind = 'ambiguous-name' THEN CASE WHEN w.answers THEN w.id END WHEN a.kind = 'none' AND r.kind = 'resolved' THEN r.id END AS vessel_id
  FROM pairs p JOIN act a ON a.vessel_name IS NOT DISTINCT FROM p.vessel_name AND a.registration_mark IS NOT DISTINCT FROM p.registration_mark JOIN ret r ON r.vessel_name IS NOT DISTINCT FROM p.vessel_name AND r.registration_mark IS NOT DISTINCT FROM p.registration_mark
  LEFT JOIN answer w ON w.vessel_name IS NOT DISTINCT FROM p.vessel_name AND w.registration_mark IS NOT DISTINCT FROM p.registration_mark)"""


_REPORT = """report AS (SELECT CASE WHEN c_custkey % 11 <> 0 THEN ' VESSEL ' || (c_custkey % 800) END AS vessel_name,
  CASE WHEN c_custkey % 4 <> 1 THEN 'r ' || (c_custkey % 900) WHEN c_custkey % 8 = 1 THEN 'cs-' || c_custkey END AS registration_mark FROM customer)"""
_RESOLVED = f"WITH {B.DIRECTORY_SQL}, {_REPORT}, {directory_sql()}"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return B.table(spark, sf_dir, "customer").select(
        F.when(key % 11 != 0, F.concat(F.lit(" VESSEL "), (key % 800).cast("string"))).alias("vessel_name"),
        F.when(key % 4 != 1, F.concat(F.lit("r "), (key % 900).cast("string"))).when(key % 8 == 1, F.concat(F.lit("cs-"), key.cast("string"))).alias("registration_mark"),
    )


@query("ent_01", _RESOLVED + " SELECT vessel_name, registration_mark, vessel_id, CASE WHEN vessel_id IS NOT NULL THEN 'resolved' ELSE 'not-found' END AS outcome FROM resolved")
def ent_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel resolution of (name, mark) pairs."""
    return C.resolve_vessels(_reports(spark, sf_dir), B.directory(spark, sf_dir))


@query("jn_13", _RESOLVED + " SELECT d.status_id, count(*) AS pairs, count(r.vessel_id) AS resolved FROM resolved r LEFT JOIN directory d ON d.id = r.vessel_id GROUP BY 1")
def jn_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs resolve to vessels of either fleet."""
    found = C.resolve_vessels(_reports(spark, sf_dir), B.directory(spark, sf_dir))
    joined = found.join(B.directory(spark, sf_dir).select(F.col("id").alias("vessel_id"), "status_id"), "vessel_id", "left")
    return joined.groupBy("status_id").agg(F.count("*").alias("pairs"), F.count("vessel_id").alias("resolved"))


@query("jn_15", _CLOSURE + ", e AS (SELECT -1000000e0 AS x0, 8000000e0 AS y0, 500000e0 AS x1, 9500000e0 AS y1) SELECT jm_number FROM closure, e WHERE list_bool_or([radians(p.lon) * 6378137e0 BETWEEN x0 AND x1 AND ln(tan(radians(p.lat) / 2 + 0.7853981633974483e0)) * 6378137e0 BETWEEN y0 AND y1 FOR p IN points])")
def jn_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures with a vertex in an envelope in metres, which is a table of one row."""
    envelope = _values(spark, ("x0", "y0", "x1", "y1"), [(-1_000_000.0, 8_000_000.0, 500_000.0, 9_500_000.0)])
    inside = lambda p: geo.mercator_x(p["lon"]).between(F.col("x0"), F.col("x1")) & geo.mercator_y(p["lat"]).between(F.col("y0"), F.col("y1"))
    return B.closures(spark, sf_dir).crossJoin(F.broadcast(envelope)).filter(F.exists("points", inside)).select("jm_number")


_POINTERS = _CASES + """, n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY recorded_at DESC, revision_id DESC) AS t FROM revision),
ptr AS (SELECT c.case_id, (SELECT revision_id FROM n WHERE n.case_id = c.case_id AND t = 1) AS current_id, CASE WHEN c.admin_status = 'approved' THEN (SELECT min(revision_id) FROM n WHERE n.case_id = c.case_id) END AS published_id FROM cases c)"""


def _pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case with the revision it stands at, and the one that is published."""
    ends = B.revisions(spark, sf_dir).groupBy("case_id").agg(F.max_by("revision_id", F.struct("recorded_at", "revision_id")).alias("current_id"), F.min("revision_id").alias("first_id"))
    return B.cases(spark, sf_dir).join(ends, "case_id", "left").select("case_id", "current_id", F.when(F.col("admin_status") == "approved", F.col("first_id")).alias("published_id"))


@query("jn_16", _POINTERS + " SELECT p.case_id, a.content AS current_content, b.content AS published_content FROM ptr p LEFT JOIN revision a ON a.revision_id = p.current_id LEFT JOIN revision b ON b.revision_id = p.published_id")
def jn_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pointers of a case followed, where there are any."""
    content = lambda name: B.revisions(spark, sf_dir).select(F.col("revision_id").alias(f"{name}_id"), F.col("content").alias(f"{name}_content"))
    return _pointers(spark, sf_dir).join(content("current"), "current_id", "left").join(content("published"), "published_id", "left").select("case_id", "current_content", "published_content")


_BOXES = [("north", -10.0, 65.0, 5.0, 70.0), ("west", -10.0, 58.0, -4.0, 70.0), ("all", -180.0, -90.0, 180.0, 90.0)]


@query("jn_17", _CLOSURE + ", box AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}e0, {b}e0, {c}e0, {d}e0)" for n, a, b, c, d in _BOXES) + ") AS t(name, x0, y0, x1, y1)) SELECT box.name, jm_number FROM closure, box WHERE has_geo AND list_bool_or([p.lat BETWEEN y0 AND y1 AND p.lon BETWEEN x0 AND x1 FOR p IN points])")
def jn_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial join of closures with a few envelopes."""
    boxes = _values(spark, ("name", "x0", "y0", "x1", "y1"), _BOXES)
    inside = F.exists("points", lambda p: p["lat"].between(F.col("y0"), F.col("y1")) & p["lon"].between(F.col("x0"), F.col("x1")))
    return B.closures(spark, sf_dir).filter("has_geo").join(F.broadcast(boxes), inside).select("name", "jm_number")


@query("jn_18", _POINTERS + ",\n" + B.VALIDATIONS_SQL + """, v AS (SELECT revision_id, count(*) AS receipts, count(*) FILTER (passed) AS passed FROM validation GROUP BY 1), o AS (SELECT case_id, count(*) AS revisions FROM revision GROUP BY 1)
SELECT p.case_id, c.title, r.content, r.n_areas, coalesce(v.receipts, 0) AS receipts, coalesce(v.passed, 0) AS passed, o.revisions, CASE WHEN v.receipts IS NULL THEN 'no receipts' WHEN r.n_areas = 0 THEN 'no areas' END AS fault
FROM ptr p JOIN cases c USING (case_id) JOIN revision r ON r.revision_id = p.published_id LEFT JOIN v ON v.revision_id = p.published_id LEFT JOIN o ON o.case_id = p.case_id""")
def jn_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published cases put together from five sets, with the first fault of each."""
    own = _pointers(spark, sf_dir).filter("published_id IS NOT NULL").join(B.cases(spark, sf_dir).select("case_id", "title"), "case_id")
    pinned = B.revisions(spark, sf_dir).select(F.col("revision_id").alias("published_id"), "content", "n_areas")
    receipts = B.validations(spark, sf_dir).groupBy(F.col("revision_id").alias("published_id")).agg(F.count("*").alias("receipts"), F.count_if("passed").alias("passed"))
    all_of = B.revisions(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("revisions"))
    joined = own.join(pinned, "published_id").join(receipts, "published_id", "left").join(all_of, "case_id", "left")
    fault = F.when(F.col("receipts").isNull(), "no receipts").when(F.col("n_areas") == 0, "no areas")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("case_id", "title", "content", "n_areas", zero("receipts"), zero("passed"), "revisions", fault.alias("fault"))


_ORDER = "(event_time, ingest_ms, source_id)"


@query("agg_03", _FIX + f" SELECT vessel_id, arg_max(speed, {_ORDER}) AS speed, arg_max(status, {_ORDER}) AS status FROM fix GROUP BY 1")
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest known values by event time, then by ingest time."""
    return B.fixes(spark, sf_dir).groupBy("vessel_id").agg(*[P.arg_max(c, "event_time", "ingest_time", "source_id") for c in ("speed", "status")])


@query("agg_04", _FIX + " SELECT round_even(latitude / 0.25e0, 0) * 0.25e0 AS cell_lat, round_even(longitude / 0.25e0, 0) * 0.25e0 AS cell_lon, count(*) AS fixes, count(DISTINCT vessel_id) AS vessels FROM fix GROUP BY 1, 2 ORDER BY fixes DESC, 1, 2 LIMIT 40")
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 densest cells."""
    return P.density(B.fixes(spark, sf_dir), 0.25, 40)


@query("agg_07", ais._TRACKS + ",\nheat AS (WITH " + ais._HEAT.format(credit=ais._CREDIT, where="") + ") SELECT ix, iy, any_value(vessels) AS vessels, string_agg(flag || ':' || type_id || ':' || seconds, ',' ORDER BY flag, type_id) AS kinds FROM heat GROUP BY ix, iy")
def agg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their vessels and the list of credited time by flag and type."""
    kinds = F.sort_array(F.collect_list(F.struct("flag", "type_id", "seconds")))
    listed = ais.q_heatmap(spark, sf_dir).groupBy("ix", "iy").agg(F.first("vessels").alias("vessels"), kinds.alias("kinds"))
    text = F.transform("kinds", lambda k: F.concat_ws(":", k["flag"], k["type_id"].cast("string"), k["seconds"].cast("string")))
    return listed.withColumn("kinds", F.array_join(text, ","))


@query("win_03", "SELECT p_partkey AS id, sum(p_size * 100) OVER (ORDER BY p_partkey % 97 DESC, p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM part")
def win_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running bytes of a cache table, most recently hit first.

    The sum is taken in two steps, so that no task holds all rows: by hit, then inside a hit.
    """
    rows = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 100).cast("long").alias("bytes"), (F.col("p_partkey") % 97).alias("hit"))
    by_hit = rows.groupBy("hit").agg(F.sum("bytes").alias("total"))
    before = by_hit.select("hit", (F.sum("total").over(Window.orderBy(F.desc("hit"))) - F.col("total")).alias("before"))
    inside = F.sum("bytes").over(Window.partitionBy("hit").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(before, "hit").select("id", (F.col("before") + F.col("inside")).alias("running"))


_WALK = """m AS (SELECT *, coalesce(speed BETWEEN 0.3 AND 5.5, false) AS fishing FROM fix),
l AS (SELECT *, lag(fishing) OVER w AS before, ms - lag(ms) OVER w AS gap FROM m WINDOW w AS (PARTITION BY vessel_id ORDER BY event_time, source_id)),
r AS (SELECT *, sum(CASE WHEN fishing AND (NOT coalesce(before, false) OR gap > 1800000) THEN 1 ELSE 0 END) OVER (PARTITION BY vessel_id ORDER BY event_time, source_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l)"""


@query("win_05", f"{_FIX}, {_WALK} SELECT vessel_id, run, count(*) AS fixes FROM r WHERE fishing GROUP BY 1, 2")
def win_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of each run and of its fixes."""
    return P.fishing_runs(B.fixes(spark, sf_dir)).select("vessel_id", "run", F.col("fix_count").alias("fixes"))


@query("win_06", f"{_FIX}, {_WALK} SELECT vessel_id, run, ms_start, ms_end, floor(knots * 10 + 0.5) / 10 AS avg_knots FROM (SELECT vessel_id, run, min(ms) AS ms_start, max(ms) AS ms_end, round(avg(speed), 6) AS knots FROM r WHERE fishing GROUP BY 1, 2)")
def win_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of runs, mean speed with one decimal."""
    knots = F.floor(F.round("avg_knots", 6) * 10 + 0.5) / 10
    return P.fishing_runs(B.fixes(spark, sf_dir)).select("vessel_id", "run", F.unix_millis("run_start").alias("ms_start"), F.unix_millis("run_end").alias("ms_end"), knots.alias("avg_knots"))


@query("win_11", _FIX + f" SELECT vessel_id, floor(epoch(event_time) / greatest(1, 1339200 // 400))::BIGINT AS bucket, count(*) AS fixes FROM fix WHERE {_PERIOD} GROUP BY 1, 2")
def win_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch-aligned buckets: the period's share of at most 400 points."""
    step = max(1, 1_339_200 // 400)
    cut = B.fixes(spark, sf_dir).filter(P.in_period(_FROM, _TO, closed=False))
    return cut.groupBy("vessel_id", F.floor(F.unix_timestamp("event_time") / step).alias("bucket")).agg(F.count("*").alias("fixes"))


@query("win_12", f"""{_FIX}, {ais._WINDOWS_SQL} SELECT idx, floor((epoch(event_time) - epoch(from_time)) / greatest(1, floor(greatest(1, epoch(to_time) - epoch(from_time)) / 7) + 1))::BIGINT AS bucket, (epoch_us(max(event_time)) // 1000) AS t
FROM fix JOIN win ON fix.vessel_id = win.vessel_id AND event_time BETWEEN from_time AND to_time GROUP BY 1, 2""")
def win_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets from the start of each window; no window has over seven."""
    return P.track_windows(B.fixes(spark, sf_dir), ais._windows(spark), 7).filter("bucket IS NOT NULL").select("idx", "bucket", F.unix_millis("t").alias("t"))


@query("top_01", _FIX + " SELECT vessel_id, count(*) AS fixes FROM fix GROUP BY 1 ORDER BY fixes DESC, vessel_id LIMIT 10")
def top_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).groupBy("vessel_id").agg(F.count("*").alias("fixes")).orderBy(F.desc("fixes"), "vessel_id").limit(10)


@query("top_04", _CASES + " SELECT case_id, row_number() OVER (PARTITION BY region ORDER BY CASE urgency WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, NOT is_read DESC, updated_day DESC, case_id) AS place FROM cases")
def top_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place in the queue of a region: pressing ones first, then the unread."""
    w = Window.partitionBy("region").orderBy(K.urgency_rank(), F.desc(~F.col("is_read")), F.desc("updated_day"), "case_id")
    return B.cases(spark, sf_dir).select("case_id", F.row_number().over(w).cast("long").alias("place"))


@query("top_05", "WITH " + B.FEATURES_SQL + """ SELECT feature_id, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN lower(name) = 'blue' THEN 0 WHEN lower(name) LIKE 'blue%' THEN 1 ELSE 2 END, geometry_kind <> 'point', name, feature_id) AS place FROM feature WHERE lower(name) LIKE '%blue%'""")
def top_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance in each kind: equal, then prefix, then anywhere; points first."""
    low = F.lower("name")
    rank = F.when(low == "blue", 0).when(low.startswith("blue"), 1).otherwise(2)
    w = Window.partitionBy("kind").orderBy(rank, F.col("geometry_kind") != "point", "name", "feature_id")
    return B.features(spark, sf_dir).filter(low.contains("blue")).select("feature_id", F.row_number().over(w).cast("long").alias("place"))


def _km(lat: float, lon: float) -> str:
    return f"2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(lat - {lat}e0) / 2), 2) + cos(radians({lat}e0)) * cos(radians(lat)) * pow(sin(radians(lon - ({lon}e0)) / 2), 2))))"


@query("top_06", "WITH " + B.FEATURES_SQL + f" SELECT feature_id, round({_km(62.5, 3.5)}, 3) AS km FROM feature ORDER BY {_km(62.5, 3.5)}, feature_id LIMIT 25")
def top_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 features nearest to a point."""
    near = B.features(spark, sf_dir).withColumn("d", geo.haversine_asin(F.lit(62.5), F.lit(3.5), F.col("lat"), F.col("lon")))
    return near.orderBy("d", "feature_id").limit(25).select("feature_id", F.round("d", 3).alias("km"))


@query("top_08", _CASES + ",\n" + B.VALIDATIONS_SQL + """, r AS (SELECT case_id, string_agg(revision_id::VARCHAR, ',' ORDER BY recorded_at DESC, revision_id DESC) AS revisions, string_agg(status, '' ORDER BY revision_id) AS statuses FROM revision GROUP BY 1),
v AS (SELECT case_id, string_agg(revision_id || '/' || receipt, ',' ORDER BY revision_id, receipt) AS receipts FROM validation JOIN revision USING (revision_id) WHERE kind = 'legal' GROUP BY 1)
SELECT case_id, title, revisions, statuses, receipts FROM cases LEFT JOIN r USING (case_id) LEFT JOIN v USING (case_id)""")
def top_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their child lists, each in an order of its own."""
    revisions = B.revisions(spark, sf_dir)
    listed = lambda what, desc, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*what)), asc=not desc), text), ",")
    own = revisions.groupBy("case_id").agg(listed(["recorded_at", "revision_id"], True, lambda x: x["revision_id"].cast("string")).alias("revisions"), F.replace(listed(["revision_id", "status"], False, lambda x: x["status"]), F.lit(","), F.lit("")).alias("statuses"))
    legal = B.validations(spark, sf_dir).filter("kind = 'legal'").join(revisions.select("revision_id", "case_id"), "revision_id")
    receipts = legal.groupBy("case_id").agg(listed(["revision_id", "receipt"], False, lambda x: F.concat_ws("/", x["revision_id"].cast("string"), x["receipt"].cast("string"))).alias("receipts"))
    return B.cases(spark, sf_dir).select("case_id", "title").join(own, "case_id", "left").join(receipts, "case_id", "left")


@query("top_09", "SELECT s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY TRY_CAST(p AS INTEGER) ASC NULLS LAST, s_suppkey) AS place FROM (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'x' ELSE (s_suppkey % 30)::VARCHAR END AS p FROM supplier)")
def top_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in the order of their numbers, not of their digits; those without one last."""
    key = F.col("s_suppkey")
    paragraph = F.when(key % 4 == 0, F.lit(None)).when(key % 7 == 0, "x").otherwise((key % 30).cast("string"))
    w = Window.partitionBy("s_nationkey").orderBy(paragraph.try_cast("int").asc_nulls_last(), key)
    return B.table(spark, sf_dir, "supplier").select(key.alias("id"), F.row_number().over(w).cast("long").alias("place"))


# Source types with a default group, in the order of those groups, and where they start.
DEFAULT_GROUPS, DEFAULT_FLOOR = ("fiskeridir-jmelding", "fiskistofa-wfs", "logasavn", "vorn-veidibann"), 1000


def group_order(sort_order: Column, source_type: Column) -> Column:
    """Order of a group: its own, else that of the default group of its source, after all others."""
    known = F.array_position(F.array(*[F.lit(x) for x in DEFAULT_GROUPS]), source_type)
    return F.coalesce(sort_order, DEFAULT_FLOOR + F.when(known > 0, known - 1).otherwise(len(DEFAULT_GROUPS)))


_SOURCES = (*DEFAULT_GROUPS, "other")


@query("top_11", f"""WITH g AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS region, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 9 END AS sort_order, s_suppkey % 5 AS k FROM supplier)
SELECT id, coalesce(sort_order, {DEFAULT_FLOOR} + k) AS position, row_number() OVER (PARTITION BY region ORDER BY coalesce(sort_order, {DEFAULT_FLOOR} + k), name, id) AS place FROM g""")
def top_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a region: by their own order, then the default groups in theirs, then by name."""
    key = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in _SOURCES]), (key % 5 + 1).cast("int"))
    groups = B.table(spark, sf_dir, "supplier").select(key.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("region"), group_order(F.when(key % 3 != 0, key % 9), kind).alias("position"))
    return groups.select("id", "position", F.row_number().over(Window.partitionBy("region").orderBy("position", "name", "id")).cast("long").alias("place"))


_BRANCHES = ais.WINDOWS[:5]


@query("set_01", _FIX + " " + " UNION ALL ".join(f"SELECT {i} AS idx, source_id FROM fix WHERE vessel_id = {v} AND event_time BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for i, v, a, b in _BRANCHES))
def set_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of branches, each with its own vessel and period."""
    fixes = B.fixes(spark, sf_dir)
    parts = [fixes.filter((F.col("vessel_id") == v) & P.in_period(a, b, closed=True)).select(F.lit(i).alias("idx"), "source_id") for i, v, a, b in _BRANCHES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("set_03", _CASES + ",\n" + B.VALIDATIONS_SQL + " SELECT case_id, max(moment)::BIGINT AS last_at, count(*) AS events FROM (SELECT case_id, recorded_at AS moment FROM revision UNION ALL SELECT case_id, v.recorded_at FROM validation v JOIN revision USING (revision_id)) GROUP BY 1")
def set_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of a case over two tables."""
    revisions = B.revisions(spark, sf_dir)
    receipts = B.validations(spark, sf_dir).select("revision_id", F.col("recorded_at").alias("at")).join(revisions.select("revision_id", "case_id"), "revision_id")
    events = revisions.select("case_id", F.col("recorded_at").alias("at")).unionByName(receipts.select("case_id", "at"))
    return events.groupBy("case_id").agg(F.max("at").alias("last_at"), F.count("*").alias("events"))


@query("set_05", "WITH " + places.NOTICES_SQL + " SELECT doc_id, candidate, disagreement FROM notice")
def set_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the verdicts of several detectors, and whether they differ."""
    return places.notices(spark, sf_dir).select("doc_id", sweeps.candidate().alias("candidate"), sweeps.disagreement().alias("disagreement"))
