"""Catch journal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import catches as C
from tidewater.operators import positions as P
from tidewater.plans.base import query
from tidewater.sources import bridge as B

_JOURNAL = "WITH " + B.ENTRIES_SQL + ",\n" + B.LINES_SQL
FROM, TO = "1995-01-01", "1996-12-31"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the period; dates are text and compare as text."""
    return B.catch_entries(spark, sf_dir).filter(F.col("reported_date").between(FROM, TO))


@query("agg_10", _JOURNAL + f"""
SELECT reported_date, species, round(sum(coalesce(weight_kg, tonnes * 1000, 0)), 2) AS weight_kg FROM entry JOIN line USING (innmelding_id) WHERE reported_date BETWEEN '{FROM}' AND '{TO}' GROUP BY ALL""")
def agg_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_day(_entries(spark, sf_dir), B.catch_lines(spark, sf_dir)).withColumn("weight_kg", F.round("weight_kg", 2))


@query("q_catch", _JOURNAL + f""",
day AS (SELECT reported_date, species, sum(coalesce(weight_kg, tonnes * 1000, 0)) AS kg FROM entry JOIN line USING (innmelding_id) WHERE reported_date BETWEEN '{FROM}' AND '{TO}' GROUP BY ALL)
SELECT reported_date, round(sum(kg), 2) AS total_kg, count(*) AS n_species, string_agg(species, '|' ORDER BY species) AS species FROM day GROUP BY reported_date""")
def q_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = C.day_totals(C.by_day(_entries(spark, sf_dir), B.catch_lines(spark, sf_dir)))
    return days.select("reported_date", F.round("total_kg", 2).alias("total_kg"), F.size("catches").cast("long").alias("n_species"), F.array_join(F.transform("catches", lambda c: c["species"]), "|").alias("species"))


@query("agg_11", _JOURNAL + """,
r AS (SELECT route_key, latitude, longitude, reported_date, reported_time, row_number() OVER (PARTITION BY route_key ORDER BY reported_date DESC NULLS LAST, reported_time DESC NULLS LAST, innmelding_id DESC, line_index) AS turn
  FROM entry JOIN line USING (innmelding_id) WHERE route_key IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)
SELECT route_key, latitude, longitude, reported_date, reported_time FROM r WHERE turn = 1""")
def agg_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_location(B.catch_entries(spark, sf_dir), B.catch_lines(spark, sf_dir))


@query("jn_03", _JOURNAL + """
SELECT e.innmelding_id, r.latitude AS reported_latitude, r.longitude AS reported_longitude FROM entry e
LEFT JOIN (SELECT innmelding_id, arg_max(latitude, (line_index, latitude, longitude)) AS latitude, arg_max(longitude, (line_index, latitude, longitude)) AS longitude FROM line WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1) r USING (innmelding_id)""")
def jn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.catch_entries(spark, sf_dir).select("innmelding_id").join(C.last_position(B.catch_lines(spark, sf_dir)), "innmelding_id", "left")


CURSOR = ("1996-06-30", 20_000)


@query("q_catchfull", _JOURNAL + f"""
SELECT DISTINCT e.innmelding_id, e.reported_date, e.vessel_name, e.registration_mark FROM entry e LEFT JOIN line l USING (innmelding_id)
WHERE (e.vessel_name ILIKE '%77%' OR e.registration_mark ILIKE '%77%' OR l.species ILIKE '%77%' OR l.quality ILIKE '%77%' OR l.route_key ILIKE '%77%') AND e.reported_date BETWEEN '{FROM}' AND '{TO}'
  AND (e.reported_date < '{CURSOR[0]}' OR (e.reported_date = '{CURSOR[0]}' AND e.innmelding_id < {CURSOR[1]}))
ORDER BY e.reported_date DESC, e.innmelding_id DESC LIMIT 51""")
def q_catchfull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(_entries(spark, sf_dir), B.catch_lines(spark, sf_dir), "77", CURSOR, 50).select("innmelding_id", "reported_date", "vessel_name", "registration_mark")


@query("agg_27", _JOURNAL + " SELECT DISTINCT route_key FROM line WHERE route_key IS NOT NULL")
def agg_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.catch_lines(spark, sf_dir).select("route_key").filter("route_key IS NOT NULL").distinct()


@query("jn_01", _JOURNAL + " SELECT priority, count(*) AS n, round(sum(tonnes), 2) AS tonnes FROM entry JOIN line USING (innmelding_id) GROUP BY priority")
def jn_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.catch_entries(spark, sf_dir).join(B.catch_lines(spark, sf_dir), "innmelding_id").groupBy("priority").agg(F.count("*").alias("n"), F.round(F.sum("tonnes"), 2).alias("tonnes"))


@query("jn_02", _JOURNAL + " SELECT e.innmelding_id, e.reported_date FROM entry e WHERE EXISTS (SELECT 1 FROM line l WHERE l.innmelding_id = e.innmelding_id AND l.species ILIKE '%a%')")
def jn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.catch_lines(spark, sf_dir).filter(F.col("species").ilike("%a%"))
    return B.catch_entries(spark, sf_dir).join(lines, "innmelding_id", "left_semi").select("innmelding_id", "reported_date")


@query("jn_14", _JOURNAL + """,
area AS (SELECT '#' || lpad(i::VARCHAR, 4, '0') AS route_key, 'Area ' || i AS area, 50e0 + i / 10e0 AS centre_lat FROM range(0, 40) AS t(i))
SELECT l.innmelding_id, l.line_index, l.route_key, a.area, a.centre_lat FROM line l LEFT JOIN area a USING (route_key)""")
def jn_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines enriched by their route's area, where there is one."""
    i = F.col("id")
    areas = spark.range(40).select(F.concat(F.lit("#"), F.lpad(i.cast("string"), 4, "0")).alias("route_key"), F.concat(F.lit("Area "), i.cast("string")).alias("area"), (50.0 + i / 10).alias("centre_lat"))
    return B.catch_lines(spark, sf_dir).join(F.broadcast(areas), "route_key", "left").select("innmelding_id", "line_index", "route_key", "area", "centre_lat")


@query("txt_17", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE '#' || lpad((s_suppkey % 5000)::VARCHAR, 4, '0') END AS route_key FROM supplier""")
def txt_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route keys as ``#0000``; what is not one to four figures is null."""
    key = F.col("s_suppkey")
    raw = F.when(key % 6 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(F.concat(F.lit(" "), (key % 5000).cast("string"), F.lit(" ")))
    digits = F.regexp_extract(F.trim(raw), r"^#?(\d{1,4})$", 1)
    return B.table(spark, sf_dir, "supplier").select(key.alias("id"), F.when(digits != "", F.concat(F.lit("#"), F.lpad(digits, 4, "0"))).alias("route_key"))


@query("fn_07", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS price, CASE WHEN p_partkey % 3 = 0 THEN round(p_size * 1000e0, 1) END AS kg FROM part""")
def fn_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from locale text (``1.234,5``, ``12 %``), and kilograms from tonnes."""
    from tidewater.functions.numbers import locale_number

    key = F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    text = F.when(key % 5 == 0, F.lit("ukjent")).otherwise(F.concat(F.lit(" "), thousands, F.lit(","), rest, F.lit(" %")))
    tonnes = F.when(key % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",0")))
    return B.table(spark, sf_dir, "part").select(key.alias("id"), F.round(locale_number(text), 2).alias("price"), F.round(locale_number(tonnes) * 1000, 1).alias("kg"))


_ANCHOR = """anchor AS (SELECT innmelding_id, CASE WHEN innmelding_id % 3 = 0 THEN 'h1' ELSE 'h2' END AS params_hash, innmelding_id * 7 % 1000 AS computed_at, CASE WHEN innmelding_id % 4 = 0 THEN 'no-track' ELSE 'ok' END AS anchor_status FROM entry WHERE innmelding_id % 5 <> 0)"""


@query("flt_17", _JOURNAL + ",\n" + _ANCHOR + """,
j AS (SELECT e.innmelding_id, a.computed_at, a.params_hash, a.anchor_status, e.innmelding_id * 3 % 1000 AS updated_at FROM entry e LEFT JOIN anchor a USING (innmelding_id)),
k AS (SELECT innmelding_id, CASE WHEN computed_at IS NULL THEN 'missing' WHEN params_hash <> 'h2' THEN 'parameters' WHEN computed_at < updated_at THEN 'outdated' WHEN anchor_status IN ('no-track', 'no-run') AND computed_at < 700 THEN 'retry' END AS reason FROM j)
SELECT * FROM k WHERE reason IS NOT NULL""")
def flt_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("innmelding_id")
    entries = B.catch_entries(spark, sf_dir).withColumn("updated_at", key * 3 % 1000)
    anchors = entries.filter(key % 5 != 0).select(key, F.when(key % 3 == 0, "h1").otherwise("h2").alias("params_hash"), (key * 7 % 1000).alias("computed_at"), F.when(key % 4 == 0, "no-track").otherwise("ok").alias("anchor_status"))
    return C.stale(entries, anchors, "h2", ["no-track", "no-run"], 700).select("innmelding_id", "reason")


_REPORTS = """report AS (
  SELECT e.innmelding_id, CASE WHEN e.innmelding_id % 9 <> 0 THEN e.vessel_id % 150 END AS vessel_id, TIMESTAMP '2024-01-02 00:00:00' + to_seconds((e.innmelding_id * 977) % 2400000) AS reported_at, l.latitude AS reported_latitude, l.longitude AS reported_longitude
  FROM entry e LEFT JOIN (SELECT innmelding_id, arg_max(latitude, (line_index, latitude, longitude)) AS latitude, arg_max(longitude, (line_index, latitude, longitude)) AS longitude FROM line WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1) l USING (innmelding_id))"""


@query("q_anchor", _JOURNAL + ",\n" + B.FIXES_SQL + ",\n" + _REPORTS + """,
one AS (SELECT r.innmelding_id, f.event_time, f.ms, arg_max(f.latitude, (ingest_ms, source_id)) AS latitude, arg_max(f.longitude, (ingest_ms, source_id)) AS longitude, arg_max(f.speed, (ingest_ms, source_id)) AS speed, max(source_id) AS source_id
  FROM report r JOIN fix f ON r.vessel_id = f.vessel_id AND f.event_time BETWEEN r.reported_at - INTERVAL 48 HOUR AND r.reported_at GROUP BY ALL),
m AS (SELECT *, coalesce(speed BETWEEN 0.3 AND 5.5, false) AS fishing FROM one),
l AS (SELECT *, lag(fishing) OVER w AS before, ms - lag(ms) OVER w AS gap FROM m WINDOW w AS (PARTITION BY innmelding_id ORDER BY event_time, source_id)),
w AS (SELECT *, sum(CASE WHEN fishing AND (NOT coalesce(before, false) OR gap > 1800000) THEN 1 ELSE 0 END) OVER (PARTITION BY innmelding_id ORDER BY event_time, source_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
runs AS (SELECT innmelding_id, run, avg(latitude) AS lat, avg(longitude) AS lon FROM w WHERE fishing GROUP BY ALL),
d AS (SELECT runs.innmelding_id, pow(sin(radians(r.reported_latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(r.reported_latitude)) * pow(sin(radians(r.reported_longitude - lon) / 2), 2) AS a FROM runs JOIN report r USING (innmelding_id)),
s AS (SELECT innmelding_id, count(*) AS run_count, min(round(2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a)), 1)) AS nearest_km, count(*) FILTER (2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a)) > 100) AS beyond_limit FROM d GROUP BY 1),
c AS (SELECT innmelding_id, count(*) AS fix_count FROM one GROUP BY 1)
SELECT r.innmelding_id, CASE WHEN r.vessel_id IS NULL THEN 'no-vessel' WHEN c.fix_count IS NULL THEN 'no-track' WHEN s.run_count IS NULL THEN 'no-run' ELSE 'ok' END AS status, coalesce(c.fix_count, 0) AS fix_count, coalesce(s.run_count, 0) AS run_count, s.nearest_km, coalesce(s.beyond_limit, 0) AS beyond_limit
FROM report r LEFT JOIN c USING (innmelding_id) LEFT JOIN s USING (innmelding_id)""")
def q_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch reports to positions derived from their vessel's track."""
    key = F.col("innmelding_id")
    start = F.unix_timestamp(F.lit("2024-01-02 00:00:00").cast("timestamp"))
    entries = B.catch_entries(spark, sf_dir).select(key, F.when(key % 9 != 0, F.col("vessel_id") % 150).alias("vessel_id"), F.timestamp_seconds(start + key * 977 % 2400000).alias("reported_at"))
    reports = entries.join(C.last_position(B.catch_lines(spark, sf_dir)), "innmelding_id", "left")
    return C.anchors(reports, B.fixes(spark, sf_dir))


@query("agg_29", "WITH " + B.DIRECTORY_SQL + " SELECT count(*) AS ambiguous FROM (SELECT lower(trim(name)) FROM directory GROUP BY 1 HAVING count(*) > 1)")
def agg_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.directory(spark, sf_dir).groupBy(C.normal_text(F.col("name")).alias("name")).count()
    return names.filter("count > 1").agg(F.count("*").alias("ambiguous"))


@query("agg_30", _JOURNAL + """ SELECT string_agg(status || '=' || n, ', ' ORDER BY status) AS summary FROM (SELECT status, count(*) AS n FROM entry GROUP BY status)""")
def agg_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = B.catch_entries(spark, sf_dir).groupBy("status").count()
    pairs = F.sort_array(F.collect_list(F.struct("status", "count")))
    return counts.agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["status"], F.lit("="), p["count"].cast("string"))), ", ").alias("summary"))


@query("snk_06", _JOURNAL + """,
old AS (SELECT innmelding_id, count(*) AS n, round(sum(tonnes), 2) AS t FROM line WHERE (innmelding_id + line_index) % 7 <> 0 GROUP BY 1), new AS (SELECT innmelding_id, count(*) AS n, round(sum(tonnes), 2) AS t FROM line GROUP BY 1)
SELECT CASE WHEN old.innmelding_id IS NULL THEN 'inserted' WHEN old.n = new.n THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM new LEFT JOIN old USING (innmelding_id) GROUP BY 1""")
def snk_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master-detail replace: which reports' lines differ from the stored ones, by a hash of the sorted lines."""
    from tidewater.operators.sinks import classify_by_hash, detail_hash

    lines = B.catch_lines(spark, sf_dir)
    stored = detail_hash(lines.filter((F.col("innmelding_id") + F.col("line_index")) % 7 != 0), "innmelding_id")
    return classify_by_hash(detail_hash(lines, "innmelding_id"), stored, "innmelding_id").groupBy("change").agg(F.count("*").alias("n"))


@query("agg_01", "WITH " + B.FIXES_SQL + " SELECT vessel_id, arg_max(speed, (event_time, source_id)) AS speed FROM fix GROUP BY 1")
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest known speed: rows without one do not count."""
    return B.fixes(spark, sf_dir).groupBy("vessel_id").agg(P.arg_max("speed", "event_time", "source_id"))
