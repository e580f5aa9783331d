"""Position queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import geo
from tidewater.operators import positions as P
from tidewater.plans.base import query
from tidewater.sources import bridge as B

FROM, TO = "2024-01-03 00:00:00", "2024-01-28 00:00:00"
BBOX = (-6.8, 60.02, -5.4, 60.55)
RING = ((-6.9, 60.0), (-5.2, 60.05), (-5.5, 60.58), (-6.2, 60.3), (-6.9, 60.0))
ALL_FLAGS, ALL_TYPES = B.FLAGS, B.TYPES
_WINDOW = f"event_time >= TIMESTAMP '{FROM}' AND event_time < TIMESTAMP '{TO}'"
_BBOX = f"latitude BETWEEN {BBOX[1]}e0 AND {BBOX[3]}e0 AND longitude BETWEEN {BBOX[0]}e0 AND {BBOX[2]}e0"


def _sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def _ring_sql(ring=RING) -> str:
    points = list(ring)[:-1]
    terms = []
    for (xi, yi), (xj, yj) in zip(points, points[-1:] + points[:-1], strict=True):
        if yi != yj:
            terms.append(f"CASE WHEN ({yi}e0 > latitude) <> ({yj}e0 > latitude) AND longitude < (latitude - {yi}e0) * ({(xj - xi) / (yj - yi)!r}::DOUBLE) + {xi}e0 THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


_BANDS = ", ".join(f"({t}, {a}e0, {b}e0)" for t, (a, b) in P.SPEED_BANDS.items())
_REG = f"""reg AS (
  SELECT r.vessel_id, r.type_id, r.flag, r.name, b.low, b.high FROM registry r JOIN (VALUES {_BANDS}) AS b(type_id, low, high) USING (type_id)
  WHERE r.snapshot = (SELECT max(snapshot) FROM registry))"""


_CREDITED = f"""fx AS (
  SELECT vessel_id, event_time, arg_min(latitude, source_id) AS latitude, arg_min(longitude, source_id) AS longitude
  FROM fix JOIN reg USING (vessel_id) WHERE {_WINDOW} AND speed BETWEEN low AND high GROUP BY ALL),
credited AS (
  SELECT *, date_diff('second', lag(event_time, 1, event_time) OVER (PARTITION BY vessel_id ORDER BY event_time), event_time) AS gap_s FROM fx)"""


_CREDIT = "sum(CASE WHEN gap_s > 0 AND gap_s <= 1800 THEN gap_s ELSE 0 END)::BIGINT"
_HEAT = """per_vessel AS (
  SELECT floor(longitude / 0.1e0)::BIGINT AS ix, floor(latitude / 0.03e0)::BIGINT AS iy, vessel_id, {credit} AS seconds FROM credited GROUP BY ALL HAVING seconds > 0)
SELECT ix, iy, flag, type_id, sum(count(*)) OVER (PARTITION BY ix, iy)::BIGINT AS vessels, sum(seconds)::BIGINT AS seconds
FROM per_vessel JOIN reg USING (vessel_id) {where} GROUP BY ix, iy, flag, type_id"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.current_registry(B.registry(spark, sf_dir), ALL_FLAGS, ALL_TYPES)


def _fixes(spark: SparkSession, sf_dir: str, closed: bool = False) -> DataFrame:
    return B.fixes(spark, sf_dir).filter(P.in_period(FROM, TO, closed))


_TRACKS = _sql(B.FIXES_SQL, B.REGISTRY_SQL, _REG, _CREDITED, body="").rstrip("\n")


@query("q_heatmap", _TRACKS + ",\n" + _HEAT.format(credit=_CREDIT, where=""))
def q_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.heatmap(_fixes(spark, sf_dir), _registry(spark, sf_dir))


_CELLS = f"WHERE ix BETWEEN floor({BBOX[0]}e0 / 0.1e0) AND floor({BBOX[2]}e0 / 0.1e0) AND iy BETWEEN floor({BBOX[1]}e0 / 0.03e0) AND floor({BBOX[3]}e0 / 0.03e0)"


@query("q_heatmap_region", _TRACKS + ",\n" + _HEAT.format(credit=_CREDIT, where=_CELLS))
def q_heatmap_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.heatmap(_fixes(spark, sf_dir), _registry(spark, sf_dir), BBOX)


@query("agg_08", _TRACKS + ",\nheat AS (WITH " + _HEAT.format(credit=_CREDIT, where="") + """)
SELECT ix, iy, vessels, count(*)::BIGINT AS kinds, round(sum(floor(seconds / 60e0 * 100 + 0.5) / 100), 2) AS minutes
FROM heat WHERE floor(seconds / 60e0 * 100 + 0.5) > 0 GROUP BY ix, iy, vessels""")
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.weights(q_heatmap(spark, sf_dir))
    kinds = F.flatten(F.transform(F.map_values("weights"), lambda j: F.map_values(F.from_json(j, "map<string,double>"))))
    return w.select("ix", "iy", "vessels", F.size(kinds).cast("long").alias("kinds"), F.round(F.aggregate(kinds, F.lit(0.0), lambda a, x: a + x), 2).alias("minutes"))


HOVER = (60.25, -6.1, 45.0)
HOVER_WINDOWS = (("2024-01-03 00:00:00", "2024-01-12 00:00:00"), ("2024-01-15 00:00:00", "2024-01-28 00:00:00"))
_IN_W = " ".join(f"WHEN event_time >= TIMESTAMP '{a}' AND event_time < TIMESTAMP '{b}' THEN {i}" for i, (a, b) in enumerate(HOVER_WINDOWS))
_HOVER_SQL = _sql(B.FIXES_SQL, B.REGISTRY_SQL, _REG, f"""fx AS (
  SELECT vessel_id, event_time, CASE {_IN_W} END AS w, arg_min(latitude, source_id) AS latitude, arg_min(longitude, source_id) AS longitude
  FROM fix JOIN reg USING (vessel_id) WHERE CASE {_IN_W} END IS NOT NULL AND speed BETWEEN low AND high GROUP BY ALL),
credited AS (
  SELECT *, date_diff('second', lag(event_time, 1, event_time) OVER (PARTITION BY vessel_id, w ORDER BY event_time), event_time) AS gap_s,
    round((floor(longitude / 0.1e0) + 0.5e0) * 0.1e0, 3) AS clon, round((floor(latitude / 0.03e0) + 0.5e0) * 0.03e0, 3) AS clat FROM fx),
vessels AS (
  SELECT vessel_id, {_CREDIT} AS seconds FROM credited
  WHERE 2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(clat - {HOVER[0]}e0) / 2), 2) + cos(radians({HOVER[0]}e0)) * cos(radians(clat)) * pow(sin(radians(clon - ({HOVER[1]}e0)) / 2), 2)))) <= {HOVER[2]}e0
  GROUP BY vessel_id HAVING seconds > 0)""", body="SELECT vessel_id, name, flag, type_id, seconds FROM vessels JOIN reg USING (vessel_id)")


@query("q_hover", _HOVER_SQL)
def q_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hover(B.fixes(spark, sf_dir), _registry(spark, sf_dir), *HOVER, HOVER_WINDOWS)


@query("agg_09", _HOVER_SQL.replace("SELECT vessel_id, name, flag, type_id, seconds FROM vessels JOIN reg USING (vessel_id)", """SELECT vessel_id, round(seconds / 60e0, 2) AS minutes, count(*) OVER () AS vessel_count, sum(seconds) OVER ()::BIGINT AS total_seconds
FROM vessels JOIN reg USING (vessel_id) ORDER BY seconds DESC, vessel_id LIMIT 50"""))
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 busiest vessels, with count and total over all."""
    all_vessels = q_hover(spark, sf_dir)
    total = all_vessels.agg(F.count("*").alias("vessel_count"), F.sum("seconds").alias("total_seconds"))
    top = all_vessels.orderBy(F.desc("seconds"), "vessel_id").limit(50)
    return top.join(F.broadcast(total)).select("vessel_id", F.round(F.col("seconds") / 60, 2).alias("minutes"), "vessel_count", "total_seconds")


@query("q_density", _sql(B.FIXES_SQL, body=f"""SELECT round_even(latitude / 0.1e0, 0) * 0.1e0 AS cell_lat, round_even(longitude / 0.1e0, 0) * 0.1e0 AS cell_lon, count(*) AS fixes, count(DISTINCT vessel_id) AS vessels
FROM fix WHERE {_WINDOW} AND {_BBOX} AND speed BETWEEN 0.3 AND 20 GROUP BY 1, 2 ORDER BY fixes DESC, 1, 2 LIMIT 200"""))
def q_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _fixes(spark, sf_dir).filter(geo.in_bbox(F.col("longitude"), F.col("latitude"), BBOX) & P.in_band(0.3, 20.0))
    return P.density(cut, 0.1, 200)


@query("q_density_polygon", _sql(B.FIXES_SQL, body=f"""SELECT round_even(latitude / 0.1e0, 0) * 0.1e0 AS cell_lat, round_even(longitude / 0.1e0, 0) * 0.1e0 AS cell_lon, count(*) AS fixes, count(DISTINCT vessel_id) AS vessels
FROM fix WHERE {_WINDOW} AND {_ring_sql()} GROUP BY 1, 2"""))
def q_density_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.density(_fixes(spark, sf_dir).filter(geo.in_any_ring(F.col("longitude"), F.col("latitude"), [RING])), 0.1, 1_000_000)


_EFFORT = f"""fx AS (SELECT DISTINCT vessel_id, event_time FROM fix WHERE {_WINDOW} AND {_BBOX} AND speed BETWEEN 0.3 AND 5.5),
d AS (SELECT *, date_diff('second', lag(event_time, 1, event_time) OVER (PARTITION BY vessel_id ORDER BY event_time), event_time) AS gap_s FROM fx),
e AS (SELECT vessel_id, count(*) AS fixes, sum(CASE WHEN gap_s > 0 AND gap_s <= 86400 THEN gap_s ELSE 0 END)::BIGINT AS fishing_seconds, count(DISTINCT event_time::DATE) AS active_days, (epoch_us(min(event_time)) // 1000) AS first_seen, (epoch_us(max(event_time)) // 1000) AS last_seen FROM d GROUP BY vessel_id)"""


def _effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _fixes(spark, sf_dir).filter(geo.in_bbox(F.col("longitude"), F.col("latitude"), BBOX) & P.in_band(0.3, 5.5))
    return P.effort(cut, 86400).withColumns({"first_seen": F.unix_millis("first_seen"), "last_seen": F.unix_millis("last_seen")})


@query("q_effort", _sql(B.FIXES_SQL, _EFFORT, body="SELECT * FROM e"))
def q_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effort(spark, sf_dir)


@query("agg_05", _sql(B.FIXES_SQL, _EFFORT, body="SELECT vessel_id, fishing_seconds, count(*) OVER () AS vessels, sum(fixes) OVER ()::BIGINT AS all_fixes, sum(fishing_seconds) OVER ()::BIGINT AS all_seconds, count(*) OVER () > 20 AS truncated FROM e ORDER BY fishing_seconds DESC, vessel_id LIMIT 20"))
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 vessels by effort, totals over all, and whether the list was cut."""
    e = _effort(spark, sf_dir)
    total = e.agg(F.count("*").alias("vessels"), F.sum("fixes").alias("all_fixes"), F.sum("fishing_seconds").alias("all_seconds"))
    return e.orderBy(F.desc("fishing_seconds"), "vessel_id").limit(20).join(F.broadcast(total)).select("vessel_id", "fishing_seconds", "vessels", "all_fixes", "all_seconds", (F.col("vessels") > 20).alias("truncated"))


TRACK_IDS = tuple(range(0, 40))


@query("q_tracks", _sql(B.FIXES_SQL, body=f"""SELECT vessel_id, (epoch_us(max(event_time)) // 1000) AS t, arg_max(latitude, (event_time, ingest_ms, source_id)) AS latitude, arg_max(longitude, (event_time, ingest_ms, source_id)) AS longitude,
  arg_max(speed, (event_time, ingest_ms, source_id)) AS speed, arg_max(heading, (event_time, ingest_ms, source_id)) AS heading, arg_max(course, (event_time, ingest_ms, source_id)) AS course, arg_max(status, (event_time, ingest_ms, source_id)) AS status
FROM fix WHERE vessel_id IN {TRACK_IDS} AND {_WINDOW} GROUP BY vessel_id, floor(epoch(event_time) / 43200)"""))
def q_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _fixes(spark, sf_dir).filter(F.col("vessel_id").isin(list(TRACK_IDS)))
    return P.tracks(cut, 43200).drop("bucket").withColumn("t", F.unix_millis("t"))


WINDOWS = [(i, i % 30, f"2024-01-{2 + i % 20:02d} 00:00:00", f"2024-01-{5 + i % 20:02d} 12:00:00") for i in range(60)] + [(60, 999_999, "2024-01-02 00:00:00", "2024-01-03 00:00:00")]
_WINDOWS_SQL = "win AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {v}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, v, a, b in WINDOWS) + ") AS t(idx, vessel_id, from_time, to_time))"


def _windows(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, {v}L, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, v, a, b in WINDOWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(idx, vessel_id, from_time, to_time)")


@query("q_trackwin", _sql(B.FIXES_SQL, _WINDOWS_SQL, """p AS (
  SELECT idx, (epoch_us(max(event_time)) // 1000) AS t, arg_max(latitude, (event_time, ingest_ms, source_id)) AS latitude, arg_max(longitude, (event_time, ingest_ms, source_id)) AS longitude, arg_max(speed, (event_time, ingest_ms, source_id)) AS speed, arg_max(status, (event_time, ingest_ms, source_id)) AS status
  FROM fix JOIN win ON fix.vessel_id = win.vessel_id AND event_time BETWEEN from_time AND to_time
  GROUP BY idx, floor((epoch(event_time) - epoch(from_time)) / greatest(1, floor(greatest(1, epoch(to_time) - epoch(from_time)) / 10) + 1)))""", body="SELECT win.idx, win.vessel_id, p.t, p.latitude, p.longitude, p.speed, p.status FROM win LEFT JOIN p USING (idx)"))
def q_trackwin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.track_windows(B.fixes(spark, sf_dir), _windows(spark), 10).drop("bucket").withColumn("t", F.unix_millis("t"))


@query("q_fixwin", _sql(B.FIXES_SQL, _WINDOWS_SQL, """seen AS (
  SELECT fix.vessel_id, event_time, arg_max(latitude, (ingest_ms, source_id)) AS latitude, arg_max(longitude, (ingest_ms, source_id)) AS longitude, arg_max(speed, (ingest_ms, source_id)) AS speed
  FROM fix JOIN win ON fix.vessel_id = win.vessel_id AND event_time BETWEEN from_time AND to_time GROUP BY ALL),
newest AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY event_time DESC) AS turn FROM seen)""", body="SELECT idx, newest.vessel_id, (epoch_us(event_time) // 1000) AS t, latitude, longitude, speed FROM newest JOIN win ON newest.vessel_id = win.vessel_id AND event_time BETWEEN from_time AND to_time WHERE turn <= 25"))
def q_fixwin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fix_windows(B.fixes(spark, sf_dir), _windows(spark), 25).select("idx", "vessel_id", F.unix_millis("event_time").alias("t"), "latitude", "longitude", "speed")


@query("q_runs", _sql(B.FIXES_SQL, """m AS (SELECT *, coalesce(speed BETWEEN 0.3 AND 5.5, false) AS fishing FROM fix),
l AS (SELECT *, lag(fishing) OVER w AS before, ms - lag(ms) OVER w AS gap FROM m WINDOW w AS (PARTITION BY vessel_id ORDER BY event_time, source_id)),
r AS (SELECT *, sum(CASE WHEN fishing AND (NOT coalesce(before, false) OR gap > 1800000) THEN 1 ELSE 0 END) OVER (PARTITION BY vessel_id ORDER BY event_time, source_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l)""",
body="SELECT vessel_id, run, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, count(*) AS fix_count, (epoch_us(min(event_time)) // 1000) AS run_start, (epoch_us(max(event_time)) // 1000) AS run_end, round(avg(speed), 6) AS avg_knots FROM r WHERE fishing GROUP BY vessel_id, run"))
def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.fishing_runs(B.fixes(spark, sf_dir))
    return r.select("vessel_id", "run", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "fix_count", F.unix_millis("run_start").alias("run_start"), F.unix_millis("run_end").alias("run_end"), F.round("avg_knots", 6).alias("avg_knots"))


@query("agg_06", _sql(B.FIXES_SQL, body="SELECT vessel_id, strftime(event_time, '%Y-%m-%d') AS day, count(*) AS fixes, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon FROM fix GROUP BY 1, 2"))
def agg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_rollup(B.fixes(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("src_01", _sql(B.FIXES_SQL, body="SELECT source_id, vessel_id, ms AS t FROM fix WHERE (event_time, source_id) > (TIMESTAMP '2024-01-10 00:00:00', 500) ORDER BY event_time, source_id LIMIT 500"))
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset page: the next rows after a (time, id) cursor."""
    cursor = F.struct(F.lit("2024-01-10 00:00:00").cast("timestamp").alias("event_time"), F.lit(500).cast("long").alias("source_id"))
    page = B.fixes(spark, sf_dir).filter((F.col("event_time") >= F.lit("2024-01-10 00:00:00").cast("timestamp")) & (F.struct("event_time", "source_id") > cursor))
    return page.orderBy("event_time", "source_id").limit(500).select("source_id", "vessel_id", F.unix_millis("event_time").alias("t"))


@query("src_02", _sql(B.FIXES_SQL, body="SELECT source_id, ms AS t FROM fix WHERE event_time >= TIMESTAMP '2024-01-10 05:00:00' AND event_time < TIMESTAMP '2024-01-10 06:00:00' AND (event_time, source_id) > (TIMESTAMP '2024-01-10 05:10:00', 0)"))
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = B.fixes(spark, sf_dir).filter(P.in_period("2024-01-10 05:00:00", "2024-01-10 06:00:00", closed=False))
    after = F.struct(F.lit("2024-01-10 05:10:00").cast("timestamp").alias("event_time"), F.lit(0).cast("long").alias("source_id"))
    return cut.filter(F.struct("event_time", "source_id") > after).select("source_id", F.unix_millis("event_time").alias("t"))


@query("src_03", _sql(B.FIXES_SQL, body="SELECT (epoch_us(date_trunc('hour', event_time)) // 1000) AS bucket, count(*) AS n FROM fix GROUP BY 1"))
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).groupBy(F.unix_millis(F.date_trunc("hour", "event_time")).alias("bucket")).agg(F.count("*").alias("n"))


@query("src_04", _sql(B.FIXES_SQL, body="SELECT min(ms) AS first FROM fix"))
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).agg(F.unix_millis(F.min("event_time")).alias("first"))


@query("src_05", _sql(B.FIXES_SQL, body="SELECT count(*) AS n FROM fix"))
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).agg(F.count("*").alias("n"))


@query("src_06", """SELECT event_id AS source_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 0 ELSE value END AS latitude, CASE WHEN event_id % 13 <> 0 THEN value END AS speed,
  coalesce(CASE WHEN event_id % 5 <> 0 THEN (epoch_us(ts) // 1000) END, CASE WHEN event_id % 10 <> 0 THEN (epoch_us(ts) // 1000) + 1000 END, 0) AS t
FROM events""")
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as typed fixes: a missing or NaN position is 0, a missing speed stays missing, times fall back from event to ingest to the epoch."""
    key, ts = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    raw = B.table(spark, sf_dir, "events").select(
        key.alias("source_id"), F.when(key % 11 == 0, F.lit("NaN")).when(key % 7 != 0, F.col("value").cast("string")).alias("lat"), F.when(key % 13 != 0, F.col("value")).alias("speed"),
        F.when(key % 5 != 0, ts).alias("event_ms"), F.when(key % 10 != 0, ts + 1000).alias("ingest_ms"),
    )
    lat = F.col("lat").try_cast("double")
    return raw.select("source_id", F.coalesce(F.when(~F.isnan(lat), lat), F.lit(0.0)).alias("latitude"), "speed", F.coalesce("event_ms", "ingest_ms", F.lit(0)).cast("long").alias("t"))


@query("src_20", _sql(B.REGISTRY_SQL, body="SELECT vessel_id, type_id, CASE WHEN upper(trim(flag)) = 'SE' THEN 'SE' ELSE upper(trim(flag)) END AS flag, name FROM registry WHERE snapshot = (SELECT max(snapshot) FROM registry) AND type_id IS NOT NULL AND flag IS NOT NULL"))
def src_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows that have a type and a flag, the flag trimmed, upper-case, and with its alias resolved."""
    reg = B.registry(spark, sf_dir)
    flag = F.upper(F.trim(F.when(F.col("flag") == "SE", F.lit(" sw ")).otherwise(F.col("flag"))))
    newest = reg.join(F.broadcast(reg.agg(F.max("snapshot").alias("snapshot"))), "snapshot", "left_semi")
    return newest.filter("type_id IS NOT NULL AND flag IS NOT NULL").select("vessel_id", "type_id", F.when(flag == "SW", "SE").otherwise(flag).alias("flag"), "name")


@query("agg_26", _sql(B.REGISTRY_SQL, body=f"SELECT f.flag, count(r.vessel_id) AS n, count(r.vessel_id) = 0 AS missing FROM (SELECT unnest({[*B.FLAGS, 'XX']}) AS flag) f LEFT JOIN (SELECT * FROM registry WHERE snapshot = 2) r USING (flag) GROUP BY f.flag"))
def agg_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (*B.FLAGS, "XX")])).alias("flag"))
    newest = B.registry(spark, sf_dir).filter("snapshot = 2").groupBy("flag").agg(F.count("*").alias("k"))
    return flags.join(newest, "flag", "left").select("flag", F.coalesce("k", F.lit(0)).alias("n"), F.col("k").isNull().alias("missing"))


@query("snk_02", _sql(B.FIXES_SQL, body="SELECT vessel_id, ms // 3600000 AS hour, arg_max(source_id, (ingest_ms, source_id)) AS source_id FROM fix GROUP BY 1, 2"))
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace by key: one row per vessel and hour, the last ingested."""
    rows = B.fixes(spark, sf_dir).withColumns({"hour": F.floor(F.unix_millis("event_time") / 3600000), "version": F.struct("ingest_time", "source_id")})
    return P.replace_by_key(rows, ["vessel_id", "hour"], "version").select("vessel_id", "hour", "source_id")


@query("geo_13", _sql(B.FIXES_SQL, body="SELECT source_id, round(radians(longitude) * 6378137e0, 3) AS x, round(ln(tan(radians(latitude) / 2 + 0.7853981633974483e0)) * 6378137e0, 3) AS y FROM fix"))
def geo_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).select("source_id", F.round(geo.mercator_x(F.col("longitude")), 3).alias("x"), F.round(geo.mercator_y(F.col("latitude")), 3).alias("y"))


@query("geo_05", _sql(B.FIXES_SQL, """a AS (SELECT source_id, pow(sin(radians(latitude - 62e0) / 2), 2) + cos(radians(62e0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 6e0) / 2), 2) AS a FROM fix)""", body="SELECT source_id, round(2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a)), 4) AS km FROM a"))
def geo_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).select("source_id", F.round(geo.haversine_atan2(F.lit(62.0), F.lit(-6.0), F.col("latitude"), F.col("longitude")), 4).alias("km"))
