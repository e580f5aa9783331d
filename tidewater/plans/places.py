"""Closure, gazetteer and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import dates, geo, texts
from tidewater.operators import areas as A
from tidewater.operators import sinks, sweeps
from tidewater.plans.base import query
from tidewater.sources import bridge as B
from tidewater.sources import feeds

BOX = (-5.0, 60.0, 3.0, 64.0)
NOW = 9700  # days since 1970
_W = "WITH " + B.CLOSURES_SQL
_HIT = f"list_bool_or([p.lat BETWEEN {BOX[1]}e0 AND {BOX[3]}e0 AND p.lon BETWEEN {BOX[0]}e0 AND {BOX[2]}e0 FOR p IN points])"
_KM = "list_min([2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(p.lat - 61.5e0) / 2), 2) + cos(radians(61.5e0)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - 2e0) / 2), 2)))) FOR p IN points])"


def in_force(status: str, now: int):
    """The three clock-relative filters; they overlap on purpose."""
    start, end = F.col("valid_from"), F.col("valid_to")
    if status == "current":
        return (F.col("status") == "O") & (end.isNull() | (end >= now)) & (start.isNull() | (start <= now))
    if status == "archived":
        return (F.col("status") == "F") | F.coalesce(end < now, F.lit(False))
    if status == "upcoming":
        return (F.col("status") == "O") & F.coalesce(start > now, F.lit(False))
    return F.col("status") == status


@query("q_geo_list", _W + f" SELECT jm_number, title, region FROM closure WHERE status = 'O' AND (valid_to IS NULL OR valid_to >= {NOW}) AND (valid_from IS NULL OR valid_from <= {NOW}) AND region = 'NO' AND jm_number > 'J-2' ORDER BY jm_number LIMIT 101")
def q_geo_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = B.closures(spark, sf_dir).filter(in_force("current", NOW) & (F.col("region") == "NO") & (F.col("jm_number") > "J-2"))
    return page.orderBy("jm_number").limit(101).select("jm_number", "title", "region")


@query("flt_14", _W + f""", f AS (SELECT region, status = 'O' AND (valid_to IS NULL OR valid_to >= {NOW}) AND (valid_from IS NULL OR valid_from <= {NOW}) AS c, status = 'F' OR coalesce(valid_to < {NOW}, false) AS a, status = 'O' AND coalesce(valid_from > {NOW}, false) AS u FROM closure)
SELECT region, count(*) FILTER (c) AS current, count(*) FILTER (a) AS archived, count(*) FILTER (u) AS upcoming FROM f GROUP BY region""")
def flt_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.closures(spark, sf_dir).groupBy("region").agg(*[F.count_if(in_force(s, NOW)).alias(s) for s in ("current", "archived", "upcoming")])


@query("flt_15", _W + f" SELECT jm_number, CASE WHEN coalesce(valid_to, valid_from + 14) < {NOW} THEN 'expired' WHEN valid_from > {NOW} THEN 'upcoming' ELSE 'current' END AS state FROM closure")
def flt_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.coalesce("valid_to", F.col("valid_from") + 14)
    return B.closures(spark, sf_dir).select("jm_number", F.when(end < NOW, "expired").when(F.col("valid_from") > NOW, "upcoming").otherwise("current").alias("state"))


@query("q_geo_bbox", _W + f" SELECT jm_number FROM closure WHERE has_geo AND {_HIT}")
def q_geo_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.closures(spark, sf_dir).filter(F.col("has_geo") & geo.points_in_bbox(F.col("points"), BOX)).select("jm_number")


@query("q_geo_near", _W + f" SELECT jm_number, round({_KM}, 3) AS km FROM closure WHERE has_geo AND {_KM} <= 250 ORDER BY {_KM}, jm_number LIMIT 100")
def q_geo_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = B.closures(spark, sf_dir).filter("has_geo").withColumn("d", geo.nearest_km(F.col("points"), 61.5, 2.0)).filter("d <= 250")
    return near.orderBy("d", "jm_number").limit(100).select("jm_number", F.round("d", 3).alias("km"))


@query("q_geo_draw", _W + """, gate AS (SELECT 'J-' || c_custkey AS jm_number FROM customer WHERE c_custkey % 3 = 0)
SELECT c.jm_number, c.has_geo AND NOT (c.region = 'NO' AND g.jm_number IS NOT NULL) AS drawable FROM closure c LEFT JOIN gate g USING (jm_number)""")
def q_geo_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures with a published case keep their text but lose the drawn geometry."""
    gate = B.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("J-"), F.col("c_custkey").cast("string")).alias("jm_number"), F.lit(True).alias("gated"))
    joined = B.closures(spark, sf_dir).join(gate, "jm_number", "left")
    return joined.select("jm_number", (F.col("has_geo") & ~((F.col("region") == "NO") & F.coalesce("gated", F.lit(False)))).alias("drawable"))


@query("agg_17", _W + " SELECT jm_number, round(list_min([p.lat FOR p IN points]), 6) AS min_lat, round(list_max([p.lat FOR p IN points]), 6) AS max_lat, round(list_min([p.lon FOR p IN points]), 6) AS min_lon, round(list_max([p.lon FOR p IN points]), 6) AS max_lon FROM closure")
def agg_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = B.closures(spark, sf_dir).select("jm_number", geo.bbox_of(F.col("points")).alias("b"))
    return box.select("jm_number", *[F.round(f"b.{c}", 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query("agg_18", _W + " SELECT jm_number, round(list_sum([p.lat FOR p IN points]) / 3, 6) AS lat, round(list_sum([p.lon FOR p IN points]) / 3, 6) AS lon FROM closure")
def agg_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.closures(spark, sf_dir).select("jm_number", geo.centroid_of(F.col("points")).alias("c"))
    return c.select("jm_number", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("geo_10", _W + " SELECT jm_number, 'MULTIPOINT(' || array_to_string([printf('(%.6f %.6f)', p.lon, p.lat) FOR p IN points], ', ') || ')' AS wkt FROM closure")
def geo_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.closures(spark, sf_dir).select("jm_number", geo.multipoint_wkt(F.col("points")).alias("wkt"))


_F = "WITH " + B.FEATURES_SQL


@query("q_gebco_name", _F + """ SELECT feature_id, name, kind FROM feature WHERE lower(name) LIKE '%red%' OR lower(name || ' ' || kind) LIKE '%red%'
ORDER BY CASE WHEN lower(name) = 'red' OR lower(name || ' ' || kind) = 'red' THEN 0 WHEN lower(name) LIKE 'red%' THEN 1 ELSE 2 END, CASE WHEN geometry_kind = 'point' THEN 0 ELSE 1 END, name, feature_id LIMIT 100""")
def q_gebco_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name search: exact before prefix before anywhere, points first."""
    low, both = F.lower("name"), F.lower(F.concat_ws(" ", "name", "kind"))
    rank = F.when((low == "red") | (both == "red"), 0).when(low.startswith("red"), 1).otherwise(2)
    found = B.features(spark, sf_dir).filter(low.contains("red") | both.contains("red"))
    return found.orderBy(rank, F.when(F.col("geometry_kind") == "point", 0).otherwise(1), "name", "feature_id").limit(100).select("feature_id", "name", "kind")


@query("q_gebco_bbox", _F + f" SELECT feature_id, name FROM feature WHERE lat BETWEEN {BOX[1]}e0 AND {BOX[3]}e0 AND lon BETWEEN {BOX[0]}e0 AND {BOX[2]}e0 ORDER BY name, feature_id LIMIT 500")
def q_gebco_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.features(spark, sf_dir).filter(geo.in_bbox(F.col("lon"), F.col("lat"), BOX)).orderBy("name", "feature_id").limit(500).select("feature_id", "name")


_FKM = "2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(lat - 60e0) / 2), 2) + cos(radians(60e0)) * cos(radians(lat)) * pow(sin(radians(lon - 1e0) / 2), 2))))"


@query("q_gebco_near", _F + f" SELECT feature_id, round({_FKM}, 3) AS km FROM feature WHERE {_FKM} <= 500 ORDER BY {_FKM}, feature_id LIMIT 50")
def q_gebco_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = B.features(spark, sf_dir).withColumn("d", geo.haversine_asin(F.lit(60.0), F.lit(1.0), F.col("lat"), F.col("lon"))).filter("d <= 500")
    return near.orderBy("d", "feature_id").limit(50).select("feature_id", F.round("d", 3).alias("km"))


@query("q_gillnet", """WITH net AS (SELECT s_suppkey AS net_id, s_suppkey % 4 AS snapshot, s_name AS vessel, 58e0 + s_suppkey * 7 % 60 / 10e0 AS lat, -5e0 + s_suppkey * 3 % 90 / 10e0 AS lon FROM supplier)
SELECT net_id, vessel FROM net WHERE snapshot = (SELECT max(snapshot) FROM net) AND lat BETWEEN 59 AND 63 AND lon BETWEEN -4 AND 3""")
def q_gillnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of the newest snapshot in a box."""
    key = F.col("s_suppkey")
    nets = B.table(spark, sf_dir, "supplier").select(key.alias("net_id"), (key % 4).alias("snapshot"), F.col("s_name").alias("vessel"), (58.0 + key * 7 % 60 / F.lit(10.0)).alias("lat"), (-5.0 + key * 3 % 90 / F.lit(10.0)).alias("lon"))
    newest = nets.agg(F.max("snapshot").alias("snapshot"))
    return nets.join(F.broadcast(newest), "snapshot", "left_semi").filter(geo.in_bbox(F.col("lon"), F.col("lat"), (-4.0, 59.0, 3.0, 63.0))).select("net_id", "vessel")


_AREA = """WITH ev AS (SELECT c_custkey AS seq, c_custkey % 300 AS id, c_custkey % 2 = 0 AS name_set, c_name AS name, c_custkey % 3 = 0 AS color_set, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS color, c_custkey % 31 = 7 AS deleted FROM customer)"""


@query("q_areas", _AREA + " SELECT id, arg_max(CASE WHEN name_set THEN [name] END, CASE WHEN name_set THEN seq END)[1] AS name, arg_max([color], CASE WHEN color_set THEN seq END)[1] AS color FROM ev GROUP BY id HAVING NOT bool_or(deleted)")
def q_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas after all patches; deleted ones are gone."""
    key = F.col("c_custkey")
    events = B.table(spark, sf_dir, "customer").select(
        key.alias("seq"), (key % 300).alias("id"), (key % 2 == 0).alias("name_set"), F.col("c_name").alias("name"), (key % 3 == 0).alias("color_set"), F.when(key % 9 != 0, F.col("c_mktsegment")).alias("color"), (key % 31 == 7).alias("deleted"),
    )
    return sinks.fold_patches(events, "id", "seq", ["name", "color"], "deleted").select("id", "name", "color")


@query("q_poi", "SELECT p_partkey AS number, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Untitled' END AS title, 2 AS n_aliases FROM part WHERE p_partkey BETWEEN 100 AND 999 AND p_partkey % 5 <> 0")
def q_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest from fragments: a key of three figures, the title without its prefix, aliases that are text."""
    key = F.col("p_partkey")
    raw = B.table(spark, sf_dir, "part").select(
        F.concat(F.when(key % 5 == 0, "poi_").otherwise("poi-"), key.cast("string")).alias("key"), F.when(key % 2 == 0, F.concat(F.lit("POI: "), F.col("p_name"))).otherwise(F.lit("poi:  Untitled")).alias("title"),
        F.array(F.col("p_brand"), F.lit(None), F.col("p_type")).alias("aliases"),
    )
    return feeds.points_of_interest(raw).select("number", "title", F.size("aliases").alias("n_aliases"))


@query("txt_02", """SELECT o_orderkey AS id, round(58 + o_orderkey % 9 + (o_orderkey % 60) / 60e0, 6) AS lat, round(-(o_orderkey % 12 + (o_orderkey % 50 + 0.5e0) / 60e0), 6) AS lon FROM orders""")
def txt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates written in two forms, read back."""
    key = F.col("o_orderkey")
    whole = lambda c: c.cast("int")
    symbol = F.format_string("punkt %d° %d,0' N %d° %d,5' W og", whole(58 + key % 9), whole(key % 60), whole(key % 12), whole(key % 50))
    dms = F.format_string("%d° %d' 0,0” N %d° %d' 30.0” W", whole(58 + key % 9), whole(key % 60), whole(key % 12), whole(key % 50))
    found = B.table(spark, sf_dir, "orders").select(key.alias("id"), texts.all_coordinates(F.when(key % 2 == 0, symbol).otherwise(dms)).alias("p"))
    return found.select("id", F.round(F.get("p", F.lit(0))["lat"], 6).alias("lat"), F.round(F.get("p", F.lit(0))["lon"], 6).alias("lon"))


@query("txt_09", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 70 < 60 THEN round(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * (o_orderkey % 80 + (o_orderkey % 70 + 0.25e0) / 60e0), 6) END AS degrees FROM orders")
def txt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(F.format_string("%02d %02d,250", (key % 80).cast("int"), (key % 70).cast("int")), F.when(key % 2 == 0, "N").otherwise("S"))
    return B.table(spark, sf_dir, "orders").select(key.alias("id"), F.round(texts.authority_coordinate(text), 6).alias("degrees"))


@query("txt_11", r"""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS n FROM pages""")
def txt_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", F.length(texts.html_text(F.col("html"))).cast("long").alias("n"))


@query("txt_13", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'archived' WHEN 1 THEN 'current' WHEN 2 THEN 'archived' ELSE 'unknown' END AS status FROM orders")
def txt_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, "Melding UTGÅTT").when(key % 4 == 1, "Gjeldende frå").when(key % 4 == 2, "gjeldende, men i arkivet").otherwise("J-melding")
    return B.table(spark, sf_dir, "orders").select(key.alias("id"), texts.status_of(text, F.lit("unknown")).alias("status"))


@query("txt_14", "SELECT o_orderkey AS id, 'J-' || (o_orderkey % 300) || '-' || year(o_orderdate) AS jm_number, strftime(o_orderdate, '%d.%m.%Y') AS stated FROM orders")
def txt_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notice number and date from a heading."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Forskrift j-"), (key % 300).cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"), F.lit(": endring, fastsatt "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" kl. 12"))
    number = F.upper(F.regexp_extract(text, r"(?i)\b(J-\d+-\d{4})\b", 1))
    return B.table(spark, sf_dir, "orders").select(key.alias("id"), number.alias("jm_number"), F.regexp_extract(text, r"\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\b", 1).alias("stated"))


_DATES = """WITH d AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders), m AS (SELECT id, CASE id % 5 WHEN 3 THEN NULL ELSE epoch_us(day::TIMESTAMP) // 1000 + CASE WHEN id % 5 = 4 THEN 68400000 ELSE 0 END END AS start_ms FROM d)"""


@query("dt_01", _DATES + " SELECT id, start_ms, CASE WHEN id % 5 = 4 THEN start_ms ELSE start_ms + 86399999 END AS end_ms, CASE WHEN coalesce(CASE WHEN id % 5 = 4 THEN start_ms ELSE start_ms + 86399999 END < 838080000000, false) THEN 'archived' ELSE 'current' END AS status FROM m")
def dt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written validity dates in four forms and one that does not exist."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(key % 5 == 0, F.date_format(day, "d.M.yyyy")).when(key % 5 == 1, F.date_format(day, "yyyy-MM-dd")).when(key % 5 == 2, F.concat(F.lit(" "), F.date_format(day, "dd/MM/yyyy")))
        .when(key % 5 == 3, F.lit("31.02.1997")).otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T19:00:00Z")))
    )
    rows = B.table(spark, sf_dir, "orders").select(key.alias("id"), raw.alias("raw"))
    return rows.select("id", dates.validity(F.col("raw"))["ms"].alias("start_ms"), dates.validity_end(F.col("raw")).alias("end_ms"), dates.with_expiry(F.lit("current"), F.col("raw"), F.lit(838080000000)).alias("status"))


@query("dt_08", "SELECT o_orderkey AS id, strftime(DATE '1899-12-30' + (30000 + o_orderkey % 15000)::INTEGER, '%Y-%m-%d') AS day, printf('%02d:%02d:00', o_orderkey % 24, o_orderkey % 60) AS time FROM orders")
def dt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    serial = 30000 + key % 15000 + (key % 24 * 60 + key % 60) / F.lit(1440.0)
    return B.table(spark, sf_dir, "orders").select(key.alias("id"), F.date_format(dates.excel_date(serial), "yyyy-MM-dd").alias("day"), dates.excel_time(serial).alias("time"))


@query("dt_09", """WITH s AS (SELECT user_id, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id)
SELECT user_id, epoch_us(t)::BIGINT // 1000 AS bucket FROM s, unnest(range(date_trunc('hour', first), last + INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS r(t)""")
def dt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour buckets of every vessel, from the one that holds its first fix to that of its last."""
    ends = B.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    buckets = F.sequence(F.date_trunc("hour", "first"), F.col("last"), F.expr("INTERVAL 1 HOUR"))
    return ends.select("user_id", F.explode(buckets).alias("b")).select("user_id", F.unix_millis("b").alias("bucket"))


@query("fn_01", "SELECT c_custkey AS id, floor(c_acctbal * 10 + 0.5) / 10 AS rounded FROM customer")
def fn_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.functions.numbers import half_up

    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), half_up(F.col("c_acctbal"), 1).alias("rounded"))


@query("fn_04", "SELECT c_custkey AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT c_custkey, sha256('case:' || c_name) AS h FROM customer)")
def fn_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), texts.uuid_from(F.concat(F.lit("case:"), F.col("c_name"))).alias("uuid"))


@query("fn_05", "SELECT c_custkey AS id, substr(sha256('gap=30&key=' || c_custkey || '&max=5.5'), 1, 16) AS hash FROM customer")
def fn_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of sorted parameters."""
    text = F.array_join(F.array_sort(F.array(F.lit("max=5.5"), F.lit("gap=30"), F.concat(F.lit("key="), F.col("c_custkey").cast("string")))), "&")
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


@query("fn_12", "SELECT doc_id, greatest(1, ceil(length(text) / 500e0))::BIGINT AS parts, sha256(text) AS hash FROM documents")
def fn_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split into parts and put together again by part number."""
    parts = B.table(spark, sf_dir, "documents").select("doc_id", F.inline(texts.chunks(F.col("text"), 500)))
    whole = parts.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("part", "body"))).alias("all"))
    return whole.select("doc_id", "parts", F.sha2(F.array_join(F.transform("all", lambda p: p["body"]), ""), 256).alias("hash"))


@query("wf_15", r"""SELECT doc_id, contains(text, 'de la') AS quoted, regexp_matches(text, '(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)') AS word FROM documents""")
def wf_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim quotes, and values as whole words."""
    return B.table(spark, sf_dir, "documents").select("doc_id", F.col("text").contains("de la").alias("quoted"), texts.whole_word(F.col("text"), F.lit("the")).alias("word"))


#: Documents with something written into each: a pair, half a pair, two pairs, a compact pair, a word alone, nothing.
NOTICES_SQL = """notice AS (
  SELECT *, signs >= 2 OR pairs > 0 OR worded AS candidate, (signs >= 2 OR pairs > 0 OR worded) AND NOT (signs >= 2 AND pairs > 0 AND worded) AS disagreement
  FROM (SELECT doc_id, lang, doc_id % 5 <> 0 AS live, [2, 1, 4, 0, 0, 0][doc_id % 6 + 1] AS signs, [1, 0, 2, 1, 0, 0][doc_id % 6 + 1] AS pairs, doc_id % 6 IN (0, 2, 4) AS worded FROM documents))"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of coordinates in documents, whose places vary by row."""
    k = F.col("doc_id")
    whole = lambda c: c.cast("int")
    pair = lambda more: F.format_string("%d° %d,5' N %d° %d' W", whole(58 + k % 9 + more), whole(k % 60), whole(k % 12), whole(k % 50))
    written = (
        F.when(k % 6 == 0, F.concat(F.lit("Posisjon "), pair(0))).when(k % 6 == 1, F.format_string("punkt %d° %d,5' N og land", whole(58 + k % 9), whole(k % 60)))
        .when(k % 6 == 2, F.concat(F.lit("Koordinatar: "), pair(0), F.lit(" og "), pair(1))).when(k % 6 == 3, F.format_string("%02d%02d N - %03d%02d V", whole(58 + k % 9), whole(k % 60), whole(k % 12), whole(k % 50)))
        .when(k % 6 == 4, "koordinatar manglar").otherwise("")
    )
    docs = B.table(spark, sf_dir, "documents").withColumns({"text": F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), written, F.lit("\n")), "live": k % 5 != 0})
    return sweeps.evidence(docs, "doc_id", "lang", "live")


@query("q_sweep", "WITH " + NOTICES_SQL + """ SELECT lang, count(*) AS scanned, count(*) FILTER (candidate) AS candidates, count(*) FILTER (candidate AND live) AS in_force, count(*) FILTER (candidate AND NOT live) AS skipped, coalesce(sum(pairs) FILTER (live), 0)::BIGINT AS read,
 coalesce(sum(pairs) FILTER (NOT live), 0)::BIGINT AS withheld, count(*) FILTER (signs > 0 AND pairs = 0) AS gaps, count(*) FILTER (disagreement) AS disagreements FROM notice GROUP BY lang""")
def q_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a corpus sweep by language: what looks like coordinates, and what was read as such."""
    return sweeps.counters(notices(spark, sf_dir), "lang")


@query("agg_25", _W + " SELECT split_part(jm_number, '-', 2)::BIGINT % 500 AS number, region, sum(len(points))::BIGINT AS vertices, arg_min(title, jm_number) AS name, count(*) AS parts FROM closure GROUP BY 1, 2")
def agg_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of one notice and paragraph as one: parts together, vertices summed, the first name kept."""
    number = F.split_part("jm_number", F.lit("-"), F.lit(2)).cast("long") % 500
    return B.closures(spark, sf_dir).groupBy(number.alias("number"), "region").agg(F.sum(F.size("points")).alias("vertices"), F.min_by("title", "jm_number").alias("name"), F.count("*").alias("parts"))


@query("q_diverge", _W + """, own AS (SELECT jm_number, points[1].lat AS lat, points[1].lon AS lon, len(points) AS n FROM closure WHERE split_part(jm_number, '-', 2)::BIGINT % 8 <> 0),
theirs AS (SELECT jm_number, points[1].lat + CASE WHEN split_part(jm_number, '-', 2)::BIGINT % 6 = 0 THEN 0.01e0 ELSE 0 END AS lat, points[1].lon AS lon, len(points) - CASE WHEN split_part(jm_number, '-', 2)::BIGINT % 9 = 0 THEN 1 ELSE 0 END AS n FROM closure)
SELECT t.jm_number, CASE WHEN o.jm_number IS NULL THEN 'missing-area' WHEN o.n <> t.n THEN 'vertex-count' WHEN abs(o.lat - t.lat) > 1e-4 OR abs(o.lon - t.lon) > 1e-4 THEN 'position' END AS kind
FROM theirs t LEFT JOIN own o USING (jm_number) WHERE o.jm_number IS NULL OR o.n <> t.n OR abs(o.lat - t.lat) > 1e-4 OR abs(o.lon - t.lon) > 1e-4""")
def q_diverge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings where an authority's vertices differ from our own."""
    c = B.closures(spark, sf_dir)
    number = F.split_part("jm_number", F.lit("-"), F.lit(2)).cast("long")
    own = c.filter(number % 8 != 0).select("jm_number", F.col("points").alias("own"))
    moved = lambda p: F.struct((p["lat"] + F.when(number % 6 == 0, 0.01).otherwise(0.0)).alias("lat"), p["lon"].alias("lon"))
    theirs = c.select("jm_number", F.transform(F.when(number % 9 == 0, F.slice("points", 1, 2)).otherwise(F.col("points")), moved).alias("theirs"))
    return A.divergence(theirs.withColumn("unreadable", F.lit(0)), own, "jm_number")


@query("wf_16", "SELECT doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 20")
def wf_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of an index: longest first within a group."""
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return B.table(spark, sf_dir, "documents").withColumn("place", F.row_number().over(w)).filter("place <= 20").select("doc_id", "n_chars", "place")
