"""Domain tables over the star-schema test tables, and the same as DuckDB common table expressions.

All mappings are integer arithmetic and doubles, so that both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Vessel flags and types that the activity layer knows.
FLAGS = ("FO", "NO", "IS", "GL", "DK", "SE", "GB", "IE", "CA", "RU", "NZ")
TYPES = (2, 28, 4, 3, 5, 10, 29, 8, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position fixes from ``events``."""
    return as_fixes(table(spark, sf_dir, "events"))


def as_fixes(e: DataFrame) -> DataFrame:
    """Position fixes of a batch or stream of events."""
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("source_id"), F.col("user_id").alias("vessel_id"),
        ((F.col("event_id") * 37) % 60 / F.lit(100.0) + 60.0 + 0.005).alias("latitude"), ((F.col("event_id") * 53) % 200 / F.lit(100.0) - 7.0 + 0.005).alias("longitude"),
        F.when(F.col("event_type") != "error", F.col("value") / 10.0).alias("speed"), ((F.col("event_id") * 7) % 360).alias("heading"), ((F.col("event_id") * 11) % 360).alias("course"),
        F.col("event_type").alias("status"), ts.alias("event_time"), F.timestamp_millis(F.unix_millis(ts) + F.col("event_id") % 60 * 1000).alias("ingest_time"),
    )


FIXES_SQL = """fix AS (
  SELECT event_id AS source_id, user_id AS vessel_id, (event_id * 37) % 60 / 100e0 + 60e0 + 0.005e0 AS latitude, (event_id * 53) % 200 / 100e0 - 7e0 + 0.005e0 AS longitude,
    CASE WHEN event_type <> 'error' THEN value / 10e0 END AS speed, (event_id * 7) % 360 AS heading, (event_id * 11) % 360 AS course, event_type AS status,
    ts AS event_time, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) + event_id % 60 * 1000 AS ingest_ms
  FROM events)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel registry snapshots from ``customer``: the newest, and a stale one with other types."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")

    def snapshot(number: int, shift: int) -> DataFrame:
        return c.select(key.alias("vessel_id"), _pick((key + shift) % 9, TYPES).alias("type_id"), _pick(F.col("c_nationkey") % 11, FLAGS).alias("flag"), F.col("c_name").alias("name"), F.lit(number).cast("long").alias("snapshot"))

    return snapshot(1, 1).unionByName(snapshot(2, 0))


REGISTRY_SQL = f"""registry AS (
  SELECT c_custkey AS vessel_id, (ARRAY{list(TYPES)})[(c_custkey + s.shift) % 9 + 1] AS type_id, (ARRAY{list(FLAGS)})[c_nationkey % 11 + 1] AS flag, c_name AS name, s.snapshot
  FROM customer, (VALUES (1, 1), (2, 0)) AS s(snapshot, shift))"""


def catch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch reports from ``orders``: dates and times as text, vessel names from customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("innmelding_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reported_date"),
        F.format_string("%02d:%02d:00", (key % 24).cast("int"), (key * 7 % 60).cast("int")).alias("reported_time"),
        F.col("c_name").alias("vessel_name"), F.concat(F.lit("R-"), (F.col("c_custkey") % 400).cast("string"), F.lit("-AA")).alias("registration_mark"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("vessel_id"),
    )


ENTRIES_SQL = """entry AS (
  SELECT o_orderkey AS innmelding_id, strftime(o_orderdate, '%Y-%m-%d') AS reported_date, printf('%02d:%02d:00', o_orderkey % 24, o_orderkey * 7 % 60) AS reported_time,
    c_name AS vessel_name, 'R-' || (c_custkey % 400) || '-AA' AS registration_mark, o_orderpriority AS priority, o_orderstatus AS status, o_custkey AS vessel_id
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def catch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch lines from ``lineitem`` and ``part``; some lack a weight, some a route, some a position."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("innmelding_id"), line.alias("line_index"), F.col("p_type").alias("species"), F.col("p_brand").alias("quality"), F.col("l_quantity").alias("tonnes"),
        F.when(line % 2 == 0, F.col("l_quantity") * 1000).alias("weight_kg"), F.col("l_extendedprice").alias("value"),
        F.when(supplier % 10 != 0, F.concat(F.lit("#"), F.lpad((supplier % 50).cast("string"), 4, "0"))).alias("route_key"),
        F.when(line % 3 != 0, 60.0 + supplier % 60 / F.lit(10.0)).alias("latitude"), F.when(line % 3 != 0, -7.0 + supplier % 200 / F.lit(10.0)).alias("longitude"),
    )


LINES_SQL = """line AS (
  SELECT l_orderkey AS innmelding_id, l_linenumber AS line_index, p_type AS species, p_brand AS quality, l_quantity AS tonnes, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 1000 END AS weight_kg,
    l_extendedprice AS value, CASE WHEN l_suppkey % 10 <> 0 THEN '#' || lpad((l_suppkey % 50)::VARCHAR, 4, '0') END AS route_key,
    CASE WHEN l_linenumber % 3 <> 0 THEN 60e0 + l_suppkey % 60 / 10e0 END AS latitude, CASE WHEN l_linenumber % 3 <> 0 THEN -7e0 + l_suppkey % 200 / 10e0 END AS longitude
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# Accounts that the reports store: leaves of all sections, and one total that then wins over its sum.
STORED_ACCOUNTS = (1, 2, 3, 5, 7, 9, 10, 12, 14, 18, 21, 22, 26, 30, 31, 34, 36, 38, 40, 44, 58, 49, 6)


def account_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored accounts of annual reports: company, year, account, value."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = o.join(li, o.o_orderkey == li.l_orderkey)
    grouped = joined.groupBy(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("year"), _pick(F.col("l_partkey") % len(STORED_ACCOUNTS), STORED_ACCOUNTS).alias("account"))
    return grouped.agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


ACCOUNTS_SQL = f"""account AS (
  SELECT o_custkey AS company_id, year(o_orderdate) AS year, (ARRAY{list(STORED_ACCOUNTS)})[l_partkey % {len(STORED_ACCOUNTS)} + 1] AS account, round(sum(l_extendedprice), 2) AS value
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies from ``customer``: currency, country, labels as comma-separated text; some names are marked as old."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("company_id"), F.when(key % 17 == 0, F.concat("c_name", F.lit(" (OLD)"))).otherwise(F.col("c_name")).alias("name"), _pick(key % 4, ("DKK", "NOK", "ISK", "EUR")).alias("currency"),
        _pick(key % 3, ("FO", "NO", "IS")).alias("country"), F.when(key % 9 != 0, F.concat(F.lower("c_mktsegment"), F.lit(", "), _pick(key % 3, ("PELAGIC", " Trawl", "longline ")))).alias("labels"),
    )


COMPANIES_SQL = """company AS (
  SELECT c_custkey AS company_id, CASE WHEN c_custkey % 17 = 0 THEN c_name || ' (OLD)' ELSE c_name END AS name, (ARRAY['DKK', 'NOK', 'ISK', 'EUR'])[c_custkey % 4 + 1] AS currency,
    (ARRAY['FO', 'NO', 'IS'])[c_custkey % 3 + 1] AS country, CASE WHEN c_custkey % 9 <> 0 THEN lower(c_mktsegment) || ', ' || (ARRAY['PELAGIC', ' Trawl', 'longline '])[c_custkey % 3 + 1] END AS labels
  FROM customer)"""


def rates(spark: SparkSession) -> DataFrame:
    """Euro rates by year; one currency is unknown before 1995."""
    years = spark.range(1990, 2030).select(F.col("id").cast("int").alias("year"))
    rows = F.array(*[F.struct(F.lit(q).alias("quote"), F.lit(r).alias("base"), F.lit(d).alias("step")) for q, r, d in (("DKK", 7.5, 0.01), ("NOK", 9.0, 0.05), ("ISK", 120.0, 1.0), ("EUR", 1.0, 0.0))])
    return years.select("year", F.inline(rows)).filter("quote <> 'ISK' OR year >= 1995").select("year", "quote", (F.col("base") + F.col("step") * (F.col("year") - 1990)).alias("rate"))


RATES_SQL = """rate AS (
  SELECT year::INTEGER AS year, quote, base + step * (year - 1990) AS rate
  FROM range(1990, 2030) AS y(year), (VALUES ('DKK', 7.5e0, 0.01e0), ('NOK', 9e0, 0.05e0), ('ISK', 120e0, 1e0), ('EUR', 1e0, 0e0)) AS q(quote, base, step) WHERE quote <> 'ISK' OR year >= 1995)"""


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel directory from ``customer``: shared names, marks with zeros and punctuation, an active and a retired fleet."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"), F.concat(F.lit("Vessel "), (key % 700).cast("string"), F.when(key % 5 == 0, " R-12").otherwise("")).alias("name"),
        F.when(key % 3 != 0, F.concat(F.lit("R-0"), (key % 900).cast("string"))).alias("registration_number"), F.concat(F.lit("H "), (key % 300).cast("string")).alias("harbour_number"),
        F.when(key % 4 == 0, F.concat(F.lit("CS"), key.cast("string"))).alias("call_sign"), F.lit(None).cast("string").alias("mmsi"), F.when(key % 6 == 0, 2).otherwise(1).alias("status_id"),
    )


DIRECTORY_SQL = """directory AS (
  SELECT c_custkey AS id, 'Vessel ' || (c_custkey % 700) || CASE WHEN c_custkey % 5 = 0 THEN ' R-12' ELSE '' END AS name, CASE WHEN c_custkey % 3 <> 0 THEN 'R-0' || (c_custkey % 900) END AS registration_number,
    'H ' || (c_custkey % 300) AS harbour_number, CASE WHEN c_custkey % 4 = 0 THEN 'CS' || c_custkey END AS call_sign, NULL::VARCHAR AS mmsi, CASE WHEN c_custkey % 6 = 0 THEN 2 ELSE 1 END AS status_id
  FROM customer)"""


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures from ``orders``: validity as days, and three vertices each."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    vertex = lambda i: F.struct((58.0 + (key * 13 + i * 7) % 1200 / F.lit(100.0)).alias("lat"), (-10.0 + (key * 29 + i * 11) % 2500 / F.lit(100.0)).alias("lon"))
    return o.select(
        F.concat(F.lit("J-"), key.cast("string")).alias("jm_number"), F.concat(F.lit("Closure "), F.col("o_orderpriority")).alias("title"),
        _pick(key % 3, ("NO", "FO", "IS")).alias("region"), F.when(key % 5 != 0, day).alias("valid_from"), F.when(key % 7 != 0, day + (key % 90).cast("int")).alias("valid_to"),
        F.col("o_orderstatus").alias("status"), (key % 4 != 0).alias("has_geo"), F.array(vertex(0), vertex(1), vertex(2)).alias("points"),
    )


_VERTEX = "{{'lat': 58e0 + (o_orderkey * 13 + {0} * 7) % 1200 / 100e0, 'lon': -10e0 + (o_orderkey * 29 + {0} * 11) % 2500 / 100e0}}"
CLOSURES_SQL = f"""closure AS (
  SELECT 'J-' || o_orderkey AS jm_number, 'Closure ' || o_orderpriority AS title, (ARRAY['NO', 'FO', 'IS'])[o_orderkey % 3 + 1] AS region,
    CASE WHEN o_orderkey % 5 <> 0 THEN date_diff('day', DATE '1970-01-01', o_orderdate::DATE) END AS valid_from,
    CASE WHEN o_orderkey % 7 <> 0 THEN date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + o_orderkey % 90 END AS valid_to,
    o_orderstatus AS status, o_orderkey % 4 <> 0 AS has_geo, [{', '.join(_VERTEX.format(i) for i in range(3))}] AS points
  FROM orders)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer features from ``part``."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("feature_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.when(key % 3 == 0, "point").otherwise("line").alias("geometry_kind"),
        (55.0 + key * 17 % 1500 / F.lit(100.0)).alias("lat"), (-20.0 + key * 31 % 4000 / F.lit(100.0)).alias("lon"),
    )


FEATURES_SQL = """feature AS (
  SELECT p_partkey AS feature_id, p_name AS name, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'point' ELSE 'line' END AS geometry_kind,
    55e0 + p_partkey * 17 % 1500 / 100e0 AS lat, -20e0 + p_partkey * 31 % 4000 / 100e0 AS lon
  FROM part)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulation cases from ``customer``."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("case_id"), F.col("c_name").alias("title"), _pick(key % 3, ("NO", "FO", "IS")).alias("region"),
        _pick(key % 5, ("unread", "under_review", "awaiting_geometry", "awaiting_regulatory", "approved")).alias("admin_status"), _pick(key * 7 % 4, ("critical", "high", "medium", "low")).alias("urgency"),
        F.when(key % 4 != 0, key % 13).alias("assignee"), (key % 2 == 0).alias("is_read"), F.when(key % 6 == 0, key % 40).alias("snoozed_until"), (key * 11 % 365).alias("updated_day"),
    )


CASES_SQL = """cases AS (
  SELECT c_custkey AS case_id, c_name AS title, (ARRAY['NO', 'FO', 'IS'])[c_custkey % 3 + 1] AS region,
    (ARRAY['unread', 'under_review', 'awaiting_geometry', 'awaiting_regulatory', 'approved'])[c_custkey % 5 + 1] AS admin_status, (ARRAY['critical', 'high', 'medium', 'low'])[c_custkey * 7 % 4 + 1] AS urgency,
    CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 13 END AS assignee, c_custkey % 2 = 0 AS is_read, CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 40 END AS snoozed_until, c_custkey * 11 % 365 AS updated_day
  FROM customer)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Immutable revisions of cases from ``orders``; ``sequence`` orders the commands of a case."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("case_id"), key.alias("revision_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("recorded_at"), F.col("o_orderstatus").alias("status"), (key % 3).alias("n_areas"), F.round("o_totalprice", 2).alias("content"))


REVISIONS_SQL = """revision AS (
  SELECT o_custkey AS case_id, o_orderkey AS revision_id, epoch(o_orderdate)::BIGINT AS recorded_at, o_orderstatus AS status, o_orderkey % 3 AS n_areas, round(o_totalprice, 2) AS content
  FROM orders)"""


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation receipts of revisions' areas from ``lineitem``; some have no command sequence."""
    li = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("revision_id"), line.alias("receipt"), (line % 3).alias("area"), F.when(line % 2 == 0, "legal").otherwise("geometry").alias("kind"),
        F.when(line != 5, F.col("l_partkey") % 100).alias("command_sequence"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("recorded_at"), (F.col("l_returnflag") != "R").alias("passed"),
    )


VALIDATIONS_SQL = """validation AS (
  SELECT l_orderkey AS revision_id, l_linenumber AS receipt, l_linenumber % 3 AS area, CASE WHEN l_linenumber % 2 = 0 THEN 'legal' ELSE 'geometry' END AS kind,
    CASE WHEN l_linenumber <> 5 THEN l_partkey % 100 END AS command_sequence, epoch(l_shipdate)::BIGINT AS recorded_at, l_returnflag <> 'R' AS passed
  FROM lineitem)"""
