"""Further rule, scraping and paging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import dates, geo, texts
from tidewater.operators import finance as N
from tidewater.operators import positions as P
from tidewater.plans.base import query
from tidewater.sources import bridge as B


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "orders")


@query("src_13", "SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS links FROM pages")
def src_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of a page."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return B.table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"))


@query("src_14", "SELECT s_suppkey AS id, 'skyndilokun-' || s_suppkey AS ref, CASE WHEN s_suppkey % 3 = 0 THEN 'Nr. ' || s_suppkey ELSE 'Closure' END AS title FROM supplier")
def src_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure records of feature JSON, with fallbacks for missing fields."""
    k = F.col("s_suppkey")
    text = F.format_string('{"properties":{"nr":%s,"name":%s}}', k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit('"Nr. '), k.cast("string"), F.lit('"'))).otherwise("null"))
    p = F.from_json(text, "struct<properties:struct<nr:bigint,name:string>>")["properties"]
    return B.table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("skyndilokun-"), p["nr"].cast("string")).alias("ref"), F.coalesce(p["name"], F.lit("Closure")).alias("title"))


@query("src_16", "SELECT s_suppkey // 100 AS batch, count(*) AS asked, count(*) FILTER (s_suppkey % 13 = 0) AS missing FROM supplier GROUP BY 1")
def src_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register fetched in batches of 100 ids: what each batch asked for and did not get."""
    inventory = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    returned = inventory.filter("id % 13 <> 0").withColumn("got", F.lit(True))
    joined = inventory.join(returned, "id", "left").groupBy(F.floor(F.col("id") / 100).alias("batch"))
    return joined.agg(F.count("*").alias("asked"), F.count_if(F.col("got").isNull()).alias("missing"))


@query("src_17", "SELECT p_partkey AS id, '## ' || p_name || chr(10) || '- ' || p_brand || chr(10) || '**' || p_type || '**' AS markdown FROM part")
def src_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML of a notice as Markdown."""
    html = F.concat(F.lit("<h2>"), F.col("p_name"), F.lit("</h2><ul><li>"), F.col("p_brand"), F.lit("</li></ul><p><strong>"), F.col("p_type"), F.lit("</strong></p>"))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), texts.html_markdown(html).alias("markdown"))


@query("txt_12", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'snart' END AS value FROM orders")
def txt_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of a definition list: the machine time if there is one, else the text."""
    k = F.col("o_orderkey")
    cell = F.when(k % 2 == 0, F.concat(F.lit('<time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('">i dag</time>'))).otherwise(F.lit("<b>snart</b>"))
    html = F.concat(F.lit("<dl><dt>Other</dt><dd>x</dd><dt class='a'> Gyldig </dt>\n<dd>"), cell, F.lit("</dd></dl>"))
    return _orders(spark, sf_dir).select(k.alias("id"), texts.definition(html, "Gyldig").alias("value"))


@query("txt_15", "SELECT s_suppkey AS id, 'vorn-veidibann-' || s_suppkey || '-' || CASE WHEN s_suppkey % 3 = 0 THEN '20206' ELSE '2026' END AS source_key, 'Veiðibann nr. ' || s_suppkey || ' - ' || CASE WHEN s_suppkey % 3 = 0 THEN '2020' ELSE '2026' END AS title FROM supplier")
def txt_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and title of a ban from its address; a year that is no year defers to the stated one."""
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://x.fo/Veidibann-nr-"), k.cast("string"), F.lit("-"), F.when(k % 3 == 0, "20206").otherwise("2026"))
    part = lambda i: F.regexp_extract(F.lower(url), r"nr-(\d+)-(\d+)", i)
    year = F.when(part(2).rlike(r"^\d{4}$"), part(2)).otherwise("2020")
    return B.table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("vorn-veidibann-"), part(1), F.lit("-"), part(2)).alias("source_key"), F.concat(F.lit("Veiðibann nr. "), part(1), F.lit(" - "), year).alias("title"))


@query("txt_23", "SELECT o_orderkey AS id, 'LOG-K-' || (o_orderkey % 200) || '-' || year(o_orderdate) AS jm_number, CASE WHEN o_orderkey % 5 = 0 THEN 'international' ELSE 'home' END AS waters FROM orders")
def txt_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute number and waters from a title."""
    k = F.col("o_orderkey")
    title = F.concat(F.lit("Kunngerð nr. "), (k % 200).cast("string"), F.lit(" um friðing"), F.when(k % 5 == 0, " í altjóða sjógvi").otherwise(""), F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit(")"))
    number = F.concat(F.regexp_extract(title, r"nr\.\s*(\d+).*?\((\d{4})\)", 1), F.lit("/"), F.regexp_extract(title, r"nr\.\s*(\d+).*?\((\d{4})\)", 2))
    waters = F.when(title.rlike("(?i)NEAFC|NAFO|altjóða sjógvi"), "international").otherwise("home")
    return _orders(spark, sf_dir).select(k.alias("id"), F.concat(F.lit("LOG-K-"), F.replace(number, F.lit("/"), F.lit("-"))).alias("jm_number"), waters.alias("waters"))


@query("dt_04", "SELECT o_orderkey AS id, epoch_us(make_timestamp(1998, 7, 1 + o_orderkey % 20, 23, o_orderkey % 60, 0.0)) // 1000 AS from_ms, epoch_us(make_timestamp(1998, 10, 3, 0, 0, 0.0)) // 1000 AS to_ms FROM orders")
def dt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Kunngerðin er galdandi frá hin "), (1 + k % 20).cast("string"), F.lit(". juli 1998 klokkan 23:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(" til og við 3. oktober 1998."))
    w = dates.faroese_window(text)
    return _orders(spark, sf_dir).select(k.alias("id"), w["from_ms"].alias("from_ms"), w["to_ms"].alias("to_ms"))


@query("dt_07", "SELECT o_orderkey AS id, epoch_us(o_orderdate::TIMESTAMP - INTERVAL 48 HOUR) // 1000 AS window_from, strftime(o_orderdate::DATE - 2, '%Y-%m-%d') AS from_day FROM orders")
def dt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window before an instant, and the day it begins on."""
    at = F.col("o_orderdate").cast("timestamp")
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), (F.unix_millis(at) - 48 * 3_600_000).alias("window_from"), F.date_format(F.date_add(F.to_date(at), -2), "yyyy-MM-dd").alias("from_day"))


@query("q_fragsync", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'unrecoverable' WHEN 1 THEN 'in-sync' WHEN 2 THEN 'rewrite' ELSE 'unrecoverable' END AS action FROM orders")
def q_fragsync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with a published fragment whose front matter may have drifted from its row."""
    k = F.col("o_orderkey")
    front = F.concat(F.lit("---\nstatus: "), F.when(k % 4 == 1, "current").otherwise("archived"), F.lit("\nvalid_to: 3.8.1998\n---\n"))
    content = F.when(k % 4 == 0, " ").when(k % 4 == 3, front).otherwise(F.concat(front, F.lit("Body")))
    rows = _orders(spark, sf_dir).select(k.alias("id"), content.alias("content"), F.lit("current").alias("status"), F.lit(902_188_799_999).alias("valid_to"))
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    fields = F.str_to_map(F.regexp_extract("content", pattern, 1), F.lit("\n"), F.lit(": "))
    drifted = ~F.try_element_at(fields, F.lit("status")).eqNullSafe(F.col("status")) | ~dates.validity_end(F.try_element_at(fields, F.lit("valid_to"))).eqNullSafe(F.col("valid_to"))
    body = F.trim(F.regexp_extract("content", pattern, 2))
    action = F.when(F.trim("content") == "", "unrecoverable").when(~drifted, "in-sync").when(body == "", "unrecoverable").otherwise("rewrite")
    return rows.select("id", action.alias("action"))


@query("snk_10", "SELECT c_custkey AS vessel_id, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 6 END AS type_id FROM customer WHERE (SELECT count(*) FROM customer) > 0")
def snk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new snapshot takes over whole; an empty read is refused and the old one stays."""
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vessel_id"))
    old, new = c.withColumns({"type_id": F.lit(1), "snapshot": F.lit(1)}), c.withColumns({"type_id": F.when(F.col("vessel_id") % 2 == 0, 7).otherwise(6), "snapshot": F.lit(2)})
    both = old.unionByName(new).unionByName(new.filter("false").withColumn("snapshot", F.lit(3)))
    return both.join(F.broadcast(both.agg(F.max("snapshot").alias("snapshot"))), "snapshot", "left_semi").select("vessel_id", "type_id")


@query("snk_13", "SELECT user_id AS vessel_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS fixes FROM events GROUP BY 1, 2")
def snk_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rollup kept up to date from partial counts of two batches."""
    fixes = B.fixes(spark, sf_dir)
    parts = [fixes.filter(F.col("source_id") % 2 == i).groupBy("vessel_id", F.date_format("event_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")) for i in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("vessel_id", "day").agg(F.sum("n").alias("fixes"))


_FIX = "WITH " + B.FIXES_SQL


@query("flt_04", _FIX + " SELECT count(*) FILTER (speed BETWEEN 0 AND 1000) AS known, count(*) FILTER (speed BETWEEN 1 AND 5) AS band, count(*) FILTER (speed IS NULL) AS unknown FROM fix")
def flt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).agg(F.count_if(P.in_band(0, 1000)).alias("known"), F.count_if(P.in_band(1, 5)).alias("band"), F.count_if(F.col("speed").isNull()).alias("unknown"))


@query("flt_08", _FIX + " SELECT DISTINCT vessel_id FROM fix WHERE floor(longitude / 0.1e0) BETWEEN -70 AND -66 AND floor(latitude / 0.03e0) BETWEEN 2001 AND 2004")
def flt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessels with a fix in the wanted cells."""
    ix, iy = geo.cell_index(F.col("longitude"), P.GRID_LON), geo.cell_index(F.col("latitude"), P.GRID_LAT)
    return B.fixes(spark, sf_dir).filter(ix.between(-70, -66) & iy.between(2001, 2004)).select("vessel_id").distinct()


@query("flt_11", "SELECT p_partkey AS id FROM part WHERE p_name ILIKE 'red bolt' OR p_name ILIKE '%RING%' OR p_brand ILIKE 'brand#1%'")
def flt_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part")
    return p.filter(F.col("p_name").ilike("red bolt") | F.col("p_name").ilike("%RING%") | F.col("p_brand").ilike("brand#1%")).select(F.col("p_partkey").alias("id"))


@query("flt_13", "WITH " + B.COMPANIES_SQL + " SELECT company_id FROM company WHERE name NOT LIKE '%(OLD)%' AND list_contains(string_split(replace(upper(labels), ' ', ''), ','), 'TRAWL')")
def flt_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.companies(spark, sf_dir).filter(~F.col("name").like("%(OLD)%") & (F.expr("find_in_set('TRAWL', replace(upper(labels), ' ', ''))") > 0)).select("company_id")


@query("flt_18", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0")
def flt_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only dates of the readable shape."""
    shaped = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return shaped.filter(F.col("d").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).select("id")


@query("flt_20", "SELECT event_id AS id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT > 50")
def flt_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on JSON: a key that is there, and its value."""
    e = B.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.filter(F.array_contains(F.json_object_keys("props"), "k") & (k > 50)).select(F.col("event_id").alias("id"), k.alias("k"))


@query("flt_25", "WITH " + B.CLOSURES_SQL + " SELECT jm_number FROM closure WHERE list_bool_and([p.lat BETWEEN 58 AND 68 AND p.lon BETWEEN -8 AND 12 FOR p IN points])")
def flt_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures that lie in the plausible region with all their vertices."""
    return B.closures(spark, sf_dir).filter(F.forall("points", lambda p: geo.in_bbox(p["lon"], p["lat"], (-8.0, 58.0, 12.0, 68.0)))).select("jm_number")


@query("prj_01", _FIX + " SELECT source_id AS \"sourceId\", strftime(event_time, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || 'Z' AS \"eventTime\" FROM fix")
def prj_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel-case fields and ISO instants."""
    return B.fixes(spark, sf_dir).select(F.col("source_id").alias("sourceId"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("eventTime"))


@query("jn_12", _FIX + " SELECT CASE WHEN event_time >= TIMESTAMP '2024-01-03' AND event_time < TIMESTAMP '2024-01-10' THEN 0 WHEN event_time >= TIMESTAMP '2024-01-12' AND event_time < TIMESTAMP '2024-01-20' THEN 1 ELSE -1 END AS w, count(*) AS n FROM fix GROUP BY 1")
def jn_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix in one of disjoint half-open windows, or in none."""
    w = F.when(P.in_period("2024-01-03 00:00:00", "2024-01-10 00:00:00", False), 0).when(P.in_period("2024-01-12 00:00:00", "2024-01-20 00:00:00", False), 1).otherwise(-1)
    return B.fixes(spark, sf_dir).groupBy(w.alias("w")).agg(F.count("*").alias("n"))


@query("jn_19", "SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END, p_partkey) AS paired, CASE WHEN p_partkey % 4 = 0 THEN 'theirs' WHEN p_partkey % 6 = 0 THEN 'ours' ELSE 'both' END AS side FROM part WHERE NOT (p_partkey % 4 = 0 AND p_partkey % 6 = 0)")
def jn_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairing by paragraph, with what either side alone has."""
    p = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    ours, theirs = p.filter("id % 4 <> 0").withColumn("a", F.col("id")), p.filter("id % 6 <> 0").withColumn("b", F.col("id"))
    side = F.when(F.col("a").isNull(), "theirs").when(F.col("b").isNull(), "ours").otherwise("both")
    return ours.join(theirs, "id", "full").select("id", F.coalesce("a", "b").alias("paired"), side.alias("side"))


@query("agg_02", _FIX + " SELECT vessel_id, epoch_us(date_trunc('hour', event_time)) // 1000 AS hour, arg_max(latitude, (ingest_ms, source_id)) AS latitude FROM fix GROUP BY 1, 2")
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ingested value of each vessel and hour."""
    return B.fixes(spark, sf_dir).groupBy("vessel_id", F.unix_millis(F.date_trunc("hour", "event_time")).alias("hour")).agg(P.arg_max("latitude", "ingest_time", "source_id"))


@query("agg_12", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def agg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).distinct()


@query("agg_19", "WITH " + B.ACCOUNTS_SQL + " SELECT company_id, year, round(sum(value) FILTER (account IN (1, 2, 3)), 2) AS gross FROM account GROUP BY 1, 2 HAVING count(*) FILTER (account IN (1, 2, 3)) > 0")
def agg_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One total of the account tree, by a join with its leaves."""
    leaves = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in N.TOTALS[4]])).alias("account"))
    return B.account_values(spark, sf_dir).join(F.broadcast(leaves), "account").groupBy("company_id", "year").agg(F.round(F.sum("value"), 2).alias("gross"))


@query("agg_28", """WITH l AS (SELECT DISTINCT l_orderkey AS id, l_quantity AS q, l_returnflag AS f FROM lineitem)
SELECT id, q, f, row_number() OVER (PARTITION BY id ORDER BY printf('%.2f|%s', q, f)) - 1 AS line_index FROM l""")
def agg_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook lines grouped by report: exact repeats go, the rest is numbered in the order of its fingerprint."""
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f")).distinct()
    print_ = F.format_string("%.2f|%s", "q", "f")
    return lines.withColumn("line_index", (F.row_number().over(Window.partitionBy("id").orderBy(print_)) - 1).cast("long"))


@query("win_01", _FIX + " SELECT vessel_id, ms, date_diff('second', lag(event_time, 1, event_time) OVER (PARTITION BY vessel_id ORDER BY event_time), event_time) AS gap_s FROM fix")
def win_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).select("vessel_id", F.unix_millis("event_time").alias("ms"), P.gap_seconds("vessel_id").alias("gap_s"))


@query("win_02", _FIX + " SELECT vessel_id, source_id % 2 AS w, ms, date_diff('second', lag(event_time, 1, event_time) OVER (PARTITION BY vessel_id, source_id % 2 ORDER BY event_time), event_time) AS gap_s FROM fix")
def win_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap never reaches from one window into another."""
    return B.fixes(spark, sf_dir).withColumn("w", F.col("source_id") % 2).select("vessel_id", "w", F.unix_millis("event_time").alias("ms"), P.gap_seconds("vessel_id", "w").alias("gap_s"))


@query("win_04", _FIX + " SELECT vessel_id, source_id FROM fix QUALIFY row_number() OVER (PARTITION BY vessel_id ORDER BY event_time DESC) <= 5")
def win_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.sinks import keep_newest

    return keep_newest(B.fixes(spark, sf_dir), ["vessel_id"], 5, "event_time").select("vessel_id", "source_id")


@query("win_07", "WITH " + B.VALIDATIONS_SQL + " SELECT revision_id, kind, max(coalesce(command_sequence, -1)) AS last FROM validation GROUP BY 1, 2")
def win_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last receipt of each revision and scope, those without a sequence last."""
    from tidewater.operators.cases import latest_verdict

    return latest_verdict(B.validations(spark, sf_dir), "revision_id", "kind").select("revision_id", "kind", F.coalesce("command_sequence", F.lit(-1)).alias("last"))


@query("top_02", _FIX + " SELECT source_id, row_number() OVER (ORDER BY ms DESC, source_id DESC) <= 100 AS on_page FROM fix ORDER BY ms DESC, source_id DESC LIMIT 101")
def top_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyset page of 100, and one row more that tells of a next page."""
    page = B.fixes(spark, sf_dir).select("source_id", F.unix_millis("event_time").alias("ms")).orderBy(F.desc("ms"), F.desc("source_id")).limit(101)
    return page.withColumn("on_page", F.row_number().over(Window.orderBy(F.desc("ms"), F.desc("source_id"))) <= 100).select("source_id", "on_page")


@query("top_03", "SELECT c_custkey AS id, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_name DESC, c_custkey OFFSET 40 LIMIT 20")
def top_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset page with the total."""
    c = B.table(spark, sf_dir, "customer")
    return c.orderBy(F.desc("c_name"), "c_custkey").offset(40).limit(20).join(F.broadcast(c.agg(F.count("*").alias("total")))).select(F.col("c_custkey").alias("id"), "total")


@query("top_07", "WITH " + B.CLOSURES_SQL + " SELECT jm_number, row_number() OVER (ORDER BY valid_to DESC NULLS LAST, jm_number) AS place FROM closure ORDER BY place LIMIT 200")
def top_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = B.closures(spark, sf_dir).orderBy(F.col("valid_to").desc_nulls_last(), "jm_number").limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("valid_to").desc_nulls_last(), "jm_number")).cast("long")).select("jm_number", "place")


@query("top_10", _FIX + ", ask AS (SELECT unnest([1, 2, 3, 999999]) AS vessel_id) SELECT a.vessel_id, count(f.vessel_id) AS points, max(f.ms) AS last FROM ask a LEFT JOIN fix f USING (vessel_id) GROUP BY 1")
def top_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested vessels with their points; those without any are answered, too."""
    ask = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 999999)])).alias("vessel_id"))
    grouped = B.fixes(spark, sf_dir).join(F.broadcast(ask), "vessel_id", "left_semi").groupBy("vessel_id").agg(F.count("*").alias("n"), F.max(F.unix_millis("event_time")).alias("last"))
    return ask.join(grouped, "vessel_id", "left").select("vessel_id", F.coalesce("n", F.lit(0)).alias("points"), "last")


@query("geo_18", "WITH " + B.CLOSURES_SQL + " SELECT region, sum(len(points))::BIGINT AS vertices, round(max((list_max([p.lon FOR p IN points]) - list_min([p.lon FOR p IN points])) * (list_max([p.lat FOR p IN points]) - list_min([p.lat FOR p IN points]))), 4) AS widest FROM closure GROUP BY region")
def geo_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices by region, and the largest bounding box in square degrees."""
    b = geo.bbox_of(F.col("points"))
    area = (b["max_lon"] - b["min_lon"]) * (b["max_lat"] - b["min_lat"])
    return B.closures(spark, sf_dir).groupBy("region").agg(F.sum(F.size("points")).alias("vertices"), F.round(F.max(area), 4).alias("widest"))


@query("fn_06", "SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS same FROM orders")
def fn_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of nested values, nulls included."""
    k = F.col("o_orderkey")
    nested = lambda x: F.struct(F.lit(None).cast("string").alias("a"), F.array(F.struct(x.alias("v"))).alias("b"))
    return _orders(spark, sf_dir).select(k.alias("id"), nested(k).eqNullSafe(nested(F.when(k % 5 == 0, k))).alias("same"))


@query("fn_10", "SELECT s_suppkey AS id, unnest([s_suppkey, s_suppkey + 1]) AS n FROM supplier")
def fn_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a JSON array."""
    k = F.col("s_suppkey")
    return B.table(spark, sf_dir, "supplier").select(k.alias("id"), F.explode(F.from_json(F.format_string("[%d,%d]", k, k + 1), "array<bigint>")).alias("n"))


@query("wf_08", "SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'legal' END, CASE WHEN o_orderkey % 3 = 0 THEN 'coverage' END, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'shape' END) AS missing FROM orders")
def wf_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What still blocks an approval: legal review, coverage, or a shape that is not drawn or no longer the one validated."""
    k = F.col("o_orderkey")
    o = _orders(spark, sf_dir).select(k.alias("id"), (k % 2 != 0).alias("legal"), (k % 3 != 0).alias("coverage"))
    shapes = o.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("shape")).select("id", "shape", F.when((F.col("shape") == 1) & (F.col("id") % 5 == 0), None).otherwise("g").alias("geojson"), F.when((F.col("shape") == 2) & (F.col("id") % 7 == 0), "old").otherwise("now").alias("seen"))
    state = shapes.groupBy("id").agg(F.bool_or(F.col("geojson").isNull() | (F.col("seen") != "now")).alias("open_shape"))
    parts = [F.when(~F.col("legal"), "legal"), F.when(~F.col("coverage"), "coverage"), F.when(F.col("open_shape"), "shape")]
    return o.join(state, "id").select("id", F.concat_ws(",", *parts).alias("missing"))


@query("wf_10", "SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS holds FROM orders")
def wf_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval evidence: ids and hashes equal, place by place."""
    k = F.col("o_orderkey")
    stated, found = F.array(k, k + 1), F.array(k, F.when(k % 4 == 0, k + 2).otherwise(k + 1))
    return _orders(spark, sf_dir).select(k.alias("id"), ((F.size(stated) == F.size(found)) & F.forall(F.zip_with(stated, found, lambda a, b: a == b), lambda x: x)).alias("holds"))


@query("wf_14", "SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 100 ORDER BY 1 LIMIT 32")
def wf_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page of cases with open work."""
    return _orders(spark, sf_dir).filter("o_orderstatus = 'O' AND o_custkey > 100").select(F.col("o_custkey").alias("case_id")).distinct().orderBy("case_id").limit(32)


@query("wf_17", "SELECT c_custkey AS id, c_custkey % 6 <> 0 AND c_custkey % 10 <> 0 AS is_current FROM customer")
def wf_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a published fragment is current: render version, revision and name, nulls comparing as equal."""
    k = F.col("c_custkey")
    f = B.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 6 == 0, 2).otherwise(3).alias("version"), F.when(k % 10 == 0, None).otherwise(k).alias("revision"))
    return f.select("id", ((F.col("version") >= 3) & F.col("revision").eqNullSafe(F.col("id"))).alias("is_current"))


@query("wf_18", "SELECT doc_id, left(text, 100) AS clipped, length(text) > 100 AS was_clipped, greatest(len(string_split(text, ' ')) - 20, 0) AS dropped FROM documents")
def wf_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped text, and the last 20 of a list with the number that went."""
    words = F.split("text", " ")
    last = F.when(F.size(words) > 20, F.slice(words, -20, 20)).otherwise(words)
    return B.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 100).alias("clipped"), (F.length("text") > 100).alias("was_clipped"), (F.size(words) - F.size(last)).cast("long").alias("dropped"))


@query("wf_02", "SELECT o_orderkey AS revision_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'under_review' ELSE 'unchanged' END AS admin_status, CASE WHEN o_orderkey % 2 = 0 THEN 'published' ELSE 'draft' END AS status FROM orders WHERE o_custkey % 7 <> 0")
def wf_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of a case's pointer: only to its own revision; leaving an approved one demotes the case, which stays published if a pin exists."""
    k = F.col("o_orderkey")
    moves = _orders(spark, sf_dir).select(k.alias("revision_id"), "o_custkey", F.when(F.col("o_custkey") % 7 == 0, -1).otherwise(F.col("o_custkey")).alias("owner"), (F.col("o_orderstatus") == "F").alias("leaves_approved"), (k % 3 == 0).alias("same"), (k % 2 == 0).alias("pinned"))
    own = moves.filter("owner = o_custkey")
    return own.select("revision_id", F.when(F.col("leaves_approved") & ~F.col("same"), "under_review").otherwise("unchanged").alias("admin_status"), F.when(F.col("pinned"), "published").otherwise("draft").alias("status"))

