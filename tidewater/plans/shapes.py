"""Queries over feeds, areas read from text, rings, boxes and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import geo, sweep
from tidewater.operators import areas as A
from tidewater.plans import places
from tidewater.plans.base import query
from tidewater.sources import bridge as B
from tidewater.sources import feeds

BOX = (-5.0, 60.0, 3.0, 64.0)


@query("src_10", """SELECT '#' || lpad(s_suppkey::VARCHAR, 4, '0') AS route_key, CASE WHEN s_suppkey % 2 = 0 THEN '27.' || s_suppkey END AS fao_area, 60 + s_suppkey / 10e0 AS centre_latitude, 1 AS n_points FROM supplier WHERE s_suppkey < 10000 AND (s_suppkey % 7 <> 0 OR s_suppkey % 3 = 0)""")
def src_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed JSON register of areas; one entry in seven has no readable key, and of those one in three is known by its route alone."""
    key = F.col("s_suppkey")
    fao = F.when(key % 2 == 0, F.format_string('"27.%d"', key)).otherwise("null")
    entry = F.format_string('{"%s":{"Rute":%s,"FAOArea":%s,"Center":{"Latitude":%s,"Longitude":1.0},"Coordinates":[{"Latitude":60.0,"Longitude":1.0},{"Latitude":null,"Longitude":2.0}]}}',
        F.when(key % 7 == 0, "x").otherwise(key.cast("string")), F.when(key % 3 == 0, F.format_string('" %d "', key)).otherwise("null"), fao, (60 + key / F.lit(10.0)).cast("string"))
    areas = feeds.route_areas(B.table(spark, sf_dir, "supplier").select(entry.alias("payload")))
    return areas.select("route_key", "fao_area", "centre_latitude", F.size("coordinates").alias("n_points"))


@query("src_11", """SELECT s_suppkey AS feature_id, s_name AS name, 'Bank' AS kind, (60e0 + s_suppkey % 10 + 61e0 + s_suppkey % 10) / 2 AS lat, 2e0 + s_suppkey % 5 AS lon FROM supplier""")
def src_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a paged map service; every page repeats the feature of the page before."""
    key = F.col("s_suppkey")
    feature = lambda k, name: F.format_string('{"attributes":{"OBJECTID":%d,"NAME":"%s","TYPE":"Bank"},"geometry":{"points":[[%s,%s],[%s,%s]]}}', k, name, (2.0 + k % 5).cast("string"), (60.0 + k % 10).cast("string"), (2.0 + k % 5).cast("string"), (61.0 + k % 10).cast("string"))
    page = F.concat(F.lit('{"features":['), feature(key, F.col("s_name")), F.lit(","), feature(F.greatest(key - 1, F.lit(0)), F.lit("again")), F.lit("]}"))
    pages = B.table(spark, sf_dir, "supplier").select(key.alias("page"), page.alias("payload"))
    return feeds.map_features(pages).filter("name <> 'again'")


@query("src_12", """SELECT s_suppkey AS page, 'Vessel ' || n AS vessel, 'CS' || n AS call_sign, i::INTEGER AS idx, round(60 + s_suppkey % 9 + 0.5e0 + i / 60e0, 6) AS from_lat, round(-(8 + n / 60e0), 6) AS from_lon FROM supplier, range(1, 3) AS v(n), range(1, 4) AS r(i)""")
def src_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of HTML tables, under the vessel row above them."""
    key = F.col("s_suppkey")
    net = lambda n, i: F.format_string("<tr><td>%d.</td><td>%d°%d,0000' N</td><td>008°%d,0000' W</td><td>A</td><td>61°1,0' N</td><td>7°2,0' W</td><td>B</td></tr>", F.lit(i), (60 + key % 9).cast("int"), F.lit(30 + i), F.lit(n))
    vessel = lambda n: F.concat(F.lit(f"<tr><th>Nets</th><td>Vessel {n}</td><td>CS{n}</td><td>19-06-2026 06:23</td></tr>"), *[net(n, i) for i in (1, 2, 3)], F.lit("<tr><td>note</td></tr>"))
    pages = B.table(spark, sf_dir, "supplier").select(key.alias("page"), F.concat(F.lit("<table>\n"), vessel(1), vessel(2), F.lit("</table>")).alias("html"))
    nets = feeds.gillnets(pages)
    return nets.select("page", "vessel", "call_sign", "idx", F.round("from_lat", 6).alias("from_lat"), F.round("from_lon", 6).alias("from_lon"))


@query("txt_05", """SELECT o_orderkey AS id, 'Area ' || n AS name, n::INTEGER AS paragraph, 2 AS n_points, round(50 + n + 0.5e0, 6) AS first_lat FROM orders, range(1, 3) AS t(n)""")
def txt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named areas of notices: points under headings, repeats left out, text before the consolidation mark ignored."""
    key = F.col("o_orderkey")
    area = lambda n: f"### Area {n}\n§ {n}. Forbod\n{50 + n}° 30' N 2° 0' E og {51 + n}° 0,0' N 3° 30' E\n{50 + n}°30' N 2°00' E\n"
    body = F.concat(F.lit("Gammalt 10° 0' N 1° 0' E\nForskriften lyder etter dette:\n"), F.lit(area(1)), F.lit(area(2)))
    notices = B.table(spark, sf_dir, "orders").select(key.alias("id"), body.alias("body"))
    found = A.named_areas(notices, "id")
    # The paragraph line under a heading begins a part of its own; its points belong to the heading's name.
    return found.select("id", "name", "paragraph", F.size("points").alias("n_points"), F.round(F.get("points", F.lit(0))["lat"], 6).alias("first_lat"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    point = lambda lat, lon: F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon"))
    square = [point(0, 0), point(0, 4), point(4, 4), point(4, 0)]
    ring = F.when(key % 4 == 0, F.array(*square, square[0])).when(key % 4 == 1, F.array(*square)).when(key % 4 == 2, F.array(*square, point(2, 9))).otherwise(F.array(square[0], square[2], square[1], square[3]))
    return B.table(spark, sf_dir, "supplier").select(key.alias("id"), ring.alias("ring"))


@query("geo_17", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 3 THEN 3 ELSE 4 END AS n_points, CASE s_suppkey % 4 WHEN 2 THEN 'typo-unclosed-ring-repaired' WHEN 3 THEN 'typo-unclosed-ring-repaired' END AS warning FROM supplier")
def geo_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed, open, mistyped and crossing rings."""
    fixed = _rings(spark, sf_dir).select("id", A.repaired_ring(F.col("ring")).alias("r"))
    return fixed.select("id", F.size("r.points").alias("n_points"), F.col("r.warning").alias("warning"))


@query("q_reading", "SELECT id, ring::INTEGER AS ring, CASE WHEN ring = 3 OR id % 4 = 0 AND ring = 2 THEN 'no-parser-counterpart' WHEN ring = 2 THEN 'not-a-closure' ELSE 'agreed' END AS outcome FROM (SELECT s_suppkey AS id FROM supplier), range(1, 4) AS t(ring)")
def q_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reading against the parser's rings; each parser ring answers one ring of the reading."""
    rings = _rings(spark, sf_dir)
    read = rings.select("id", "ring", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).select("id", F.col("n").alias("ring"), F.col("ring").alias("points"), F.when(F.col("n") == 2, "reference").otherwise("closure").alias("kind"))
    twice = F.when(F.col("id") % 4 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    parsed = rings.select("id", F.col("ring").alias("points"), F.explode(twice).alias("ring"))
    return A.compare_readings(read, parsed, "id")


_LINE = "[{'lat': 58e0 + o_orderkey * 13 % 900 / 100e0, 'lon': -12e0 + o_orderkey * 7 % 2000 / 100e0}, {'lat': 58e0 + o_orderkey * 17 % 900 / 100e0, 'lon': -12e0 + o_orderkey * 29 % 2000 / 100e0}]"


@query("geo_07", f"""WITH l AS (SELECT o_orderkey AS id, {_LINE} AS p FROM orders), d AS (SELECT id, p[1].lon AS x, p[1].lat AS y, p[2].lon - p[1].lon AS dx, p[2].lat - p[1].lat AS dy FROM l)
SELECT id, NOT ((dx = 0 AND (x < {BOX[0]} OR x > {BOX[2]})) OR (dy = 0 AND (y < {BOX[1]} OR y > {BOX[3]}))) AND
 greatest(0e0, CASE WHEN dx > 0 THEN ({BOX[0]}e0 - x) / dx WHEN dx < 0 THEN ({BOX[2]}e0 - x) / dx ELSE 0 END, CASE WHEN dy > 0 THEN ({BOX[1]}e0 - y) / dy WHEN dy < 0 THEN ({BOX[3]}e0 - y) / dy ELSE 0 END)
 <= least(1e0, CASE WHEN dx > 0 THEN ({BOX[2]}e0 - x) / dx WHEN dx < 0 THEN ({BOX[0]}e0 - x) / dx ELSE 1 END, CASE WHEN dy > 0 THEN ({BOX[3]}e0 - y) / dy WHEN dy < 0 THEN ({BOX[1]}e0 - y) / dy ELSE 1 END) AS meets FROM d""")
def geo_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that meet a box."""
    key = F.col("o_orderkey")
    point = lambda a, b: F.struct((58.0 + key * a % 900 / F.lit(100.0)).alias("lat"), (-12.0 + key * b % 2000 / F.lit(100.0)).alias("lon"))
    return B.table(spark, sf_dir, "orders").select(key.alias("id"), A.line_meets_box(F.array(point(13, 7), point(17, 29)), BOX).alias("meets"))


@query("win_08", "SELECT page_id, (length(html) - length(replace(html, '<p', '')))::BIGINT // 2 AS n FROM pages")
def win_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<p")).cast("long").alias("n"))


@query("win_10", """WITH o AS (SELECT o_orderkey AS id, 3 + o_orderkey * 7 % 200 AS n, 2 + o_orderkey % 40 AS most FROM orders),
t AS (SELECT id, CASE WHEN n <= most THEN range(0, n) ELSE [floor(i * ((n - 1)::DOUBLE / (most - 1)) + 0.5)::BIGINT FOR i IN range(0, most)] END AS k FROM o)
SELECT id, len(k)::INTEGER AS n, k[1]::INTEGER AS first, k[len(k)]::INTEGER AS last, list_sum(k)::BIGINT AS total FROM t""")
def win_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinning of lines to some vertices at even strides, both ends kept; short lines stay as they are."""
    k = F.col("o_orderkey")
    line = F.sequence(F.lit(0), (2 + k * 7 % 200).cast("int"))
    thin = B.table(spark, sf_dir, "orders").select(k.alias("id"), geo.thinned(line, (2 + k % 40).cast("int")).alias("t"))
    return thin.select("id", F.size("t").alias("n"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("prj_02", "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey + 0.5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE s_suppkey * 1e0 END AS number FROM supplier")
def prj_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from text: what is no finite number is null."""
    from tidewater.functions.numbers import number_or_null

    key = F.col("s_suppkey")
    text = F.when(key % 4 == 0, F.concat(key.cast("string"), F.lit(".5"))).when(key % 4 == 1, "NaN").when(key % 4 == 2, "n/a").otherwise(key.cast("string"))
    return B.table(spark, sf_dir, "supplier").select(key.alias("id"), number_or_null(text).alias("number"))


@query("txt_08", "WITH " + places.NOTICES_SQL + " SELECT doc_id, signs::INTEGER AS signs, pairs::INTEGER AS pairs FROM notice")
def txt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What looks like a coordinate in each text, and the pairs that are read."""
    return places.notices(spark, sf_dir).select("doc_id", "signs", "pairs")


@query("txt_16", "SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'current' END AS status, 'Body ' || s_suppkey AS body FROM supplier")
def txt_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter and body of a fragment."""
    key = F.col("s_suppkey")
    text = F.concat(F.lit("---\ntitle: "), F.col("s_name"), F.when(key % 2 == 0, "\nstatus: current").otherwise(""), F.lit("\n---\nBody "), key.cast("string"))
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    fields = F.str_to_map(F.regexp_extract(text, pattern, 1), F.lit("\n"), F.lit(": "))
    return B.table(spark, sf_dir, "supplier").select(key.alias("id"), fields["title"].alias("title"), F.try_element_at(fields, F.lit("status")).alias("status"), F.regexp_extract(text, pattern, 2).alias("body"))


@query("fn_13", "SELECT doc_id, greatest(1, ceil(octet_length(encode(text)) / 1000e0))::BIGINT AS parts, sha256(text) AS whole FROM documents")
def fn_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte parts with a hash each, put together and held against the hash of the whole."""
    raw = F.encode("text", "UTF-8")
    d = B.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), F.sha2(raw, 256).alias("whole"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / 1000).cast("int"))
    parts = d.select("doc_id", "whole", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("part"), F.substring("raw", i * 1000 + 1, F.lit(1000)).alias("data")))).alias("p"))
    hashed = parts.select("doc_id", "whole", "p.part", "p.data", F.sha2("p.data", 256).alias("part_hash"))
    good = hashed.filter(F.sha2("data", 256) == F.col("part_hash")).groupBy("doc_id", "whole").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("part", "data"))).alias("all"))
    joined = F.aggregate("all", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    return good.filter(F.sha2(joined, 256) == F.col("whole")).select("doc_id", "parts", "whole")



@query("txt_07", "SELECT s_suppkey AS id, chr((97 + s_suppkey % 3)::INTEGER) AS name, 3 AS n_points, CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 0 END AS orphans, s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AS drawable, round(61 + s_suppkey % 50 / 60e0, 6) AS first_lat FROM supplier")
def txt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of statutes, vertex by vertex; some have a latitude too many, some an item that merely looks like a vertex."""
    k = F.col("s_suppkey")
    item = lambda i, text: F.concat(F.lit(f"- **{i})** "), text, F.lit("\n"))
    first = F.format_string("61°%d' N 7°0' V", (k % 50).cast("int"))
    alone = F.when(k % 4 == 0, item("d", F.lit("63°0' N 64°0' N"))).otherwise("")
    unread = F.when(k % 5 == 0, item("e", F.lit("63°99' N 8°10' V"))).otherwise("")
    body = F.concat(F.lit("### § 1 Økini\n**Stk. 1.** Øki "), F.substring(F.lit("abc"), (k % 3 + 1).cast("int"), F.lit(1)), F.lit(" er friðað\n"), item("a", first), item("b", F.lit("62º0,5´ N 8°0' V;")), item("c", F.lit("62°30' N 6°59' V")), alone, unread, F.lit("### § 2 Annað\n"), item("a", F.lit("Skip við longri enn 15 m")))
    rings = A.statute_areas(B.table(spark, sf_dir, "supplier").select(k.alias("id"), body.alias("body")), "id")
    return rings.select("id", "name", F.size("points").alias("n_points"), "orphans", "drawable", F.round(F.get("points", F.lit(0))["lat"], 6).alias("first_lat"))


@query("geo_15", """SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'too many coordinates' WHEN 2 THEN 'coordinate out of range' WHEN 3 THEN 'ring is not closed' WHEN 4 THEN 'too few points' WHEN 5 THEN 'self-intersection' END AS problem,
  CASE WHEN s_suppkey % 4 = 1 THEN 'self-intersection' WHEN s_suppkey % 4 = 2 THEN 'hole outside shell' WHEN s_suppkey % 4 = 3 AND s_suppkey % 3 = 0 THEN 'nested holes' END AS of_holes FROM supplier""")
def geo_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of 5 to 12 corners with each of the problems in turn, and shells with two holes."""
    k = F.col("s_suppkey")
    n = (k % 8 + 5).cast("int")
    size = (k % 11 + 1) / F.lit(10.0)
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))

    def oval(count, r, lat=0.0, lon=0.0, turns=1):
        at = lambda i: F.radians(i * F.lit(360.0) * turns / count + k % 90)
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: point(F.lit(lat) + 60 + r * F.sin(at(i)), F.lit(lon) + r * F.cos(at(i))))

    closed = lambda r: F.concat(r, F.slice(r, 1, 1))
    # Twice around with an odd number of corners is a star, which crosses itself.
    star = oval(2 * (k % 4).cast("int") + 5, size, turns=2)
    far = F.transform(closed(oval(n, size)), lambda p: point(p["lat"] + 40, p["lon"]))
    ring = (
        F.when(k % 7 == 1, closed(oval(n + 20, size))).when(k % 7 == 2, far).when(k % 7 == 3, oval(n, size)).when(k % 7 == 4, closed(oval(F.lit(2), size))).when(k % 7 == 5, closed(star)).when(k % 7 == 6, closed(oval(n, size)))
    )
    nested = (k % 4 == 3) & (k % 3 == 0)
    second = F.when(k % 4 == 1, oval(n, size, lon=size * 2.7)).when(k % 4 == 2, oval(n, size / 10, lon=30.0)).when(nested, oval(n, size / 10)).otherwise(oval(n, size / 5, lon=size / 2))
    holes = F.array(oval(n, size * 3), F.when(nested, oval(n, size / 2)).otherwise(oval(n, size / 5, lat=-size / 2)), second)
    return B.table(spark, sf_dir, "supplier").select(k.alias("id"), A.ring_problems(ring, most=20).alias("problem"), sweep.polygon_problem(holes).alias("of_holes"))


_FLAT = "(1 / 298.257223563e0)"
#: The inverse problem on the ellipsoid: thirty rounds of the longitude on the auxiliary sphere, then the length of the arc.
_SIN_S = "sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2))"
_ARC = f"""SELECT *, {_FLAT} / 16 * cos2 * (4 + {_FLAT} * (4 - 3 * cos2)) AS c, CASE WHEN cos2 = 0 THEN 0 ELSE cos_s - 2 * sin(u1) * sin(u2) / cos2 END AS mid
  FROM (SELECT *, 1 - sin_a * sin_a AS cos2 FROM (SELECT *, atan2(sin_s, cos_s) AS s, CASE WHEN sin_s = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / sin_s END AS sin_a
  FROM (SELECT *, {_SIN_S} AS sin_s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cos_s FROM it)))"""


@query("geo_08", f"""WITH RECURSIVE {B.FEATURES_SQL},
it AS (SELECT feature_id, atan((1 - {_FLAT}) * tan(radians(60e0))) AS u1, atan((1 - {_FLAT}) * tan(radians(lat))) AS u2, radians(lon - 1e0) AS apart, radians(lon - 1e0) AS lam, 0 AS k FROM feature
  UNION ALL SELECT feature_id, u1, u2, apart, apart + (1 - c) * {_FLAT} * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1))), k + 1 FROM ({_ARC}) WHERE k < 30),
arc AS (SELECT feature_id, sin_s, cos_s, s, mid, cos2 * (pow(6378137e0, 2) - pow(6378137e0 * (1 - {_FLAT}), 2)) / pow(6378137e0 * (1 - {_FLAT}), 2) AS q FROM ({_ARC}) WHERE k = 30),
ab AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS a, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS b FROM arc),
km AS (SELECT feature_id, 6378137e0 * (1 - {_FLAT}) * a * (s - b * sin_s * (mid + b / 4 * (cos_s * (2 * mid * mid - 1) - b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))) / 1000 AS km FROM ab)
SELECT feature_id, round(km, 3) AS km FROM km WHERE km <= 300""")
def geo_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features within 300 km on the ellipsoid; unit tests hold the distance against published ones, too."""
    near = B.features(spark, sf_dir).withColumn("km", A.geodesic_km(F.lit(60.0), F.lit(1.0), F.col("lat"), F.col("lon")))
    return near.filter("km <= 300").select("feature_id", F.round("km", 3).alias("km"))


@query("wf_09", "SELECT doc_id, CASE WHEN length(text) < 40 THEN 'quote' WHEN doc_id % 5 = 0 THEN 'foreign reference' WHEN doc_id % 7 = 0 THEN 'repeated id' END AS violation FROM documents")
def wf_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape state against its text: quotes are the text at their span, ids do not repeat, references stay inside."""
    d = F.col("doc_id")
    state = B.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.struct(F.lit(11).alias("start"), F.lit(30).alias("n"), F.substring("text", 11, 30).alias("quote")).alias("span"),
        F.when(d % 7 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("ids"), F.when(d % 5 == 0, F.array(F.lit(9))).otherwise(F.array(F.lit(1))).alias("refers"),
    )
    quoted = (F.length("span.quote") == F.col("span.n")) & (F.substring(F.col("text"), F.col("span.start"), F.col("span.n")) == F.col("span.quote"))
    violation = F.when(~quoted, "quote").when(F.size(F.array_except("refers", "ids")) > 0, "foreign reference").when(F.size(F.array_distinct("ids")) != F.size("ids"), "repeated id")
    return state.select("doc_id", violation.alias("violation"))


@query("wf_12", "SELECT o_custkey AS case_id, count(*) AS n, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS manifest FROM orders GROUP BY 1")
def wf_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of all parts of a snapshot, in the order of their ids."""
    o = B.table(spark, sf_dir, "orders")
    parts = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["o_orderkey"].cast("string"), F.lit(":"), p["o_orderstatus"])), ",")
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("n"), parts.alias("parts")).select("case_id", "n", F.sha2(text, 256).alias("manifest"))


@query("wf_13", "WITH RECURSIVE c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey - 1 END AS before FROM supplier), w(id, link, depth) AS (SELECT id, before, 0 FROM c UNION ALL SELECT w.id, c.before, w.depth + 1 FROM w JOIN c ON c.id = w.link) SELECT id, max(depth)::BIGINT AS depth FROM w GROUP BY id")
def wf_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many predecessors a command has, by doubling: each step joins every command's pointer with that of the one it points at."""
    k = F.col("s_suppkey")
    chain = B.table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 10 != 0, k - 1).alias("at"))
    known = chain.select("id")
    # A pointer to a command that is not there ends the chain; a cycle ends with the doublings.
    chain = chain.join(known.withColumnRenamed("id", "at").withColumn("there", F.lit(True)), "at", "left").select("id", F.when(F.col("there"), F.col("at")).alias("at"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    for _ in range(5):
        ahead = chain.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"))
        chain = chain.join(ahead, "at", "left").select("id", F.col("further").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return chain.select("id", "depth")


@query("wf_11", "SELECT coalesce(a.p_partkey, b.p_partkey) AS id, CASE WHEN a.p_partkey IS NULL THEN 'unnumbered' WHEN b.p_partkey IS NULL THEN 'no polygon' WHEN a.p_size % 2 = 0 THEN 'bound' ELSE 'other source' END AS state FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) b USING (p_partkey)")
def wf_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official polygons bound to the paragraphs of a text: only where both are there and the source is the stated one."""
    p = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    paragraphs = p.filter("id % 3 <> 0").select("id", F.when(F.col("p_size") % 2 == 0, "s").otherwise("t").alias("source"))
    polygons = p.filter("id % 5 <> 0").select("id", F.lit("s").alias("polygon_source"))
    state = F.when(F.col("source").isNull(), "unnumbered").when(F.col("polygon_source").isNull(), "no polygon").when(F.col("source") == F.col("polygon_source"), "bound").otherwise("other source")
    return paragraphs.join(polygons, "id", "full").select("id", state.alias("state"))
