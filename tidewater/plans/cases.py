"""Case workflow and write-semantics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import cases as K
from tidewater.operators import sinks as S
from tidewater.plans.base import query
from tidewater.sources import bridge as B
from tidewater.streaming.assemble import assemble

_C = "WITH " + B.CASES_SQL
_R = _C + ",\n" + B.REVISIONS_SQL + ",\n" + B.VALIDATIONS_SQL
_RANK = "CASE urgency WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_FLAGS = """, lv AS (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY command_sequence DESC NULLS LAST, recorded_at DESC, receipt DESC, area DESC, passed) AS t FROM validation WHERE kind = 'legal'),
gv AS (SELECT *, row_number() OVER (PARTITION BY revision_id, area ORDER BY command_sequence DESC NULLS LAST, recorded_at DESC, receipt DESC, area DESC, passed) AS t FROM validation WHERE kind = 'geometry'),
np AS (SELECT gv.revision_id, count(*) FILTER (passed) AS n FROM gv JOIN revision USING (revision_id) WHERE t = 1 AND area < n_areas GROUP BY 1),
flags AS (SELECT r.case_id, r.revision_id, coalesce(lv.passed, false) AS legal, r.n_areas > 0 AND coalesce(np.n, 0) = r.n_areas AS geometry, r.n_areas FROM revision r LEFT JOIN lv ON lv.revision_id = r.revision_id AND lv.t = 1 LEFT JOIN np ON np.revision_id = r.revision_id)"""


@query("q_queue", _C + f" SELECT case_id, urgency, updated_day FROM cases WHERE admin_status IN ('unread', 'under_review') AND (snoozed_until IS NULL OR snoozed_until <= 20) ORDER BY {_RANK}, updated_day DESC, case_id OFFSET 20 LIMIT 50")
def q_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.queue(B.cases(spark, sf_dir), ["unread", "under_review"], 20, 20, 50).select("case_id", "urgency", "updated_day")


@query("q_counts", _C + " SELECT admin_status, count(*) AS n, count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (assignee IS NULL) AS unassigned FROM cases GROUP BY 1")
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cases(spark, sf_dir).groupBy("admin_status").agg(F.count("*").alias("n"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if(F.col("assignee").isNull()).alias("unassigned"))


@query("agg_13", _C + " SELECT region, count(*) FILTER (admin_status = 'unread') AS unread, count(*) FILTER (admin_status = 'approved') AS approved, count(*) AS total FROM cases GROUP BY region")
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = B.cases(spark, sf_dir).groupBy("region").pivot("admin_status", ["unread", "approved"]).agg(F.count(F.lit(1))).fillna(0)
    total = B.cases(spark, sf_dir).groupBy("region").agg(F.count("*").alias("total"))
    return wide.join(total, "region")


@query("agg_14", _C + " SELECT region, count(*) FILTER (is_read) AS n_read, round(avg(updated_day) FILTER (is_read), 4) AS mean_day FROM cases GROUP BY region")
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cases(spark, sf_dir).groupBy("region").agg(F.count_if("is_read").alias("n_read"), F.round(F.avg(F.when(F.col("is_read"), F.col("updated_day"))), 4).alias("mean_day"))


@query("agg_15", _C + " SELECT count(*) AS total FROM cases WHERE admin_status = 'unread'")
def agg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cases(spark, sf_dir).filter("admin_status = 'unread'").agg(F.count("*").alias("total"))


@query("agg_16", _R + " SELECT case_id, coalesce(max(s), 0) + 1 AS next FROM (SELECT case_id, revision_id % 50 AS s FROM revision UNION ALL SELECT case_id, snoozed_until FROM cases) GROUP BY case_id")
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next sequence over two logs."""
    both = B.revisions(spark, sf_dir).select("case_id", (F.col("revision_id") % 50).alias("s")).unionByName(B.cases(spark, sf_dir).select("case_id", F.col("snoozed_until").alias("s")))
    return both.groupBy("case_id").agg((F.coalesce(F.max("s"), F.lit(0)) + 1).alias("next"))


@query("q_caseproj", _R + """, p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY recorded_at, revision_id) - 1 AS position, count(*) OVER (PARTITION BY case_id) AS n FROM revision)
SELECT case_id, revision_id, position, position = 0 AS is_first, position = n - 1 AS is_current FROM p""")
def q_caseproj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.positions(B.revisions(spark, sf_dir)).select("case_id", "revision_id", F.col("position").cast("long").alias("position"), "is_first", "is_current")


def _validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose order has no ties: equal ones fall to the one that failed."""
    v = B.validations(spark, sf_dir)
    return v.groupBy(*[c for c in v.columns if c != "passed"]).agg(F.min("passed").alias("passed"))


@query("wf_04", _R + _FLAGS + " SELECT * FROM flags")
def wf_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.review_flags(B.revisions(spark, sf_dir), _validations(spark, sf_dir))


@query("wf_03", _R + _FLAGS + " SELECT revision_id, CASE WHEN legal AND NOT geometry AND n_areas > 0 THEN 'awaiting_geometry_validation' WHEN NOT legal AND geometry THEN 'awaiting_regulatory_validation' ELSE 'under_review' END AS lane FROM flags")
def wf_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.review_flags(B.revisions(spark, sf_dir), _validations(spark, sf_dir)).select("revision_id", K.lane(F.lit("under_review")).alias("lane"))


_CUR = ", cur AS (SELECT case_id, arg_max(revision_id, (recorded_at, revision_id)) AS current_revision FROM revision GROUP BY 1)"
_OUT = "CASE WHEN c.current_revision IS DISTINCT FROM f.revision_id THEN 'stale revision' WHEN NOT f.legal THEN 'legal validation missing' WHEN NOT (f.revision_id % 4 = 0) AND NOT f.geometry THEN 'geometry validation missing' END"


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = B.revisions(spark, sf_dir)
    current = revisions.groupBy("case_id").agg(F.max(F.struct("recorded_at", "revision_id"))["revision_id"].alias("current_revision"))
    flags = K.review_flags(revisions, _validations(spark, sf_dir)).join(current, "case_id")
    reason = K.approval_outcome(F.col("current_revision"), F.col("revision_id"), F.col("revision_id") % 4 == 0)
    return flags.select("case_id", "revision_id", reason.alias("reason"))


@query("wf_05", _R + _FLAGS + _CUR + f" SELECT f.case_id, f.revision_id, {_OUT} AS reason FROM flags f JOIN cur c USING (case_id)")
def wf_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approvals(spark, sf_dir)


@query("q_published", _R + _FLAGS + f""", ap AS (SELECT f.case_id, f.revision_id, f.legal AND (f.geometry OR f.revision_id % 4 = 0) AS applied FROM flags f),
pin AS (SELECT case_id, max(revision_id) AS revision_id FROM ap WHERE applied GROUP BY 1)
SELECT case_id, revision_id, title, region, content, recorded_at FROM cases JOIN pin USING (case_id) JOIN revision USING (case_id, revision_id)""")
def q_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = B.revisions(spark, sf_dir)
    flags = K.review_flags(revisions, _validations(spark, sf_dir))
    approvals = flags.select("case_id", "revision_id", (F.col("legal") & (F.col("geometry") | (F.col("revision_id") % 4 == 0))).alias("applied"), F.col("revision_id").alias("sequence"))
    return K.published(B.cases(spark, sf_dir), approvals, revisions)


@query("q_withdrawn", _C + " SELECT case_id, title FROM cases WHERE admin_status = 'approved' AND case_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 30 = 0)")
def q_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = B.cases(spark, sf_dir).filter("admin_status = 'approved'")
    return approved.join(B.revisions(spark, sf_dir).filter("revision_id % 30 = 0"), "case_id", "left_anti").select("case_id", "title")


@query("wf_06", _R + " SELECT r.revision_id, count(*) AS counted FROM revision r JOIN validation v USING (revision_id) WHERE v.command_sequence < r.revision_id % 80 GROUP BY 1")
def wf_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that precede the approval's own sequence."""
    joined = B.revisions(spark, sf_dir).join(B.validations(spark, sf_dir).select("revision_id", "command_sequence"), "revision_id")
    return joined.filter(F.col("command_sequence") < F.col("revision_id") % 80).groupBy("revision_id").agg(F.count("*").alias("counted"))


@query("q_candidates", _R + f" SELECT c.case_id, count(r.revision_id) AS n FROM cases c LEFT JOIN revision r ON r.case_id = c.case_id AND r.status = 'O' WHERE c.admin_status = 'under_review' GROUP BY c.case_id, c.urgency, c.updated_day ORDER BY {_RANK}, c.updated_day DESC, c.case_id LIMIT 100")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ones = B.revisions(spark, sf_dir).filter("status = 'O'").groupBy("case_id").agg(F.count("*").alias("k"))
    found = B.cases(spark, sf_dir).filter("admin_status = 'under_review'").join(open_ones, "case_id", "left")
    return found.orderBy(K.urgency_rank(), F.desc("updated_day"), "case_id").limit(100).select("case_id", F.coalesce("k", F.lit(0)).alias("n"))


@query("q_case", _R + """ SELECT c.case_id, coalesce(r.revisions, '') AS revisions, coalesce(r.n, 0) AS n FROM cases c LEFT JOIN (SELECT case_id, string_agg(revision_id::VARCHAR, ',' ORDER BY recorded_at, revision_id) AS revisions, count(*) AS n FROM revision GROUP BY 1) r USING (case_id)""")
def q_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case detail with its ordered child list."""
    lists = B.revisions(spark, sf_dir).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("recorded_at", "revision_id"))).alias("r"), F.count("*").alias("k"))
    joined = B.cases(spark, sf_dir).join(lists, "case_id", "left")
    ids = F.array_join(F.transform("r", lambda x: x["revision_id"].cast("string")), ",")
    return joined.select("case_id", F.coalesce(ids, F.lit("")).alias("revisions"), F.coalesce("k", F.lit(0)).alias("n"))


_ACT = """, act AS (SELECT o_custkey AS case_id, o_orderkey % 9973 AS action_id, o_orderkey AS seq, (ARRAY['mark_read', 'assign', 'set_urgency', 'reject', 'mark_duplicate', 'note'])[o_orderkey % 6 + 1] AS kind, o_orderpriority AS value FROM orders),
once AS (SELECT case_id, action_id, min(seq) AS seq, arg_min(kind, seq) AS kind, arg_min(value, seq) AS value FROM act GROUP BY 1, 2),
f AS (SELECT case_id, bool_or(kind = 'mark_read') AS read, arg_max(value, CASE WHEN kind = 'assign' THEN seq END) AS assignee, arg_max(value, CASE WHEN kind = 'set_urgency' THEN seq END) AS urgency, arg_max(kind, CASE WHEN kind IN ('reject', 'mark_duplicate') THEN seq END) AS closed FROM once GROUP BY 1)"""


@query("wf_01", _C + _ACT + " SELECT case_id, read, assignee, urgency, CASE WHEN closed = 'reject' THEN 'rejected' WHEN closed = 'mark_duplicate' THEN 'duplicate' WHEN read THEN 'under_review' ELSE 'unread' END AS status FROM f")
def wf_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("mark_read", "assign", "set_urgency", "reject", "mark_duplicate", "note")]), (key % 6 + 1).cast("int"))
    return K.fold_actions(o.select(F.col("o_custkey").alias("case_id"), (key % 9973).alias("action_id"), key.alias("seq"), kind.alias("kind"), F.col("o_orderpriority").alias("value")))


_CMD = """, cmd AS (SELECT case_id, revision_id AS command_id, row_number() OVER w + count(*) FILTER (revision_id % 61 = 0) OVER (PARTITION BY case_id ORDER BY recorded_at, revision_id ROWS UNBOUNDED PRECEDING) AS sequence,
  CASE WHEN revision_id % 29 = 0 THEN 0 ELSE lag(revision_id) OVER w END AS predecessor, revision_id % 7 = 0 AS refuse FROM revision WINDOW w AS (PARTITION BY case_id ORDER BY recorded_at, revision_id))"""


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command logs of cases; some name a wrong predecessor, and some leave a sequence out."""
    w = Window.partitionBy("case_id").orderBy("recorded_at", "revision_id")
    key = F.col("revision_id")
    left_out = F.count_if(key % 61 == 0).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return B.revisions(spark, sf_dir).select("case_id", key.alias("command_id"), (F.row_number().over(w) + left_out).cast("long").alias("sequence"), F.when(key % 29 == 0, 0).otherwise(F.lag(key).over(w)).alias("predecessor"), (key % 7 == 0).alias("refuse"))


@query("win_09", _R + _CMD + " SELECT case_id, command_id, sequence FROM (SELECT *, lag(command_id) OVER (PARTITION BY case_id ORDER BY sequence) AS before, row_number() OVER (PARTITION BY case_id ORDER BY sequence) AS place FROM cmd) WHERE predecessor IS DISTINCT FROM before OR sequence <> place")
def win_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chain_breaks(_commands(spark, sf_dir)).select("case_id", "command_id", "sequence")


@query("str_08", _R + _CMD + """, b AS (SELECT *, lag(command_id) OVER w AS before, row_number() OVER w AS place FROM cmd WINDOW w AS (PARTITION BY case_id ORDER BY sequence, command_id)),
c AS (SELECT *, bool_or(sequence <> place OR predecessor IS DISTINCT FROM before) OVER (PARTITION BY case_id ORDER BY sequence, command_id ROWS UNBOUNDED PRECEDING) AS blocked FROM b)
SELECT case_id, sequence, command_id, CASE WHEN blocked THEN 'pending' WHEN refuse THEN 'refused' ELSE 'applied' END AS outcome, CASE WHEN NOT blocked THEN (place - 1) // 32 + 1 END AS drain FROM c""")
def str_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.apply_in_order(_commands(spark, sf_dir))


@query("wf_07", _R + """, sh AS (SELECT revision_id, a AS shape_id, sha256(revision_id || ':' || a || CASE WHEN revision_id % 5 = 0 THEN 'x' ELSE '' END) AS shape_hash FROM revision, range(0, 3) AS t(a) WHERE a < n_areas),
dec AS (SELECT revision_id, area AS shape_id, command_sequence, receipt, bool_and(passed) AS passed, sha256(revision_id || ':' || area) AS seen FROM validation GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY revision_id, shape_id ORDER BY coalesce(command_sequence, -1) DESC, receipt DESC) AS t FROM dec)
SELECT sh.revision_id, sh.shape_id, coalesce(l.passed AND l.seen = sh.shape_hash, false) AS validated FROM sh LEFT JOIN l ON l.revision_id = sh.revision_id AND l.shape_id = sh.shape_id AND l.t = 1""")
def wf_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("revision_id").cast("string")
    shapes = B.revisions(spark, sf_dir).filter("n_areas > 0").select("revision_id", F.explode(F.sequence(F.lit(0), (F.col("n_areas") - 1).cast("int"))).alias("shape_id"))
    shapes = shapes.withColumn("shape_hash", F.sha2(F.concat(key, F.lit(":"), F.col("shape_id").cast("string"), F.when(F.col("revision_id") % 5 == 0, "x").otherwise("")), 256))
    seen = F.sha2(F.concat(key, F.lit(":"), F.col("area").cast("string")), 256)
    decisions = B.validations(spark, sf_dir).groupBy("revision_id", F.col("area").alias("shape_id"), "command_sequence", "receipt", seen.alias("shape_hash")).agg(F.min("passed").alias("passed"))
    return K.shape_review(decisions, shapes)


@query("wf_20", "WITH g AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN ' Group ' ELSE 'group ' END || (s_suppkey % 11) AS name, s_suppkey % 3 AS region, s_suppkey % 5 <> 0 AS active FROM supplier) SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY region, lower(trim(name))) AS n FROM g WHERE active) WHERE n > 1")
def wf_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    groups = B.table(spark, sf_dir, "supplier").select(key.alias("id"), F.concat(F.when(key % 2 == 0, " Group ").otherwise("group "), (key % 11).cast("string")).alias("name"), (key % 3).alias("region"), (key % 5 != 0).alias("active"))
    return K.name_conflicts(groups).select("id")


@query("wf_19", "SELECT lower('J-' || s_suppkey) AS ref FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE lower('j-' || c_custkey) = lower('J-' || s_suppkey) AND c_custkey % 3 = 0)")
def wf_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register entries without a case, whatever the case of their keys."""
    register = B.table(spark, sf_dir, "supplier").select(F.lower(F.concat(F.lit("J-"), F.col("s_suppkey").cast("string"))).alias("ref"))
    known = B.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.lower(F.concat(F.lit("j-"), F.col("c_custkey").cast("string"))).alias("ref"))
    return register.join(known, "ref", "left_anti")


@query("jn_08", _R + " SELECT c.case_id, (EXISTS (SELECT 1 FROM revision r WHERE r.case_id = c.case_id AND r.status = 'O')) OR c.is_read AS fenced FROM cases c")
def jn_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = B.revisions(spark, sf_dir).groupBy("case_id").agg(F.bool_or(F.col("status") == "O").alias("has_open"))
    return B.cases(spark, sf_dir).join(some, "case_id", "left").select("case_id", (F.coalesce("has_open", F.lit(False)) | F.col("is_read")).alias("fenced"))


@query("jn_07", _R + " SELECT c.case_id FROM cases c WHERE NOT EXISTS (SELECT 1 FROM revision r LEFT JOIN validation v ON v.revision_id = r.revision_id AND v.passed WHERE r.case_id = c.case_id AND ((r.status = 'O' AND r.revision_id % 9 = 0) OR (v.revision_id IS NOT NULL AND r.revision_id % 9 = 1 AND EXISTS (SELECT 1 FROM validation x WHERE x.revision_id = r.revision_id AND x.area = 2))))")
def jn_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_revision = B.validations(spark, sf_dir).groupBy("revision_id").agg(F.bool_or("passed").alias("any_passed"), F.bool_or(F.col("area") == 2).alias("has_third"))
    blocking = B.revisions(spark, sf_dir).join(per_revision, "revision_id", "left").filter(((F.col("status") == "O") & (F.col("revision_id") % 9 == 0)) | ((F.col("revision_id") % 9 == 1) & F.coalesce("any_passed", F.lit(False)) & F.coalesce("has_third", F.lit(False))))
    return B.cases(spark, sf_dir).join(blocking, "case_id", "left_anti").select("case_id")


@query("jn_21", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0")
def jn_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose hash is not the stored one, or that are not stored."""
    o = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    stored = o.filter(key % 13 != 0).select(key.alias("id"), F.sha2(F.concat(key.cast("string"), F.when(key % 17 == 0, "old").otherwise("")), 256).alias("old"))
    new = o.select(key.alias("id"), F.sha2(key.cast("string"), 256).alias("hash"))
    return new.join(stored, "id", "left").filter(~F.col("hash").eqNullSafe(F.col("old"))).select("id")


@query("snk_03", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 <> 0")
def snk_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return S.upsert(c.filter("id % 3 <> 0").withColumn("origin", F.lit("old")), c.filter("id % 4 = 0").withColumn("origin", F.lit("new")), ["id"])


@query("snk_04", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'old' ELSE 'new' END AS origin FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 <> 0")
def snk_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return S.insert_absent(c.filter("id % 3 <> 0").withColumn("origin", F.lit("old")), c.filter("id % 4 = 0").withColumn("origin", F.lit("new")), ["id"])


@query("snk_05", "SELECT o_custkey AS id, sum(o_orderkey % 7)::BIGINT AS emitted FROM orders GROUP BY 1")
def snk_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive upsert: stored count plus deltas."""
    o = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 7).alias("delta"), "o_orderkey")
    stored = o.filter("o_orderkey % 2 = 0").groupBy("id").agg(F.sum("delta").alias("delta"))
    return stored.unionByName(o.filter("o_orderkey % 2 = 1").select("id", "delta")).groupBy("id").agg(F.sum("delta").alias("emitted"))


@query("snk_07", "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'inserted' WHEN p_partkey % 10 = 1 THEN 'removed' WHEN p_partkey % 10 = 2 THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM part GROUP BY 1")
def snk_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    hashed = lambda text: p.select(key.alias("id"), F.sha2(text, 256).alias("hash"), (key % 10).alias("d"))
    new = hashed(F.col("p_name")).filter("d <> 1")
    stored = hashed(F.concat("p_name", F.when(key % 10 == 2, " old").otherwise(""))).filter("d <> 0")
    return S.full_diff(new, stored, "id").groupBy("change").agg(F.count("*").alias("n"))


@query("snk_09", "SELECT o_custkey AS id, greatest(max(o_orderkey), o_custkey * 5) AS checked FROM orders GROUP BY o_custkey")
def snk_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check time never moves back."""
    return B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.greatest(F.max("o_orderkey"), F.col("o_custkey") * 5).alias("checked"))


@query("snk_11", "SELECT case_id, run_id FROM (SELECT o_custkey AS case_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS t FROM orders) WHERE t <= 3")
def snk_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), "o_orderdate")
    return S.keep_newest(runs, ["case_id"], 3, "o_orderdate", "run_id").select("case_id", "run_id")


@query("snk_12", "SELECT id FROM (SELECT p_partkey AS id, sum(p_size * 100) OVER (PARTITION BY p_brand ORDER BY p_partkey % 97 DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS s FROM part) WHERE s <= 20000")
def snk_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows that fit the byte budget, most recently hit first."""
    rows = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 100).alias("bytes"), F.col("p_brand").alias("tenant"), (F.col("p_partkey") % 97).alias("hit"))
    return S.within_budget(rows, "tenant", "bytes", 20_000, "hit", "id").select("id")


@query("snk_14", "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey < 9000 AND (ARRAY['NO', 'FO', 'NO'])[o_orderkey % 3 + 1] <> 'NO')")
def snk_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old chunks go, except those of one region (the default where none is stated)."""
    key = F.col("o_orderkey")
    rows = B.table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 3 == 0, "NO").when(key % 3 == 1, "FO").alias("region"))
    return rows.filter(~((F.col("id") < 9000) & (F.coalesce("region", F.lit("NO")) != "NO"))).select("id")


@query("set_02", "SELECT o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def set_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"))
    return a.union(B.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select("c_custkey")).distinct()


@query("set_04", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0")
def set_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an inventory lists and a fetch did not return."""
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(B.table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("id")), "id", "left_anti")


_PARTS = """part AS (
  SELECT conv_id AS signature, turn AS part, max(turn) OVER w - min(turn) OVER w + 1 AS total, text AS body, turn = max(turn) OVER w AND conv_id % 3 = 0 OR turn = min(turn) OVER w AND conv_id % 7 = 0 AS cut
  FROM conversations WINDOW w AS (PARTITION BY conv_id))"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in parts with their stated total; of some the last part is missing, of some the first."""
    w = Window.partitionBy("conv_id")
    c = B.table(spark, sf_dir, "conversations").withColumns({"last": F.max("turn").over(w), "start": F.min("turn").over(w)})
    cut = ((F.col("turn") == F.col("last")) & (F.col("conv_id") % 3 == 0)) | ((F.col("turn") == F.col("start")) & (F.col("conv_id") % 7 == 0))
    return c.filter(~cut).select(F.col("conv_id").alias("signature"), F.col("turn").alias("part"), (F.col("last") - F.col("start") + 1).alias("total"), F.col("text").alias("body"))


@query("str_06", "WITH " + _PARTS + " SELECT signature AS conv_id, count(*) AS parts, sha256(string_agg(body, '' ORDER BY part)) AS hash FROM (SELECT signature, part, max(total) AS total, min(body) AS body FROM part WHERE NOT cut GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = max(total)")
def str_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages put together from their parts, those of which as many parts are there as they state."""
    whole = assemble(_parts(spark, sf_dir))
    return whole.select(F.col("signature").alias("conv_id"), "parts", F.sha2("body", 256).alias("hash"))


@query("q_ledger", "WITH b AS (SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS bucket, count(*) AS emitted, count(*) FILTER (event_id % 10 <> 0) AS projected FROM events GROUP BY 1) SELECT CASE WHEN projected = emitted THEN 'done' WHEN projected = 0 THEN 'pending' ELSE 'partial' END AS state, count(*) AS buckets, sum(emitted)::BIGINT AS emitted, sum(projected)::BIGINT AS projected FROM b GROUP BY 1")
def q_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the backfill ledger by state."""
    e = B.table(spark, sf_dir, "events")
    buckets = e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("bucket")).agg(F.count("*").alias("emitted"), F.count_if(F.col("event_id") % 10 != 0).alias("projected"))
    state = F.when(F.col("projected") == F.col("emitted"), "done").when(F.col("projected") == 0, "pending").otherwise("partial")
    return buckets.groupBy(state.alias("state")).agg(F.count("*").alias("buckets"), F.sum("emitted").alias("emitted"), F.sum("projected").alias("projected"))
