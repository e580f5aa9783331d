"""Queries over the training-data operators, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, exact_dedup, language, line_dedup, mixing, negatives, packing, quality, simhash_dedup, token_output, url_filter, warc, whitening
from tidewater.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs.withColumn("n_lines", F.size(F.split("text", "\n"))))
    return found.withColumn("n_lines_left", F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.labelled_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_output.encode_and_read(spark, _table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = exact_dedup.new_index(spark, docs.count())
    found = exact_dedup.exact_duplicates(docs, index)
    index.close()
    return found


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.pages_to_warc(spark, _table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    found = mixed.select("doc_id", "key", "size", "source_size", "target", "taken", F.size("positions").alias("copies"), F.round(F.get("positions", F.lit(0)), 9).alias("first_position"))
    return found.orderBy(F.asc_nulls_last("first_position"), "key").drop("key")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", relabelled))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_url_filter, op3_token_output, op4_simhash_near_dedup, op5_quality_classifier, op6_language_id, op7_exact_dedup, op8_best_fit_packing, op9_decontamination, op10_warc, op11_embedding_whitening, op12_source_mixing, op13_hard_negatives)
}


def _url_sql(training: url_filter.Training = url_filter.Training()) -> str:
    """Rules, training and scoring of op2 in DuckDB; the rounds of training are a recursive query."""
    d, k = training.buckets, training.gram
    rows = ", ".join(f"('{host}', '{path}', {label})" for host, path, label in url_filter.labelled_rows())
    grams = lambda s: f"list_distinct([({' + '.join(f'ascii(substr({s}, i + {j}, 1)) * {31 ** (k - 1 - j)}' for j in range(k))}) % {d} FOR i IN range(1, length({s}) - {k - 2})])"
    rules = ", ".join(f"('{v}', '{t}')" for v, t in url_filter.RULES)
    return f"""
WITH RECURSIVE
labelled(host, path, y) AS (VALUES {rows}),
x AS (SELECT row_number() OVER () AS id, y::DOUBLE AS y, '^' || host || '|' || path || '$' AS s FROM labelled),
feature AS (SELECT id, unnest({grams('s')}) AS b FROM x UNION ALL SELECT id, {d} FROM x),
gd(round, w) AS (
  SELECT 0, [0.0::DOUBLE FOR i IN range(0, {d + 1})]
  UNION ALL
  SELECT g.round + 1, [g.w[i + 1] - {training.rate}::DOUBLE * coalesce(m.step[i], 0) FOR i IN range(0, {d + 1})]
  FROM gd g, (
    SELECT map(list(b), list(g)) AS step FROM (
      SELECT f.b, sum(e.err) / (SELECT count(*) FROM x) AS g
      FROM feature f JOIN (
        SELECT x.id, 1 / (1 + exp(-sum(gd.w[feature.b + 1]))) - any_value(x.y) AS err
        FROM x JOIN feature USING (id), gd GROUP BY x.id) e USING (id)
      GROUP BY f.b)) m
  WHERE g.round < {training.rounds}),
model AS (SELECT w FROM gd WHERE round = {training.rounds}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rule(verdict, text) AS (VALUES {rules}),
fit AS (
  SELECT s.page_id, arg_max(rule.text, length(rule.text)) AS rule, arg_max(rule.verdict, length(rule.text)) AS verdict
  FROM split s JOIN rule ON (s.host = split_part(rule.text, '/', 1) OR ends_with(s.host, '.' || split_part(rule.text, '/', 1))) AND starts_with(s.path, substr(rule.text, instr(rule.text, '/')))
  GROUP BY s.page_id),
scored AS (
  SELECT page_id, host, path, w[{d + 1}] + coalesce(list_sum([w[b + 1] FOR b IN {grams("('^' || host || '|' || path || '$')")}]), 0) AS total FROM split, model)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN s.total >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM scored s LEFT JOIN fit f USING (page_id)"""


_EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""

_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

#: Limits fall in line by their size for their weight: the first source whose share at the level of those before it stays within its limit sets the level.
_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT AS turn, sum(source_size) OVER ()::BIGINT AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(source_size * 3.0::DOUBLE) OVER (lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(turn + 1.0::DOUBLE) OVER (lv ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW lv AS (ORDER BY source_size * 3.0::DOUBLE / (turn + 1), source IS NULL, source)),
o AS (SELECT *, first_value(CASE WHEN level * (turn + 1) <= source_size * 3 THEN level END IGNORE NULLS) OVER (ORDER BY source_size * 3.0::DOUBLE / (turn + 1), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS settled FROM l),
t AS (SELECT source, source_size, turn, CASE WHEN settled IS NULL THEN source_size * 3.0::DOUBLE ELSE settled * (turn + 1) END AS target FROM o),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.turn, t.target, floor(t.target)::BIGINT AS words,
    (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS turns FROM p),
r AS (SELECT *, greatest(0, least(size, words - turns * source_size - start)) AS part FROM q),
f AS (SELECT *, CASE WHEN size > 0 THEN turns + (part > 0)::INT ELSE 0 END AS copies, (start + (CASE WHEN turns > 0 THEN size ELSE part END) / 2.0::DOUBLE) / nullif(words, 0) AS share FROM r)
SELECT doc_id, size, source_size, target, (turns * size + part)::BIGINT AS taken, copies::INT AS copies,
  CASE WHEN copies > 0 THEN round(CASE turn WHEN 0 THEN least(share * 2 / (sqrt(greatest(2.25 - share * 2, 0)) + 1.5), 1) WHEN 1 THEN share ELSE least(share * 6 / (sqrt(share * 18 + 2.25) + 1.5), 1) END, 9) END AS first_position
FROM f"""

#: Both sides are small where this runs: every score is computed.
_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE)::BIGINT FOR c IN embedding] AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum([a.x[i] * b.x[i] FOR i IN range(1, len(a.x) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLE_SQL: dict[str, str] = {"op2_url_filter": _url_sql(), "op7_exact_dedup": _EXACT_SQL, "op10_warc": _WARC_SQL, "op12_source_mixing": _MIX_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
