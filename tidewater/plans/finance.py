"""Finance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import finance as N
from tidewater.plans.base import query
from tidewater.sources import bridge as B

_ALL = (*N.LEAVES, *N.TOTALS)
_PIVOT = "stored AS (SELECT company_id, year, " + ", ".join(f"max(CASE WHEN account = {i} THEN value END) AS s{i}" for i in _ALL) + " FROM account GROUP BY company_id, year)"
_LEAF = "r0 AS (SELECT *, " + ", ".join(f"coalesce(s{i}, 0e0) AS a{i}" for i in N.LEAVES) + " FROM stored)"
_STEPS = [f"r{k + 1} AS (SELECT *, coalesce(s{t}, {' + '.join(f'a{c}' for c in N.TOTALS[t])}) AS a{t} FROM r{k})" for k, t in enumerate(N.by_depth())]
_RESOLVED = ["WITH " + B.ACCOUNTS_SQL, _PIVOT, _LEAF, *_STEPS, f"resolved AS (SELECT * FROM r{len(_STEPS)})"]


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.resolve_accounts(B.account_values(spark, sf_dir), ["company_id", "year"])


@query("fin_01", ",\n".join(_RESOLVED) + "\nSELECT company_id, year, " + ", ".join(f"round(a{t}, 2) AS a{t}" for t in N.TOTALS) + " FROM resolved")
def fin_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("company_id", "year", *[F.round(f"a{t}", 2).alias(f"a{t}") for t in N.TOTALS])


def _figure_sql(top: int, less: int | None, bottom: int) -> str:
    return f"round(CASE WHEN a{bottom} <> 0 THEN (a{top}{f' - a{less}' if less else ''}) / a{bottom} END, 6)"


@query("agg_20", ",\n".join(_RESOLVED) + "\nSELECT company_id, year, " + ", ".join(f"{_figure_sql(*v)} AS {k}" for k, v in N.KEY_FIGURES.items()) + " FROM resolved")
def agg_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = N.key_figures(_resolved(spark, sf_dir), ["company_id", "year"])
    return figures.select("company_id", "year", *[F.round(k, 6).alias(k) for k in N.KEY_FIGURES])


def _worth(a: str, wanted: str) -> str:
    return f"CASE WHEN currency = '{wanted}' THEN {a} ELSE floor({a} / f.rate * t.rate + 0.5e0) END"


def _money(metric: int, wanted: str) -> str:
    return f"""money AS (
  SELECT r.company_id, r.year, c.name, c.country, c.labels, {_worth(f'r.a{metric}', wanted)} AS value, {_worth('r.a4', wanted)} AS gross_profit
  FROM resolved r JOIN company c USING (company_id) LEFT JOIN rate f ON f.year = r.year AND f.quote = c.currency LEFT JOIN rate t ON t.year = r.year AND t.quote = '{wanted}')"""


@query("fin_02", ",\n".join([*_RESOLVED, B.COMPANIES_SQL, B.RATES_SQL, _money(6, "DKK")]) + """
SELECT company_id, name, country, round(value, 0) AS value, round(gross_profit, 0) AS gross_profit FROM money
WHERE year = 1996 AND value IS NOT NULL AND name NOT LIKE '%(OLD)%' AND list_contains(string_split(replace(upper(labels), ' ', ''), ','), 'PELAGIC') ORDER BY value DESC, company_id LIMIT 200""")
def fin_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market: the companies of a category by a metric in one currency."""
    companies = B.companies(spark, sf_dir).filter(~F.col("name").contains("(OLD)") & (F.expr("find_in_set('PELAGIC', replace(upper(labels), ' ', ''))") > 0))
    year = N.resolve_accounts(B.account_values(spark, sf_dir).filter("year = 1996"), ["company_id", "year"])
    money = N.in_currency(year, companies, B.rates(spark), 6, "DKK").filter("value IS NOT NULL")
    return money.orderBy(F.desc("value"), "company_id").limit(200).select("company_id", "name", "country", F.round("value", 0).alias("value"), F.round("gross_profit", 0).alias("gross_profit"))


@query("fin_03", ",\n".join([*_RESOLVED, B.COMPANIES_SQL, B.RATES_SQL, _money(1, "EUR")]) + """
SELECT company_id, name, count(*) AS n_years, string_agg(year || '=' || coalesce(round(value, 0)::BIGINT::VARCHAR, 'null'), ';' ORDER BY year) AS series FROM money GROUP BY company_id, name""")
def fin_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of a metric by company, years ascending."""
    money = N.in_currency(_resolved(spark, sf_dir), B.companies(spark, sf_dir), B.rates(spark), 1, "EUR")
    series = F.sort_array(F.collect_list(F.struct("year", F.coalesce(F.round("value", 0).cast("bigint").cast("string"), F.lit("null")).alias("value"))))
    text = F.array_join(F.transform("series", lambda p: F.concat(p["year"].cast("string"), F.lit("="), p["value"])), ";")
    return money.groupBy("company_id", "name").agg(F.count("*").alias("n_years"), series.alias("series")).withColumn("series", text)


@query("fin_04", "WITH " + B.ACCOUNTS_SQL + ", " + B.COMPANIES_SQL + """
SELECT company_id, name FROM company c WHERE name ILIKE '%12%' AND name NOT LIKE '%(OLD)%' AND EXISTS (SELECT 1 FROM account a WHERE a.company_id = c.company_id) ORDER BY name, company_id LIMIT 50""")
def fin_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company search among those with a report."""
    found = B.companies(spark, sf_dir).filter(F.col("name").ilike("%12%") & ~F.col("name").like("%(OLD)%"))
    return found.join(B.account_values(spark, sf_dir), "company_id", "left_semi").orderBy("name", "company_id").limit(50).select("company_id", "name")


@query("fin_05", "WITH " + B.ACCOUNTS_SQL + ", " + B.COMPANIES_SQL + """
SELECT DISTINCT category FROM (SELECT upper(trim(unnest(string_split(labels, ',')))) AS category FROM company c WHERE EXISTS (SELECT 1 FROM account a WHERE a.company_id = c.company_id)) WHERE category <> ''""")
def fin_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct category labels of companies with a report."""
    found = B.companies(spark, sf_dir).join(B.account_values(spark, sf_dir), "company_id", "left_semi")
    return found.select(F.explode(N.categories(F.col("labels"))).alias("category")).distinct()


@query("src_18", "WITH " + B.RATES_SQL + """, f AS (SELECT year, quote, rate FROM rate WHERE quote <> 'EUR' UNION SELECT year, 'EUR', 1e0 FROM rate)
SELECT year(o_orderdate) AS year, quote, round(rate, 6) AS rate, count(*) AS reports, round(sum(o_totalprice::DOUBLE / rate), 2) AS euros FROM orders JOIN f ON f.year = year(o_orderdate) GROUP BY 1, 2, 3""")
def src_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the years that reports ask for, the euro's added where the feed lacks it."""
    feed = B.rates(spark).filter("quote <> 'EUR'")
    known = feed.unionByName(B.rates(spark).select("year").distinct().select("year", F.lit("EUR").alias("quote"), F.lit(1.0).alias("rate")))
    reports = B.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("double").alias("value"))
    joined = reports.join(known, "year").groupBy("year", "quote", "rate").agg(F.count("*").alias("reports"), F.round(F.sum(F.col("value") / F.col("rate")), 2).alias("euros"))
    return joined.select("year", "quote", F.round("rate", 6).alias("rate"), "reports", "euros")
