"""Annual reports: account roll-up, key figures, currency conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numbers import half_up, ratio

# Leaf accounts by id.
LEAVES = {
    1: "REVENUE", 2: "CHANGES_IN_INVENTORY", 3: "NET_OPERATING_EXPENSES", 5: "SALARIES", 7: "DEPRECIATION_AND_IMPAIRMENT", 9: "RELATED_COMPANIES", 10: "NET_FINANCIAL_EXPENSES", 12: "EXTRAORDINARY",
    14: "TAXES", 15: "FISHING_RIGHTS", 17: "DIVIDEND", 18: "LICENCES", 19: "GOODWILL", 21: "VESSELS", 22: "BUILDINGS_ETC", 23: "EQUIPMENT", 24: "OTHER_TANGIBLE_ASSETS", 26: "RELATED_COMPANIES_ASSETS",
    27: "SHARES", 28: "RECEIVABLES", 30: "INVENTORY", 31: "OTHER_RECEIVABLES", 32: "RECEIVABLES_IN_RELATED_COMPANIES", 34: "CASH", 36: "SHARE_CAPITAL", 37: "FUNDS_PREMIUM_AND_OTHER_EQUITY",
    38: "PROFIT_CARRIED_FORWARD", 40: "DEFERRED_TAX_LIABILITIES", 41: "OTHER_NON_CURRENT_OBLIGATIONS", 44: "NON_CURRENT_MORTGAGE_AND_BANK_DEBTS", 45: "NON_CURRENT_DEBT_TO_RELATED_COMPANIES", 46: "CORPORATION_TAX",
    48: "DEBT_DIVIDEND", 49: "OTHER_CURRENT_LIABILITIES", 56: "OTHER_INTANGIBLE_ASSETS", 58: "CURRENT_MORTGAGE_AND_BANK_DEBTS", 59: "CURRENT_DEBT_TO_RELATED_COMPANIES",
}
# Totals by id, and the accounts that they sum.
TOTALS = {
    4: (1, 2, 3), 6: (4, 5), 8: (6, 7), 11: (8, 9, 10), 13: (11, 12), 16: (13, 14, 15), 20: (18, 19, 56), 25: (21, 22, 23, 24), 29: (26, 27, 28), 57: (20, 25, 29), 33: (30, 31, 32, 34), 35: (57, 33),
    39: (36, 38, 37), 43: (40, 44, 45, 41), 50: (58, 46, 48, 59, 49), 51: (43, 50), 52: (39, 51),
}
# Key figures as (numerator, subtracted from it, denominator).
KEY_FIGURES = {
    "ebit_margin": (8, None, 1), "ebitda_margin": (6, None, 1), "ebit_gross_profit": (8, None, 4), "ebitda_gross_profit": (6, None, 4), "ebitda_total_liabilities": (6, None, 51), "net_income_equity": (16, None, 39),
    "net_income_revenue": (16, None, 1), "net_income_gross_profit": (16, None, 4), "liabilities_equity": (51, None, 39), "current_ratio": (33, None, 50), "quick_ratio": (33, 30, 50),
}


def by_depth() -> list[int]:
    """Totals in an order in which those that a total sums come before it."""
    done: list[int] = []
    while len(done) < len(TOTALS):
        done += [t for t in TOTALS if t not in done and all(c in LEAVES or c in done for c in TOTALS[t])]
    return done


def resolve_accounts(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, account, value`` -> a row for each report with a column ``a<id>`` for every account.

    A stored value wins over the sum; a leaf that is not stored is 0. Each report's rows meet before they become a wide one: wide rows, nearly all
    of them null, shrink so far in a shuffle that one task would get very many.
    """
    wide = values.repartition(*keys).groupBy(*keys).agg(*[F.max(F.when(F.col("account") == i, F.col("value"))).alias(f"s{i}") for i in (*LEAVES, *TOTALS)])
    wide = wide.withColumns({f"a{i}": F.coalesce(f"s{i}", F.lit(0.0)) for i in LEAVES})
    for total in by_depth():
        parts = [F.col(f"a{c}") for c in TOTALS[total]]
        wide = wide.withColumn(f"a{total}", F.coalesce(F.col(f"s{total}"), sum(parts[1:], parts[0])))
    return wide.select(*keys, *[f"a{i}" for i in (*LEAVES, *TOTALS)])


def key_figures(resolved: DataFrame, keys: list[str]) -> DataFrame:
    def figure(top: int, less: int | None, bottom: int) -> Column:
        return ratio(F.col(f"a{top}") - F.col(f"a{less}") if less else F.col(f"a{top}"), F.col(f"a{bottom}"))

    return resolved.select(*keys, *[figure(*parts).alias(name) for name, parts in KEY_FIGURES.items()])


def converted(amount: Column, native: Column, wanted: str, rate_from: Column, rate_to: Column) -> Column:
    """An amount in the wanted currency, through the euro and rounded; as it is in its own; null without a rate."""
    return F.when(native == wanted, amount).otherwise(half_up(ratio(amount, rate_from) * rate_to))


def categories(labels: Column) -> Column:
    """Comma-separated labels as trimmed upper-case text, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(labels, ","), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def in_currency(resolved: DataFrame, companies: DataFrame, rates: DataFrame, metric: int, wanted: str) -> DataFrame:
    """``company_id, year, name, country, labels, value, gross_profit`` in the wanted currency."""
    own = rates.select("year", F.col("quote").alias("currency"), F.col("rate").alias("rate_from"))
    to = rates.filter(F.col("quote") == wanted).select("year", F.col("rate").alias("rate_to"))
    joined = resolved.join(companies, "company_id").join(own, ["year", "currency"], "left").join(to, "year", "left")
    worth = lambda a: converted(F.col(a), F.col("currency"), wanted, F.col("rate_from"), F.col("rate_to"))
    return joined.select("company_id", "year", "name", "country", "labels", worth(f"a{metric}").alias("value"), worth("a4").alias("gross_profit"))
