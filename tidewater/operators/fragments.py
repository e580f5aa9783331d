"""Rows rendered as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE = "\n"


def cell(value: Column) -> Column:
    """Text for a table's cell: bars escaped, lines joined, nothing as a dash."""
    return F.regexp_replace(F.replace(F.coalesce(value.cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def table(rows: DataFrame, key: str, columns: dict[str, str], *order: str) -> DataFrame:
    """``key, table``: a Markdown table of each key's rows, in order; ``columns`` are headings and the columns below them."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns.values()]), F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda r: r["line"])
    head = "| " + " | ".join(columns) + " |" + _LINE + "|" + " --- |" * len(columns) + _LINE
    return rows.groupBy(key).agg(F.concat(F.lit(head), F.array_join(lines, _LINE)).alias("table"))


def page(matter: dict[str, Column], title: Column, facts: dict[str, Column], sections: dict[str, Column]) -> Column:
    """A page: front matter, title, a list of facts, and sections under headings."""
    front = [F.lit("---"), *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in matter.items()], F.lit("---")]
    listed = [F.concat(F.lit(f"- {k}: "), v.cast("string")) for k, v in facts.items()]
    parts = [F.concat_ws(_LINE, *front), F.concat(F.lit("# "), title), F.concat_ws(_LINE, *listed), *[F.concat(F.lit(f"## {k}{_LINE}{_LINE}"), v) for k, v in sections.items()]]
    return F.concat_ws(_LINE + _LINE, *parts)


def index_row(title: Column, url: Column, vertices: Column, signals: Column) -> Column:
    """A line of an index: a linked title and two counts."""
    return F.concat(F.lit("| ["), cell(title), F.lit("]("), url, F.lit(") | "), vertices.cast("string"), F.lit(" | "), signals.cast("string"), F.lit(" |"))


def points_list(points: Column) -> Column:
    """Vertices as a list; none is said in words."""
    text = F.array_join(F.transform(points, lambda p: F.concat(F.lit("  - "), p["lat"].cast("string"), F.lit(", "), p["lon"].cast("string"))), _LINE)
    return F.when(F.size(points) > 0, text).otherwise("  (no vertices)")
