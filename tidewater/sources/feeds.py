"""Readers of outside documents: workbooks, JSON registers, HTML tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import texts
from tidewater.schemas import POSITION_FIX

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROUTE_AREAS = "map<string,struct<Rute:string,FAOArea:string,Center:struct<Latitude:double,Longitude:double>,Coordinates:array<struct<Latitude:double,Longitude:double>>>>"
MAP_FEATURES = "struct<features:array<struct<attributes:struct<FEATURE_ID:bigint,OBJECTID:bigint,NAME:string,TYPE:string>,geometry:struct<x:double,y:double,points:array<array<double>>>>>>"


def _cells(data: bytes) -> list[list[str | None]]:
    """First sheet of a workbook as a matrix of texts."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    rows = []
    for row in sheet.iter(f"{_MAIN}row"):
        out: list[str | None] = []
        for cell in row.iter(f"{_MAIN}c"):
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            at = len(out)
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            out += [None] * (at - len(out))
            value = cell.find(f"{_MAIN}v")
            text = value.text if value is not None else "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
            out.append(shared[int(text)] if cell.get("t") == "s" and text is not None else text)
        rows.append(out)
    return rows


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """``path, row, cells`` of the first sheet of every workbook under ``path``; the header is row 0."""
    return workbook_cells(spark.read.format("binaryFile").load(path))


def workbook_cells(files: DataFrame) -> DataFrame:
    """The same of files that are read already: ``path`` and ``content``."""

    @F.pandas_udf("array<array<string>>")
    def cells(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in contents:
            yield s.map(_cells)

    return files.select("path", F.posexplode(cells("content")).alias("row", "cells"))


def route_areas(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``route_key, fao_area, centre_latitude, centre_longitude, coordinates`` of a keyed JSON register; entries without a readable key go."""
    areas = payloads.select(F.explode(F.from_json(column, ROUTE_AREAS)).alias("key", "v"))
    clean = lambda c: F.regexp_extract(F.trim(c), r"^#?(\d{1,4})$", 1)
    number = F.coalesce(F.nullif(clean(F.col("v.Rute")), F.lit("")), F.nullif(clean(F.col("key")), F.lit("")))
    points = F.filter("v.Coordinates", lambda p: p["Latitude"].isNotNull() & p["Longitude"].isNotNull())
    out = areas.select(F.concat(F.lit("#"), F.lpad(number, 4, "0")).alias("route_key"), F.col("v.FAOArea").alias("fao_area"), F.col("v.Center.Latitude").alias("centre_latitude"), F.col("v.Center.Longitude").alias("centre_longitude"), points.alias("coordinates"))
    return out.filter("route_key IS NOT NULL")


def map_features(pages: DataFrame, column: str = "payload", order: str = "page") -> DataFrame:
    """``feature_id, name, kind, lat, lon`` of paged map-service answers; ids fall back to the object id, and of repeated ids the first stays."""
    rows = pages.select(order, F.posexplode(F.from_json(column, MAP_FEATURES)["features"]).alias("place", "f"))
    points = F.when(F.col("f.geometry.x").isNotNull(), F.array(F.array("f.geometry.x", "f.geometry.y"))).otherwise(F.col("f.geometry.points"))
    mean = lambda i: F.aggregate("points", F.lit(0.0), lambda a, p: a + F.get(p, F.lit(i))) / F.size("points")
    named = rows.select(order, "place", F.coalesce("f.attributes.FEATURE_ID", "f.attributes.OBJECTID").alias("feature_id"), F.col("f.attributes.NAME").alias("name"), F.col("f.attributes.TYPE").alias("kind"), points.alias("points"))
    first = Window.partitionBy("feature_id").orderBy(order, "place")
    kept = named.filter("feature_id IS NOT NULL AND size(points) > 0").withColumn("turn", F.row_number().over(first)).filter("turn = 1")
    return kept.select("feature_id", "name", "kind", mean(1).alias("lat"), mean(0).alias("lon"))


def authority_closures(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``jm_number, paragraph, name, points, unreadable`` of a closure register: vertices as ``DD MM,mmm[NSEW]`` texts.

    A vertex with a part that cannot be read is left out and counted.
    """
    entry = F.from_json(column, "struct<jmNumber:string,paragraph:int,name:string,vertices:array<struct<lat:string,lon:string>>>")
    point = lambda v: F.struct(texts.authority_coordinate(v["lat"]).alias("lat"), texts.authority_coordinate(v["lon"]).alias("lon"))
    read = payloads.select(entry.alias("e")).filter("e.jmNumber IS NOT NULL").select("e.jmNumber", "e.paragraph", "e.name", F.transform("e.vertices", point).alias("all"))
    whole = F.filter("all", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return read.select(F.col("jmNumber").alias("jm_number"), "paragraph", "name", whole.alias("points"), (F.size("all") - F.size(whole)).alias("unreadable"))


def points_of_interest(fragments: DataFrame) -> DataFrame:
    """``number, title, aliases`` of fragments ``key, title, aliases``: keys are ``poi-`` and three figures from 100, titles lose their prefix."""
    number = F.regexp_extract("key", r"^poi-(\d{3})$", 1).try_cast("bigint")
    found = fragments.withColumn("number", number).filter(F.col("number").between(100, 999))
    return found.select("number", F.trim(F.regexp_replace("title", r"(?i)^poi:\s*", "")).alias("title"), F.array_compact("aliases").alias("aliases"))


def net_degrees(text: Column) -> Column:
    """Degrees and decimal minutes of a net's end, such as ``63°10,5' N``."""
    pattern = r"(\d+)\s*°\s*([\d.,]+)\s*'?\s*([NSEWnsew])"
    value = F.regexp_extract(text, pattern, 1).try_cast("double") + F.regexp_replace(F.regexp_extract(text, pattern, 2), ",", ".").try_cast("double") / 60
    return F.when(F.upper(F.regexp_extract(text, pattern, 3)).isin("S", "W"), -value).otherwise(value)


def gillnets(pages: DataFrame, key: str = "page", column: str = "html") -> DataFrame:
    """Nets of the vessel tables of a page: ``key, vessel, call_sign, gear, idx, from_lat, from_lon, to_lat, to_lon``.

    A row of four cells that ends in a time names the vessel of the net rows after it.
    """
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("place", "tr"))
    cells = F.filter(F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), texts.html_text), lambda c: c != "")
    rows = rows.select(key, "place", cells.alias("c"))
    header = F.when((F.size("c") == 4) & F.get("c", F.lit(3)).rlike(r"^\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}$"), F.struct(F.get("c", F.lit(1)).alias("vessel"), F.get("c", F.lit(2)).alias("call_sign"), F.get("c", F.lit(0)).alias("gear")))
    so_far = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("h", F.last(header, ignorenulls=True).over(so_far))
    nets = filled.filter((F.size("c") == 7) & F.get("c", F.lit(0)).rlike(r"^\d+\s*\.?$") & F.col("h").isNotNull())
    at = lambda i: net_degrees(F.get("c", F.lit(i)))
    idx = F.regexp_extract(F.get("c", F.lit(0)), r"^(\d+)", 1).cast("int")
    return nets.select(key, "h.vessel", "h.call_sign", "h.gear", idx.alias("idx"), at(1).alias("from_lat"), at(2).alias("from_lon"), at(4).alias("to_lat"), at(5).alias("to_lon")).dropna(subset=["from_lat", "from_lon", "to_lat", "to_lon"])


def read_fixes(spark: SparkSession, path: str, source: str = "parquet", schema: T.StructType | str = POSITION_FIX, **options: str) -> DataFrame:
    """Position fixes from a batch source by format name (``parquet``, ``orc``, ``csv``, ``json``, ``jdbc``, ...), as declared by ``schema``."""
    reader = spark.read.format(source).options(**options)
    return reader.schema(schema).load(path) if source != "jdbc" else reader.load()


def stream_fixes(spark: SparkSession, path: str, source: str = "parquet", files_per_trigger: int = 100, schema: T.StructType | str = POSITION_FIX) -> DataFrame:
    """The same as a stream; new files are read a few at a time."""
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
