"""Declared schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, DOUBLE, STRING, TIMESTAMP, INT = T.LongType(), T.DoubleType(), T.StringType(), T.TimestampType(), T.IntegerType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POSITION_FIX = schema(source_id=LONG, vessel_id=LONG, latitude=DOUBLE, longitude=DOUBLE, speed=DOUBLE, heading=DOUBLE, course=DOUBLE, status=STRING, event_time=TIMESTAMP, ingest_time=TIMESTAMP)
WINDOW_REQUEST = schema(idx=INT, vessel_id=LONG, from_time=TIMESTAMP, to_time=TIMESTAMP)
REGISTRY = schema(vessel_id=LONG, type_id=INT, flag=STRING, name=STRING, snapshot=LONG)
POINT = schema(lat=DOUBLE, lon=DOUBLE)
