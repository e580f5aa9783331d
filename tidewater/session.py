"""Session settings and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def prepare(spark: SparkSession) -> SparkSession:
    """UTC for all time arithmetic, and the package where Python workers find it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); in local mode a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-tidewater-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read from there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, unless they import it from ``PYTHONPATH`` or the working directory."""
    found = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if ROOT in found or Path.cwd() == ROOT or getattr(context, "_tidewater_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tidewater-ship-")) / "tidewater_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((ROOT / "tidewater").rglob("*.py")):
            out.write(path, path.relative_to(ROOT).as_posix())
    context.addPyFile(str(target))
    context._tidewater_shipped = True
