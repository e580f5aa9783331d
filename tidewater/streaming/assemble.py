"""Messages that arrive in parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What identifies a snapshot in all its parts.
MANIFEST = ("case_id", "total_parts", "snapshot_sha256")


def assemble(parts: DataFrame) -> DataFrame:
    """Batch: ``signature, part, total, body`` -> complete messages ``signature, parts, body``.

    A message is complete when as many different parts are there as it states. A repeated part counts once (the smallest body).
    """
    once = parts.groupBy("signature", "part").agg(F.min("body").alias("body"), F.max("total").alias("total"))
    whole = once.groupBy("signature").agg(F.count("*").alias("parts"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("part", "body"))).alias("all"))
    return whole.filter("parts = total").select("signature", "parts", F.array_join(F.transform("all", lambda p: p["body"]), "").alias("body"))


def assemble_stream(parts: DataFrame, ttl: str = "10 minutes", watermark: str = "1 minute") -> DataFrame:
    """Stream: ``signature, part, total, body, arrived`` -> messages as soon as all parts are there; what stays incomplete for ``ttl`` goes.

    A part that comes again with another body makes the message conflict: it comes out once, with status ``conflict`` and no body, and
    later parts of it are ignored until ``ttl`` has passed since. Time is that of ``arrived``, as far as the watermark is.
    """
    limit = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[int, str] = {}
        if state.exists:
            places, bodies, conflict, until = state.get
            # New parts may come in the batch in which the time to live has passed: they begin anew.
            if until >= state.getCurrentWatermarkMs():
                if conflict:
                    return
                held = dict(zip(places, bodies, strict=True))
        total, conflict, latest = 0, False, state.getCurrentWatermarkMs()
        for frame in frames:
            for part, of, body, ms in zip(frame["part"].tolist(), frame["total"].tolist(), frame["body"].tolist(), frame["ms"].tolist(), strict=True):
                latest = max(latest, ms)
                conflict |= held.setdefault(part, body) != body
                total = max(total, of)
        done = not conflict and total and len(held) == total
        if conflict or done:
            body = None if conflict else "".join(held[i] for i in sorted(held))
            yield pd.DataFrame({"signature": [key[0]], "status": ["conflict" if conflict else "complete"], "parts": [len(held)], "body": [body]})
        if done:
            if state.exists:
                state.remove()
            return
        state.update(([], [], True, latest + limit) if conflict else (list(held), list(held.values()), False, latest + limit))
        state.setTimeoutTimestamp(latest + limit)

    held = "parts array<int>, bodies array<string>, conflict boolean, until long"
    timed = parts.withWatermark("arrived", watermark).withColumn("ms", F.unix_millis("arrived"))
    return timed.groupBy("signature").applyInPandasWithState(run, "signature long, status string, parts long, body string", held, "append", GroupStateTimeout.EventTimeTimeout)


def checked_parts(parts: DataFrame) -> DataFrame:
    """``parts`` with ``problem``: why a part goes to quarantine, the first reason that holds, else null.

    Parts are ``assembly_id, arrived, case_id, total_parts, snapshot_sha256, part_number, part_sha256, data``. A part whose bytes
    do not have the stated hash, or whose number is out of range, is rejected before anything else counts. Of the others, the first that
    arrives states the manifest of its assembly, and the first of a number states the bytes of that part.
    """
    stated = F.when(F.sha2("data", 256) != F.col("part_sha256"), "part hash").when(~F.col("part_number").between(0, F.col("total_parts") - 1), "part number")
    marked = parts.withColumn("_rejected", stated)
    valid = F.col("_rejected").isNull()
    whole = Window.partitionBy("assembly_id", valid)
    manifest = F.struct(*MANIFEST)
    first = F.min(F.struct(F.col("arrived"), manifest.alias("m"))).over(whole)["m"]
    marked = marked.withColumns({"_valid": valid, "_alien": manifest != first})
    same = Window.partitionBy("assembly_id", "_valid", "_alien", "part_number")
    bytes_of = F.min(F.struct("arrived", "part_sha256")).over(same)["part_sha256"]
    problem = F.coalesce("_rejected", F.when(F.col("_alien"), "conflicting manifest").when(F.col("part_sha256") != bytes_of, "conflicting part"))
    return marked.withColumn("problem", problem).drop("_rejected", "_valid", "_alien")


def assemble_snapshots(parts: DataFrame, slots: int = 4) -> tuple[DataFrame, DataFrame]:
    """Snapshots and the quarantine of their parts (``checked_parts``).

    Snapshots are ``assembly_id, case_id, parts, status, body``: ``complete`` when all parts are there and have the manifest's hash together,
    ``rejected`` when they have not, ``staging`` while parts are missing. At most ``slots`` incomplete snapshots of a case are staging, those
    that began first; the others are ``queued``. Only complete ones have a body.
    """
    checked = checked_parts(parts)
    good = checked.filter("problem IS NULL")
    once = good.groupBy("assembly_id", *MANIFEST, "part_number").agg(F.min("arrived").alias("arrived"), F.min("data").alias("data"))
    whole = once.groupBy("assembly_id", *MANIFEST).agg(F.min("arrived").alias("began"), F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("part_number", "data"))).alias("all"))
    body = F.concat_ws("", F.transform("all", lambda p: p["data"]))
    status = F.when(F.col("parts") < F.col("total_parts"), "staging").when(F.sha2("body", 256) == F.col("snapshot_sha256"), "complete").otherwise("rejected")
    judged = whole.withColumn("body", body).withColumn("status", status)
    turn = F.row_number().over(Window.partitionBy("case_id", "status").orderBy("began", "assembly_id"))
    queued = judged.withColumn("status", F.when((F.col("status") == "staging") & (turn > slots), "queued").otherwise(F.col("status")))
    shown = F.when(F.col("status") == "complete", F.col("body"))
    return queued.select("assembly_id", "case_id", "parts", "status", shown.alias("body")), checked.filter("problem IS NOT NULL")


def split_snapshot(assembly_id: str, case_id: int, body: str, size: int, arrived: int = 0) -> list[tuple]:
    """Rows of a snapshot's parts, as ``checked_parts`` takes them."""
    cut = [body[i : i + size] for i in range(0, len(body), size)] or [""]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return [(assembly_id, arrived + i, case_id, len(cut), sha(body), i, sha(x), x) for i, x in enumerate(cut)]
