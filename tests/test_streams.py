"""Streams against their batch twins."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.operators.positions import daily_rollup, fishing_runs, replace_by_key
from tidewater.schemas import POSITION_FIX
from tidewater.sources.feeds import read_fixes, stream_fixes
from tidewater.streaming import assemble, tail

DAY = datetime(2024, 5, 1)


@pytest.fixture
def landing(spark, tmp_path):
    """Two files that overlap, as lookback reads do."""
    row = lambda i, late=0: (i, i % 3, 60.0 + i / 100, -7.0, 2.0, 0.0, 0.0, "ok", DAY + timedelta(minutes=5 * i), DAY + timedelta(minutes=5 * i, seconds=late))
    for k, rows in enumerate(([row(i) for i in range(20)], [row(i) for i in range(15, 40)])):
        spark.createDataFrame(rows, POSITION_FIX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert k < 2
    return str(tmp_path)


def drain(query):
    assert query.awaitTermination(120) and query.exception() is None


def test_tail_dedup_and_replacing_write(spark, landing):
    deduped = tail.tail(stream_fixes(spark, f"{landing}/in", files_per_trigger=1))
    drain(tail.write_replacing(deduped, f"{landing}/out", f"{landing}/cp"))
    batch = replace_by_key(read_fixes(spark, f"{landing}/in"), ["source_id"], "ingest_time")
    out = tail.read_replaced(spark, f"{landing}/out")
    assert sorted(r.source_id for r in out.collect()) == sorted(r.source_id for r in batch.collect()) == list(range(40))
    assert {tuple(r) for r in daily_rollup(out).collect()} == {tuple(r) for r in daily_rollup(batch).collect()}


def memory(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    drain(q)
    return df.sparkSession.table(name)


def test_hourly_rollup_equals_batch(spark, landing):
    live = memory(tail.hourly(tail.tail(stream_fixes(spark, f"{landing}/in"), "1 hour", on="event_time"), watermark=None), "hourly", "complete")
    batch = read_fixes(spark, f"{landing}/in").dropDuplicates(["source_id"]).groupBy("vessel_id", F.window("event_time", "1 hour")).count()
    assert {(r.vessel_id, r.window.start, r.fixes) for r in live.collect()} == {(r.vessel_id, r.window.start, r["count"]) for r in batch.collect()}


def test_sessions_merge_at_exactly_the_gap(spark, tmp_path):
    rows = [(i, 1, 60.0, -7.0, 2.0, 0.0, 0.0, "ok", DAY + timedelta(minutes=m), DAY) for i, m in enumerate((0, 30, 61))]
    spark.createDataFrame(rows, POSITION_FIX).write.parquet(f"{tmp_path}/in")
    live = memory(tail.sessions(stream_fixes(spark, f"{tmp_path}/in")), "sessions", "complete")
    assert sorted(r.fixes for r in live.collect()) == [1, 2]


def test_assembly_stream_and_batch(spark, tmp_path):
    rows = [(1, 1, 2, "b"), (1, 0, 2, "a"), (2, 0, 2, "x"), (3, 0, 2, "p"), (3, 0, 2, "q"), (4, 0, 1, "solo"), (4, 0, 1, "solo"), (5, 0, 3, "a"), (5, 1, 3, "b"), (6, 1, 2, "m")]
    rows = [(*r, DAY) for r in rows]
    schema = "signature long, part int, total int, body string, arrived timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    live = memory(assemble.assemble_stream(stream), "assembled", "append")
    assert sorted((r.signature, r.status, r.body) for r in live.collect()) == [(1, "complete", "ab"), (3, "conflict", None), (4, "complete", "solo")]
    batch = assemble.assemble(spark.createDataFrame([r for r in rows if r[0] != 3], schema))
    assert sorted((r.signature, r.body) for r in batch.collect()) == [(1, "ab"), (4, "solo")]


def test_a_conflict_lasts(spark, tmp_path):
    """Parts that come after a conflict do not begin the message anew; after the time to live it may."""
    schema = "signature long, part int, total int, body string, arrived timestamp"
    at = lambda m: DAY + timedelta(minutes=m)
    files = [[(1, 0, 1 + 1, "p", at(0)), (1, 0, 2, "q", at(0))], [(1, 0, 2, "p", at(1)), (1, 1, 2, "r", at(1))], [(9, 0, 1, "clock", at(60))], [(1, 0, 2, "p", at(61)), (1, 1, 2, "r", at(61))]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if k < 3 else 0)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = memory(assemble.assemble_stream(stream), "conflicts", "append")
    assert sorted((r.signature, r.status, r.body or "") for r in live.collect()) == [(1, "complete", "pr"), (1, "conflict", ""), (9, "complete", "clock")]


def test_runs_of_a_stream_end_as_in_the_batch_walk(spark, tmp_path):
    """Also where fixes come out of order and over several batches: every run that is over equals the walk's."""
    speeds = [2.0, 2.0, None, 3.0, 9.0, 1.0, 1.0, 1.0, 0.1, 2.0]
    rows = [(i, i % 2, 60.0, -7.0, speeds[(i // 2) % 10], 0.0, 0.0, "ok", DAY + timedelta(minutes=7 * (i // 2) + (40 if i > 60 else 0)), DAY) for i in range(120)]
    rows.append((999, 5, 60.0, -7.0, 9.0, 0.0, 0.0, "ok", DAY + timedelta(days=2), DAY))
    for part in (rows[0:40:2] + rows[1:40:2], rows[60:20:-1][:20] + rows[61:], rows[40:61]):
        spark.createDataFrame(part, POSITION_FIX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = memory(tail.runs(stream_fixes(spark, f"{tmp_path}/in")), "runs", "append")
    batch = fishing_runs(read_fixes(spark, f"{tmp_path}/in").dropDuplicates(["source_id"])).select("vessel_id", F.unix_millis("run_start"), F.unix_millis("run_end"), "fix_count")
    assert sorted(tuple(r)[:3] for r in live.collect()) == sorted(tuple(r)[:3] for r in batch.collect())


def test_last_runs_of_an_input_that_is_read_once(spark, tmp_path):
    """A passed run of two fixes with nothing behind it is over, a single fix is not, nor a run that a later fix may go on with; microseconds order the fixes."""
    at = lambda minutes, micros=0: DAY + timedelta(minutes=minutes, microseconds=micros)
    fix = lambda i, vessel, speed, when: (i, vessel, 60.0, -7.0, speed, 0.0, 0.0, "ok", when, DAY)
    rows = [fix(1, 1, 2.0, at(0)), fix(2, 1, 3.0, at(5)), fix(3, 2, 2.0, at(5)), fix(4, 3, 2.0, at(4)), fix(5, 3, 2.0, at(5)), fix(6, 3, 2.0, at(20)), fix(8, 4, 2.0, at(0, 100)), fix(7, 4, 9.0, at(0, 200)), fix(9, 5, 9.0, at(70))]
    spark.createDataFrame(rows, POSITION_FIX).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = {last: memory(tail.runs(stream_fixes(spark, f"{tmp_path}/in"), close_last=last), f"last_runs_{last}", "append").collect() for last in (False, True)}
    assert {last: sorted((r.vessel_id, r.fix_count, r.avg_knots) for r in got) for last, got in found.items()} == {False: [(4, 1, 2.0)], True: [(1, 2, 2.5), (4, 1, 2.0)]}


def test_snapshots(spark):
    """Parts in any order, missing, repeated, corrupt, conflicting, of another manifest, and a whole that has another hash."""
    schema = "assembly_id string, arrived long, case_id long, total_parts int, snapshot_sha256 string, part_number int, part_sha256 string, data string"
    split = assemble.split_snapshot
    good, cut, bad = split("good", 1, "abcdefgh", 3), split("cut", 1, "abcdefgh", 3, 10)[:2], split("bad", 2, "xyz", 2, 20)
    bad = [(*r[:4], "0" * 64, *r[5:]) for r in bad]
    again = ("good", 90, 1, 3, good[0][4], 0, split("-", 1, "zzz", 3)[0][6], "zzz")
    alien = ("good", 91, 1, 4, good[0][4], 0, good[0][6], "abc")
    corrupt = ("good", 1, 1, 3, good[0][4], 1, "0" * 64, "???")
    late = [split(f"late{i}", 1, "abcdefgh", 3, 100 + 10 * i)[0] for i in range(3)]
    snapshots, quarantine = assemble.assemble_snapshots(spark.createDataFrame([*good[::-1], good[0], *cut, *bad, again, alien, corrupt, *late], schema), slots=2)
    assert sorted((r.assembly_id, r.parts, r.status, r.body) for r in snapshots.collect()) == [("bad", 2, "rejected", None), ("cut", 2, "staging", None), ("good", 3, "complete", "abcdefgh"), ("late0", 1, "staging", None), ("late1", 1, "queued", None), ("late2", 1, "queued", None)]
    assert sorted((r.arrived, r.problem) for r in quarantine.collect()) == [(1, "part hash"), (90, "conflicting part"), (91, "conflicting manifest")]
    empty = assemble.assemble_snapshots(spark.createDataFrame([], schema))
    assert [df.count() for df in empty] == [0, 0]
