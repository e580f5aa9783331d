"""Merged storage and ordered commands: the same rows whatever is merged, dies or comes late."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewater.operators import cases
from tidewater.streaming import ordered, store
from tidewater.streaming.store import Conflict, MergedStore

FIX = "vessel_id long, event_time timestamp, source_id long, ingest_time timestamp, latitude double"


def batch(spark, rng, n, ingest):
    rows = [(rng.randrange(6), f"2024-0{rng.randrange(1, 4)}-1{rng.randrange(10)} 0{rng.randrange(4)}:00:00", rng.randrange(2), f"2024-06-01 00:00:{ingest:02d}", float(rng.randrange(100))) for _ in range(n)]
    return spark.createDataFrame(rows, "vessel_id long, t string, source_id long, i string, latitude double").select("vessel_id", F.to_timestamp("t").alias("event_time"), "source_id", F.to_timestamp("i").alias("ingest_time"), "latitude").dropDuplicates(["vessel_id", "event_time", "source_id"])


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def newest(batches):
    found = {}
    for b in batches:
        for r in b:
            found[tuple(r)[:3]] = tuple(r)
    return sorted(found.values())


@pytest.fixture
def kept(spark, tmp_path):
    schema = spark.createDataFrame([], FIX).schema
    return store.positions_store(spark, f"file://{tmp_path}/fixes", schema)


def test_readers_see_the_same_rows_whatever_is_merged(spark, kept):
    rng, sent = random.Random(1), []
    assert kept.read().count() == 0 and kept.merge() == 0
    for number in range(6):
        rows = batch(spark, rng, 60, number).cache()
        sent.append(rows.collect())
        assert kept.append(rows, "live", number)
        before = rows_of(kept.read())
        assert before == newest(sent)
        reader = kept.read()
        if number % 2:
            kept.merge(fan_in=2)
        # A reader that began before the merge, and one after it.
        assert rows_of(reader) == before == rows_of(kept.read())
    assert not kept.append(batch(spark, rng, 5, 9), "live", 3) and rows_of(kept.read()) == newest(sent)
    assert {s["level"] for s in kept.manifest()["segments"]} != {0}
    kept.merge(whole=True)
    segments = kept.manifest()["segments"]
    assert len(segments) == len({s["month"] for s in segments}) and rows_of(kept.read()) == newest(sent)
    # Merged months are read as they are: no shuffle, and a month's files alone.
    plan = kept.read(["2024-02"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and rows_of(kept.read(["2024-02"])) == [r for r in newest(sent) if r[1].month == 2]
    assert all("year_month=2024-02" in f for f in kept.read(["2024-02"]).inputFiles()) and len(kept.read(["2024-02"]).inputFiles()) < len(kept.read().inputFiles())
    assert kept.vacuum(keep=1) > 5 and rows_of(kept.read()) == newest(sent)


def test_what_dies_leaves_no_trace(spark, kept, monkeypatch):
    rng = random.Random(2)
    first, second = batch(spark, rng, 40, 1).cache(), batch(spark, rng, 40, 2).cache()
    kept.append(first, "live", 0)
    kept.append(second, "live", 1)
    want = rows_of(kept.read())

    class Died(Exception):
        pass

    def dies(*_):
        raise Died

    monkeypatch.setattr(MergedStore, "_commit", dies)
    with pytest.raises(Died):
        kept.merge(whole=True)
    with pytest.raises(Died):
        kept.append(batch(spark, rng, 40, 3), "live", 2)
    assert rows_of(kept.read()) == want and kept.manifest()["version"] == 2
    monkeypatch.undo()
    kept.merge(whole=True)
    assert rows_of(kept.read()) == want
    # Of two writers that began at one version the second is refused.
    stale = kept.manifest()
    kept.append(first, "other", 0)
    with pytest.raises(Conflict):
        kept._commit(stale, [], {})
    assert kept.vacuum(keep=1) >= 3 and rows_of(kept.read()) == newest([second.collect(), first.collect(), second.collect()])


def test_hourly_states_fold_to_the_rollup(spark, tmp_path):
    rng = random.Random(3)
    rollup, every = store.hourly_store(spark, f"file://{tmp_path}/hours"), []
    for number in range(4):
        rows = batch(spark, rng, 50, number).cache()
        every.append(rows)
        rollup.append(store.hourly_states(rows), "live", number)
        rollup.merge(fan_in=3)
    whole = every[0]
    for e in every[1:]:
        whole = whole.unionByName(e)
    assert rows_of(rollup.read()) == rows_of(store.hourly_states(whole).select(*store.HOURLY.names))


def commands(case, n, rng):
    """A log, and what is wrong with it: nothing, a gap, a wrong predecessor."""
    flaw = rng.choice([None, None, "gap", "wrong"])
    at = rng.randrange(2, n) if n > 2 else 0
    rows = [[case, s, case * 1000 + s, None if s == 1 else case * 1000 + s - 1, rng.random() < 0.2] for s in range(1, n + 1)]
    if flaw == "gap":
        del rows[at - 1]
    elif flaw == "wrong":
        rows[at - 1][3] = 5
    return [tuple(r) for r in rows]


def test_commands_in_any_order_settle_as_in_the_batch(spark, tmp_path):
    rng = random.Random(4)
    every = [c for case in range(1, 9) for c in commands(case, rng.choice([1, 3, 40, 70]), rng)]
    rng.shuffle(every)
    kinds = "case_id long, sequence long, command_id long, predecessor long, refuse boolean"
    df = spark.createDataFrame(every, kinds)
    for i in range(4):
        # Each part is a batch of its own; some commands are delivered again in the next one.
        spark.createDataFrame(every[i::4] + (every[i - 1 :: 4][:5] if i else []), kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/out"
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def write(rows, number):
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with ordered.keyed_state(spark):
        q = ordered.apply_as_they_come(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")
    settled = spark.read.parquet(path).select("case_id", "sequence", "command_id", "outcome", "drain")
    want = rows_of(cases.apply_in_order(df).withColumn("drain", F.coalesce("drain", F.lit(0))))
    got = ordered.with_pending(df, settled)
    assert rows_of(got.withColumn("drain", F.coalesce("drain", F.lit(0)))) == want and settled.count() == settled.distinct().count()
    assert {r[3] for r in want} == {"applied", "refused", "pending"} and max(r[4] for r in want) > 1


def test_what_waits_too_long_is_reported(spark, tmp_path):
    kinds = "case_id long, sequence long, command_id long, predecessor long, refuse boolean"
    spark.createDataFrame([(1, 1, 10, None, False), (1, 3, 12, 11, False)], kinds).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    seen = []
    with ordered.keyed_state(spark):
        q = ordered.apply_as_they_come(stream, patience="1 second").writeStream.foreachBatch(lambda rows, _: seen.extend(tuple(r)[1:4] for r in rows.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            if len(seen) >= 2 or q.awaitTermination(1):
                break
    finally:
        q.stop()
    assert seen[:2] == [(1, 10, "applied"), (3, 12, "pending")]


class CountedState:
    """One value and one map of a case, with the number of calls that would go to the engine."""

    def __init__(self):
        self.value, self.entries, self.calls, self.largest = None, {}, 0, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value, self.largest = value, max(self.largest, len(value[-1]))

    def getValue(self, key):
        self.calls += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.entries[key]


@pytest.mark.parametrize("n", [1, 12, 60, 300])
def test_a_case_is_read_and_written_once_a_batch(n):
    """As many calls for sixty commands as for one; a case with hundreds parked has them in the map, and its value stays small."""
    rng = random.Random(n)
    every = [Row(case_id=1, sequence=s, command_id=s * 10, predecessor=s * 10 - 10 if s > 1 else None, refuse=s % 3 == 0) for s in range(1, n + 1)]
    every = every[:1] + rng.sample(every[1:], n - 1)
    state = CountedState()
    log = ordered.CommandLog(32, None)
    log.init(state)
    # The first command comes last, and all are delivered twice.
    batches = [[*every[1:], *every[1:]], [*every[5:], every[0]], []]
    got = [[tuple(r) for r in log.handleInputRows((1,), iter(b), None)] for b in batches]
    assert got == [[], [(1, s, s * 10, "refused" if s % 3 == 0 else "applied", (s - 1) // 32 + 1) for s in range(1, n + 1)], []]
    assert state.entries == {} and state.largest <= 64 * 32
    assert (state.calls == 2 * len(batches)) == (n <= 65)
    # Another command under the last sequence stops the case behind it.
    again = [Row(case_id=1, sequence=n, command_id=7, predecessor=None, refuse=False), Row(case_id=1, sequence=n + 1, command_id=8, predecessor=n * 10, refuse=False)]
    assert list(log.handleInputRows((1,), iter(again), None)) == [] and state.value[2]
