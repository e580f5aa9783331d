"""The keyset source: batch and stream give the same rows, once each, also at equal times and after a restart."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewater.sources import keyset

SCHEMA = "source_id long, ingest_time timestamp, speed double"
START = datetime(2024, 3, 1, 22, 30)


def add(spark, path, rows):
    spark.createDataFrame([(i, m) for i, m in rows], "source_id long, m long").select("source_id", (F.lit(START.isoformat(sep=" ")).cast("timestamp") + F.make_dt_interval(mins=F.col("m").cast("int"))).alias("ingest_time"), (F.col("source_id") / 2).alias("speed")).coalesce(1).write.mode("append").parquet(path)


def source(reader, path):
    return reader.format("keyset").schema(SCHEMA).option("path", f"file://{path}")


def test_batch_reads_hours_within_the_bounds(spark, tmp_path):
    keyset.register(spark)
    add(spark, f"{tmp_path}/t", [(i, i * 7) for i in range(60)])
    df = source(spark.read, f"{tmp_path}/t").load()
    assert sorted(tuple(r) for r in df.select("source_id", "speed").collect()) == [(i, i / 2) for i in range(60)] and df.rdd.getNumPartitions() == 8
    low, high = START + timedelta(minutes=100), START + timedelta(minutes=200)
    cut = df.filter((F.col("ingest_time") >= F.lit(low.isoformat(sep=" ")).cast("timestamp")) & (F.col("ingest_time") < F.lit(high.isoformat(sep=" ")).cast("timestamp")))
    assert sorted(r.source_id for r in cut.collect()) == [i for i in range(60) if 100 <= i * 7 < 200] and cut.rdd.getNumPartitions() <= 3


def test_stream_resumes_without_loss_at_equal_times(spark, tmp_path):
    keyset.register(spark)
    table, out = f"{tmp_path}/t", f"file://{tmp_path}/out"
    seen = []

    def drain():
        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        q = source(spark.readStream, table).load().writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.source_id for r in spark.read.parquet(out).collect())

    for rows in ([(1, 0), (2, 5), (3, 5)], [(4, 5), (5, 5)], [(6, 5), (7, 300)], [(8, 300), (9, 301)]):
        add(spark, table, rows)
        seen += [i for i, _ in rows]
        # Each call is a query of its own that goes on from the checkpoint.
        assert drain() == seen
    assert drain() == seen == sorted(r.source_id for r in source(spark.read, table).load().collect())
