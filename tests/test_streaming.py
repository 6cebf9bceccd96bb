from pyspark.sql import functions as F

from logweave.operators import bins as B
from logweave.streaming import stream


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_dedupe_and_bins(spark):
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events*.parquet")
    logs = events.select((F.floor(F.col("event_id") / 4)).cast("long").alias("block_number"), F.col("ts").cast("timestamp").alias("ts"), F.lit("h").alias("block_hash"), (F.col("event_id") % 4).alias("log_index"))
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert sum(r.n_logs for r in run(stream.block_bins(logs, 50), "bins", "complete")) == n
    small = stream.sieve_and_dedupe(logs, lambda d: d.where("log_index < 3"), delay="1000 days")
    assert len(run(small, "firsts")) == 3


def test_stateful_completion(spark, tmp_path):
    rows = [(0, 4, 1, 10), (12, 19, 2, 20), (5, 9, 3, 5), (10, 11, 4, 9), (20, 25, 5, 5)]
    df = spark.createDataFrame(rows, "from_block long, to_block long, fetched_at long, fetched_at_block long")
    B.fan_out(df, 10).repartition(3).write.parquet(str(tmp_path / "in"))
    parts = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = run(stream.complete_bins(parts, 10), "completed")
    assert sorted(tuple(r) for r in got) == [(0, 9, 3, 10), (10, 19, 4, 20)]
