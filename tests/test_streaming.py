import shutil

from pyspark.sql import functions as F

from lodegraph.streaming import windows as W

SF = "/root/testdata/sf0.001"


def _run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in")
    batch = spark.read.parquet(str(tmp_path / "in"))
    return batch, W.stream_of(spark, str(tmp_path / "in"), batch.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream_windows_are_a_subset_of_batch(spark, tmp_path):
    batch, stream = _source(spark, tmp_path)
    got = {(r["start"], r["event_type"]): r["n"] for r in _run(spark, W.tumbling_counts(stream), "tumbling").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in W.tumbling_counts(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_distinct_and_resume(spark, tmp_path):
    batch, stream = _source(spark, tmp_path)
    assert _run(spark, W.distinct_events(stream, ["event_id"]), "dist").count() == batch.select("event_id").distinct().count()
    out = str(tmp_path / "out")
    for i in range(2):  # a second query from the start adds nothing
        q = W.append_unseen(stream.select("event_id", "ts"), out, ["event_id"], str(tmp_path / f"cp{i}"))
        q.awaitTermination()
    assert spark.read.parquet(out).count() == batch.select("event_id").distinct().count()
