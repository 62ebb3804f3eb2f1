import datetime

from pyspark.sql import functions as F

from evidloom.operators.chunks import chunks
from evidloom.streaming import state


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_chunks_of_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("source_id"), "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(state.chunk_stream(stream, max_chars=900).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(str(tmp_path / "out")))
    key = ["source_id", "chunk_no", "sha256"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*key).collect())) == sorted(map(tuple, chunks(docs, max_chars=900).select(*key).collect()))


def test_batch_states_follow_outputs(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, "a", True, t(1)), (1, "b", True, t(2)), (1, "a", False, t(3)), (2, "a", True, t(1)), (2, "a", True, t(2)), (3, "x", False, t(1))]
    schema = "batch_id bigint, path string, present boolean, at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "state")
    run(state.batch_states(stream, 2).writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(state.upsert_each(target, "batch_id")).start())
    assert {r["batch_id"]: (r["status"], r["outputs"]) for r in state.current(spark, target, "batch_id").collect()} == {1: ("running", 1), 2: ("running", 1)}


def test_windowed_counts_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(state.windowed_counts(stream).writeStream.trigger(availableNow=True).outputMode("complete").queryName("counts").format("memory").option("checkpointLocation", str(tmp_path / "c")).start())
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))
