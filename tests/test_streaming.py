import datetime as dt

from loomgraph.streaming import ingest


def test_statements_once_and_windows(spark, tmp_path):
    day = dt.datetime(2025, 3, 3)
    rows = [("a", "p", "b", 0, day), ("a", "p", "b", 3, day + dt.timedelta(1)), ("a", "p", "c", 0, day)]
    spark.createDataFrame(rows, "subject string, predicate string, object string, chunk_no int, loaded_at timestamp").write.parquet(f"{tmp_path}/in/t.parquet")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/t.parquet").schema).parquet(f"{tmp_path}/in/t.parquet")
    query = ingest.new_statements(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert sorted((r["subject"], r["object"]) for r in spark.table("once").collect()) == [("a", "b"), ("a", "c")]
    events = [(1, day, "x", 1.0), (2, day + dt.timedelta(hours=2), "x", 2.0), (3, day + dt.timedelta(days=1), "y", 4.0)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/e/events.parquet")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e/events.parquet").schema).parquet(f"{tmp_path}/e/events.parquet")
    found = ingest.run_once(ingest.windowed(stream), f"{tmp_path}/out", ["window_start", "event_type"]).collect()
    assert sorted((r["event_type"], r["n"], r["value"]) for r in found) == [("x", 2, 3.0), ("y", 1, 4.0)]
