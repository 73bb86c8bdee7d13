from conftest import DATA

from tessera.streaming.events import windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, windowed_counts(batch).collect()))
