from panelwright.streaming.events import hopping_counts

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = hopping_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hops").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: {(r["start"], r["event_type"]): r["n"] for r in df.collect()}
    assert key(spark.table("hops")) == key(hopping_counts(events))
