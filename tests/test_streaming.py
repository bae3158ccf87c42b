from rasterloom.streaming.previews import latest, request_stream


def test_only_the_latest_request_of_an_image_counts(spark, tmp_path):
    schema = "image_id string, generation long, mode string"
    for k, rows in enumerate(([("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 4, "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = latest(request_stream(spark, f"{tmp_path}/in", schema), "image_id", "generation")
    running = stream.writeStream.outputMode("complete").format("memory").queryName("previews").option("checkpointLocation", f"{tmp_path}/state").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(map(tuple, spark.table("previews").collect())) == [("a", 3, "z"), ("b", 5, "y")]
