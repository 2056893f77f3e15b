from terrasieve.streaming.ingest import load_line_stream, normalised_stream


def test_lines(spark, tmp_path):
    rows = [(1, "ImageId,BuildingId", "a,1"), (2, "ImageId,BuildingId", "a"), (3, "ImageId,BuildingId", "a,x")]
    spark.createDataFrame(rows, "line_id long, header_line string, line_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_id long, header_line string, line_text string").parquet(str(tmp_path / "in"))
    load_line_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.line_id for r in spark.read.parquet(str(tmp_path / "out/valid")).collect()] == [1]
    assert sorted((r.line_id, r.reason) for r in spark.read.parquet(str(tmp_path / "out/faulty")).collect()) == [(2, "column_count"), (3, "value")]


def test_timestamps(spark, tmp_path):
    spark.createDataFrame([(1, "p", "2017-01-01 00:00:00")], "id long, src string, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, src string, t string").parquet(str(tmp_path / "in"))
    lookup = spark.createDataFrame([("p", "Asia/Tokyo", "DMY")], "src string, tz_name string, date_order string")
    q = normalised_stream(stream, "id", ["t"], "src", lookup).writeStream.format("memory").queryName("times").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("times").first().instant_us == 1483228800000000 - 9 * 3600 * 1000000
