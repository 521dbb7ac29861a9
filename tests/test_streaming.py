from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.streaming import jobs


def test_late_rows_are_left_out(spark, tmp_path):
    """A row behind the watermark of an earlier batch does not count any more."""
    schema, src = "ts timestamp, event_type string, value double, user_id long", str(tmp_path / "in")

    def put(rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double, user_id long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    out = tmp_path / "out"

    def run():
        df = jobs.daily_downsample(spark.readStream.schema(schema).parquet(src))
        q = df.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(out / f"b{i}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    put([("2024-01-05 10:00:00", "a", 1.0, 1)])
    run()
    put([("2024-01-01 10:00:00", "a", 9.0, 1), ("2024-01-05 11:00:00", "a", 3.0, 1)])
    run()
    last = sorted(out.iterdir())
    rows = [tuple(r) for p in last for r in spark.read.parquet(str(p)).collect()]
    assert ("2024-01-05", "a", 1.0, 3.0, 2, 2.0) in rows and not [r for r in rows if r[0] == "2024-01-01"]


def test_accept_new_once(spark, sf, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k long, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        jobs.accept_new(spark.readStream.schema(schema).parquet(src), "k", out, str(tmp_path / "cp")).awaitTermination()

    run()
    spark.createDataFrame([(2, "d"), (3, "e")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]
