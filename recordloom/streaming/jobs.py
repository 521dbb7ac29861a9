"""Structured Streaming: downsampling, de-duplication, new against existing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from recordloom.common import scratch_path


def daily_downsample(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Lowest, highest, count and mean per day and type; rows later than the watermark are left out."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    out = w.agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count("*").alias("n"), F.round(F.avg("value"), 1).alias("mean"))
    return out.select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "lowest", "highest", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events that lie closer than `gap`."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n_events")).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n_events")


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events without repeats within the watermark; state is bounded by it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def accept_new(stream: DataFrame, key: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append to the Parquet `table` the stream's rows whose key it does not hold; each batch once.

    A batch is written into its own folder, so a batch that is repeated after a failure
    replaces itself; it is held against all earlier ones, read as one table.
    """
    schema = stream.schema

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
            known = spark.read.schema(whole).parquet(table).where(F.col("batch") < batch_id).select(key)
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what is there, into a table of the shared folder, and return that table.

    In complete mode each batch replaces the result, in append mode it adds a folder of its own.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, "stream")

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={batch_id}")

    q = df.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def events_stream(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
