"""Run events, in batch and as a stream: counts, windows, sessions, distinct events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
GAP = "6 hours"


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need an instant, files hold local times: these are read as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def metrics(events: DataFrame) -> DataFrame:
    """Events by kind with how many took long and how many carry properties."""
    return events.groupBy("event").agg(F.count("*").alias("n"), F.count_if(F.col("elapsed") >= 50).alias("slow"), F.count_if(F.col("props").isNotNull()).alias("with_props"), F.countDistinct("run_id").alias("runs"))


def windows(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Events per tumbling window and kind. The same plan for batch and stream."""
    return events.groupBy(F.window("ts", size).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event", "n")


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """A run's events with less than the gap between them make a session."""
    return events.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("run_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def first_of_each(events: DataFrame) -> DataFrame:
    """The earliest event of each run and kind; ties go to the smaller id."""
    w = Window.partitionBy("run_id", "event").orderBy("ts", "event_id")
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def stages(events: DataFrame) -> DataFrame:
    """Each event with the time since the run's previous one, in seconds."""
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    return events.withColumn("since", F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)))


def stream(spark: SparkSession, path: str, watermark: str = "7 days") -> DataFrame:
    """The event table as a file stream with a watermark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(EVENT_SCHEMA)  # streams read folders: a lone file by its name within its own
    s = reader.parquet(path) if folder else reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return timed(s.select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("event"), F.col("value").alias("elapsed"), "props")).withWatermark("ts", watermark)


def run_to_end(frame: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now, into a memory table, and returns that. A failed query raises."""
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return frame.sparkSession.table(name)


def into_batches(frame: DataFrame, sink, checkpoint: str, mode: str = "update", dead_letters: str | None = None):
    """Hands each micro-batch to sink(df, id); reports those at which the sink raised, and keeps their rows.

    dead_letters: folder for the rows of such batches, as Parquet by batch, so that the stream goes on without losing any;
    beside the checkpoint unless given. If they can't be written either, the query fails and the batch comes again.
    """
    failures: list[tuple[int, str]] = []
    kept = dead_letters or f"{checkpoint.rstrip('/')}-dead-letters"

    def each(df: DataFrame, batch: int) -> None:
        try:
            sink(df, batch)
        except Exception as e:  # isolated, as a broken listener must not end a run
            df.write.mode("overwrite").parquet(f"{kept}/batch={batch}")
            failures.append((batch, f"{type(e).__name__}: {e}"))

    q = frame.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return failures
