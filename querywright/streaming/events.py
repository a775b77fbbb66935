"""The same aggregations over files that arrive: Structured Streaming with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch
from ..tables import Registry, load

R = Registry()
#: How late an event may come behind the newest one; files are read in no order of event time.
LATE = "366 days"


def windowed_counts(events: DataFrame, *, size: str = "1 day", late: str | None = None) -> DataFrame:
    """Events and their summed value by type and window of event time; ``late`` bounds the state of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


_DAILY = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM events GROUP BY ALL"


@R.frame(_DAILY)
def window_daily_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@R.frame(_DAILY)
def window_daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of its files, run to its end; each batch's updated windows replace the earlier ones."""
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    # Updated windows only are written, and state older than the watermark is let go.
    query = windowed_counts(stream, late=LATE).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    newest = F.max_by(F.struct("n", "total"), "batch").alias("newest")
    return spark.read.parquet(f"{out}/rows").groupBy("start", "event_type").agg(newest).select("start", "event_type", "newest.n", "newest.total")
