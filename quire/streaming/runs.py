"""Structured Streaming over files: idempotent logs, late data, keyed state.

Every stream reads what has arrived, in bounded batches, writes to the shared folder with its checkpoint there and
stops; run again with the same checkpoint it goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.logs import place


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    """Files of a folder as they arrive; as a pattern, the path may also be one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def settle_stream(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and read what it wrote. Modes other than append go through foreachBatch,
    where each batch is written under its own number, so that a batch tried again replaces itself."""
    spark = stream.sparkSession
    out, checkpoint = place(spark, name), place(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part-of={n}")).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def first_sight(stream: DataFrame, key: str, time: str, late: str = "3650 days") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per window of event time; windows close when the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def retry_states(stream: DataFrame, key: str, status: str) -> DataFrame:
    """(key, failures, state) of every file that had a run in a batch, with the attempts of all batches before."""
    s = F.lower(F.trim(status))
    counts = stream.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count_if(s == "failed").alias("failures"), F.count_if(s == "success").alias("done"))
    state = F.when(F.col("done") > 0, "done").when(F.col("failures") >= 3, "permanently_failed").otherwise("retry")
    return counts.select("key", "failures", state.alias("state"))
