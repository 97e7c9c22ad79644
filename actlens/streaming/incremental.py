"""Mergeable statistics over a stream of activations: micro-batches add to tables that combine by addition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_sums(acts: DataFrame) -> DataFrame:
    """(feature, n, total, square, most): what a batch adds for each latent."""
    v = F.col("value")
    return acts.groupBy("feature").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("square"), F.max(v).alias("most"))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's sums once under its batch id: a batch that is run again after a failure replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_sums(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def combined(sums: DataFrame) -> DataFrame:
    """(feature, n, mean, std, most) from the rows of all batches."""
    s = sums.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("s"), F.sum("square").alias("q"), F.max("most").alias("most"))
    mean = F.col("s") / F.col("n")
    return s.select("feature", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"), "most")


def late_counts(stream: DataFrame, time: str, delay: str = "7 days", window: str = "1 day") -> DataFrame:
    """(day, feature, n, most): per latent and event day, with rows later than `delay` left out by the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "feature").agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("w.start").alias("day"), "feature", "n", "most")
