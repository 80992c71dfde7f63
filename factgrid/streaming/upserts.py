"""Extension: a stream of entry changes applied to an index in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index
from ..sources.records import number_rows


def dense(df: DataFrame, order: str) -> DataFrame:
    """Number the rows of a micro-batch from 0 in their order."""
    return number_rows(df.orderBy(order).withColumn("__at", F.monotonically_increasing_id()), "__at").withColumnRenamed("n", "pos")


def upsert_stream(changes: DataFrame, path: str, order: str, checkpoint: str):
    """Apply ``changes (id, text, order)`` to the index at ``path``; of equal ids the greatest order wins.

    Each batch is one delta layer of the stored index, entered together with
    its number: a batch that is run again after a failure changes nothing. An
    index that is not there yet is made with field maps and vectors.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        delta = dense(index.keep_last(batch, "id", order), order).select("pos", "id", "text")
        if not index.exists(spark, path):
            try:
                index.save(index.completed(delta.limit(0), ["pos", "id", "text", "fields", "hv"]), path, expected=0)
            except index.Conflict:
                pass  # another stream was first
        index.append(delta, path, source=checkpoint, batch=number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(events: DataFrame, ts: str, key: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Per window and key the count and sum; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
