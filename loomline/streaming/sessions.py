"""Structured Streaming: sessions of a stream of messages, and a snapshot kept up to date by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.sources.parts import PARTS, Parts


def session_counts(stream: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(line_id, start, end, messages) of sessions; end is the last message's time. A session comes out when the watermark has passed it.

    Gaps of exactly ``gap`` do not part a session, as in the batch form. Replayed ids within the lateness are dropped.
    """
    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    once = timed.dropDuplicatesWithinWatermark(["id"])
    counted = once.groupBy("line_id", F.session_window("timestamp", gap)).agg(F.count("*").alias("messages"), F.max("timestamp").alias("end"))
    return counted.select("line_id", F.col("session_window.start").alias("start"), "end", "messages")


def keep_snapshot(stream: DataFrame, path: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Merges each batch of changed messages into a table of parts under the path, which Parts(spark, path).read() gives; deleted ones go. Finishes with what is there.

    A batch rewrites the parts that its ids fall in, and no others; one that is run again is left out, so failures do no harm.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.drop("_corrupt_record")
        table = Parts(batch.sparkSession, path) if Parts.there(batch.sparkSession, path) else Parts.create(rows.limit(0), path, parts=parts)
        table.merge(rows, number, gone=F.col("deleted"))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
