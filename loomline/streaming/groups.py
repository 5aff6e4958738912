"""Display groups over a stream: messages of a line with less than so many minutes from each to the next, closed as the watermark passes.

``session_window`` joins messages that are exactly its gap apart, which the groups of a timeline do not; times are whole microseconds, so its gap is one less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_groups(stream: DataFrame, minutes: int = 10, lateness: str = "1 hour") -> DataFrame:
    """(line_id, start, end, messages, first_id) of the groups of each line, each once the watermark is so many minutes past its end; the rows of timeline.groups_of_lines.

    stream: id, line_id, timestamp and other columns of any name. Order of arrival does not matter within the lateness, and replayed ids count once; messages that come later than that are dropped. Rows without id or
    time are left out, those without a line are one line. The state is the ids of the lateness, over all tasks, and a row for each group of a line. Sets the session's state store to RocksDB, as the ids may be many.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select("id", "line_id", F.col("timestamp").cast("timestamp").alias("timestamp")).filter("id IS NOT NULL AND timestamp IS NOT NULL").withWatermark("timestamp", lateness)
    once = rows.dropDuplicatesWithinWatermark(["line_id", "id"])
    window = F.session_window("timestamp", f"{minutes * 60_000_000 - 1} microseconds")
    found = once.groupBy("line_id", window).agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("messages"), F.min_by("id", F.struct("timestamp", "id")).alias("first_id"))
    return found.select("line_id", "start", "end", "messages", "first_id")
