"""Sessions: messages of a line with short gaps between them, and the digest of sessions by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import dates, json
from loomline.operators import hierarchy
from loomline.operators.ordered import with_previous, with_running_sum


def display_text(type_: Column, content: Column, metadata: Column) -> Column:
    """A message as an export shows it: tasks with their state, documents by their first 30 characters, others by their first 200."""
    task = F.concat(content, F.lit(" - "), type_, F.lit(" - "), json.completion_label(metadata))
    document = F.concat(type_, F.lit(" - "), F.coalesce(F.left(content, F.lit(30)), F.lit("")))
    return F.when(type_ == "task", task).when(type_ == "document", document).otherwise(F.coalesce(F.left(content, F.lit(200)), F.lit("")))


def exported(messages: DataFrame, least: int = 7) -> DataFrame:
    """Messages with a type, surely not deleted, and with so many characters at least."""
    return messages.filter(F.col("type").isNotNull() & ~F.col("deleted") & (F.length("content") >= least))


def with_session(messages: DataFrame, gap_minutes: int = 30, bucket: str = "day") -> DataFrame:
    """messages with session, a number from 1 within each line: a new one begins after a gap of more than ``gap_minutes``.

    Messages of one time share a session. A line with very many messages is worked on day by day.
    """
    timed = with_previous(messages, "timestamp", "id", ["timestamp"], ["line_id"], bucket)
    starts = F.col("prev_timestamp").isNull() | (dates.seconds_between(F.col("prev_timestamp"), F.col("timestamp")) > gap_minutes * 60)
    return with_running_sum(timed, F.when(starts, 1).otherwise(0), "session", "timestamp", "id", ["line_id"], bucket).drop("prev_timestamp")


def session_digest(messages: DataFrame, lines: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(full_path, start_time, end_time, combined_content) of every session of every line that a root leads to.

    Texts are joined by line breaks in the order of time and id. Lines that no root leads to are left out with their messages.
    """
    shown = exported(messages).withColumn("display_text", display_text(F.col("type"), F.col("content"), F.col("metadata")))
    sessions = with_session(shown.select("id", "line_id", "timestamp", "display_text"), gap_minutes)
    texts = F.array_sort(F.collect_list(F.struct("timestamp", "id", "display_text")))
    merged = sessions.groupBy("line_id", "session").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.array_join(F.transform(texts, lambda t: t["display_text"]), "\n").alias("combined_content"))
    path = hierarchy.paths(lines).select(F.col("id").alias("line_id"), "full_path")
    return merged.join(path, "line_id").select("full_path", dates.minute_text(F.col("start")).alias("start_time"), dates.minute_text(F.col("end")).alias("end_time"), "combined_content")


def in_export_order(digest: DataFrame) -> DataFrame:
    return digest.orderBy("full_path", F.desc("start_time"))
