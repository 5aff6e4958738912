"""Counts and summaries of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import dates, text
from loomline.model import ALL_LINES, MAIN_LINE
from loomline.operators import hierarchy


def kept() -> Column:
    return ~F.coalesce(F.col("deleted"), F.lit(False))


def message_counts(messages: DataFrame, lines: DataFrame, deleted: bool = True) -> DataFrame:
    """(id, messages) for every line, 0 where there are none."""
    counts = (messages if deleted else messages.filter(kept())).groupBy(F.col("line_id").alias("id")).agg(F.count("*").alias("messages"))
    return lines.select("id").join(counts, "id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def character_counts(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, messages, characters) of messages that are not deleted, 0 where there are none."""
    counts = messages.filter(kept()).groupBy(F.col("line_id").alias("id")).agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("characters"))
    zero = {"messages": F.coalesce("messages", F.lit(0)), "characters": F.coalesce("characters", F.lit(0))}
    return lines.select("id").join(counts, "id", "left").withColumns(zero)


def last_messages(messages: DataFrame) -> DataFrame:
    """(line_id, id, timestamp, content) of the newest message of each line."""
    newest = F.max_by(F.struct("id", "timestamp", "content"), F.struct("timestamp", "id")).alias("m")
    return messages.filter(kept()).groupBy("line_id").agg(newest).select("line_id", "m.*")


def statistics(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: total_lines, total_messages, total_branches, max_depth, avg_messages_per_line (0 without lines)."""
    depths = hierarchy.depths(lines).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    of_lines = lines.agg(F.count("*").alias("total_lines"), F.count_if(F.col("parent_line_id").isNotNull() & (F.col("parent_line_id") != "")).alias("total_branches"))
    joined = of_lines.crossJoin(messages.agg(F.count("*").alias("total_messages"))).crossJoin(depths)  # one row each
    average = F.coalesce(F.try_divide(F.col("total_messages").cast("double"), F.col("total_lines").cast("double")), F.lit(0.0))
    return joined.select("total_lines", "total_messages", "total_branches", "max_depth", average.alias("avg_messages_per_line"))


def by_depth(lines: DataFrame) -> DataFrame:
    return hierarchy.depths(lines).filter("depth IS NOT NULL").groupBy("depth").agg(F.count("*").alias("lines"))


def recent(lines: DataFrame, current: str | None = None, count: int = 30) -> DataFrame:
    """The lines changed last, without the current, the main and the virtual one."""
    hidden = [x for x in (current, MAIN_LINE, ALL_LINES) if x]
    return history(lines.filter(~F.col("id").isin(*hidden))).limit(count)


def history(lines: DataFrame) -> DataFrame:
    return lines.withColumn("changed_at", F.coalesce("updated_at", "created_at")).orderBy(F.desc("changed_at"), "id")


def display_info(messages: DataFrame, lines: DataFrame, now: Column) -> DataFrame:
    """(id, preview, relative_time, branches) of each line: its last message in 20 characters, when it was, and its number of children."""
    last = last_messages(messages).select(F.col("line_id").alias("id"), text.shortened(F.col("content"), 20).alias("preview"), "timestamp")
    below = hierarchy.child_counts(lines).select(F.col("parent_line_id").alias("id"), "children")
    out = lines.select("id", "updated_at", "created_at").join(last, "id", "left").join(below, "id", "left")
    when = dates.relative_time(F.coalesce("timestamp", "updated_at", "created_at"), now)
    return out.select("id", F.coalesce("preview", F.lit("")).alias("preview"), when.alias("relative_time"), F.coalesce("children", F.lit(0)).alias("branches"))


def branching_from(messages: DataFrame, lines: DataFrame, message_id: str) -> DataFrame:
    """The child lines of the line of a message."""
    line = messages.filter(F.col("id") == message_id).select(F.col("line_id").alias("parent_line_id"))
    return lines.join(line, "parent_line_id", "left_semi")


def find(lines: DataFrame, name_or_id: str) -> DataFrame:
    """The line of this id, else of this name, else the main line, else the oldest one."""
    c = F.col
    order = F.when(c("id") == name_or_id, 0).when(c("name") == name_or_id, 1).when(c("id") == MAIN_LINE, 2).otherwise(3)
    return lines.orderBy(order, "created_at", "id").limit(1)


def of_message(messages: DataFrame, lines: DataFrame, message_id: str) -> DataFrame:
    return lines.join(messages.filter(F.col("id") == message_id).select(F.col("line_id").alias("id")), "id", "left_semi")


def level_counts(log: DataFrame, level: str = "level") -> DataFrame:
    """(level, count) of a log."""
    return log.groupBy(level).agg(F.count("*").alias("count"))
