"""Integrity: rows that point at nothing, lines that point at themselves, repairs and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_messages(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """Messages whose line does not exist."""
    return messages.join(lines.select(F.col("id").alias("line_id")), "line_id", "left_anti")


def dangling_parents(lines: DataFrame) -> DataFrame:
    """Lines with a parent id that is no line's."""
    named = lines.filter("parent_line_id is not null")
    return named.join(lines.select(F.col("id").alias("parent_line_id")), "parent_line_id", "left_anti")


def unused_lines(messages: DataFrame, lines: DataFrame) -> DataFrame:
    return lines.join(messages.select(F.col("line_id").alias("id")), "id", "left_anti")


def self_references(lines: DataFrame) -> DataFrame:
    return lines.filter("id = parent_line_id")


def without_self_references(lines: DataFrame) -> DataFrame:
    return lines.withColumn("parent_line_id", F.when(F.col("parent_line_id") != F.col("id"), F.col("parent_line_id")))


def with_placeholders(messages: DataFrame, lines: DataFrame, name: str = "[復元] ") -> DataFrame:
    """lines and, for each line that only messages know, a new one under a name made of its id."""
    lost = orphan_messages(messages, lines).groupBy("line_id").agg(F.min("timestamp").alias("first"))
    made = lost.select(F.col("line_id").alias("id"), F.concat(F.lit(name), F.col("line_id")).alias("name"), F.col("first").cast(lines.schema["created_at"].dataType).alias("created_at"))
    return lines.unionByName(made, allowMissingColumns=True)


def missing_by_content(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of source with a content that no row of target has; null counts as empty."""
    text = F.coalesce(F.col("content"), F.lit(""))
    return source.withColumn("_text", text).join(target.select(text.alias("_text")), "_text", "left_anti").drop("_text")


def ids_not_found(asked: DataFrame, table: DataFrame) -> DataFrame:
    return asked.join(table, "id", "left_anti")


def ids_found(asked: DataFrame, table: DataFrame) -> DataFrame:
    return table.join(asked, "id", "left_semi")


def counts(messages: DataFrame) -> DataFrame:
    """One row: total, deleted and kept messages, and how many lines they are on."""
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    return messages.agg(F.count("*").alias("total"), F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"), F.count_distinct("line_id").alias("lines"))


def report(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """(check, rows): how many rows break each rule; all are 0 in a sound snapshot."""
    from loomline.operators.hierarchy import depths

    checks = {"message_without_line": orphan_messages(messages, lines), "line_without_parent": dangling_parents(lines), "self_reference": self_references(lines), "cycle": depths(lines).filter("ended = 'cycle'")}
    out = None
    for name, found in checks.items():
        row = found.agg(F.lit(name).alias("check"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out
