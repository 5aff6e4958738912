"""Tasks: the table of tasks, its filters, orders and counts, and time spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import dates, json, text
from loomline.model import PRIORITY_RANK
from loomline.operators import ordered

SORT_KEYS = ("content", "completed", "priority", "line_name", "created_at", "updated_at", "completed_at")


def rank(priority: Column) -> Column:
    out = F.lit(0)
    for name, n in PRIORITY_RANK.items():
        out = F.when(priority == name, n).otherwise(out)
    return out


def rows(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, content, completed, priority, line_id, line_name, created_at, updated_at, completed_at) of tasks that are not deleted.

    Unknown and missing priorities are medium, a line without a name is called by its id.
    """
    tasks = messages.filter((F.col("type") == "task") & ~F.coalesce(F.col("deleted"), F.lit(False))).withColumn("_fields", json.parsed(F.col("metadata")))
    named = tasks.join(lines.select(F.col("id").alias("line_id"), F.col("name").alias("_name")), "line_id", "left")
    field = lambda key: json.field(F.col("_fields"), key)
    priority, completed = field("priority"), F.coalesce(field("completed") == "true", F.lit(False))
    kind = dict(messages.dtypes)["timestamp"]
    return named.select(
        "id", "content", completed.alias("completed"), F.when(priority.isin(*PRIORITY_RANK), priority).otherwise("medium").alias("priority"), "line_id",
        F.coalesce("_name", "line_id").alias("line_name"), F.col("timestamp").alias("created_at"), "updated_at", field("completedAt").try_cast(kind).alias("completed_at"),
    )


def filtered(tasks: DataFrame, completed: bool | None = None, priorities: list[str] = (), line_names: list[str] = (), search: str = "") -> DataFrame:
    """An empty list, a blank search and None filter nothing; the search itself is not trimmed."""
    if completed is not None:
        tasks = tasks.filter(F.col("completed") == completed)
    if priorities:
        tasks = tasks.filter(F.col("priority").isin(*priorities))
    if line_names:
        tasks = tasks.filter(F.col("line_name").isin(*line_names))
    return tasks.filter(text.contains_ci(F.col("content"), search)) if search.strip() else tasks


def sort_columns(key: str, descending: bool = False, collation: str | None = "ja") -> list[Column]:
    """An order by one key, missing dates first, ties by id. Texts compare as in the collation, or by code points without one."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key}")
    c = F.col(key)
    if key == "priority":
        c = rank(c)
    elif key in ("content", "line_name") and collation:
        c = F.collate(c, collation)
    return [c.desc_nulls_last() if descending else c.asc_nulls_first(), F.col("id")]


def toggled(key: str, descending: bool, chosen: str) -> tuple[str, bool]:
    """The order after a key was chosen: the same one turns round, another begins ascending."""
    return (key, not descending) if key == chosen else (chosen, False)


def sorted_(tasks: DataFrame, key: str, descending: bool = False, collation: str | None = "ja") -> DataFrame:
    return tasks.orderBy(*sort_columns(key, descending, collation))


def with_position(tasks: DataFrame, key: str, descending: bool = False, collation: str | None = "ja", name: str = "position") -> DataFrame:
    """tasks with their place, from 1, in the order by a key: a number to sort and page by afterwards, without the collation.

    The place is worked out in sorted ranges, so a large table is no single task's.
    """
    return ordered.with_position(tasks, sort_columns(key, descending, collation), name)


def counts_by_priority(tasks: DataFrame) -> DataFrame:
    """(priority, tasks) for each of the priorities, 0 where there are none."""
    spark: SparkSession = tasks.sparkSession
    keys = spark.createDataFrame([(p,) for p in PRIORITY_RANK], "priority string")
    return F.broadcast(keys).join(tasks.groupBy("priority").agg(F.count("*").alias("tasks")), "priority", "left").withColumn("tasks", F.coalesce("tasks", F.lit(0)))


def counts_by_line(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("line_name").agg(F.count("*").alias("tasks"))


def totals(tasks: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("completed"), F.lit(False))
    return tasks.agg(F.count_if(done).alias("completed"), F.count_if(~done).alias("incomplete"), F.count("*").alias("total"))


def priorities(tasks: DataFrame) -> DataFrame:
    """Distinct priorities with rank, the highest first."""
    return tasks.select("priority", rank(F.col("priority")).alias("rank")).distinct().orderBy(F.desc("rank"))


def toggle_completed(metadata: Column, now: Column) -> Column:
    """Metadata with completion turned round: completedAt is set, or taken out."""
    fields = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    rest = F.map_filter(fields, lambda k, v: ~k.isin("completed", "completedAt") & v.isNotNull())
    done = json.is_completed(metadata)
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.map_concat(rest, F.when(done, F.create_map(F.lit("completed"), F.lit("false"))).otherwise(F.create_map(F.lit("completed"), F.lit("true"), F.lit("completedAt"), stamp))))


def in_progress(metadata: Column) -> Column:
    """Checked in and not out again; empty texts count as missing."""
    there = lambda key: F.coalesce(json.value(metadata, key) != "", F.lit(False))
    return there("checkedInAt") & ~there("checkedOutAt")


def time_spent(metadata: Column, now: Column, clamp: bool = True) -> Column:
    """Minutes recorded, and those since the check-in if it runs; clamp: never less for it."""
    recorded = F.coalesce(json.value(metadata, "timeSpent").try_cast("double"), F.lit(0.0))
    start = json.value(metadata, "checkedInAt").try_cast("timestamp")
    running = F.floor(dates.seconds_between(start, now) / 60 + 0.5).cast("double")
    running = F.greatest(running, F.lit(0.0)) if clamp else running
    return recorded + F.when(in_progress(metadata), F.coalesce(running, F.lit(0.0))).otherwise(0.0)


def checked_out_at(start: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, start)


def session_totals(metadata: Column, now: Column) -> Column:
    """struct(working, total, last, has_previous): minutes in all, those of the last session that has ended, and whether there was time before the present or last session."""
    spent = F.coalesce(json.value(metadata, "timeSpent").try_cast("double"), F.lit(0.0))
    moment = lambda key: json.value(metadata, key).try_cast("timestamp")
    working = in_progress(metadata)
    running = dates.duration_minutes(moment("checkedInAt"), now)
    given = lambda key: F.coalesce(json.value(metadata, key) != "", F.lit(False))
    last = F.when(~working & given("checkedInAt") & given("checkedOutAt"), dates.duration_minutes(moment("checkedInAt"), moment("checkedOutAt")))
    before = F.when(working | last.isNull(), spent > 0).otherwise(spent > last)
    return F.struct(working.alias("working"), (spent + F.when(working, running).otherwise(0)).alias("total"), last.alias("last"), before.alias("has_previous"))
