"""Tags of lines, their use, and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_COLOUR = "#e5e7eb"


def uses(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """tags with count, how often lines have each; 0 where none has it."""
    counts = lines.select(F.explode("tag_ids").alias("id")).groupBy("id").agg(F.count("*").alias("count"))
    return tags.join(counts, "id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def rollup(lines: DataFrame, tags: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, id, name, count): every group with the sum of its tags' counts, and every tag without a group. Tags of groups that do not exist are in neither."""
    used = uses(lines, tags)
    sums = used.groupBy(F.col("group_id").alias("id")).agg(F.sum("count").alias("count"))
    of_groups = groups.join(sums, "id", "left").select(F.lit("group").alias("kind"), "id", "name", F.coalesce("count", F.lit(0)).alias("count"))
    alone = used.filter("group_id is null or group_id = ''").select(F.lit("tag").alias("kind"), "id", "name", "count")
    return of_groups.unionByName(alone)


def by_group(tags: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, name, tag_names) of every group, names in order; none for an empty group."""
    names = tags.groupBy(F.col("group_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("tag_names"))
    return groups.select("id", "name").join(names, "id", "left").withColumn("tag_names", F.coalesce("tag_names", F.array().cast("array<string>")))


def lines_with(lines: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """Lines that have a tag of this name."""
    having = lines.select("id", F.explode("tag_ids").alias("tag_id")).join(tags.filter(F.col("name") == name).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return lines.join(having.select("id"), "id", "left_semi")


def first_names(lines: DataFrame, tags: DataFrame, count: int = 2) -> DataFrame:
    """(id, tag_names): the names of a line's first tags in their order; ids that are no tag are skipped."""
    first = lines.select("id", F.posexplode(F.slice("tag_ids", 1, count)).alias("at", "tag_id"))
    named = first.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("id")
    names = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("tag_names"))
    return lines.select("id").join(names, "id", "left").withColumn("tag_names", F.coalesce("tag_names", F.array().cast("array<string>")))


def labels(lines: DataFrame, tags: DataFrame, count: int = 2) -> DataFrame:
    """(id, label): "#name" of the first tags, joined by spaces."""
    return first_names(lines, tags, count).select("id", F.array_join(F.transform("tag_names", lambda n: F.concat(F.lit("#"), n)), " ").alias("label"))


def missing_on(lines: DataFrame, tags: DataFrame, line_id: str) -> DataFrame:
    """Tags that a line does not have."""
    return tags.join(lines.filter(F.col("id") == line_id).select(F.explode("tag_ids").alias("id")), "id", "left_anti")


def available_on(lines: DataFrame, tags: DataFrame, groups: DataFrame, line_id: str) -> DataFrame:
    """(group_id, group_name, order, tag_names): what a line could get, by group; groups without any are skipped."""
    free = missing_on(lines, tags, line_id).groupBy("group_id").agg(F.array_sort(F.collect_list("name")).alias("tag_names"))
    return free.join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"), "order"), "group_id").select("group_id", "group_name", "order", "tag_names").orderBy("order")


def in_group_colour(tags: DataFrame, groups: DataFrame) -> DataFrame:
    """tags with the colour of their group where it has one, else their own or the default."""
    of = groups.select(F.col("id").alias("group_id"), F.col("color").alias("_group"))
    return tags.join(of, "group_id", "left").withColumn("color", F.coalesce("_group", "color", F.lit(DEFAULT_COLOUR))).select(*tags.columns)


def flattened(tags: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, id, name, group_id): the groups and their tags in one list; tags of no known group are left out."""
    of_group = tags.join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    return groups.select(F.lit("group").alias("kind"), "id", "name", F.col("id").alias("group_id")).unionByName(of_group.select(F.lit("tag").alias("kind"), "id", "name", "group_id"))
