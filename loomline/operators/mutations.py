"""Mutations as transformations of a snapshot. The present is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import json
from loomline.model import MAIN_LINE, Snapshot
from loomline.operators import hierarchy
from loomline.operators.stored import all_of, own_name


def create(table: DataFrame, rows: DataFrame) -> DataFrame:
    """New rows; columns that they lack are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def update(table: DataFrame, changes: DataFrame, now: Column | None = None, order: str | None = None) -> DataFrame:
    """changes: id, and for each column c to be changed the new c and a boolean set_c; where it is false or null the old value stays, so null can be set.

    Of several changes of one id the last counts, by the column ``order`` of changes if it is given, else by a hash of the change; the others are left out whole, and no row is doubled. updated_at of changed rows
    becomes now where there is such a column, whatever the changes say.
    """
    columns = [c for c in changes.columns if c != "id" and f"set_{c}" in changes.columns]
    key, patch = own_name(table, "_of"), own_name(table, "_patch")
    fields = [F.col(f"`{c}`").alias(f"new{n}") for n, c in enumerate(columns)] + [F.coalesce(F.col(f"`set_{c}`"), F.lit(False)).alias(f"set{n}") for n, c in enumerate(columns)]
    place = F.struct(*([F.col(f"`{order}`")] if order else []), F.xxhash64(*all_of(changes)))
    once = changes.groupBy(F.col("id").alias(key)).agg(F.max_by(F.struct(*fields, F.lit(True).alias("hit")), place).alias(patch))
    p = F.col(patch)
    out = table.join(once, F.col("id") == F.col(key), "left")
    values = {c: F.when(p[f"set{n}"], p[f"new{n}"]).otherwise(F.col(f"`{c}`")) for n, c in enumerate(columns)}
    if now is not None and "updated_at" in table.columns:
        values["updated_at"] = F.when(p["hit"], now).otherwise(F.col("updated_at"))
    return out.select(*[values[c].alias(c) if c in values else x for c, x in zip(table.columns, all_of(table), strict=True)])


def touch(table: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """updated_at of the rows with these ids."""
    key = own_name(table, "_of")
    hit = ids.select(F.col("id").alias(key)).distinct()
    changed = F.when(F.col(key).isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at")
    return table.join(hit, F.col("id") == F.col(key), "left").select(*[changed if c == "updated_at" else x for c, x in zip(table.columns, all_of(table), strict=True)])


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def delete_lines(snapshot: Snapshot, ids: DataFrame) -> Snapshot:
    """Lines and the messages on them."""
    gone = ids.select("id")
    return snapshot.with_(lines=delete(snapshot.lines, gone), messages=snapshot.messages.join(gone.withColumnRenamed("id", "line_id"), "line_id", "left_anti").select(*snapshot.messages.columns))


def deletion_status(lines: DataFrame, requested: DataFrame) -> DataFrame:
    """requested (id) with status: ok, unknown, protected (the main line) or has_children."""
    counts = hierarchy.child_counts(lines).select(F.col("parent_line_id").alias("id"), "children")
    held = requested.join(lines.select("id", F.lit(True).alias("_there")), "id", "left").join(counts, "id", "left")
    status = F.when(F.col("id").isNull() | F.col("_there").isNull(), "unknown").when(F.col("id") == MAIN_LINE, "protected").when(F.col("children") > 0, "has_children").otherwise("ok")
    return held.select("id", status.alias("status"))


def fallback_line(lines: DataFrame, deleted: str) -> DataFrame:
    """(id): where to go after a deletion: the main line, else the oldest other one."""
    return lines.filter(F.col("id") != deleted).orderBy(F.when(F.col("id") == MAIN_LINE, 0).otherwise(1), "created_at", "id").limit(1).select("id")


def delete_group(snapshot: Snapshot, group_id: str, tags: str = "unlink") -> Snapshot:
    """A tag group; its tags lose it, or are deleted too."""
    if tags not in ("unlink", "delete"):
        raise ValueError("tags is 'unlink' or 'delete'")
    of_group = F.coalesce(F.col("group_id") == group_id, F.lit(False))
    kept = snapshot.tags.filter(~of_group) if tags == "delete" else snapshot.tags.withColumn("group_id", F.when(~of_group, F.col("group_id")))
    return snapshot.with_(tags=kept, tag_groups=snapshot.tag_groups.filter(F.col("id") != group_id))


def reorder_groups(groups: DataFrame, ordered_ids: list[str]) -> DataFrame:
    """order becomes the place in the list; groups that are not in it keep theirs."""
    place = F.array_position(F.array(*[F.lit(x) for x in ordered_ids]), F.col("id")).cast("int") - 1 if ordered_ids else F.lit(-1)
    return groups.withColumn("order", F.when(place >= 0, place).otherwise(F.col("order")))


def move_messages(snapshot: Snapshot, ids: DataFrame, target: str, now: Column) -> Snapshot:
    """Messages to another line; the lines that they leave and the target count as changed. Messages already there stay as they are."""
    return _moved(snapshot, ids.select("id").distinct().withColumn("line_id", F.lit(target)), now)


def _moved(snapshot: Snapshot, places: DataFrame, now: Column) -> Snapshot:
    """Messages to lines by places (id, line_id; an id once); both lines of each that moves count as changed."""
    messages = snapshot.messages
    key, to = own_name(messages, "_of"), own_name(messages, "_to")
    held = messages.join(places.select(F.col("id").alias(key), F.col("line_id").alias(to)), F.col("id") == F.col(key), "left")
    moves = F.coalesce(F.col(to) != F.col("line_id"), F.lit(False))
    touched = held.filter(moves).select(F.explode(F.array("line_id", to)).alias("id")).distinct()
    values = {"line_id": F.when(moves, F.col(to)).otherwise(F.col("line_id")), "updated_at": F.when(moves, now).otherwise(F.col("updated_at"))}
    moved = held.select(*[values[c].alias(c) if c in values else x for c, x in zip(messages.columns, all_of(messages), strict=True)])
    return snapshot.with_(messages=moved, lines=touch(snapshot.lines, touched, now))


def affected_lines(messages: DataFrame, ids: DataFrame, target: str) -> DataFrame:
    """(id): the lines of the messages, and the target."""
    spark = messages.sparkSession
    return messages.join(ids.select("id"), "id", "left_semi").select(F.col("line_id").alias("id")).union(spark.createDataFrame([(target,)], "id string")).distinct()


def reparent(lines: DataFrame, source: str, target: str | None, now: Column) -> DataFrame:
    """A line under another, or as a root; a move that would make a cycle raises an error."""
    if target is not None:
        moves = lines.sparkSession.createDataFrame([(source, target)], "source string, target string")
        if hierarchy.would_cycle(lines, moves).first()["circular"]:
            raise ValueError(f"{source} under {target} would be a cycle")
    hit = F.col("id") == source
    return lines.withColumn("parent_line_id", F.when(hit, F.lit(target)).otherwise(F.col("parent_line_id"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def edit_message(messages: DataFrame, message_id: str, content: str, kind: str | None, now: Column) -> DataFrame:
    """New content; another type brings its default metadata, text none."""
    hit = F.col("id") == message_id
    turned = hit & F.lit(kind is not None) & ~F.col("type").eqNullSafe(F.lit(kind))
    metadata = json.default_metadata(F.lit(kind), F.lit(content), now)
    return messages.withColumns(
        {
            "metadata": F.when(turned, metadata).otherwise(F.col("metadata")),
            "type": F.when(turned, F.lit(kind)).otherwise(F.col("type")),
            "content": F.when(hit, F.lit(content)).otherwise(F.col("content")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    )


def create_message_with_line_update(snapshot: Snapshot, rows: DataFrame, now: Column) -> Snapshot:
    """New messages, and their lines changed."""
    return snapshot.with_(messages=create(snapshot.messages, rows), lines=touch(snapshot.lines, rows.select(F.col("line_id").alias("id")), now))


def undo_move(snapshot: Snapshot, before: DataFrame, now: Column) -> Snapshot:
    """Messages back to the lines that they have in ``before`` (id, line_id); both lines of each count as changed. Of several lines for an id the first by name counts."""
    return _moved(snapshot, before.groupBy("id").agg(F.min("line_id").alias("line_id")), now)
