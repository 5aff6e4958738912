"""Edits of nested tags: a column of arrays of tags that have tags below them, as deep as the column's type goes.

A tag is a struct with an id and, but for the lowest level, an array ``subtags`` of structs. Every edit is one expression of higher-order functions, made from the type of the column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BELOW = "subtags"


def _open(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as what an edit puts in may have them."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_open(kind.elementType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _open(f.dataType), True) for f in kind])
    return kind


def _level(df: DataFrame, column: str) -> T.StructType:
    kind = _open(df.schema[column].dataType)
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType) or "id" not in kind.elementType.names:
        raise ValueError(f"{column} is no array of tags with an id")
    return kind.elementType


def _below(level: T.StructType) -> T.StructType | None:
    return level[BELOW].dataType.elementType if BELOW in level.names else None


def _fitted(tag: Column, has: T.StructType, wants: T.StructType) -> Column:
    """A tag of one level as one of another; what it does not have is null. Tags below it that the other level has no room for are an error, not lost."""
    fields = []
    for f in wants:
        if f.name != BELOW:
            fields.append((tag[f.name] if f.name in has.names else F.lit(None)).cast(f.dataType).alias(f.name))
        elif _below(has) is None:
            fields.append(F.lit(None).cast(f.dataType).alias(BELOW))
        else:
            fields.append(F.transform(tag[BELOW], lambda t: _fitted(t, _below(has), _below(wants))).alias(BELOW))
    made = F.struct(*fields)
    if _below(wants) is None and _below(has) is not None:
        made = F.when(F.coalesce(F.size(tag[BELOW]), F.lit(0)) > 0, F.raise_error(F.lit("the column has no room for tags so deep")).cast(wants)).otherwise(made)
    return made


def _with_below(tag: Column, level: T.StructType, below: Column) -> Column:
    """The tag with other tags below it."""
    return F.struct(*[(below.cast(f.dataType) if f.name == BELOW else tag[f.name]).alias(f.name) for f in level])


def _everywhere(tags: Column, level: T.StructType, edit: Callable[[Column, T.StructType], Column | None], hit: Callable[[Column], Column]) -> Column:
    """Tags with edit in the place of those that hit, at all levels; below one that hits nothing is looked at."""

    def one(tag: Column) -> Column:
        lower = _below(level)
        same = tag if lower is None else _with_below(tag, level, _everywhere(tag[BELOW], lower, edit, hit))
        made = edit(tag, level)
        return same if made is None else F.when(hit(tag), made).otherwise(same)

    return F.transform(tags, one)


def add(df: DataFrame, column: str, tag: Column) -> DataFrame:
    """A tag more at the end of the top level; a null column becomes one of this tag. tag: a struct with any of the fields."""
    level = _level(df, column)
    new = _fitted(tag, _type(df, tag), level)
    return df.withColumn(column, F.array_append(F.coalesce(F.col(f"`{column}`"), F.array().cast(_open(df.schema[column].dataType))), new))


def update(df: DataFrame, column: str, tag: Column) -> DataFrame:
    """The tag in the place of every one with its id, with what is below them; an id that no tag has changes nothing."""
    kind = _type(df, tag)
    return df.withColumn(column, _everywhere(F.col(f"`{column}`"), _level(df, column), lambda _, level: _fitted(tag, kind, level), lambda t: F.coalesce(t["id"] == tag["id"], F.lit(False))))


def delete(df: DataFrame, column: str, tag_id: Column | str) -> DataFrame:
    """Without the tags of this id and what is below them, at whatever level. An array may become empty; a null one stays."""
    gone = F.lit(tag_id) if isinstance(tag_id, str) else tag_id

    def without(tags: Column, level: T.StructType) -> Column:
        kept = F.filter(tags, lambda t: F.coalesce(t["id"] != gone, F.lit(True)))
        lower = _below(level)
        return kept if lower is None else F.transform(kept, lambda t: _with_below(t, level, without(t[BELOW], lower)))

    return df.withColumn(column, without(F.col(f"`{column}`"), _level(df, column)))


def add_below(df: DataFrame, column: str, parent_id: Column | str, tag: Column) -> DataFrame:
    """A tag more below every one of an id, after those that are there; none at the lowest level, where it is an error, and nothing for an id that no tag has."""
    parent, kind = F.lit(parent_id) if isinstance(parent_id, str) else parent_id, _type(df, tag)

    def more(t: Column, level: T.StructType) -> Column:
        lower = _below(level)
        if lower is None:
            return F.raise_error(F.lit("the column has no room for tags so deep")).cast(level)
        return _with_below(t, level, F.array_append(F.coalesce(t[BELOW], F.array().cast(level[BELOW].dataType)), _fitted(tag, kind, lower)))

    return df.withColumn(column, _everywhere(F.col(f"`{column}`"), _level(df, column), more, lambda t: F.coalesce(t["id"] == parent, F.lit(False))))


def _type(df: DataFrame, tag: Column) -> T.StructType:
    return _open(df.select(tag.alias("t")).schema["t"].dataType)


def flattened(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, path, id, name): every tag of every level, with the ids above it and its own joined by "/"."""
    level, out = _level(df, column), None
    at = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(F.col(f"`{column}`")).alias("_tag")).withColumn("_path", F.col("_tag.id"))
    while True:
        here = at.select(*[F.col(f"`{k}`") for k in keys], F.col("_path").alias("path"), F.col("_tag.id").alias("id"), F.col("_tag.name").alias("name"))
        out = here if out is None else out.unionByName(here)
        level = _below(level)
        if level is None:
            return out
        at = at.select(*[F.col(f"`{k}`") for k in keys], "_path", F.explode(F.col("_tag")[BELOW]).alias("_tag")).withColumn("_path", F.concat("_path", F.lit("/"), F.col("_tag.id")))
