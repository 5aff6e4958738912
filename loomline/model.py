"""The data model: a log of typed messages on lines, lines that form a tree, tags and their groups."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType(), False), T.StructField("content", T.StringType(), False), T.StructField("timestamp", T.TimestampType(), False), T.StructField("updated_at", T.TimestampType()),
        T.StructField("line_id", T.StringType(), False), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("has_bookmark", T.BooleanType()), T.StructField("author", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())), T.StructField("type", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("deleted", T.BooleanType()),
        T.StructField("deleted_at", T.TimestampType()),
    ]
)
LINES = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("parent_line_id", T.StringType()), T.StructField("tag_ids", T.ArrayType(T.StringType())), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)
TAGS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("color", T.StringType()), T.StructField("group_id", T.StringType())])
TAG_GROUPS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("color", T.StringType()), T.StructField("order", T.IntegerType())])

#: Fixed values of the model.
MAIN_LINE, ALL_LINES = "main", "__timeline__"
MESSAGE_TYPES = ("text", "task", "document", "session")
PRIORITY_RANK = {"urgent": 4, "high": 3, "medium": 2, "low": 1}
PAGE_SIZE = 200


@dataclass(frozen=True)
class Snapshot:
    """The four tables at one time. Mutations give a new snapshot; nothing is changed in place."""

    messages: DataFrame
    lines: DataFrame
    tags: DataFrame
    tag_groups: DataFrame

    def with_(self, **tables: DataFrame) -> Snapshot:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {"tag_groups": self.tag_groups, "tags": self.tags, "lines": self.lines, "messages": self.messages}
