"""CSV exchange: export with a header, ISO times and JSON in quotes; import without guessing types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.model import LINES, MESSAGES, TAG_GROUPS, TAGS, Snapshot
from loomline.operators.sync import insert_if_absent
from loomline.sources import csv_records

#: Columns of each file; images are not exported.
COLUMNS = {
    "tag_groups": (TAG_GROUPS, ["id", "name", "color", "order"]), "tags": (TAGS, ["id", "name", "color", "group_id"]), "lines": (LINES, ["id", "name", "parent_line_id", "tag_ids", "created_at", "updated_at"]),
    "messages": (MESSAGES, ["id", "content", "timestamp", "updated_at", "line_id", "tags", "has_bookmark", "author", "type", "metadata", "deleted", "deleted_at"]),
}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
JSON_COLUMNS = {"metadata"}


def as_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, ISO)
    return column.cast("string")


def csv_field(column: Column, kind: T.DataType, json: bool = False) -> Column:
    """A value as it stands in a line: nothing for null, quotes around JSON and around what has a comma, a line break or a quote."""
    text = as_text(column, kind)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    always = json or isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    return F.coalesce(quoted if always else F.when(text.rlike('[,\n"]'), quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): the rows as lines of CSV, without the header."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`"), kinds[c], c in JSON_COLUMNS) for c in columns]).alias("line"))


def export(snapshot: Snapshot, path: str) -> None:
    """Folders of CSV files, each with a header, written by all tasks."""
    for name, table in snapshot.tables().items():
        schema, columns = COLUMNS[name]
        kinds = {f.name: f.dataType for f in table.schema}
        texts = table.select(*[as_text(F.col(f"`{c}`"), kinds[c]).alias(c) for c in columns])
        texts.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}.csv")


def summary(snapshot: Snapshot) -> DataFrame:
    """(table, rows) of what an export has, and the total."""
    out = None
    for name, table in snapshot.tables().items():
        row = table.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out.unionByName(out.agg(F.lit("total").alias("table"), F.sum("rows").alias("rows")))


def read_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as texts; quoted line breaks and doubled quotes are understood, blank lines and rows of another width are dropped. Files are read in blocks, by many tasks each."""
    return csv_records.rows(spark, path, columns)


def from_text(column: Column, kind: T.DataType) -> Column:
    """A text as a value of its column's type; empty and impossible texts are null. A text column keeps what looks like a number."""
    text = F.nullif(column, F.lit(""))
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.ArrayType):
        return F.from_json(text, kind)
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text).isin("true", "t"), True).when(F.lower(text).isin("false", "f"), False)
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(text)
    return text.try_cast(kind)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    schema, columns = COLUMNS[name]
    raw = read_text(spark, path, columns)
    out = raw.select(*[from_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    if name == "messages":
        out = out.withColumns({"content": F.coalesce("content", F.lit("")), "has_bookmark": F.coalesce("has_bookmark", F.lit(False)), "deleted": F.coalesce("deleted", F.lit(False))})
    return out


def import_(spark: SparkSession, path: str, into: Snapshot | None = None) -> Snapshot:
    """The tables of an export; into: a snapshot whose rows stay and to which absent ids are added. Missing files are empty tables."""
    tables = {}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, (schema, _) in COLUMNS.items():
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.csv")
        there = place.getFileSystem(conf).exists(place)
        tables[name] = read_table(spark, f"{path}/{name}.csv", name) if there else spark.createDataFrame([], schema)
    if into is not None:
        tables = {name: insert_if_absent(old, tables[name]) for name, old in into.tables().items()}
    return Snapshot(**tables)
