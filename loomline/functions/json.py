"""Functions over metadata columns that hold JSON objects as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value(metadata: Column, key: str) -> Column:
    """A top-level value as text; null if it is missing or null."""
    return F.get_json_object(metadata, f"$.{key}")


def parsed(metadata: Column) -> Column:
    """The object as VARIANT, so that any number of keys costs one parse; null for what is no JSON, or has a key twice."""
    return F.try_parse_json(metadata)


def field(variant: Column, key: str, kind: str = "string") -> Column:
    """A top-level value of a parsed object; null if it is missing, null or not of the kind. As text, values are as in JSON, texts without their quotes."""
    return F.try_variant_get(variant, f"$['{key}']", kind)


def entries(df: DataFrame, metadata: str) -> DataFrame:
    """df with a row for each entry of an object, its key and its value as text (null for null); rows whose metadata is no object have none."""
    held = df.withColumn("_parsed", parsed(F.col(f"`{metadata}`")))
    each = held.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_parsed").outer()))
    return each.filter(F.col("key").isNotNull()).withColumn("value", F.col("value").try_cast("string")).drop("_parsed", "pos")


def kept_values(variant: Column, keys: list[str]) -> Column:
    """An object with these keys only, their values as they were: numbers stay numbers. Null if it has none of them; null values are left out."""
    value = lambda k: F.try_variant_get(variant, f"$['{k}']", "variant")
    there = [value(k).isNotNull() & ~F.is_variant_null(value(k)) for k in keys]
    some = there[0]
    for t in there[1:]:
        some = some | t
    return F.when(some, F.to_json(F.struct(*[F.when(t, value(k)).alias(k) for k, t in zip(keys, there, strict=True)])))


def metadata_text(metadata: Column) -> Column:
    """"k: v" of all entries in key order, joined by commas; null for none. Null values are left out."""
    entries = F.array_sort(F.map_entries(F.from_json(metadata, "map<string,string>")))
    texts = F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.nullif(F.array_join(texts, ", "), F.lit(""))


#: How an export calls a task that is done, one of which nothing is known, and one that is not done.
DONE, NOT_KNOWN, NOT_DONE = "完了", "不明", "未完了"


def completion_label(metadata: Column) -> Column:
    """Done, unknown or not done, as an export says it."""
    done = F.coalesce(value(metadata, "completed"), F.lit(""))
    return F.when(F.lower(done).isin("t", "true", "1", "yes"), DONE).when(done == "", NOT_KNOWN).otherwise(NOT_DONE)


def is_completed(metadata: Column) -> Column:
    """Exactly true."""
    return F.coalesce(value(metadata, "completed") == "true", F.lit(False))


def default_metadata(kind: Column, content: Column, now: Column) -> Column:
    """Metadata of a new message of a type; null for text."""
    characters = F.length(F.trim(content))
    task = F.to_json(F.struct(F.lit("medium").alias("priority"), F.lit(False).alias("completed"), F.array().cast("array<string>").alias("tags"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"), F.lit(0).alias("timeSpent")))
    document = F.to_json(F.struct(F.lit(False).alias("isCollapsed"), characters.alias("wordCount"), characters.alias("originalLength")))
    return F.when(kind == "task", task).when(kind == "document", document).when(kind == "session", F.lit('{"timeSpent":0}'))


def ids_of(text: Column) -> Column:
    """A value that is either a JSON array of ids or one id, as an array."""
    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
    return F.coalesce(listed, F.array(text))


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; where both have a key the second counts."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


def kept_keys(metadata: Column, keys: list[str]) -> Column:
    """An object with these keys only, values as texts; null if it has none of them. Null values are left out."""
    fields = F.map_filter(F.from_json(metadata, "map<string,string>"), lambda k, v: k.isin(*keys) & v.isNotNull())
    return F.when(F.size(fields) > 0, F.to_json(fields))


def compact(*columns: Column) -> Column:
    """An object of the columns that are not null."""
    return F.to_json(F.struct(*columns))


def with_new_ids(rows, name: str = "id"):
    """rows with a random UUID where the id is null."""
    return rows.withColumn(name, F.coalesce(F.col(name), F.uuid()))
