"""Snapshots from and to files: JSON documents, Parquet folders, by name, and with a fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.model import LINES, MESSAGES, TAG_GROUPS, TAGS, Snapshot
from loomline.sources import published

_MESSAGE = "struct<id:string,content:string,timestamp:string,updatedAt:string,lineId:string,tags:array<string>,hasBookmark:boolean,author:string,images:array<string>,type:string,metadata:string,deleted:boolean,deletedAt:string>"
_LINE = "struct<id:string,name:string,parent_line_id:string,parentLineId:string,tagIds:array<string>,created_at:string,updated_at:string>"
DOCUMENT = f"messages map<string,{_MESSAGE}>, lines array<{_LINE}>, tags map<string,struct<id:string,name:string,color:string,groupId:string>>, tagGroups map<string,struct<id:string,name:string,color:string,order:int>>"
TABLES = {"messages": MESSAGES, "lines": LINES, "tags": TAGS, "tag_groups": TAG_GROUPS}


def from_json(spark: SparkSession, path: str, lines: bool = False) -> Snapshot:
    """JSON documents with all four tables, in the present or the old form, where lines name their parent parentLineId and lack a time of creation.

    A document is a file, which one task reads whole; lines: it is a line of a file, and files are split.
    """
    document = spark.read.schema(DOCUMENT).option("multiLine", not lines).json(path)
    moment = lambda c: F.try_to_timestamp(F.col(c))
    m = document.select(F.explode(F.map_values("messages")).alias("r")).select("r.*")
    messages = m.select("id", "content", moment("timestamp").alias("timestamp"), moment("updatedAt").alias("updated_at"), F.col("lineId").alias("line_id"), "tags", F.col("hasBookmark").alias("has_bookmark"), "author", "images", "type", "metadata", "deleted", moment("deletedAt").alias("deleted_at"))
    n = document.select(F.explode("lines").alias("r")).select("r.*")
    lines = n.select("id", "name", F.coalesce("parent_line_id", "parentLineId").alias("parent_line_id"), F.col("tagIds").alias("tag_ids"), F.coalesce(moment("created_at"), moment("updated_at")).alias("created_at"), moment("updated_at").alias("updated_at"))
    tags = document.select(F.explode(F.map_values("tags")).alias("r")).select("r.id", "r.name", "r.color", F.col("r.groupId").alias("group_id"))
    groups = document.select(F.explode(F.map_values("tagGroups")).alias("r")).select("r.*")
    return Snapshot(messages, lines, tags, groups)


def normalised(snapshot: Snapshot, now) -> Snapshot:
    """Messages that are not deleted; a missing time becomes now."""
    m = snapshot.messages.filter(~F.coalesce(F.col("deleted"), F.lit(False))).withColumn("timestamp", F.coalesce("timestamp", now))
    return snapshot.with_(messages=m)


def epoch_pair(pair, now):
    """A struct of _seconds and _nanoseconds as a timestamp; now if it is not whole."""
    return F.coalesce(F.timestamp_micros(pair["_seconds"] * F.lit(1_000_000) + F.floor(pair["_nanoseconds"] / 1000)), now)


def save(snapshot: Snapshot, path: str, keep: int = 2) -> None:
    """Parquet, a folder per table, in place of what is there: all four tables are written first and published together by one rename.

    Readers see the tables of one version, before or after, and a snapshot may be made from the one that it replaces. keep: versions that stay for readers that have begun.
    """
    spark = snapshot.messages.sparkSession
    at = published.draft(path)
    for name, table in snapshot.tables().items():
        table.write.parquet(f"{at}/{name}")
    published.publish(spark, at, path, max(published.numbers(spark, path), default=-1) + 1)
    published.drop_old(spark, path, keep)


def load(spark: SparkSession, path: str) -> Snapshot:
    """The newest version of a snapshot; a folder with the tables in it is read as it is."""
    numbers = published.numbers(spark, path)
    at = published.place(path, numbers[-1]) if numbers else path
    return Snapshot(**{name: spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in TABLES.items()})


def save_mark(mark: DataFrame, path: str) -> None:
    mark.write.mode("overwrite").parquet(path)


def load_mark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


SOURCES: dict[str, Callable[[SparkSession, str], Snapshot]] = {"json": from_json, "parquet": load}


def open_(spark: SparkSession, kind: str, path: str, fallbacks: list[tuple[str, str]] = ()) -> Snapshot:
    """A snapshot from a source by name; if its tables can't be read, from the first other source that can."""
    failed: list[str] = []
    for name, place in dict.fromkeys([(kind, path), *fallbacks]):
        if name not in SOURCES:
            raise ValueError(f"unknown source {name}; there are {sorted(SOURCES)}")
        try:
            found = SOURCES[name](spark, place)
            for table in found.tables().values():
                table.head(1)
            return found
        except Exception as error:  # whatever a source fails with, the next one is tried and all are told
            failed.append(f"{name} {place}: {str(error)[:200]}")
    raise OSError("no source could be read:\n" + "\n".join(failed))


def tables_in(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the tables that the catalog lists; an error if it can't be reached."""
    return sorted(t.name for t in spark.catalog.listTables(database))
