"""Incremental synchronisation: what changed since a mark, merged into a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.model import Snapshot


def changed_since(table: DataFrame, mark: Column, inclusive: bool = False) -> DataFrame:
    """Rows updated after the mark, or at it as well; rows never updated do not come."""
    return table.filter(F.col("updated_at") >= mark if inclusive else F.col("updated_at") > mark)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Rows of both by key; where both have it the new row counts, whole. version: a column by which one of several new rows is chosen, the greatest.

    Of several with the same version a hash of the row decides, so that the choice is the same each time. Rows without a key are no one's version: all stay.
    One aggregation by key: no join, no window.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_side", F.lit(1)))
    order = [F.col("_side"), *([F.col(version)] if version else []), F.xxhash64(*old.columns)]
    row = F.struct(*[F.col(c) for c in old.columns])
    merged = both.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")
    return merged.unionByName(both.filter(F.col(key).isNull()).drop("_side"))


def upsert_joined(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The same for a new side that is small: the old rows that it replaces are taken out by an anti join, which needs no shuffle of them if Spark broadcasts the new keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows, and the new ones whose key no old row has. Of several new rows with one key a hash of the row decides; rows without a key all come."""
    row = F.struct(*[F.col(c) for c in old.columns])
    once = new.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.xxhash64(*old.columns)).alias("r")).select("r.*")
    absent = once.join(old.select(key), key, "left_anti").select(*old.columns)
    return old.unionByName(absent).unionByName(new.filter(F.col(key).isNull()).select(*old.columns))


def without_deleted(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.coalesce(F.col("deleted"), F.lit(False)))


def high_water_mark(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """One row, mark: the latest of all times of messages and changes of lines; the epoch if there is none."""
    kind = dict(messages.dtypes)["timestamp"]
    of_messages = messages.agg(F.greatest(F.max("updated_at"), F.max("timestamp")).alias("m"))
    marks = of_messages.unionByName(lines.agg(F.max("updated_at").alias("m")))
    return marks.agg(F.coalesce(F.max("m"), F.lit("1970-01-01 00:00:00").cast(kind)).alias("mark"))


def pull(snapshot: Snapshot, source: Snapshot, mark: Column) -> Snapshot:
    """The snapshot after an incremental pull: changed messages and lines merged, deleted messages gone, tags and groups taken over whole.

    Rows at the mark are pulled again, which the merge makes harmless; hard deletes in the source are not seen.
    """
    messages = without_deleted(upsert(snapshot.messages, changed_since(source.messages, mark, inclusive=True)))
    lines = upsert(snapshot.lines, changed_since(source.lines, mark, inclusive=True))
    return Snapshot(messages, lines, source.tags, source.tag_groups)
