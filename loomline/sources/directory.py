"""A timeline stored in its order, in ranges whose rows are counted: a page or a day is found in the list of ranges, and only the ranges that hold it are read.

    <path>/rows/<writing>/_of=<n>/_range=<n>/...   rows of a range, sorted
    <path>/versions/<number>                       the ranges of a version in order: folder, rows, first and last place

New messages are sorted into the ranges that they fall in, which alone are written again, or into new ones at the end; a version is published by one rename.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.model import PAGE_SIZE
from loomline.operators.stored import delete, forget, stored
from loomline.sources import published

#: Rows of a range, about, and rows that a task sorts where there are more ranges than tasks.
RANGE, TASK = 100_000, 250_000
VERSION = "folder string, rows long, first_at long, first_id string, last_at long, last_id string"


def _at() -> Column:
    """A time as a number; none is before all."""
    return F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(-(1 << 63)))


def _id(schema: T.StructType) -> Column:
    """The id; of a row without one a text made of all that it holds."""
    return F.coalesce(F.col("id"), F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(f"`{f.name}`") for f in schema]).cast("string")))


def _key(r: Row, end: str) -> tuple[int, str]:
    return r[f"{end}_at"], r[f"{end}_id"]


def _cut(size: int):
    """A task's sorted rows with _range: those of an old range (_of) in even runs of at most ``size`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, first = list(batches), TaskContext.get().partitionId() << 32  # about TASK rows
        if not held:
            return
        of = np.concatenate([b.column(b.schema.get_field_index("_of")).to_numpy() for b in held])
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        n = np.diff(np.append(starts, len(of)))
        nth, all_ = np.arange(len(of)) - np.repeat(starts, n), np.repeat(n, n)
        number, at = first + nth * -(-all_ // size) // all_, 0
        for b in held:
            yield b.append_column("_range", pa.array(number[at : at + b.num_rows], pa.int64()))
            at += b.num_rows

    return work


class Directory:
    """The timeline in a folder: rows with id and timestamp, in the order of both. A range is a row of the list that the driver reads, so the list has as many rows as there are files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._listed = spark, path, {}
        self.schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/settings").first()["columns"]))
        self.size = spark.read.parquet(f"{path}/settings").first()["size"]

    @classmethod
    def create(cls, timeline: DataFrame, path: str, size: int = RANGE) -> Directory:
        """A new directory in a folder that has none. size: rows of a range, about; pages should not be larger."""
        spark = timeline.sparkSession
        if published.names(spark, path):
            raise FileExistsError(path)
        if size < 1:
            raise ValueError("a range has one row at least")
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in timeline.schema]).json()
        spark.createDataFrame([(columns, size)], "columns string, size int").coalesce(1).write.parquet(f"{path}/settings")
        out = cls(spark, path)
        out._publish([], 0)
        out.append(timeline)
        return out

    def number(self) -> int:
        return published.numbers(self.spark, f"{self.path}/versions")[-1]

    def ranges(self, number: int | None = None) -> list[Row]:
        """The ranges of a version in order."""
        number = self.number() if number is None else number
        if number not in self._listed:  # a version never changes once it is published
            found = self.spark.read.schema(VERSION).parquet(published.place(f"{self.path}/versions", number)).collect()
            self._listed[number] = sorted(found, key=lambda r: _key(r, "first"))
        return list(self._listed[number])

    def _read(self, ranges: list[Row]) -> DataFrame:
        if not ranges:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{r['folder']}" for r in ranges])

    def append(self, rows: DataFrame, keep: int = 2) -> int:
        """Adds messages, of any times; gives the number of ranges that were written again. A message with the id and time of one that is there takes its place; of several such in rows a hash decides. Rows without an id are told apart by what they hold.

        The last range is filled up before new ones begin. keep: versions that stay readable.
        """
        ranges = self.ranges()
        starts = [_key(r, "first") for r in ranges]
        columns = [F.col(f"`{f.name}`") for f in self.schema]
        end = _key(ranges[-1], "last") if ranges and ranges[-1]["rows"] >= self.size else None

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                places = zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
                of = [len(starts) if end is not None and p > end else max(0, bisect_right(starts, p) - 1) for p in places]
                yield b.append_column("_of", pa.array(of, pa.int32()))

        def keyed(df: DataFrame) -> DataFrame:
            """Rows as (_row, _at, _id, _of): their place, and the number of the range that it is in."""
            named = df.select(F.struct(*columns).alias("_row"), _at().alias("_at"), _id(self.schema).alias("_id"))
            return named.mapInArrow(work, T.StructType([*named.schema, T.StructField("_of", T.IntegerType())]))

        placed = stored(keyed(rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])), "placed")
        counts = {r["_of"]: r["count"] for r in placed.groupBy("_of").count().collect()}  # a row for each range at most
        if not counts:
            forget(placed)
            return 0
        touched = [n for n in counts if n < len(ranges)]
        old = keyed(self._read([ranges[n] for n in touched])).withColumn("_new", F.lit(0))
        once = old.unionByName(placed.withColumn("_new", F.lit(1))).groupBy("_of", "_at", "_id").agg(F.max_by("_row", F.struct("_new", F.xxhash64("_row"))).alias("_row"))
        rows_of = {n: c + (ranges[n]["rows"] if n < len(ranges) else 0) for n, c in counts.items()}
        tasks = sum(max(1, -(-c // self.size)) for c in rows_of.values())
        order = [F.col("_of"), F.col("_at"), F.col("_id")]
        some = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(rows_of.values()) // TASK))
        ranged = once.repartitionByRange(min(tasks, some), *order).sortWithinPartitions(*order)
        if tasks <= some:
            ranged = ranged.withColumn("_range", F.spark_partition_id().cast("long"))
        else:  # a task writes several ranges: a task for each would send the driver its sample, its report and its sizes
            ranged = ranged.mapInArrow(_cut(self.size), T.StructType([*ranged.schema, T.StructField("_range", T.LongType())]))

        number = self.number() + 1
        writing = f"{number:010d}-{uuid.uuid4().hex}"
        ranged.select("_row.*", "_of", "_range").write.partitionBy("_of", "_range").parquet(f"{self.path}/rows/{writing}")
        forget(placed)
        made = self.spark.read.schema(T.StructType([*self.schema, T.StructField("_of", T.IntegerType()), T.StructField("_range", T.LongType())])).parquet(f"{self.path}/rows/{writing}")
        place = F.struct(_at().alias("at"), _id(self.schema).alias("id"))
        ends = made.groupBy("_of", "_range").agg(F.count("*").alias("rows"), F.min(place).alias("f"), F.max(place).alias("l")).collect()  # a row for each new range
        fresh = [(f"{writing}/_of={r['_of']}/_range={r['_range']}", r["rows"], *r["f"], *r["l"]) for r in ends]
        self._publish([*(tuple(r) for n, r in enumerate(ranges) if n not in set(touched)), *fresh], number)
        self._clean(keep)
        return len(touched)

    def _publish(self, rows: list[tuple], number: int) -> None:
        at = published.draft(f"{self.path}/versions")
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(at)
        published.publish(self.spark, at, f"{self.path}/versions", number)

    def _clean(self, keep: int) -> None:
        """Deletes old versions, and writings that no version has any rows of."""
        left = published.drop_old(self.spark, f"{self.path}/versions", keep)
        used = {r["folder"].split("/")[0] for n in left for r in self.ranges(n)}
        self._listed = {n: r for n, r in self._listed.items() if n in left}
        for writing in published.names(self.spark, f"{self.path}/rows"):
            if writing not in used:
                delete(self.spark, f"{self.path}/rows/{writing}")

    def total(self) -> int:
        return sum(r["rows"] for r in self.ranges())

    def page(self, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        """A page of messages in order, with index from 0, as timeline.page gives it; no job counts anything, and only the ranges that hold the page are opened."""
        ranges = self.ranges()
        total = sum(r["rows"] for r in ranges)
        number = max(1, min(number, -(-total // size)))
        newer, stop = (number - 1) * size, min(total, number * size)
        wanted, passed, skipped = [], 0, 0
        for r in reversed(ranges):
            if passed < stop and passed + r["rows"] > newer:
                wanted.append(r)
                skipped = passed if len(wanted) == 1 else skipped
            passed += r["rows"]
        rows = self._read(wanted).withColumns({"_at": _at(), "_id": _id(self.schema)})
        near = rows.orderBy(F.desc("_at"), F.desc("_id")).limit(stop - skipped).orderBy("_at", "_id").limit(stop - newer)
        return near.withColumn("index", F.row_number().over(W.orderBy("_at", "_id")) - 1).drop("_at", "_id")  # one page of rows

    def first_after(self, day: str) -> DataFrame:
        """The first message at or after the start of a day (of the session's time zone), with its place in the whole timeline from 0; one range is opened."""
        start = self.spark.range(1).select(F.unix_micros(F.to_timestamp(F.to_date(F.lit(day)))).alias("at")).first()["at"]
        before = 0
        for r in self.ranges():
            if r["last_at"] >= start:
                rows = self._read([r]).withColumns({"_at": _at(), "_id": _id(self.schema)})
                place = F.row_number().over(W.orderBy("_at", "_id")) - 1 + before  # one range of rows
                return rows.withColumn("place", place).filter(F.col("_at") >= start).orderBy("_at", "_id").limit(1).drop("_at", "_id")
            before += r["rows"]
        return self._read([]).withColumn("place", F.lit(0))

    def page_of(self, day: str, size: int = PAGE_SIZE) -> int:
        """The number of the page on which a day begins, or on which the newest messages are if none is so late."""
        found = self.first_after(day).select("place").first()
        return 1 if found is None else (self.total() - 1 - found["place"]) // size + 1

