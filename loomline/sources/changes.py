"""What changed in a table of ``parts``, as a Spark data source: ``spark.read.format("loomline_parts")`` and ``readStream``.

A predicate on the time of change reaches the source, which opens only the parts whose latest change is late enough and, in their files, only row groups that may have such rows. As a
stream the source goes on from a mark, the latest time of change that it has given; each micro-batch has the rows changed after one mark and up to the next.
Rows that were never changed come in a batch without a predicate only. Files are read through pyarrow's file systems, on the executors.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "loomline_parts"
_FIRST = dt.datetime(1, 1, 1, tzinfo=dt.UTC)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system of pyarrow for a path or URI as Hadoop writes it, and the path there."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def in_utc(value: dt.datetime) -> dt.datetime:
    """Spark gives a literal's time without a zone, in that of this process."""
    return value.astimezone(dt.UTC)


class Manifest:
    """The settings of a table and the parts of its newest version, read without Spark."""

    def __init__(self, path: str):
        self.system, self.path = file_system(path)
        table = lambda folder: ds.dataset(f"{self.path}/{folder}", filesystem=self.system, format="parquet").to_table().to_pylist()
        (settings,) = table("settings")
        self.changed, self.schema = settings["changed"], T.StructType.fromJson(json.loads(settings["columns"]))
        numbers = [x.base_name for x in self.system.get_file_info(fs.FileSelector(f"{self.path}/versions")) if x.base_name.isdigit()]
        zoned = lambda t: t.replace(tzinfo=dt.UTC) if t is not None and t.tzinfo is None else t
        self.parts = [r | {"least": zoned(r["least"]), "most": zoned(r["most"])} for r in table(f"versions/{max(numbers)}") if r["part"] >= 0]

    def mark(self) -> dt.datetime:
        """The latest change; the first moment of all if there is none."""
        return max((r["most"] for r in self.parts if r["most"] is not None), default=_FIRST)

    def between(self, after: dt.datetime | None, upto: dt.datetime | None) -> list[str]:
        """The folders of the parts that may have rows changed in a range."""
        late = lambda r: after is None or (r["most"] is not None and r["most"] >= after)
        early = lambda r: upto is None or (r["least"] is not None and r["least"] <= upto)
        return [r["folder"] for r in self.parts if late(r) and early(r)]


class PartRows(InputPartition):
    """The rows of a part's folder that changed in a range; ends are (time, whether it belongs)."""

    def __init__(self, folder: str, low: tuple[dt.datetime, bool] | None, high: tuple[dt.datetime, bool] | None):
        self.folder, self.low, self.high = folder, low, high


def rows_of(path: str, part: PartRows, changed: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    system, root = file_system(path)
    kind = ds.ParquetFileFormat(read_options=ds.ParquetReadOptions(coerce_int96_timestamp_unit="us"))
    files = [x.path for x in system.get_file_info(fs.FileSelector(f"{root}/rows/{part.folder}")) if x.is_file and x.base_name.endswith(".parquet")]
    if not files:
        return
    found = ds.dataset(files, filesystem=system, format=kind)
    wanted = to_arrow_schema(schema, timestamp_utc=True)
    held = found.schema.field(changed).type
    at = lambda t: pa.scalar(t if held.tz else t.replace(tzinfo=None), held)
    c, test = ds.field(changed), None
    for end, with_end, without in ((part.low, c.__ge__, c.__gt__), (part.high, c.__le__, c.__lt__)):
        if end is not None:
            one = (with_end if end[1] else without)(at(end[0]))
            test = one if test is None else test & one
    for b in found.to_batches(filter=test, columns=wanted.names, batch_size=10_000):
        if b.num_rows:
            columns = [pc.assume_timezone(x, "UTC") if pa.types.is_timestamp(x.type) and x.type.tz is None and f.type.tz is not None else x for x, f in zip(b.columns, wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, wanted, strict=True)], schema=wanted)


class PartsReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.changed = path, schema, Manifest(path).changed
        self.low: tuple[dt.datetime, bool] | None = None
        self.high: tuple[dt.datetime, bool] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if getattr(x, "attribute", None) == (self.changed,) and isinstance(getattr(x, "value", None), dt.datetime):
                end = (in_utc(x.value), not isinstance(x, (GreaterThan, LessThan)))
                if isinstance(x, (GreaterThan, GreaterThanOrEqual, EqualTo)) and (self.low is None or (end[0], not end[1]) > (self.low[0], not self.low[1])):
                    self.low = end
                if isinstance(x, (LessThan, LessThanOrEqual, EqualTo)) and (self.high is None or end < self.high):
                    self.high = end
            yield x  # Spark tests the rows again: times may be cut to whole units on the way here

    def partitions(self) -> Sequence[InputPartition]:
        folders = Manifest(self.path).between(self.low and self.low[0], self.high and self.high[0])
        return [PartRows(f, self.low, self.high) for f in folders] or [PartRows("", None, None)]

    def read(self, partition: PartRows) -> Iterator[pa.RecordBatch]:
        if partition.folder:
            yield from rows_of(self.path, partition, self.changed, self.schema)


class PartsStream(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType, since: str | None):
        self.path, self.schema = path, schema
        self.changed = Manifest(path).changed
        self.first = dt.datetime.fromisoformat(since) if since else _FIRST
        self.first = self.first if self.first.tzinfo else self.first.replace(tzinfo=dt.UTC)

    def initialOffset(self) -> dict:
        return {"mark": self.first.isoformat()}

    def latestOffset(self) -> dict:
        return {"mark": max(self.first, Manifest(self.path).mark()).isoformat()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = (dt.datetime.fromisoformat(x["mark"]) for x in (start, end))
        return [PartRows(f, (low, False), (high, True)) for f in Manifest(self.path).between(low, high)] if low < high else []

    def read(self, partition: PartRows) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.path, partition, self.changed, self.schema)

    def commit(self, end: dict) -> None:
        pass


class PartsSource(DataSource):
    """Options: path; for streams since, an ISO time after which changes count."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return Manifest(self.options["path"]).schema

    def reader(self, schema: T.StructType) -> PartsReader:
        return PartsReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> PartsStream:
        return PartsStream(self.options["path"], schema, self.options.get("since"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, which is made the calling thread's active one, and lets it push predicates down to Python sources."""
    spark._jvm.SparkSession.setActiveSession(spark._jsparkSession)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PartsSource)
