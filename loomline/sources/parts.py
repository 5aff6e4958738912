"""A keyed table that is kept up to date in place: rows in parts by the hash of their key, and versions that say which files are each part's.

A batch of changes rewrites only the parts that its keys fall in, from those parts' old rows, and publishes a new version by one rename; a batch that dies before leaves
the old version as it was. A version is a Parquet table with a row for each part: the folder of its rows, their number, a digest of them, and the
range of their times of change. So a reader of what changed since a time skips parts that did not, and two tables are compared part by part by their digests
before any row is read (``differences``).

    <path>/settings            key, time of change, number of parts, columns
    <path>/rows/<writing>/_part=<n>/...
    <path>/versions/<number>   the parts of a version
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.stored import all_of, delete, forget, stored
from loomline.sources import published

PARTS, KEEP = 64, 2
#: The part in a version's table that stands for the version itself: folder has the number of the batch that it came from.
VERSION_ROW = -1
VERSION = "part int, folder string, rows long, digest decimal(38,0), least timestamp, most timestamp"


def part_of(df: DataFrame, key: str, parts: int) -> Column:
    """The part of a row; rows without a key are dealt over all parts by what they hold."""
    c = F.col(f"`{key}`")
    return F.pmod(F.when(c.isNull(), F.xxhash64(*all_of(df))).otherwise(F.xxhash64(c)), F.lit(parts)).cast("int")


def digest_of(columns: list[Column]) -> Column:
    """A number for a set of rows, whatever their order: equal for equal sets, and different for others but for one chance in 2^64."""
    return F.sum(F.xxhash64(*columns, F.lit("loomline")).cast("decimal(38,0)"))


def digest_tree(leaves: dict[int, tuple[int, int]]) -> list[dict[int, tuple[int, int]]]:
    """(rows, digest) by number, level by level, from the leaves to one node: a node is the sum of the two below it."""
    levels = [leaves]
    while len(levels[-1]) > 1 or any(levels[-1]):
        above: dict[int, tuple[int, int]] = {}
        for n, (rows, digest) in levels[-1].items():
            held = above.get(n // 2, (0, 0))
            above[n // 2] = (held[0] + rows, held[1] + digest)
        levels.append(above)
    return levels


def unequal_leaves(first: list[dict], second: list[dict]) -> set[int]:
    """The leaves in which two trees differ; below nodes that are equal nothing is looked at."""
    height = max(len(first), len(second))
    trees = [t + [t[-1]] * (height - len(t)) for t in (first, second)]
    at = {0}
    for level in range(height - 1, -1, -1):
        a, b = trees[0][level], trees[1][level]
        at = {n for n in at if a.get(n, (0, 0)) != b.get(n, (0, 0))}
        if level:
            at = {c for n in at for c in (2 * n, 2 * n + 1)}
    return at


@dataclass
class Parts:
    """The table in a folder. key: unique but where null; changed: the time by which one of several new rows of a key is chosen, and by which readers skip parts."""

    spark: SparkSession
    path: str
    key: str = field(init=False)
    changed: str = field(init=False)
    parts: int = field(init=False)
    schema: T.StructType = field(init=False)

    def __post_init__(self) -> None:
        found = self.spark.read.parquet(f"{self.path}/settings").first()
        self.key, self.changed, self.parts, self.schema = found["key"], found["changed"], found["parts"], T.StructType.fromJson(json.loads(found["columns"]))

    @classmethod
    def create(cls, table: DataFrame, path: str, key: str = "id", changed: str = "updated_at", parts: int = PARTS) -> Parts:
        """A new table in a folder that has none; several rows of a key are settled as in a merge."""
        spark = table.sparkSession
        if cls.there(spark, path):
            raise FileExistsError(path)
        if parts < 1 or dict(table.dtypes)[changed] != "timestamp":
            raise ValueError("there is one part at least, and the time of change is a timestamp")
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema])
        spark.createDataFrame([(key, changed, parts, schema.json())], "key string, changed string, parts int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        out = cls(spark, path)
        out._publish([], None, 0)
        out.merge(table)
        return out

    @staticmethod
    def there(spark: SparkSession, path: str) -> bool:
        """Whether a folder has such a table; one that died while it was made has none."""
        return bool(published.numbers(spark, f"{path}/versions"))

    def number(self) -> int:
        """The newest version."""
        return published.numbers(self.spark, f"{self.path}/versions")[-1]

    def manifest(self, number: int | None = None) -> list[Row]:
        """The parts of a version that have rows, the newest by default: as many rows as there are parts at most."""
        return [r for r in self._rows(number) if r["part"] != VERSION_ROW]

    def _rows(self, number: int | None) -> list[Row]:
        return self.spark.read.schema(VERSION).parquet(published.place(f"{self.path}/versions", self.number() if number is None else number)).collect()

    def batch(self) -> int | None:
        """The number of the batch from which the newest version came, if it had one."""
        found = next(r["folder"] for r in self._rows(None) if r["part"] == VERSION_ROW)
        return None if found is None else int(found)

    def read(self, number: int | None = None, parts: set[int] | None = None, since: dt.datetime | None = None) -> DataFrame:
        """The rows of a version; of certain parts only; changed after a time only. Parts that are not asked for, or have nothing that new, are not opened."""
        wanted = [r for r in self.manifest(number) if (parts is None or r["part"] in parts) and (since is None or (r["most"] is not None and r["most"] > since))]
        rows = self._of([r["folder"] for r in wanted])
        return rows if since is None else rows.filter(F.col(f"`{self.changed}`") > F.lit(since))

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{f}" for f in folders])

    def merge(self, batch: DataFrame, number: int | None = None, gone: Column | None = None, keep: int = KEEP) -> list[int]:
        """Rows of the batch take the place of those with their key; gives the parts that were rewritten.

        gone: which rows go, with what they replace, such as those marked as deleted. number: that of the batch; one that is in already is not merged again. Of several rows of a key in the batch the last changed counts, and of
        those a hash decides. Rows without a key are added. keep: versions that stay readable.
        """
        done = self.batch()
        if number is not None and done is not None and number <= done:
            return []
        rows = batch.select(*self._columns(cast=True))
        rows = rows.withColumn("_part", part_of(rows, self.key, self.parts))
        whole, key = F.struct(*self._columns()), F.col(f"`{self.key}`")
        latest = F.struct(F.col(f"`{self.changed}`"), F.xxhash64(*self._columns()))
        once = rows.filter(key.isNotNull()).groupBy("_part", key.alias("_key")).agg(F.max_by(whole, latest).alias("_row"))  # first within tasks: a key that comes very often is no part's burden
        keyless = rows.filter(key.isNull()).select("_part", key.alias("_key"), whole.alias("_row"))
        return self._rewrite(once.unionByName(keyless), number if number is not None else done, gone, keep)

    def _columns(self, cast: bool = False) -> list[Column]:
        return [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if cast else F.col(f"`{f.name}`") for f in self.schema]

    def _rewrite(self, new: DataFrame, batch: int | None, gone: Column | None, keep: int, remove: bool = False) -> list[int]:
        """The parts of new (_part, _key, _row; one row for a key) with these rows in the place of those of their keys, or without them; then a new version."""
        new = stored(new, "batch")
        touched = sorted(r["_part"] for r in new.select("_part").distinct().collect())  # as many as there are parts at most
        folders = {r["part"]: r["folder"] for r in self.manifest()}
        old = self._of([folders[p] for p in touched if p in folders])
        old = old.select(part_of(old, self.key, self.parts).alias("_part"), F.col(f"`{self.key}`").alias("_key"), F.struct(*self._columns()).alias("_row"), F.lit(0).alias("_new"))
        both = old.unionByName(new.withColumn("_new", F.lit(1))).repartition(max(1, len(touched)), "_part")
        merged = both.filter("_key IS NOT NULL").groupBy("_part", "_key").agg(F.max_by("_row", "_new").alias("_row"), F.max("_new").alias("_new"))
        kept = merged.filter(F.lit(not remove) | (F.col("_new") == 0)).select("_part", "_row").unionByName(both.filter("_key IS NULL").select("_part", "_row")).select("_part", "_row.*")
        kept = kept if gone is None else kept.filter(~F.coalesce(gone, F.lit(False)))

        number = self.number() + 1
        writing = f"{number:010d}-{uuid.uuid4().hex}"
        kept.sortWithinPartitions("_part", F.col(f"`{self.changed}`")).write.partitionBy("_part").parquet(f"{self.path}/rows/{writing}")
        forget(new)
        made = self.spark.read.schema(T.StructType([*self.schema, T.StructField("_part", T.IntegerType())])).parquet(f"{self.path}/rows/{writing}")
        changed = F.col(f"`{self.changed}`")
        found = made.groupBy("_part").agg(F.count("*"), digest_of(self._columns()), F.min(changed), F.max(changed)).collect()
        rewritten = [(r[0], f"{writing}/_part={r[0]}", *r[1:]) for r in found]
        self._publish([*(tuple(r) for r in self.manifest() if r["part"] not in set(touched)), *rewritten], batch, number)
        self.clean(keep)
        return touched

    def _publish(self, rows: list[tuple], batch: int | None, number: int) -> None:
        at = published.draft(f"{self.path}/versions")
        self.spark.createDataFrame([(VERSION_ROW, None if batch is None else str(batch), None, None, None, None), *rows], VERSION).coalesce(1).write.parquet(at)
        published.publish(self.spark, at, f"{self.path}/versions", number)

    def clean(self, keep: int = KEEP) -> None:
        """Deletes versions but the newest ones, and rows that none of these has, those of batches that died among them."""
        left = published.drop_old(self.spark, f"{self.path}/versions", keep)
        used = {r["folder"] for n in left for r in self.manifest(n)}
        for writing in published.names(self.spark, f"{self.path}/rows"):
            if not any(f.startswith(f"{writing}/") for f in used):
                delete(self.spark, f"{self.path}/rows/{writing}")
                continue
            for part in published.names(self.spark, f"{self.path}/rows/{writing}"):
                if part.startswith("_part=") and f"{writing}/{part}" not in used:
                    delete(self.spark, f"{self.path}/rows/{writing}/{part}")

    def high_water_mark(self) -> dt.datetime | None:
        """The latest time of change, from the version's table alone."""
        return max((r["most"] for r in self.manifest() if r["most"] is not None), default=None)

    def digests(self, source: DataFrame) -> DataFrame:
        """(part, rows, digest) of another table with the same columns, cut in the same way; it is computed where that table is, and a row for each part is all that leaves it."""
        rows = source.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        return rows.groupBy(part_of(rows, self.key, self.parts).alias("part")).agg(F.count("*").alias("rows"), digest_of(all_of(rows)).alias("digest"))

    def unequal(self, source: DataFrame) -> set[int]:
        """The parts that differ from those of another table. Digests are summed up a tree of halves and only looked at below halves that differ."""
        sums = lambda rows: {r["part"]: (r["rows"], int(r["digest"])) for r in rows}
        trees = [digest_tree(x) for x in (sums(self.manifest()), sums(self.digests(source).collect()))]  # as many rows as there are parts at most
        return unequal_leaves(*trees)

    def differences(self, source: DataFrame) -> DataFrame:
        """(key, change) of what a table has other than this one: inserted, changed or deleted keys, the last being those that it has no more.

        Only parts that differ are read on this side and compared row by row. Rows without a key can be told apart by what they hold only, and are not compared.
        """
        parts, columns = self.unequal(source), [f.name for f in self.schema]
        rows = source.select(*[F.col(f"`{c}`").cast(f.dataType).alias(c) for c, f in zip(columns, self.schema, strict=True)])
        mine = self.read(parts=parts)
        theirs = rows.filter(part_of(rows, self.key, self.parts).isin(*parts)) if parts else rows.limit(0)
        narrow = lambda df, name: df.filter(F.col(f"`{self.key}`").isNotNull()).select(F.col(f"`{self.key}`").alias("key"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias(name))
        both = narrow(mine, "_mine").join(narrow(theirs, "_theirs"), "key", "full")
        change = F.when(F.col("_mine").isNull(), "inserted").when(F.col("_theirs").isNull(), "deleted").when(F.col("_mine") != F.col("_theirs"), "changed")
        return both.select("key", change.alias("change")).filter("change IS NOT NULL")

    def drop_deleted(self, source: DataFrame, keep: int = KEEP) -> list[int]:
        """Takes out the rows whose key a table has no more; gives the parts that were rewritten. Nothing else is taken over: that is what merge() of changes is for."""
        key = F.col("key").cast(self.schema[self.key].dataType)
        deleted = self.differences(source).filter("change = 'deleted'").select(F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int").alias("_part"), key.alias("_key"))
        nothing = F.lit(None).cast(T.StructType([T.StructField(f.name, f.dataType) for f in self.schema]))
        return self._rewrite(deleted.withColumn("_row", nothing), self.batch(), None, keep, remove=True)
