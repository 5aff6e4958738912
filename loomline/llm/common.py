"""What the operators of this subpackage share: the shared folder, written tables and skew-free lookups."""

from __future__ import annotations

import atexit
import functools
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are dealt at least; on a cluster with more shuffle partitions, over as many as these.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    A temporary folder is set only where all of Spark is one process (a local master, as in tests); a cluster that names none is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        used = spark.sparkContext._jsc.sc().getCheckpointDir()
        if used.isDefined():
            return used.get().rstrip("/")
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses; it is deleted when Python ends."""
    path = f"{shared_dir(spark)}/loomline-{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loomline_path = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes the files of a table that written() gave, once nothing that is still to run reads it."""
    _delete(table.sparkSession, table.loomline_path)


def _one_row_each(df: DataFrame) -> bool:
    """Whether df is stored files with nothing but projections and filters over them, so that a place in a file is one row at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with two more columns and their names: the file that a row is stored in and its place there. They name the row whenever it is read again.

    A df that is not simply read from files is written to the shared folder first.
    """
    names = [fresh(df, "_file"), fresh(df, "_at")]
    if not _one_row_each(df):
        df = written(df, "rows")
    place = df.metadataColumn("_metadata")
    return df.select("*", place["file_path"].alias(names[0]), place["row_index"].alias(names[1])), names


def without_rows(keyed: DataFrame, names: list[str], gone: DataFrame) -> DataFrame:
    """keyed, from row_key, but for the rows whose key is in gone (columns of the same names); the key columns go.

    The join is a shuffled one at every size, as gone grows with the data; of each partition only the keys of gone are held, and rows are not sorted.
    """
    return keyed.join(gone.select(*names).hint("shuffle_hash"), names, "left_anti").drop(*names)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, *salt_by: str) -> DataFrame:
    """Left join of rows with table, which is unique on key, without sending a hot key's rows to one task.

    The distinct (key, salt) pairs of rows, at most SALTS or as many as there are shuffle partitions for a key, fetch the table's row first; then
    rows meet their own pair. Both joins are equal on null keys. salt_by: columns in which the rows of one key differ.
    """
    salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    pairs = salted.select(F.col(key).alias("_key"), F.col("_salt").alias("_slot")).distinct()
    found = pairs.join(table.withColumnRenamed(key, "_of"), F.col("_key").eqNullSafe(F.col("_of"))).drop("_of")
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_slot"))
    return salted.join(found, on, "left").drop("_key", "_slot", "_salt")


def in_ranges(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df sorted into ranges, a task for each, with the number of the range as _range; written, so that all looks at it see the same ranges.

    order: it has to tell rows apart, or those that it does not tell apart are one task's.
    """
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), label)


def numbered(df: DataFrame, by: str, order: list[Column], label: str) -> DataFrame:
    """df with _group, the place of its group among the groups (rows equal in ``by``, null first), _at, the place of the row within it, both from 0, and _n, the rows of the group.

    Rows are sorted in ranges over all groups, so a large group is many tasks'; what is added up over ranges is a row for each range and group in it.
    """
    ranged = in_ranges(df, [F.col(by).asc_nulls_first(), *order], label)
    counts = written(ranged.groupBy("_range", by).agg(F.count("*").alias("_c")), f"{label}-counts")
    group = W.partitionBy(by)
    earlier = F.coalesce(F.sum("_c").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("_range", by, earlier.alias("_start"), F.sum("_c").over(group).alias("_n"))
    # a group is counted in the range in which it begins
    nth = F.sum(F.when(F.col("_start") == 0, 1).otherwise(0)).over(W.partitionBy("_range").orderBy(F.col(by).asc_nulls_first()))
    begun = placed.filter("_start = 0").groupBy("_range").agg(F.count("*").alias("_begun"))
    ranges = counts.select("_range").distinct().join(begun, "_range", "left")
    before = ranges.select("_range", F.coalesce(F.sum("_begun").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_groups"))  # a row for each range
    starts = placed.withColumn("_nth", nth).join(before, "_range").select(F.col("_range").alias("_r"), F.col(by).alias("_of"), "_start", "_n", (F.col("_groups") + F.col("_nth") - 1).alias("_group"))
    place = F.row_number().over(W.partitionBy("_range", by).orderBy(*order)) - 1
    joined = ranged.withColumn("_place", place).join(starts, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_of")))
    return joined.select(*df.columns, "_group", (F.col("_start") + F.col("_place")).alias("_at"), "_n")


@functools.cache
def _package() -> str:
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="loomline-")) / "loomline_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors unless their Python finds it already (PYTHONPATH, working folder, --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.realpath(os.getcwd()) == root:
        return
    if not spark.conf.get("spark.submit.pyFiles", ""):
        spark.sparkContext.addPyFile(_package())
