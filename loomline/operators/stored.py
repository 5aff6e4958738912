"""Tables that a computation keeps between its steps, in the folder that the driver and all executors share.

They cut the lineage and survive lost executors. They are Parquet, so later steps read only the columns that they need; they are deleted when Python ends, or sooner by ``forget``.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table up to which a join with it is left to Spark as it is; beyond, hot keys are dealt over SALTS tasks or as many as there are shuffle partitions.
PLAIN, SALTS = 1_000_000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where all of Spark is one process and none is set, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    used = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and used.isDefined():
        named = used.get()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; what is there goes when Python ends."""
    path = f"{shared_dir(spark)}/loomline-{label}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loomline_path = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes the files of a table from stored(), once nothing that is still to run reads it."""
    delete(table.sparkSession, table.loomline_path)


def lookup(rows: DataFrame, table: DataFrame, key: str, salt_by: str, size: int, how: str = "left") -> DataFrame:
    """rows joined with table, which has ``size`` rows and is unique on key, by that column.

    A large table is met in two steps, so that no task gets all rows of a hot key: the distinct pairs of key and salt fetch the table's row, then the rows
    their pair's. salt_by: a column in which the rows of a key differ.
    """
    if size <= PLAIN:
        return rows.join(table, key, how)
    salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    return salted.join(salted.select(key, "_salt").distinct().join(table, key), [key, "_salt"], how).drop("_salt")


def own_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_of(df: DataFrame) -> list[Column]:
    """The columns of df, also those whose names have dots or backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
