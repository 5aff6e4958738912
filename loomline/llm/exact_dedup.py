"""Exact deduplication by a tree merge of sorted digest runs, with DataFrame functions only.

Rows are dealt over runs, and a run is a partition: the number of a run says which. A leaf run, sorted by digest, has one entry for each digest: the row that stays so far and the number of
rows. In each round the runs of a group of partners, whose numbers differ in one digit, exchange entries: each partner takes
those whose digest has its own digit in that place and merges what all of them send, keeping the verified best row of each digest. A round is one exchange, by the number of the run
alone. A digit is two binomial steps at once, as four partners are two pairs of pairs. After as many rounds as a run's number has digits, every digest is in a single run, and no run
has ever had more than its share. The answers go back to the leaf runs and from there to the rows: a digest has one entry in a leaf run, so
however many rows share a text, no task gets more of them than one leaf run holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need_columns, row_key, text_or_empty, without_rows, written

#: A digest is believed only together with the length and a second, independent hash of the text.
KEY = ["_digest", "_bytes", "_check"]
#: Partners that exchange their runs in a round.
FAN_IN = 4


def digest_rows(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The narrow table on which the merge works: id, row number, the verified digest of the whole text, and more columns."""
    need_columns(df, id_col, text_col)
    text = text_or_empty(text_col)
    return df.select(
        F.col(id_col).cast("long").alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"),
        F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_check"),
        *more,
    )


def _digit(run: Column, place: int) -> Column:
    return F.pmod(F.floor(run / place), F.lit(FAN_IN))


def _merge(entries: DataFrame, runs: int, *values: Column) -> DataFrame:
    """Each run of entries in the partition of its number, sorted, with one entry for each digest: a merge needs no other exchange than this one."""
    return entries.repartitionById(runs, F.col("_run").cast("int")).sortWithinPartitions("_run", *KEY).groupBy("_run", *KEY).agg(*values)


def merged(rows: DataFrame, keep: str, runs: int | None = None) -> DataFrame:
    """rows, a written table from digest_rows, with _keep, the entry (has, wish, row) that stays, and _size, both null for a text that no other row has."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    partitions = runs or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, math.ceil(math.log(max(2, partitions), FAN_IN) - 1e-9))
    count = FAN_IN**rounds
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_row", "_id"), F.lit(count)).cast("int"))

    # the largest (preference, row) wins; a null id is less than any other
    wish = F.col("_id") if keep == "max" else -F.col("_id")
    entry = F.struct(F.col("_id").isNotNull().alias("has"), wish.alias("wish"), F.col("_row").alias("row"))
    leaves = written(_merge(rows, count, F.max(entry).alias("_best"), F.count("*").alias("_n")), "leaf-runs")
    level = leaves
    for place in (FAN_IN**k for k in range(rounds)):
        partner = F.col("_run") + (_digit(F.pmod("_check", F.lit(count)), place) - _digit(F.col("_run"), place)) * place
        level = _merge(level.withColumn("_run", partner.cast("int")), count, F.max("_best").alias("_best"), F.sum("_n").alias("_n"))

    # back only with what occurs more than once: single rows keep themselves
    answers = level.filter("_n > 1").select(*KEY, F.col("_best").alias("_keep"), F.col("_n").alias("_size"))
    return rows.join(leaves.select("_run", *KEY).join(answers, KEY), ["_run", *KEY], "left").drop("_run")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int | None = None) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept and text_sha256.

    df: any columns; only id_col (integer) and text_col are read, so others may have any name.
    keep: "max" or "min", whether the row with the largest or the smallest id of equal texts stays. runs: leaf runs at least; by default
    as many as there are shuffle partitions.

    Null texts count as empty and are equal to each other. Of rows that share text and id, exactly one is kept. Null
    ids are the last choice for either order. An empty table gives no rows. Texts are compared whole, by SHA-256,
    length and a 64-bit hash.
    """
    out = merged(written(digest_rows(df, id_col, text_col), "digests"), keep, runs)
    kept_id = F.col("_keep.wish") if keep == "max" else -F.col("_keep.wish")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_keep").isNull(), F.col("_id")).otherwise(kept_id).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_keep").isNull() | (F.col("_keep.row") == F.col("_row"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of df but for those whose text a preferred row has, with all columns of df under whatever names.

    Rows are told apart by where they are stored. Of rows that share id and text the one that happens to have the largest row number stays, whatever
    its other columns hold; rows that share only the id are not mixed up.
    """
    keyed, names = row_key(df)
    rows = written(digest_rows(keyed, id_col, text_col, *(F.col(c).alias(n) for c, n in zip(names, ("_in_file", "_in_place"), strict=True))), "digests")
    gone = merged(rows, keep).filter(F.col("_keep.row") != F.col("_row"))
    return without_rows(keyed, names, gone.select(F.col("_in_file").alias(names[0]), F.col("_in_place").alias(names[1])))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents, the largest doc_id of equal texts stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
