"""Records of CSV files whose quoted fields have line breaks, read by as many tasks as the files have blocks.

Whether a line break ends a record depends on all quotes before it. A first pass counts the quotes of each block of each file, a running sum over the blocks
of a file says whether a block begins within quotes, and a second pass cuts each block where the number of quotes is even. Only records that cross a block's
end, two pieces of a block at most, are put together afterwards. Blocks are Spark's own splits of text files, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.stored import forget, stored

#: Bytes of a block.
BLOCK = 32 << 20
#: What a piece of a block is: a record, the rest of one begun in an earlier block, or the beginning of one that goes on.
WHOLE, REST, BEGUN = 0, 1, 2


@contextmanager
def _fixed_blocks(spark: SparkSession, block: int) -> Iterator[None]:
    """Both passes have to see the same splits, however many executors there are meanwhile: splits then have a fixed size."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": str(block)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _pieces(lines: Iterator[pa.RecordBatch], inside: np.ndarray, quote: str) -> Iterator[pa.RecordBatch]:
    """(file, block, nth, kind, text) of batches of (file, block, key, value), which come block after block; inside: keys of the blocks that begin within quotes, sorted."""
    out: list[tuple] = []
    now: tuple[str, int] | None = None
    held: list[str] = []  # lines of the record at hand
    odd, rest, nth = False, False, 0

    def end_of_block() -> None:
        if now is not None and (held or rest):
            out.append((*now, nth, REST if rest else BEGUN, "\n".join(held), False))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["_file", "_block", "_nth", "_kind", "_text", "_ends"])

    for b in lines:
        quotes = pc.count_substring(b.column(3), quote).to_numpy(zero_copy_only=False) % 2 == 1
        files, blocks, keys = b.column(0), b.column(1).to_pylist(), b.column(2).to_numpy()
        values = b.column(3).to_pylist()
        names = files.to_pylist()
        for name, block, key, value, turns in zip(names, blocks, keys, values, quotes.tolist(), strict=True):
            if now != (name, block):
                end_of_block()
                now, held, nth = (name, block), [], 0
                at = np.searchsorted(inside, key)
                odd = rest = bool(at < len(inside) and inside[at] == key)
            held.append(value)
            odd ^= turns
            if not odd:
                out.append((name, block, nth, REST if rest else WHOLE, held[0] if len(held) == 1 else "\n".join(held), True))
                held, rest, nth = [], False, nth + 1
            if len(out) == 5000:
                yield batch(out)
                out = []
    end_of_block()
    if out:
        yield batch(out)


def records(spark: SparkSession, path: str, quote: str = '"', block: int = BLOCK) -> DataFrame:
    """(file, first, record): every record of the files under a path, without its line break; first: whether it is the first of its file, its header. A stored table.

    A record ends at a line break with an even number of quotes before it in the file. Quotes that never close make the rest of the file one record, as for a reader that goes through it alone.
    Blank records come as well. A carriage return before a record's line break goes with it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("_line"))
    key = F.xxhash64("_file", "_block").alias("_key")
    with _fixed_blocks(spark, block):
        quotes = F.sum(F.length("_line") - F.length(F.replace("_line", F.lit(quote), F.lit("")))) / len(quote)
        counted = lines.groupBy("_file", "_block").agg(quotes.cast("long").alias("_quotes"))
        before = F.coalesce(F.sum("_quotes").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each block of a file
        within = counted.withColumn("_before", before).filter("_before % 2 = 1").select(key)
        inside = spark.sparkContext.broadcast(np.sort(np.array([r["_key"] for r in within.collect()], np.int64)))  # eight bytes for a block at most
        cut = stored(lines.select("_file", "_block", key, "_line").mapInArrow(lambda b: _pieces(b, inside.value, quote), "_file string, _block long, _nth long, _kind int, _text string, _ends boolean"), "records")
    inside.destroy()
    whole = cut.filter(F.col("_kind") == WHOLE).select("_file", ((F.col("_block") == 0) & (F.col("_nth") == 0)).alias("first"), F.col("_text").alias("record"))
    parts = cut.filter(F.col("_kind") != WHOLE)
    begins = F.sum(F.when(F.col("_kind") == BEGUN, 1).otherwise(0)).over(W.partitionBy("_file").orderBy("_block", "_nth").rowsBetween(W.unboundedPreceding, 0))  # two rows for each block of a file
    lines_of = F.array_sort(F.collect_list(F.struct("_block", "_nth", "_text")))
    joined = parts.withColumn("_of", begins).groupBy("_file", "_of").agg(lines_of.alias("_lines"))
    first = (F.col("_lines")[0]["_block"] == 0) & (F.col("_lines")[0]["_nth"] == 0)
    crossing = joined.select("_file", first.alias("first"), F.array_join(F.transform("_lines", lambda x: x["_text"]), "\n").alias("record"))
    out = whole.unionByName(crossing)
    return out.select(F.col("_file").alias("file"), "first", F.regexp_replace("record", r"\r\z", "").alias("record"))


def rows(spark: SparkSession, path: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """The columns as texts, of all records but headers; blank records and those of another number of fields are dropped. Empty fields are null."""
    bad = "_bad"
    while bad in columns:
        bad += "_"
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(bad, T.StringType())])
    given = records(spark, path, block=block).filter(~F.col("first") & (F.trim("record") != ""))
    parsed = given.select(F.from_csv("record", ", ".join(f"`{f.name}` string" for f in schema), {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": bad, "mode": "PERMISSIVE", "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")
    return parsed.filter(F.col(f"`{bad}`").isNull()).drop(bad)
