"""Numbers of an Euler tour: each line has an entry number, and the lines below it have the numbers from there to its exit.

"Is below" is then a comparison of numbers, a subtree a range of them, and what a subtree adds up to a difference of running sums: no list of ancestors is made or
read. Numbers come from subtree sizes, running sums over siblings and sums along the way up (see doubling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.model import MAIN_LINE
from loomline.operators import doubling
from loomline.operators.hierarchy import next_line
from loomline.operators.stored import all_of, forget, own_name, stored

#: Children beyond which those of a parent are no single task's.
BROOD = 100_000


def number(lines: DataFrame, orphans: str = "root") -> DataFrame:
    """(id, parent_line_id, depth, root_id, entry, exit) of lines in depth-first order, entry from 1 without gaps; a stored table.

    Siblings are in order of created_at (none first) and id; among roots the main line is first. orphans: "root" has them as roots, "drop" leaves them and what is below out. Lines in
    or under cycles have no numbers. A parent of more than BROOD lines is summed up by days of created_at, so that it is no single task's.
    """
    if orphans not in ("root", "drop"):
        raise ValueError("orphans is 'root' or 'drop'")
    nodes = lines.select("id", next_line().alias("next"), F.col("created_at").alias("at"), F.lit(1).cast("long").alias("one"))
    sized = doubling.totals(nodes, {"levels": "one"}, {"size": "one"}, ["next", "at"])
    kept = sized.filter("ended <> 'cycle'" if orphans == "root" else "ended = 'root'")
    root = F.col("levels") == 1
    day = F.when(root & (F.col("id") == MAIN_LINE), "").otherwise(F.coalesce(F.to_date("at").cast("string"), F.lit("0")))
    dated = kept.select("id", F.when(root, "").otherwise(F.col("next")).alias("of"), day.alias("day"), "at", "size", "levels")

    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = stored(dated.groupBy("of").count().filter(F.col("count") > BROOD).select("of", F.lit(True).alias("_large")), "broods")
    cut = dated.join(F.broadcast(large), "of", "left").withColumn("unit", F.when(F.col("_large"), F.col("day")).otherwise("")).drop("_large")  # at most a row for each BROOD lines
    days = cut.join(F.broadcast(large), "of", "left_semi").groupBy("of", "unit").agg(F.sum("size").alias("size")).select("of", "unit", earlier(W.partitionBy("of").orderBy("unit")).alias("before"))
    weighed = cut.withColumn("within", earlier(W.partitionBy("of", "unit").orderBy("day", "at", "id"))).join(days, ["of", "unit"], "left")
    step = stored(weighed.select("id", F.nullif("of", F.lit("")).alias("next"), (F.coalesce("before", F.lit(0)) + F.col("within") + 1).alias("weight"), "size", "levels"), "weights")
    placed = doubling.totals(step, {"entry": "weight"}, {}, ["next", "size", "levels"])
    for table in (sized, large, step):
        forget(table)
    return placed.select("id", F.col("next").alias("parent_line_id"), (F.col("levels") - 1).cast("int").alias("depth"), F.col("top").alias("root_id"), "entry", (F.col("entry") + F.col("size") - 1).alias("exit"))


def save(numbered: DataFrame, path: str) -> None:
    """Numbers as Parquet in their order: a reader of one subtree skips the files and row groups of other ranges."""
    numbered.repartitionByRange("entry").sortWithinPartitions("entry").write.mode("overwrite").parquet(path)


def are_below(numbered: DataFrame, pairs: DataFrame, line: str = "line", above: str = "above") -> DataFrame:
    """pairs with is_below: whether one line is below the other, not the same; false if either has no number."""
    own, at, other, start, stop = (own_name(pairs, n) for n in ("_line", "_at", "_above", "_from", "_to"))
    low = numbered.select(F.col("id").alias(own), F.col("entry").alias(at))
    high = numbered.select(F.col("id").alias(other), F.col("entry").alias(start), F.col("exit").alias(stop))
    held = pairs.join(low, F.col(f"`{line}`") == F.col(own), "left").join(high, F.col(f"`{above}`") == F.col(other), "left")
    return held.select(*all_of(pairs), F.coalesce((F.col(at) > F.col(start)) & (F.col(at) <= F.col(stop)), F.lit(False)).alias("is_below"))


def _interval(numbered: DataFrame, line_id: str) -> tuple[int, int]:
    """Entry and exit of a line; an empty range for a line without a number."""
    found = numbered.filter(F.col("id") == line_id).select("entry", "exit").head()
    return (found["entry"], found["exit"]) if found else (0, -1)


def subtree(numbered: DataFrame, line_id: str) -> DataFrame:
    """The numbers of a line and all below it, by a range of numbers; none for a line without one."""
    start, stop = _interval(numbered, line_id)
    return numbered.filter(F.col("entry").between(start, stop))


def way_to(numbered: DataFrame, line_id: str) -> DataFrame:
    """The numbers of a line and all above it."""
    start, _ = _interval(numbered, line_id)
    return numbered.filter((F.col("entry") <= start) & (F.col("exit") >= start))


def subtree_sums(numbered: DataFrame, values: DataFrame, value: Column, name: str, block: int = 1 << 16) -> DataFrame:
    """(id, lines, own, <name>): how many lines a subtree has, and the sum of value over the line's rows of values (line_id) alone and over those of the whole subtree.

    What is up to a number is a running sum, in blocks of numbers; a subtree's is what is up to its exit less what is before its entry. Rows whose line has no number are in no sum.
    """
    own = values.groupBy(F.col("line_id").alias("id")).agg(F.sum(value).alias("own"))
    held = numbered.join(own, "id", "left").select("id", "entry", "exit", F.coalesce("own", F.lit(0)).cast("long").alias("own"), F.floor(F.col("entry") / block).alias("block"))
    held = stored(held, "sums")
    blocks = held.groupBy("block").agg(F.sum("own").alias("sum"))
    before = blocks.select("block", F.coalesce(F.sum("sum").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each block
    upto = held.withColumn("within", F.sum("own").over(W.partitionBy("block").orderBy("entry").rowsBetween(W.unboundedPreceding, 0))).join(before, "block")
    upto = stored(upto.select("id", "entry", "exit", "own", (F.col("before") + F.col("within")).alias("upto")), "running-sums")
    ends = upto.select(F.col("entry").alias("exit"), F.col("upto").alias("_end"))
    return upto.join(ends, "exit").select("id", (F.col("exit") - F.col("entry") + 1).alias("lines"), "own", (F.col("_end") - F.col("upto") + F.col("own")).alias(name))
