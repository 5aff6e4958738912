"""Previous rows and running sums over orders too large for one task.

A window without a partition key would send all rows to one task. Here the order is cut by time into buckets: each bucket has a window
of its own, and a small table with a row per bucket carries what one bucket hands to the next. Columns of the table may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.operators.stored import all_of, own_name, stored


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_previous(df: DataFrame, time: str, tie: str, columns: list[str], by: list[str] = (), bucket: str = "day") -> DataFrame:
    """df with prev_<column>: the values of the row before, in the order of (time, tie), among rows equal in ``by``; null for the first.

    bucket: a unit of time in which one group of ``by`` has few enough rows for a task, while all rows of a group have few enough such units.
    """
    unit, previous, first, carried, last, near = (own_name(df, n) for n in ("_bucket", "_previous", "_first", "_carried", "_last", "_near"))
    groups, keys = [_c(c) for c in by], [own_name(df, f"_of{n}") for n in range(len(by))]
    cut = df.withColumn(unit, F.date_trunc(bucket, _c(time)))
    own = W.partitionBy(*groups, unit).orderBy(_c(time), _c(tie))
    held = F.struct(*[_c(c).alias(f"c{n}") for n, c in enumerate(columns)])
    ends = cut.groupBy(*[g.alias(k) for g, k in zip(groups, keys, strict=True)], F.col(unit).alias(near)).agg(F.max_by(held, F.struct(_c(time), _c(tie))).alias(last))
    before = ends.withColumn(carried, F.lag(last).over(W.partitionBy(*keys).orderBy(near))).drop(last)
    joined = cut.withColumn(previous, F.lag(held).over(own)).withColumn(first, F.row_number().over(own) == 1)
    on = [g.eqNullSafe(F.col(k)) for g, k in zip([*groups, F.col(unit)], [*keys, near], strict=True)]
    value = F.when(F.col(first), F.col(carried)).otherwise(F.col(previous))
    return joined.join(before, on, "left").select(*all_of(df), *[value[f"c{n}"].alias(f"prev_{c}") for n, c in enumerate(columns)])


def with_running_sum(df: DataFrame, value: Column, name: str, time: str, tie: str, by: list[str] = (), bucket: str = "day") -> DataFrame:
    """df with the sum of ``value`` up to and with each row, in the order of (time, tie), among rows equal in ``by``."""
    unit, number, within, carried, total, near = (own_name(df, n) for n in ("_bucket", "_value", "_within", "_carried", "_sum", "_near"))
    groups, keys = [_c(c) for c in by], [own_name(df, f"_of{n}") for n in range(len(by))]
    cut = df.withColumn(unit, F.date_trunc(bucket, _c(time))).withColumn(number, value)
    own = W.partitionBy(*groups, unit).orderBy(_c(time), _c(tie)).rowsBetween(W.unboundedPreceding, 0)
    sums = cut.groupBy(*[g.alias(k) for g, k in zip(groups, keys, strict=True)], F.col(unit).alias(near)).agg(F.sum(number).alias(total))
    before = W.partitionBy(*keys).orderBy(near).rowsBetween(W.unboundedPreceding, -1)
    earlier = sums.withColumn(carried, F.coalesce(F.sum(total).over(before), F.lit(0))).drop(total)
    on = [g.eqNullSafe(F.col(k)) for g, k in zip([*groups, F.col(unit)], [*keys, near], strict=True)]
    joined = cut.withColumn(within, F.sum(number).over(own)).join(earlier, on)
    return joined.select(*all_of(df), (F.col(within) + F.col(carried)).alias(name))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with the place of each row, from 1, in an order that leaves no ties.

    Rows are sorted in ranges, a task for each, and the ranges counted; they are stored meanwhile, as two looks at them must see the same ranges.
    """
    part, nth, start, number = (own_name(df, n) for n in ("_range", "_nth", "_start", "_n"))
    ranged = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy(part).agg(F.count("*").alias(number)).select(part, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(start))  # a row for each range
    placed = ranged.withColumn(nth, F.row_number().over(W.partitionBy(part).orderBy(*order))).join(starts, part)
    return placed.select(*all_of(df), (F.col(start) + F.col(nth)).alias(name))
