"""Walks up a forest: trees are contracted within parts of the rows, what is left of them is walked by pointer doubling.

Rows are (id, next): next is the parent, null for a root. What a row comes to at the end is a root, a missing parent (an orphan) or, for rows in a cycle or leading into one, nothing.

A part of the rows is a task's. Within it a row knows its way up to the last ancestor that is in the part too; of the part only the rows that others point at are left, with the sums over what
is between, as the nodes of a smaller forest. Its answers go back to the parts, which finish their rows: a few shuffles of the rows whatever the depth. The first parts are ranges of ids, as lines are mostly
made soon after their parents and named in order; where that leaves many, parts are children with parents, chosen by hashes so that of a chain in any order a third goes each time. The rest is joined with itself
on the node that each row has come to, so that ways double: log2(depth) rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.stored import forget, lookup, stored

#: Nodes up to which ways are doubled at once, rows of a part, and children beyond which a parent's are not gathered with it.
SMALL, PART, HOT = 100_000, 250_000, 50_000


def _counts(state: DataFrame) -> tuple[int, int]:
    """All rows, and those that have not come to their end."""
    return tuple(state.agg(F.count("*"), F.count("next")).first())


def totals(nodes: DataFrame, above: dict[str, str], below: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """nodes (id, next and numbers) with sums over the forest and how the way up ends, without a list of ancestors anywhere.

    above: result and number, summed over a node and all its ancestors; below: over a node and all its descendants. Also top (the last ancestor that is there), ended ("root", "orphan"
    or "cycle") and missing_id, and the columns to keep. Sums of nodes that ended in a cycle mean nothing. ids are unique and not null; the result is a stored table.
    """
    start = nodes.select("id", "next", *[F.col(v).alias(k) for k, v in (above | below).items()], *[k for k in keep if k != "next"])
    held = None if hasattr(nodes, "loomline_path") else stored(start, "walk")
    out = _solved(start if held is None else held, list(above), list(below), list(keep), 0)
    if held is not None:
        forget(held)
    return out


def _solved(state: DataFrame, above: list[str], below: list[str], keep: list[str], step: int, before: int | None = None) -> DataFrame:
    """totals of a stored state (id, next, top from the first step on, sums); step and before: how often it was contracted, and its rows before that."""
    size = state.count()
    if size <= SMALL or (step > 1 and size > 0.9 * before):
        found = _doubled(state, above, below)
        if not keep:
            return found
        out = stored(found.join(state.select("id", *keep), "id"), "walk")
        forget(found)
        return out
    local = stored(_parts(state, size, step).mapInArrow(_contract(above, below, keep), _local_schema(state, above, below, keep)), "local")
    asked = local.filter("_root AND target IS NOT NULL").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("_n"), *[F.sum(f"_{c}").cast(local.schema[c].dataType).alias(c) for c in below])
    entries = local.select("id", "_part", F.col("_n").alias("_place"), F.when(F.col("ended") == "cycle", F.col("id")).otherwise(F.col("target")).alias("next"), "top", *above)
    left = stored(asked.drop("_n").join(entries, "id"), "contracted")
    solved = _solved(left, above, below, [], step + 1, size)

    there = F.col("_there").isNotNull()
    answers = solved.select(F.col("id").alias("target"), F.lit(True).alias("_there"), F.col("top").alias("_top"), F.col("ended").alias("_ended"), F.col("missing_id").alias("_missing"), *[F.col(c).alias(f"_above_{c}") for c in above])
    met = lookup(local.filter("target IS NOT NULL").drop("ended"), answers, "target", "id", solved.count())
    places = ["_part", "_n", "_up"] if below else []
    moved = met.select("id", F.coalesce("_top", "top").alias("top"), F.when(there, F.col("_ended")).otherwise("orphan").alias("ended"), F.when(there, F.col("_missing")).otherwise(F.col("target")).alias("missing_id"), *[(F.col(c) + F.coalesce(f"_above_{c}", F.lit(0))).alias(c) for c in above], *below, *keep, *places)
    ended = local.filter("target IS NULL").select("id", "top", "ended", F.lit(None).cast(local.schema["id"].dataType).alias("missing_id"), *above, *below, *keep, *places)
    out = moved.unionByName(ended)
    if below:
        came = solved.select("id", *below).join(left.select("id", "_part", "_place"), "id").drop("id")
        schema = T.StructType([f for f in out.schema if f.name not in places])
        out = out.groupBy("_part").cogroup(came.groupBy("_part")).applyInArrow(_gather(below), schema)
    out = stored(out, "walk")
    for table in (local, left, solved):
        forget(table)
    return out


def _parts(state: DataFrame, size: int, step: int) -> DataFrame:
    """state in parts with many edges inside: ranges of ids; from the second time on children with parents whose hash is less than theirs, in which a parent of very many is left alone."""
    parts = max(-(-size // PART), int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if step == 0:
        return state.repartitionByRange(parts, "id")
    hot = state.groupBy("next").count().filter((F.col("count") > HOT) & F.col("next").isNotNull()).select("next", F.lit(True).alias("_hot"))
    less = F.xxhash64("next", F.lit(step)) < F.xxhash64("id", F.lit(step))
    return state.join(F.broadcast(hot), "next", "left").repartition(parts, F.when(less & F.col("_hot").isNull(), F.col("next")).otherwise(F.col("id"))).drop("_hot")  # hot: at most a row for each HOT rows


def _local_schema(state: DataFrame, above: list[str], below: list[str], keep: list[str]) -> T.StructType:
    """Of a row of a part: its place there and its parent's, whether it is a local root, the local root's parent (target) and top, sums within the part. Sums below stay as they were, but for those of local roots."""
    kind = state.schema["id"].dataType
    named = [T.StructField(n, t) for n, t in (("id", kind), ("_part", T.IntegerType()), ("_n", T.IntegerType()), ("_up", T.IntegerType()), ("_root", T.BooleanType()), ("target", kind), ("top", kind), ("ended", T.StringType()))]
    return T.StructType([*named, *[T.StructField(c, state.schema[c].dataType) for c in [*above, *below]], *[T.StructField(f"_{c}", state.schema[c].dataType) for c in below], *[T.StructField(c, state.schema[c].dataType) for c in keep]])


def _walk(up: np.ndarray, above: list[np.ndarray], below: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of nodes with their parents' places (the number of nodes for none): local roots, whether they loop, and sums above and below, by pointer doubling. What a node gathered from less than 2^k levels below it is added to its 2^k-th ancestor's."""
    n = len(up)
    p, root = np.append(up, n), np.arange(n + 1)
    above, below = ([np.append(x, x.dtype.type(0)) for x in xs] for xs in (above, below))
    for _ in range(n.bit_length() + 1):
        moving = np.flatnonzero(p != n)
        if not len(moving):
            break
        to = p[moving]
        above = [x + x[p] for x in above]
        for i, x in enumerate(below):
            more = x.copy()
            np.add.at(more, to, x[moving])
            below[i] = more
        root[moving] = root[to]
        p = p[p]
    return root[:n], p[:n] != n, [x[:n] for x in above], [x[:n] for x in below]


def _contract(above: list[str], below: list[str], keep: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, n = rows["id"].combine_chunks(), rows.num_rows
        up = pc.fill_null(pc.index_in(rows["next"].combine_chunks(), value_set=ids), n).to_numpy(zero_copy_only=False).astype(np.int64)
        root, loops, over, under = _walk(up, [rows[c].to_numpy() for c in above], [rows[c].to_numpy() for c in below])
        looping, at = pa.array(loops), pa.array(root)
        target = pc.if_else(looping, pa.scalar(None, ids.type), rows["next"].combine_chunks().take(at))
        first = up == n
        out = {
            "id": ids, "_part": pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()), "_n": pa.array(np.arange(n), pa.int32()), "_up": pa.array(up, pa.int32()), "_root": pa.array(first), "target": target,
            "top": (rows["top"].combine_chunks() if "top" in rows.column_names else ids).take(at), "ended": pc.if_else(looping, "cycle", pc.if_else(pc.is_null(target), "root", pa.scalar(None, pa.string()))),
        }
        out |= {c: pa.array(x) for c, x in zip(above, over, strict=True)} | {c: rows[c] for c in below}
        out |= {f"_{c}": pa.array(x, mask=~first) for c, x in zip(below, under, strict=True)} | {c: rows[c] for c in keep}
        yield from pa.table(out).to_batches(max_chunksize=50_000)

    return work


def _gather(below: list[str]):
    def work(rows: pa.Table, came: pa.Table) -> pa.Table:
        """Sums below of a part's rows, with what came to it from other parts."""
        rows = rows.sort_by("_n")
        into, own = came["_place"].to_numpy(), []
        for c in below:
            x = rows[c].to_numpy().copy()
            x[into] += came[c].to_numpy()
            own.append(x)
        sums = _walk(rows["_up"].to_numpy().astype(np.int64), [], own)[3]
        for c, x in zip(below, sums, strict=True):
            rows = rows.set_column(rows.column_names.index(c), c, pa.array(x))
        return rows.drop_columns(["_part", "_n", "_up"])

    return work


def _doubled(state: DataFrame, above: list[str], below: list[str]) -> DataFrame:
    """totals of a stored state by pointer doubling: every round joins the table with itself. A row that knows its way up to a node takes over that node's way.

    Sums below double as well: what a node has gathered from less than 2^k levels below it is added to its 2^k-th ancestor's, by one aggregation a round.
    """
    columns = [*above, *below]
    top = F.col("top" if "top" in state.columns else "id")
    loops = F.col("next") == F.col("id")
    start = state.select("id", F.when(~loops, F.col("next")).alias("next"), top.alias("top"), F.when(loops, "cycle").when(F.col("next").isNull(), "root").alias("ended"), F.lit(None).cast(state.schema["id"].dataType).alias("missing_id"), *columns)
    state = stored(start, "walk")
    size, left = _counts(state)
    while left:
        moving = state.filter("next IS NOT NULL")
        reached = state.select(F.col("id").alias("next"), F.lit(True).alias("_there"), F.col("next").alias("_next"), F.col("top").alias("_top"), F.col("ended").alias("_ended"), F.col("missing_id").alias("_missing"), *[F.col(c).alias(f"_{c}") for c in above])
        met = lookup(moving, reached, "next", "id", size)
        there = F.col("_there").isNotNull()
        moved = met.select(
            "id", F.col("_next").alias("next"), F.coalesce("_top", "top").alias("top"), F.when(there, F.col("_ended")).otherwise("orphan").alias("ended"), F.when(there, F.col("_missing")).otherwise(F.col("next")).alias("missing_id"),
            *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in above], *below,
        )
        out = moved.unionByName(state.filter("next IS NULL"))
        if below:
            gathered = moving.groupBy(F.col("next").alias("id")).agg(*[F.sum(c).alias(f"_{c}") for c in below])
            out = out.join(gathered, "id", "left").select("id", "next", "top", "ended", "missing_id", *above, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in below])
        new = stored(out, "walk")
        forget(state)
        state, before, left = new, left, _counts(new)[1]
        if left == before:  # each level of a tree has rows that end in the round that reaches it: only cycles go on
            break
    ended = F.coalesce("ended", F.lit("cycle"))
    out = state.select("id", "top", ended.alias("ended"), "missing_id", *columns)
    out.loomline_path = state.loomline_path
    return out


def chains(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(id, chain, ended, missing_id) of nodes (id, next and the carried columns): chain has a struct of id and the carried columns for each ancestor that is there, root first, without the node.

    A way that meets a node again ends there: its chain has every node that it met once. ids are unique and not null; the result is a stored table.
    """
    own = F.struct("id", *carried)
    none = F.array().cast(nodes.select(F.array(own).alias("a")).schema["a"].dataType)
    loops = F.col("next") == F.col("id")
    state = stored(nodes.select("id", F.when(~loops, F.col("next")).alias("next"), own.alias("own"), none.alias("chain"), F.when(F.col("next").isNull(), "root").when(loops, "cycle").alias("ended"), F.lit(None).cast("string").alias("missing_id")), "walk")
    size, left = _counts(state)
    ids = lambda c: F.transform(c, lambda x: x["id"])
    while left:
        reached = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.array_prepend("chain", F.col("own")).alias("_more"), F.col("ended").alias("_ended"), F.col("missing_id").alias("_missing"))
        met = lookup(state.filter("next IS NOT NULL"), reached, "next", "id", size)
        there, again = F.col("_more").isNotNull(), F.exists("_more", lambda x: x["id"] == F.col("id")) | F.coalesce(F.col("_next") == F.col("id"), F.lit(False))
        cyclic = F.coalesce(F.col("_ended") == "cycle", F.lit(False)) | F.coalesce(again, F.lit(False))
        long = F.when(there, F.concat("chain", "_more")).otherwise(F.col("chain"))
        once = F.slice("long", F.lit(1), F.size(F.array_distinct(F.array_prepend(ids("long"), F.col("id")))) - 1)  # the nodes met before any is met again
        moved = met.withColumns({"long": long, "cyclic": cyclic}).select(
            "id", F.when(~F.col("cyclic"), F.col("_next")).alias("next"), "own", F.when(F.col("cyclic"), once).otherwise(F.col("long")).alias("chain"),
            F.when(F.col("cyclic"), "cycle").when(there, F.col("_ended")).otherwise("orphan").alias("ended"), F.when(there, F.when(~F.col("cyclic"), F.col("_missing"))).otherwise(F.col("next")).alias("missing_id"),
        )
        new = stored(moved.unionByName(state.filter("next IS NULL")), "walk")
        forget(state)
        state, left = new, _counts(new)[1]
    return state.select("id", F.reverse("chain").alias("chain"), "ended", "missing_id")
