"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. So every distinct
fingerprint emits all values within r bits, equal values meet, and those that meet are linked. The 2,081
values of a 64-bit fingerprint (r = 2) are not shuffled one by one: a fingerprint goes once to each group of values
that share their first bits, with the bits flipped so far, and the task of that group writes out, sorts and
compares the values. All that meet on one value are within 2r bits of each other, so a star from the first
of them keeps every link: no group is expanded into its pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need_columns, row_key, salted_lookup, ship, without_rows, written
from .components import connected_components

BITS = 64
#: Rows of one group of values that one task should take on average, and values that it holds at a time.
GROUP_ROWS = 40_000
HELD_VALUES = 6_000_000
#: Values beyond which a group is dealt out over several tasks, by so many of their next bits at most.
TASK_VALUES, MORE_BITS = 60_000_000, 12
#: Bits by which a task parts its values at a time; rows that it has as Python objects at a time.
STEP, SLICE = 4, 256


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text as an unsigned number.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a feature is the XXH64 of a shingle of
    so many words joined by single spaces, repeats included. Fewer words make one shingle; no word gives 0. A bit is
    1 if over half of the hashes have it.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(b" ".join(found), seed)
    join = b" ".join
    hashes = np.fromiter((digest(join(s), seed) for s in zip(*(found[i:] for i in range(words)), strict=False)), "<u8", len(found) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for any length
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, *more: Column) -> DataFrame:
    """(_id, _fp) and more columns: the fingerprint of each row's whole text as a signed long; a null text counts as empty."""
    need_columns(df, id_col, text_col)
    ship(df.sparkSession)
    rows = df.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"), *more)
    schema = rows.drop("_text").withColumn("_fp", F.lit(0).cast("long")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                fps = np.array([fingerprint(t, words, seed) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps, pa.int64())], schema.names)

    return rows.mapInArrow(work, schema)


@functools.cache
def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most ``most`` ones, those with fewer first."""
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def prefix_bits(count: int, radius: int) -> int:
    """First bits by which values are grouped, so that a group gets about GROUP_ROWS fingerprints."""
    for p in range(8, 28):
        if count * len(masks(p, radius)) <= GROUP_ROWS * 2**p:
            return p
    return 28


def meet(fps: np.ndarray, used: np.ndarray, prefix: int, radius: int, held: int = HELD_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Links, as two arrays of positions, between fingerprints of one group that share a value within the radius.

    used: bits flipped already to get to the group. A group with more than ``held`` values is parted by their next bits, again and again, so that
    each value is made once and only so many are in memory. The links span the same components as all colliding pairs do.
    """
    left, right = [], []
    todo = [(np.arange(len(fps)), used, prefix)]
    while todo:
        rows, flipped, p = todo.pop()
        low = BITS - p
        counts = np.bincount(flipped, minlength=radius + 1)
        if len(rows) < 2:
            continue
        if sum(int(n) * len(masks(low, radius - u)) for u, n in enumerate(counts)) > held and low > STEP:
            bits = (fps[rows] >> np.uint64(low - STEP)) & np.uint64(2**STEP - 1)
            for s in range(2**STEP):
                now = flipped + np.bitwise_count(bits ^ np.uint64(s))
                near = now <= radius
                todo.append((rows[near], now[near], p + STEP))
            continue
        a, b = _collide(fps, rows, flipped, low, radius)
        left.append(a)
        right.append(b)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(left), np.concatenate(right), len(fps))


def _collide(fps: np.ndarray, rows: np.ndarray, flipped: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each value of the lowest bits that several of the rows reach."""
    rest = fps & np.uint64(2**low - 1)
    values, owners = [], []
    for u in range(radius + 1):
        mine, m = rows[flipped == u], masks(low, radius - u)
        values.append((rest[mine, None] ^ m[None, :]).ravel())
        owners.append(np.repeat(mine, len(m)))
    v, own = np.concatenate(values), np.concatenate(owners)
    ordered = np.sort(v)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(twice, v)
    hit = twice[np.minimum(at, len(twice) - 1)] == v
    v, own = at[hit], own[hit]
    by = np.lexsort((own, v))
    v, own = v[by], own[by]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    star = np.repeat(own[first], np.diff(np.r_[first, len(v)]))
    pairs = np.unique(np.stack([star, own], 1)[star != own], axis=0)
    if (np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) > 2 * radius).any():
        raise AssertionError("fingerprints that share a value are within twice the radius")
    return pairs[:, 0], pairs[:, 1]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars, from the smallest position of each component of the links to its others."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(label, side, least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    others = np.flatnonzero(label != np.arange(n))
    return label[others], others


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between nodes struct(id, fp): they join what any two fingerprints within the distance join.

    distinct: _fp, unique, and _node, the struct for it. distance: an even number of bits.
    """
    radius = distance // 2
    if distance != 2 * radius:
        raise ValueError("meeting in the middle needs an even distance")
    spark = distinct.sparkSession
    p = prefix_bits(distinct.count(), radius)
    low = BITS - p
    flips = F.array(*[F.struct(F.lit(int(m)).alias("m"), F.lit(int(m).bit_count()).alias("used")) for m in masks(p, radius)])
    sent = distinct.select("_fp", F.col("_node.id").alias("_id"), F.explode(flips).alias("f"))
    sent = sent.select(F.shiftrightunsigned("_fp", low).bitwiseXOR(F.col("f.m")).alias("_group"), F.col("f.used").alias("_used"), "_fp", "_id")

    # a group with a tight cluster in it has many values: then it is parted by their next bits, and a fingerprint goes to the parts that it can reach
    sizes = F.element_at(F.array(*[F.lit(len(masks(low, radius - u))) for u in range(radius + 1)]), F.col("_used") + 1)
    heavy = sent.groupBy("_group").agg(F.sum(sizes.cast("long")).alias("_values")).filter(F.col("_values") > TASK_VALUES)
    heavy = heavy.select("_group", F.least(F.lit(MORE_BITS), F.ceil(F.log2(F.col("_values") / TASK_VALUES)) + 1).cast("int").alias("_more"))
    sent = sent.join(heavy, "_group", "left").withColumn("_more", F.coalesce("_more", F.lit(0)))
    further = F.element_at(F.array(*[F.array(*[F.struct(F.lit(int(m)).alias("m"), F.lit(int(m).bit_count()).alias("used")) for m in masks(e, radius)]) for e in range(MORE_BITS + 1)]), F.col("_more") + 1)
    sent = sent.withColumn("f", F.explode(F.filter(further, lambda x: x["used"] + F.col("_used") <= radius)))
    own = F.expr(f"shiftrightunsigned(_fp, {low} - _more) & (shiftleft(1L, _more) - 1)")
    sent = sent.select("_group", "_more", own.bitwiseXOR(F.col("f.m")).alias("_part"), (F.col("_used") + F.col("f.used")).alias("_used"), "_fp", "_id")

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_id", "_fp"], ignore_index=True)
        fps = frame["_fp"].to_numpy(np.int64).view(np.uint64)
        a, b = meet(fps, frame["_used"].to_numpy(), p + int(key[1]), radius)
        fp, ids = frame["_fp"].to_numpy(), frame["_id"].to_numpy()
        return pd.DataFrame({"a_id": ids[a], "a_fp": fp[a], "b_id": ids[b], "b_fp": fp[b]})

    ship(spark)
    # few bytes but much work: the number of partitions is given, so that they are not put together by their size
    sent = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_group", "_part")
    found = sent.groupBy("_group", "_more", "_part").applyInPandas(work, "a_id long, a_fp long, b_id long, b_fp long")
    node = lambda x: F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_fp").alias("fp")).alias(x)
    return found.select(node("a"), node("b"))


#: Stands for a null id in the order of nodes; no row may have it.
NO_ID = 2**63 - 1


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One row for each row of df: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Fingerprints are linked at ``distance`` (an even number) or fewer differing bits. Exact over all rows: no cap on
    the size of groups. Null and empty texts have fingerprint 0, linked like any other. Repeated rows and ids come out as
    often as they go in. A null id is never the smallest; a component of null ids only has a null component_id. An empty
    table gives no rows; columns other than the two named may have any name.
    """
    rows = written(fingerprints(df, id_col, text_col, words, seed, F.monotonically_increasing_id().alias("_row")), "fingerprints")
    least = F.col("_component.id")
    of = _components(rows, distance).select("_fp", F.when(least != NO_ID, least).alias("component_id"))
    out = salted_lookup(rows, of, "_fp", "_row")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(rows: DataFrame, distance: int) -> DataFrame:
    """(_fp, _component) for each fingerprint of rows (_id, _fp): the least node struct(id, fp) reachable, with NO_ID for a null id."""
    node = F.struct(F.coalesce(F.min("_id"), F.lit(NO_ID)).alias("id"), F.col("_fp").alias("fp"))
    distinct = written(rows.groupBy("_fp").agg(node.alias("_node")), "distinct")
    labels = connected_components(links(distinct, distance))
    of = distinct.join(labels, F.col("_node") == F.col("node"), "left")
    return of.select("_fp", F.coalesce("component", "_node").alias("_component"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """One row of df for each component, with all columns of df under whatever names: that with its smallest id.

    Null ids are the last choice; between rows of one id the place where they are stored decides. Rows are told apart by that place, so a row that goes takes no other with it.
    """
    keyed, names = row_key(df)
    place = [F.col(c).alias(n) for c, n in zip(names, ("_in_file", "_in_place"), strict=True)]
    rows = written(fingerprints(keyed, id_col, text_col, words, 42, *place), "fingerprints")
    choice = F.struct(F.coalesce("_id", F.lit(NO_ID)).alias("id"), F.col("_id").isNull().alias("none"), "_in_file", "_in_place")
    # the best row of each fingerprint, then of each component; single rows need no answer
    best = _components(rows, distance).join(rows.groupBy("_fp").agg(F.min(choice).alias("_best"), F.count("*").alias("_n")), "_fp")
    stays = best.groupBy("_component").agg(F.min("_best").alias("_stays"), F.sum("_n").alias("_all")).filter("_all > 1").select("_component", "_stays")
    of = salted_lookup(best.select("_fp", "_component"), stays, "_component", "_fp").filter("_stays is not null").select("_fp", "_stays")
    judged = salted_lookup(rows, of, "_fp", "_in_file", "_in_place").filter("_stays is not null")
    gone = judged.filter(~((F.col("_stays._in_file") == F.col("_in_file")) & (F.col("_stays._in_place") == F.col("_in_place"))))
    return without_rows(keyed, names, gone.select(F.col("_in_file").alias(names[0]), F.col("_in_place").alias(names[1])))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: four-word shingles, XXH64 with seed 42, at most four differing bits, all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
