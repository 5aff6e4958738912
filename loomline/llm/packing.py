"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily with the largest piece that fits, again and again; then its smallest piece gives
way to two unpacked ones if these fill the gap, widened by it, more tightly. Pieces of one length are alike, so the heuristic runs
over how many pieces have each length: at most ``capacity`` numbers, however large the corpus is. A bin is made
as often as its lengths allow. The pieces themselves stay distributed: each gets its rank among those
of its length, and the plan says which sequence and place that rank has.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need_columns, ship, text_or_empty, written
from .tokens import public_tokenizer, word_bpe

#: Pieces of one length that are ranked together in one group, unless a length would then have more groups than this.
RANKED, GROUPS = 200, 50_000


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int | None = 1) -> DataFrame:
    """(_id, piece, start, length, ids_crc32): the tokens of each whole text, then ``end``, cut only beyond the capacity."""
    need_columns(df, id_col, text_col)
    ship(df.sparkSession)
    last = b"" if end is None else np.array([end], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_bpe(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for i, ids in zip(b.column(0).to_pylist(), cache.ids(b.column(1).to_pylist()), strict=True):
                    ids += last
                    for n, s in enumerate(range(0, max(1, len(ids)), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        rows.append((i, n, s // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_id", "piece", "start", "length", "ids_crc32"])

    texts = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    return texts.mapInArrow(work, "_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (pieces of each length, how often the bin is made); counts: pieces of each length from 1 to capacity."""
    left = {length: n for length, n in counts.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a length is outside 1..capacity")
    sizes = sorted(left)
    bins = []

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length], sizes[bisect_right(sizes, length) - 1]

    def give(length: int) -> None:
        if length not in left:
            insort(sizes, length)
        left[length] = left.get(length, 0) + 1

    while sizes:
        held: dict[int, int] = {}
        gap = capacity
        while at := bisect_right(sizes, gap):
            length = sizes[at - 1]
            n = min(left[length], gap // length)
            held[length] = held.get(length, 0) + n
            take(length, n)
            gap -= n * length
        while gap and sizes:
            small = min(held)
            two = _best_pair(sizes, left, gap + small)
            if two is None or sum(two) <= small:
                break
            for length in two:
                take(length, 1)
                held[length] = held.get(length, 0) + 1
            held[small] -= 1
            if not held[small]:
                del held[small]
            give(small)
            gap += small - sum(two)
        times = 1 + min(left.get(length, 0) // n for length, n in held.items())
        for length, n in held.items():
            if times > 1:
                take(length, n * (times - 1))
        bins.append((held, times))
    return bins


def _best_pair(sizes: list[int], left: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum that fits the room."""
    a = np.array(sizes)
    b_at = np.searchsorted(a, np.minimum(room - a, a), side="right") - 1
    alone = (b_at >= 0) & (a[np.maximum(b_at, 0)] == a) & np.array([left[x] < 2 for x in sizes])
    b_at = np.where(alone, b_at - 1, b_at)  # a length of which one piece is left can't pair with itself
    good = b_at >= 0
    if not good.any():
        return None
    total = np.where(good, a + a[np.maximum(b_at, 0)], -1)
    best = int(total.argmax())
    return int(a[best]), int(a[b_at[best]])


class Plan:
    """Where the pieces of each length go by rank; its size is bounded by the capacity, not by the corpus."""

    def __init__(self, counts: dict[int, int], capacity: int):
        rows, given, sequence = [], dict.fromkeys(counts, 0), 0
        for held, times in best_two_fit(counts, capacity):
            offset = 0
            for length in sorted(held, reverse=True):
                n = held[length]
                rows.append((length, given[length], n, sequence, offset))
                given[length] += n * times
                offset += n * length
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.length, self.rank, self.copies, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = self._key(self.length, self.rank)

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << 44) + rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, self._key(length, rank), side="right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset: every piece whole, in a sequence of at most ``capacity`` tokens, without gaps.

    pieces: a stored table with length from 1 to capacity and _id, piece and ids_crc32, by which ties are ordered. Rows that
    are alike in all of these are interchangeable.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))
    n = F.count("*")
    of_length = pieces.groupBy("length").agg(F.ceil(n / F.greatest(F.lit(RANKED), n / GROUPS)).alias("_groups"))
    dealt = pieces.join(F.broadcast(of_length), "length")  # capacity rows at most
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.col("_groups"))).drop("_groups")
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(W.partitionBy("length", "_group").orderBy("_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("_nth", nth).join(starts, ["length", "_group"]).withColumn("_rank", F.col("_start") + F.col("_nth") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.value.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ship(spark)
    return ranked.withColumn("_at", place("length", "_rank")).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int | None = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    Every document is tokenised whole and ends with the token ``end``; a null text counts as empty and so is that token
    alone. Only documents longer than the capacity are cut. Repeated rows and ids are packed as often as they occur; an empty
    table gives no rows. Columns other than the two named may have any name.
    """
    pieces = written(token_pieces(df, tokenizer, id_col, text_col, capacity, end), "pieces")
    out = pack(pieces.filter("length > 0"), capacity)
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents in sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("word_bpe_49k.json"))
