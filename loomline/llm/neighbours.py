"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors get one more coordinate so that all have the same length; then the largest inner product is the least
Euclidean distance, for which projections on Gaussian directions, cut into slots, are a locality-sensitive hash. Each of a few tables holds every
vector in the bucket of its slots. A query visits, in each table, its own and perturbed buckets in the order of their
estimated success, until the chance that a neighbour was met reaches what is asked for. The candidates of all tables are merged and
ranked by their exact inner products, within the tasks that hold their buckets.

Equal vectors are one point with the least of their ids, as many as can matter to an answer, so the commonest vector is compared once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need_columns, salted_lookup, ship, written

#: Vectors from which the estimates of success are fitted: a bound on the sample, whatever the input; all vectors are indexed.
FIT_VECTORS, FIT_QUERIES = 16_000, 150
TABLES, RECALL = 2, 0.97
#: Vectors that a bucket should have on average; slot width in standard deviations.
BUCKET, WIDTH = 64, 1.4
#: Vectors of the index that a task should have at least, where there are tasks enough, and those that it may have at most.
SHARE, MOST_SHARE = 3_000, 100_000
#: Combinations of slots that are held at a time, the best of them, and the chance below which a single slot is not tried.
MOST_PROBES, LEAST_CHANCE = 20_000, 0.004
#: Queries of the sample by which the number of projections is chosen, and the share of them whose probes must reach the wanted chance.
TRIED, REACH = 24, 0.9
NO_KEYS = np.empty(0, np.int64)
_erf = np.vectorize(math.erf, otypes=[float])


def _below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


@dataclass
class Hashing:
    """Projections of the tables and what is known of where neighbours fall."""

    longest: float
    centre: np.ndarray
    directions: np.ndarray  # tables, projections, dimensions + 1
    shifts: np.ndarray  # tables, projections
    width: float
    slope: float  # of a neighbour's projection on the query's
    spread: float  # of what is left
    reach: tuple[int, int]  # slots from and to
    chance: float  # that a table should meet a neighbour
    most: int = MOST_PROBES

    def lengthened(self, x: np.ndarray, query: bool) -> np.ndarray:
        """With the coordinate that makes all lengths equal; queries, whose length does not matter, are stretched instead."""
        length = np.linalg.norm(x, axis=1)
        if query:
            return np.column_stack([x * (self.longest / length)[:, None], np.zeros(len(x))]) - self.centre
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - length**2, 0))]) - self.centre

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """tables, vectors, projections; in slots."""
        y = self.lengthened(x, query)
        return np.einsum("nd,tkd->tnk", y, self.directions) / self.width

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table: tables, vectors."""
        slots = np.clip(np.floor(self.project(x, False) + self.shifts[:, None, :]), *self.reach).astype(np.int64)
        return np.stack([self._key(t, s) for t, s in enumerate(slots)])

    @staticmethod
    def _key(table: int, slots: np.ndarray) -> np.ndarray:
        key = np.full(len(slots), table + 1, np.uint64)
        for column in slots.T:
            key = (key ^ (column.astype(np.int64) + 64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return (key >> np.uint64(1)).astype(np.int64)

    def probes(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query its buckets in all tables, in each those of greatest estimated success whose chances sum to what is asked for, and the least sum of a table."""
        out: list[list[np.ndarray]] = [[] for _ in q]
        reached = np.ones(len(q))
        slots = np.arange(self.reach[0], self.reach[1] + 1)
        sd = self.spread / self.width
        for t, projected in enumerate(self.project(q, True)):
            middle = projected * self.slope + self.shifts[t]
            edges = _below((np.r_[slots, slots[-1] + 1] - middle[..., None]) / sd)
            edges[..., 0], edges[..., -1] = 0, 1  # outer slots reach on without end
            chances = np.diff(edges, axis=-1)
            for i, chance in enumerate(chances):
                p, found = np.ones(1), np.zeros((1, 0), np.int64)
                for row in chance:
                    likely = np.flatnonzero(row >= LEAST_CHANCE)
                    row, own = row[likely], slots[likely]
                    p = (p[:, None] * row).ravel()
                    found = np.column_stack([np.repeat(found, len(own), axis=0), np.tile(own, len(found))])
                    if len(p) > self.most:  # the best of all begin with the best of these
                        best = np.argpartition(-p, self.most)[: self.most]
                        p, found = p[best], found[best]
                order = np.argsort(-p, kind="stable")
                sums = np.cumsum(p[order])
                n = int(np.searchsorted(sums, self.chance)) + 1
                reached[i] = min(reached[i], sums[min(n, len(sums)) - 1])
                out[i].append(self._key(t, found[order[:n]]))
        return [np.concatenate(x) for x in out], reached


def fit(sample: np.ndarray, longest: float, count: int, k: int, tables: int = TABLES, recall: float = RECALL, most: int = MOST_PROBES, seed: int = 7) -> Hashing:
    """sample: vectors of the corpus, of which there are count; the fit costs the same whatever the count.

    There are as many projections as the count asks for, but no more than with which the probes of most queries still reach the wanted chance:
    where neighbours are hardly nearer than others, buckets grow instead of being left out.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    projections = max(1, round(math.log2(max(2.0, count / BUCKET)) / 1.55))
    directions, shifts = rng.standard_normal((tables, projections, d)) / math.sqrt(d), rng.uniform(0, 1, (tables, projections))  # a Gaussian direction is sqrt(d) long
    h = Hashing(longest, np.zeros(d), directions, shifts, 1.0, 1.0, 1.0, (-4, 3), 1 - (1 - recall) ** (1 / tables), most)
    x = h.lengthened(sample, False)
    h.centre = x.mean(0)
    x = x - h.centre
    h.width = WIDTH * max(1e-12, math.sqrt((x**2).sum(1).mean() / d)) if len(x) > 1 else 1.0
    q = h.lengthened(sample[:FIT_QUERIES], True)
    near = np.einsum("qd,nd->qn", sample[:FIT_QUERIES], sample)
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    rank = min(len(sample) - 1, max(1, math.ceil(k * len(sample) / max(1, count))))
    if rank >= 1:
        top = np.argpartition(-near, rank - 1, axis=1)[:, :rank]
        a, b = np.repeat(q, rank, axis=0), x[top.ravel()]
        h.slope = float((a * b).sum() / max(1e-12, (a * a).sum()))
        h.spread = max(1e-9 + 0.05 * h.width, math.sqrt(((b - h.slope * a) ** 2).sum(1).mean() / d))
    while projections > 1 and (h.probes(sample[:TRIED])[1] >= h.chance).mean() < REACH:
        projections -= 1
        h.directions, h.shifts = directions[:, :projections], shifts[:, :projections]
    return h


def valid(vector: Column) -> Column:
    """Not null, not zero, no component null or not finite."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda v: F.coalesce((v == v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(value, lambda v: v != 0), F.lit(False))


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float = RECALL, most_probes: int = MOST_PROBES) -> DataFrame:
    """(query_id, rank, id, score, expected_recall) of the k rows found with the largest inner product to each query, in double precision, nearest first, ties to the smaller id.

    expected_recall: what the estimates say of the query's probes; a query whose probes could not reach ``recall`` is compared with every vector and has 1.

    queries: a condition on df; every row that meets it is a query, and all rows but those of its own id are its candidates. All candidates are
    returned if there are fewer than k. most_probes: combinations of slots that are held at a time for a query and table; fewer give larger buckets or
    more queries that are compared with every vector, not less recall. Vectors that are null, zero, of another dimension than most or with components that are null or
    not finite, and rows without an id, take no part. Rows that repeat id and vector count once. Empty tables give no rows.
    """
    need_columns(df, id_col, vector_col)
    spark = df.sparkSession
    ship(spark)
    rows = df.filter(valid(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vec"), F.coalesce(queries, F.lit(False)).alias("_asks"))
    sizes = rows.groupBy(F.size("_vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = f"query_id long, rank int, {id_col} long, score double, expected_recall double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("_vec") == sizes["d"])

    # of equal vectors the k + 1 least ids can be in an answer, one of them the query's own
    nth = F.row_number().over(W.partitionBy("_vec").orderBy("_id"))
    least = rows.select("_id", "_vec").distinct().withColumn("_nth", nth).filter(F.col("_nth") <= k + 1)
    points = written(least.groupBy("_vec").agg(F.sort_array(F.collect_list("_id")).alias("_ids")).withColumn("_p", F.monotonically_increasing_id()), "points")
    asked = written(rows.filter("_asks").groupBy("_vec").agg(F.min("_id").alias("_first")).withColumn("_q", F.monotonically_increasing_id()), "asked")

    count, longest = points.agg(F.count("*"), F.max(F.sqrt(F.aggregate("_vec", F.lit(0.0), lambda a, v: a + v * v)))).first()
    share = min(1.0, FIT_VECTORS / count)
    drawn = points.filter(F.pmod(F.xxhash64("_vec"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("_vec").limit(2 * FIT_VECTORS).toPandas()
    sample = np.stack(drawn["_vec"].to_list()) if len(drawn) else np.zeros((0, sizes["d"]))
    if len(sample) < 2:
        sample = np.stack([r["_vec"] for r in points.select("_vec").limit(2).collect()])
    sample = np.asarray(sample, float)
    hashing = spark.sparkContext.broadcast(fit(sample, longest, count, k, tables, recall, most_probes))
    reference = spark.sparkContext.broadcast(sample)
    # every part is searched by most queries: no more parts than there are tasks at a time, unless they would be too large for one
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(count * tables / MOST_SHARE), min(math.ceil(count * tables / SHARE), tasks))

    def bucketed(batches):
        for b in batches:
            if b.num_rows:
                yield b, hashing.value.keys(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))

    def sizes_of_parts(batches):
        held = np.zeros(parts, np.int64)
        for _, keys in bucketed(batches):
            held += np.bincount((keys % parts).ravel(), minlength=parts)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["part", "n"])

    # a part with a bucket of very many near vectors is split by vector; its queries go to all of its splits
    split = np.ones(parts, np.int64)
    for r in points.select("_p", "_vec").mapInArrow(sizes_of_parts, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():  # a row for each part at most
        split[r["part"]] = max(1, round(r["n"] / max(SHARE, 2 * count * tables / parts)))
    first = np.r_[0, np.cumsum(split)[:-1]]
    every = int(split.sum())

    def index(batches):
        for b, keys in bucketed(batches):
            own = b.column(0).to_numpy() * 0x9E3779B1 >> 7
            for t, key in enumerate(keys):
                part = key % parts
                yield pa.RecordBatch.from_arrays([pa.array((first[part] + own % split[part]).astype(np.int32)), pa.array(key), pa.array(np.full(len(key), t == 0)), *b.columns], ["_part", "_key", "_once", "_p", "_vec", "_least"])

    def probe(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                rows = []
                # what so many vectors of the sample exceed can't be among the k + 1 nearest
                known = x @ reference.value.T
                enough = 2 * (k + 1)
                bound = np.partition(known, -enough, axis=1)[:, -enough] if known.shape[1] >= enough else np.full(len(x), -np.inf)
                probes, reached = hashing.value.probes(x)
                for q, vec, keys, least, chance in zip(b.column(0).to_pylist(), x, probes, bound, reached, strict=True):
                    if chance < hashing.value.chance:
                        rows += [(part, q, vec, least, NO_KEYS, 1.0) for part in range(every)]
                        continue
                    of = keys % parts
                    order = np.argsort(of, kind="stable")
                    cut = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
                    for g in np.split(order, cut[1:]):
                        part = int(of[g[0]])
                        rows += [(int(first[part]) + i, q, vec, least, keys[g], 1 - (1 - chance) ** tables) for i in range(split[part])]
                part, q, vec, least, keys, chance = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(q, pa.int64()), pa.array(vec, pa.list_(pa.float64())), pa.array(least, pa.float64()), pa.array(keys, pa.list_(pa.int64())), pa.array(chance, pa.float64())], ["_part", "_q", "_vec", "_bound", "_keys", "_chance"])

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Candidates in the shared buckets of one part, and of them the k + 1 best of each query."""
        empty = pd.DataFrame({"_q": [], "_p": [], "_least": [], "_score": [], "_chance": []}).astype({"_q": "int64", "_p": "int64", "_least": "int64", "_score": "float64", "_chance": "float64"})
        if not len(left) or not len(right):
            return empty
        left = left.sort_values("_key", ignore_index=True)
        x, key, p, low = np.stack(left["_vec"].to_list()), left["_key"].to_numpy(), left["_p"].to_numpy(), left["_least"].to_numpy()
        y, q, bound, chance = np.stack(right["_vec"].to_list()), right["_q"].to_numpy(), right["_bound"].to_numpy(), right["_chance"].to_numpy()
        wanted = np.concatenate(right["_keys"].to_list())
        who = np.repeat(np.arange(len(q)), right["_keys"].map(len).to_numpy())
        full = np.flatnonzero(right["_keys"].map(len).to_numpy() == 0)  # these compare with every vector, once
        kinds, start = np.unique(key, return_index=True)
        stop = np.r_[start[1:], len(key)]
        at = np.searchsorted(kinds, wanted)
        hit = kinds[np.minimum(at, len(kinds) - 1)] == wanted
        order = np.argsort(at[hit], kind="stable")
        at, who = at[hit][order], who[hit][order]
        groups = [(slice(start[at[g[0]]], stop[at[g[0]]]), who[g]) for g in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(g)]
        if len(full):
            groups.append((np.flatnonzero(left["_once"].to_numpy()), full))
        out = []
        for span, mine in groups:
            for block in np.array_split(mine, max(1, len(mine) * (len(key) if len(full) else BUCKET) // 4_000_000)):
                near, ids, names = y[block] @ x[span].T, low[span], p[span]
                edge = bound[block, None]
                if near.shape[1] > k + 1:
                    edge = np.maximum(edge, -np.partition(-near, k, axis=1)[:, k : k + 1])
                r, c = np.nonzero(near >= edge - 1e-9 * np.abs(near).max(initial=0.0))  # with all ties at the edge, whatever products of blocks are rounded to
                out.append((block[r], np.einsum("nd,nd->n", y[block[r]], x[span][c]), ids[c], names[c]))
        if not sum(len(x[0]) for x in out):
            return empty
        who, score, ids, names = (np.concatenate(v) for v in zip(*out, strict=True))
        order = np.lexsort((names, ids, -score, who))
        who, score, ids, names = who[order], score[order], ids[order], names[order]
        fresh = np.r_[True, (who[1:] != who[:-1]) | (names[1:] != names[:-1])]  # tables of one part may share a candidate
        who, score, ids, names = who[fresh], score[fresh], ids[fresh], names[fresh]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        keep = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) <= k
        return pd.DataFrame({"_q": q[who[keep]], "_p": names[keep], "_least": ids[keep], "_score": score[keep], "_chance": chance[who[keep]]})

    table = points.select("_p", "_vec", F.col("_ids")[0].alias("_least")).mapInArrow(index, "_part int, _key long, _once boolean, _p long, _vec array<double>, _least long")
    held = table.repartition(every, "_part").groupBy("_part")

    def search(asks: DataFrame) -> DataFrame:
        """(_q, _found): the k + 1 best (score, id) of each query, merged over all parts."""
        found = held.cogroup(asks.repartition(every, "_part").groupBy("_part")).applyInPandas(rank, "_q long, _p long, _least long, _score double, _chance double")
        merged = found.groupBy("_q", "_p").agg(F.max("_score").alias("_score"), F.min("_least").alias("_least"), F.min("_chance").alias("_chance"))
        best = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("_score"), "_least"))
        few = merged.withColumn("_nth", best).filter(F.col("_nth") <= k + 1).join(points.select("_p", "_ids"), "_p")  # each stands for one id at least
        ids = F.flatten(F.collect_list(F.transform("_ids", lambda i: F.struct((-F.col("_score")).alias("far"), i.alias("id")))))
        return few.groupBy("_q").agg(F.slice(F.array_sort(ids), 1, k + 1).alias("_found"), F.min("_chance").alias("_chance"))

    # few bytes but much work: the number of partitions is given, so that they are not put together by their size
    dealt = asked.select("_q", "_vec").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = written(search(dealt.mapInArrow(probe, "_part int, _q long, _vec array<double>, _bound double, _keys array<long>, _chance double")), "found")
    total = points.agg(F.sum(F.size("_ids"))).first()[0]
    enough = min(k + 1, total)
    # a query that met fewer than there are is compared with every vector
    poor = asked.join(found.filter(F.size("_found") >= enough), "_q", "left_anti").select("_q", "_vec")
    if not poor.isEmpty():
        full = poor.select(F.explode(F.sequence(F.lit(0), F.lit(every - 1))).alias("_part"), "_q", "_vec", F.lit(float("-inf")).alias("_bound"), F.array().cast("array<long>").alias("_keys"), F.lit(1.0).alias("_chance"))
        rest = written(search(full), "found")
        found = found.join(rest, "_q", "left_anti").unionByName(rest)
    answers = asked.join(found, "_q").select("_vec", "_found", "_chance")
    out = salted_lookup(rows.filter("_asks").select("_id", "_vec").distinct(), answers, "_vec", "_id")
    mine = F.slice(F.filter("_found", lambda x: x["id"] != F.col("_id")), 1, k)
    out = out.select(F.col("_id").alias("query_id"), "_chance", F.posexplode(mine).alias("_at", "_one"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_one.id").alias(id_col), (-F.col("_one.far")).alias("score"), F.col("_chance").alias("expected_recall"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every vector whose vec_id is divisible by 20 against all others, 20 nearest each."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
