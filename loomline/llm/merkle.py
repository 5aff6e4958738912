"""A Merkle manifest of a dataset: for each row a leaf and the hashes that lead from it to one root.

Rows of a group (a source) are leaves of a tree in order of their identifiers; the roots of the groups, in order of the groups, are leaves of one
more tree. A node is the hash of a run of so many consecutive nodes below. Executors reduce large blocks of leaves, whole subtrees, to a node
each. The few nodes that are left are the top tree: the driver builds it and broadcasts for each block the hashes on its way from there
to the root; executors then go over their blocks again and finish the proof of each row. While more nodes are left than
the driver is to hold, they are reduced by executors in the same way, and their ways up are joined instead of broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need_columns, numbered, ship, written

#: Nodes of a run, levels of a block that one task reduces (729 leaves), and nodes that the driver holds at most.
FAN_OUT, BLOCK_LEVELS, MOST_TOP = 3, 6, 20_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEPS = "array<struct<left: string, right: string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_of(*values: Column) -> Column:
    """The leaf of a row's values, lowercase hex: each is "-" if it is null, else its number of bytes, ":" and the value as text."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def node_of(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def height(n: int, fan_out: int) -> int:
    """Levels above n nodes until one is left."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * fan_out
    return levels


def climbed(nodes: list[str], levels: int, fan_out: int) -> tuple[list[list[tuple[str, str]]], list[str]]:
    """For each node its steps over so many levels (the other nodes of its run, those left and right of it, joined), and the nodes at their end."""
    steps, at = [[] for _ in nodes], range(len(nodes))
    for _ in range(levels):
        sides = []
        for start in range(0, len(nodes), fan_out):
            run = nodes[start : start + fan_out]
            sides += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
        for way, i in zip(steps, at, strict=True):
            way.append(sides[i])
        nodes = [node_of(nodes[start : start + fan_out]) for start in range(0, len(nodes), fan_out)]
        at = [i // fan_out for i in at]
    return steps, nodes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block together, from batches sorted by _group and _block; no more than a batch and a block are held."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        group, block = (t[c].to_numpy() for c in ("_group", "_block"))
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield t.slice(start, stop - start)
        held = t.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


class Forest:
    """Trees by number, whose nodes (_group, _at, _n: nodes of the tree, _node: 32 bytes) are reduced in blocks of ``fan_out ** levels``."""

    def __init__(self, fan_out: int = FAN_OUT, levels: int = BLOCK_LEVELS, most: int = MOST_TOP):
        if fan_out < 2 or levels < 1 or most < 1:
            raise ValueError("a run has two nodes at least, a block one level and the driver one node")
        self.fan_out, self.levels, self.most, self.size = fan_out, levels, most, fan_out**levels

    def in_blocks(self, nodes: DataFrame) -> DataFrame:
        """nodes with _block, each block in one task and in order; a block has ``size`` rows at most."""
        cut = nodes.withColumn("_block", F.floor(F.col("_at") / self.size).cast("long"))
        return cut.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "_at")

    def reduced(self, nodes: DataFrame) -> DataFrame:
        """(_group, _at, _n, _node): a node for each block, after as many levels as a block has, or as the tree has if it is lower."""
        fan_out, levels, size = self.fan_out, self.levels, self.size

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = []
            for block in _blocks(batches):
                n = block["_n"][0].as_py()
                _, top = climbed_top([x.hex() for x in block["_node"].to_pylist()], min(levels, height(n, fan_out)), fan_out)
                out.append((block["_group"][0].as_py(), block["_block"][0].as_py(), -(-n // size), bytes.fromhex(top)))
                if len(out) == 5000:
                    yield _nodes_batch(out)
                    out = []
            if out:
                yield _nodes_batch(out)

        ship(nodes.sparkSession)
        return self.in_blocks(nodes.select("_group", "_at", "_n", "_node")).mapInArrow(work, "_group long, _at long, _n long, _node binary")

    def ways(self, nodes: DataFrame) -> dict | DataFrame:
        """For each node, by (_group, _at), its steps to the top of its tree, and the top: as a dictionary if there are at most ``most`` nodes, else as a written table (_group, _at, _steps, _top).

        Trees of which one node is left are done, however many they are; only the others' nodes are gone on with.
        """
        few = self._few(nodes)
        if few is not None:
            return few
        spark = nodes.sparkSession
        done, left = nodes.filter("_n = 1").select("_group", "_at", F.array().cast(STEPS).alias("_steps"), F.lower(F.hex("_node")).alias("_top")), nodes.filter("_n > 1")
        few = self._few(left)
        if few is not None:
            rest = spark.createDataFrame([(*key, *way) for key, way in few.items()], f"_group long, _at long, _steps {STEPS}, _top string")
        else:
            above = self.ways(written(self.reduced(left), "nodes"))
            rest = self.finished(left, above).select("_group", "_at", F.col("proof").alias("_steps"), F.col("top").alias("_top"))
        return written(done.unionByName(rest), "ways")

    def _few(self, nodes: DataFrame) -> dict | None:
        """The ways of at most ``most`` nodes, worked out by the driver; none if there are more."""
        few = nodes.select("_group", "_at", "_node").limit(self.most + 1).collect()
        if len(few) > self.most:
            return None
        trees: dict[int, list] = {}
        for r in sorted(few, key=lambda r: (r["_group"], r["_at"])):
            trees.setdefault(r["_group"], []).append(r["_node"].hex())
        return self.built(trees)

    def built(self, trees: dict[int, list[str]]) -> dict:
        out = {}
        for group, nodes in trees.items():
            steps, (top,) = climbed(nodes, height(len(nodes), self.fan_out), self.fan_out)
            out |= {(group, i): (way, top) for i, way in enumerate(steps)}
        return out

    def finished(self, nodes: DataFrame, above: dict | DataFrame) -> DataFrame:
        """nodes with proof, the steps to the top, and top; above: what ways() or joined_ways() gave for the blocks.

        A dictionary, which is bounded, is broadcast; a table's row for a block is put before the rows of the block.
        """
        fan_out, levels = self.fan_out, self.levels
        spark, kept = nodes.sparkSession, [c for c in nodes.columns if c != "_block"]
        known = spark.sparkContext.broadcast(above) if isinstance(above, dict) else None
        cut = nodes.withColumns({"_steps": F.lit(None).cast(STEPS), "_top": F.lit(None).cast("string")})
        if known is None:
            heads = above.select("_group", (F.col("_at") * self.size).alias("_at"), "_steps", "_top")
            cut = cut.unionByName(heads, allowMissingColumns=True)
        placed = cut.withColumn("_block", F.floor(F.col("_at") / self.size).cast("long")).repartition("_group", "_block").sortWithinPartitions("_group", "_block", F.col("_top").desc_nulls_last(), "_at")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                if known is None:
                    way, top = [(s["left"], s["right"]) for s in block["_steps"][0].as_py()], block["_top"][0].as_py()
                    block = block.slice(1)
                else:
                    way, top = known.value[block["_group"][0].as_py(), block["_block"][0].as_py()]
                steps, _ = climbed([x.hex() for x in block["_node"].to_pylist()], min(levels, height(block["_n"][0].as_py(), fan_out)), fan_out)
                flat = [s for own in steps for s in (*own, *way)]
                left, right = zip(*flat, strict=True) if flat else ((), ())
                ends = np.arange(len(steps) + 1, dtype=np.int32) * (len(flat) // len(steps))
                proof = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])).cast(_STEPS)
                block = block.combine_chunks()
                yield from block.select(kept).append_column("proof", proof).append_column("top", pa.array([top] * len(steps), pa.string())).to_batches()

        ship(spark)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in kept)
        return placed.mapInArrow(work, f"{kinds}, proof {STEPS}, top string")


def climbed_top(nodes: list[str], levels: int, fan_out: int) -> tuple[int, str]:
    """The one node that is left after the levels, without steps."""
    for _ in range(levels):
        nodes = [node_of(nodes[i : i + fan_out]) for i in range(0, len(nodes), fan_out)]
    (top,) = nodes
    return levels, top


def _nodes_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["_group", "_at", "_n", "_node"])


def manifest(df: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", more: dict[str, Column] | None = None, forest: Forest | None = None) -> DataFrame:
    """One row for each row of df: id, group, leaf, proof, subroot, root, all lowercase hex, and the columns ``more``, expressions over df.

    proof: for each level from the leaf over the root of its group to the root of all, the nodes left and right of the one on the way, joined; folded()
    leads a leaf up with it. Groups are in order of their UTF-8 bytes, null first; within a group rows ascend by id, null first, rows of one id by their leaf, and rows alike in
    both are interchangeable. Null and empty values have different leaves. One row, and one group alone, are their own root; an empty table gives no
    rows. Other columns of df may have any name; ``more`` must not use id, group_col, leaf, proof, subroot, root or names that begin with "_".
    """
    need_columns(df, *fields, id_col, group_col)
    forest, more, spark = forest or Forest(), more or {}, df.sparkSession
    leaves = written(df.select(F.col(group_col).cast("string").alias("_source"), F.col(id_col).alias("_id"), F.unhex(leaf_of(*[F.col(f"`{c}`") for c in fields])).alias("_node"), *[c.alias(n) for n, c in more.items()], F.monotonically_increasing_id().alias("_row")), "leaves")
    nodes = written(numbered(leaves, "_source", [F.col("_id").asc_nulls_first(), F.col("_node"), F.col("_row")], "ordered-leaves").drop("_row"), "leaf-nodes")

    blocks = written(forest.reduced(nodes), "blocks")
    ways = forest.ways(blocks)
    if isinstance(ways, dict):
        subroots = {group: top for (group, at), (_, top) in ways.items() if at == 0}
        tops = forest.built({0: [subroots[g] for g in sorted(subroots)]}) if subroots else {}
        above = {(group, at): ([*way, *tops[0, group][0]], (top, tops[0, group][1])) for (group, at), (way, top) in ways.items()}
        above = {key: (way, "".join(top)) for key, (way, top) in above.items()}
    else:
        groups = written(ways.filter("_at = 0").select(F.lit(0).cast("long").alias("_group"), F.col("_group").alias("_at"), F.unhex("_top").alias("_node")), "subroots")
        tops = forest.ways(groups.withColumn("_n", F.lit(groups.count()).cast("long")))
        if isinstance(tops, dict):
            tops = spark.createDataFrame([(at, way, top) for (_, at), (way, top) in tops.items()], f"_group long, _upper {STEPS}, _root string")
        else:
            tops = tops.select(F.col("_at").alias("_group"), F.col("_steps").alias("_upper"), F.col("_top").alias("_root"))
        above = written(ways.join(tops, "_group").select("_group", "_at", F.concat("_steps", "_upper").alias("_steps"), F.concat("_top", "_root").alias("_top")), "ways-up")

    rows = forest.finished(nodes, above)  # top: both roots, one after the other
    return rows.select(F.col("_id").alias(id_col), F.col("_source").alias(group_col), F.lower(F.hex("_node")).alias("leaf"), "proof", F.left("top", F.lit(64)).alias("subroot"), F.substring("top", 65, 64).alias("root"), *more)


def folded(leaf: Column, proof: Column) -> Column:
    """The root to which a leaf leads by a proof; null without either."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """The hash of all nodes of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents in threes by source; every second document, by the CRC-32 of its id, is held against its proof without its line breaks."""
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    shown = leaf_of(*[tampered if c == "text" else F.col(c) for c in FIELDS])
    rows = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), more={"shown": F.unhex(shown)})
    root = folded(F.lower(F.hex("shown")), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
ORACLE = f"""
WITH RECURSIVE docs AS (
    SELECT *, (list_reduce([4294967295] || flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: list_transform(range(8), lambda b: (ascii(substr(doc_id::VARCHAR, i + 1, 1)) >> b) & 1))),
        lambda c, bit: xor(c >> 1, CASE WHEN (c & 1) <> bit THEN 3988292384 ELSE 0 END)) & 1) = 1 AS tampered FROM documents  -- the last bit of the CRC-32 is turned at its end
), leaves AS (
    SELECT doc_id, source, sha256({_LEAF}) AS leaf, sha256({_LEAF.replace("text::VARCHAR", "CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END")}) AS shown,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM docs
), lower_tree AS (
    SELECT 0 AS level, grp, pos, leaf AS node, count(*) OVER (PARTITION BY grp) AS n FROM leaves
    UNION ALL SELECT level + 1, grp, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), ceil(any_value(n) / 3)::BIGINT FROM lower_tree WHERE n > 1 GROUP BY level, grp, pos // 3
), subroots AS (SELECT grp, level AS subheight, node AS subroot FROM lower_tree WHERE n = 1
), upper_tree AS (
    SELECT 0 AS level, grp AS pos, subroot AS node, count(*) OVER () AS n FROM subroots
    UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), ceil(any_value(n) / 3)::BIGINT FROM upper_tree WHERE n > 1 GROUP BY level, pos // 3
), levels AS (  -- both trees as levels of one, with the key of the run
    SELECT level, grp, pos, pos // 3 AS run, node FROM lower_tree WHERE n > 1
    UNION ALL SELECT u.level + 1000, -1, pos, pos // 3, node FROM upper_tree u WHERE n > 1
), runs AS (SELECT level, grp, run, list(node ORDER BY pos) AS nodes FROM levels GROUP BY ALL
), way AS (
    SELECT l.doc_id, l.grp, k.level, CASE WHEN k.level < 1000 THEN l.pos // (3 ** k.level)::BIGINT ELSE l.grp // (3 ** (k.level - 1000))::BIGINT END AS place
    FROM leaves l JOIN (SELECT DISTINCT level, grp FROM levels) k ON k.grp = l.grp OR k.grp = -1
), steps AS (
    SELECT w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.level) AS step, nodes, place % 3 + 1 AS pos FROM way w JOIN runs r ON r.level = w.level AND r.grp = CASE WHEN w.level < 1000 THEN w.grp ELSE -1 END AND r.run = place // 3
), folds AS (
    SELECT doc_id, 1 AS step, shown AS node FROM leaves
    UNION ALL SELECT f.doc_id, f.step + 1, sha256(array_to_string(s.nodes[:pos - 1], '') || f.node || array_to_string(s.nodes[pos + 1:], '')) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step
), proofs AS (SELECT doc_id, sha256(string_agg(array_to_string(nodes[:pos - 1] || nodes[pos + 1:], ''), '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY doc_id
)
SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM leaves l JOIN subroots s USING (grp) LEFT JOIN proofs p USING (doc_id) JOIN (SELECT doc_id, arg_max(node, step) AS node FROM folds GROUP BY doc_id) f USING (doc_id), (SELECT node FROM upper_tree WHERE n = 1) r
"""
