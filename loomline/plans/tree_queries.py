"""Registered queries on numbers of an Euler tour and on deep chains, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import hierarchy, intervals
from loomline.plans.mapping import duckdb, view
from loomline.plans.registry import register

_RANKED = """, r AS (SELECT *, row_number() OVER (PARTITION BY parent_line_id ORDER BY created_at, id) AS n FROM lines),
    b AS (SELECT id, parent_line_id, id AS root_id, 0 AS depth, lpad(n::VARCHAR, 10, '0') AS sort_path, [id] AS ids FROM r WHERE parent_line_id IS NULL
    UNION ALL SELECT r.id, r.parent_line_id, b.root_id, b.depth + 1, b.sort_path || '.' || lpad(r.n::VARCHAR, 10, '0'), list_append(b.ids, r.id) FROM r JOIN b ON r.parent_line_id = b.id),
    below AS (SELECT unnest(ids) AS id, id AS line_id FROM b)"""
_CHAINS = """, c AS (SELECT id, created_at, o_orderkey AS k, o_custkey % 20 AS chain FROM threads JOIN orders ON id = 'O' || o_orderkey),
    p AS (SELECT id, row_number() OVER w - 1 AS depth, first_value(id) OVER w AS root_id, first_value(created_at) OVER w AS begun, count(*) OVER (PARTITION BY chain) AS n FROM c WINDOW w AS (PARTITION BY chain ORDER BY k)),
    s AS (SELECT root_id, coalesce(sum(n) OVER (ORDER BY begun, root_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT DISTINCT root_id, begun, n FROM p))"""


@register("thread_depths", duckdb("threads") + _CHAINS + " SELECT id, depth::INT AS depth, root_id FROM p")
def thread_depths(spark, d):
    return hierarchy.depths(view(spark, d, "threads")).select("id", "depth", "root_id")


@register("thread_intervals", duckdb("threads") + _CHAINS + " SELECT id, depth::INT AS depth, before + depth + 1 AS entry, before + n AS exit FROM p JOIN s USING (root_id)")
def thread_intervals(spark, d):
    return intervals.number(view(spark, d, "threads")).select("id", "depth", "entry", "exit")


@register("line_intervals", duckdb("lines") + _RANKED + ", e AS (SELECT *, row_number() OVER (ORDER BY sort_path) AS entry FROM b) SELECT id, parent_line_id, depth, root_id, entry, entry + (SELECT count(*) FROM below WHERE below.id = e.id) - 1 AS exit FROM e")
def line_intervals(spark, d):
    return intervals.number(view(spark, d, "lines"))


@register("is_descendant", duckdb("lines") + _RANKED + """, pairs AS (SELECT id AS line, 'N' || length(name) AS above FROM lines UNION ALL SELECT id, 'R' || (substr(id, 2)::INT % 5) FROM lines)
    SELECT line, above, EXISTS (SELECT 1 FROM below WHERE below.id = pairs.above AND below.line_id = pairs.line AND pairs.line <> pairs.above) AS is_below FROM pairs""")
def is_descendant(spark, d):
    rows = view(spark, d, "lines")
    by_name = rows.select(F.col("id").alias("line"), F.concat(F.lit("N"), F.length("name")).alias("above"))
    by_number = rows.select(F.col("id").alias("line"), F.concat(F.lit("R"), F.substring("id", 2, 20).cast("int") % 5).alias("above"))
    return intervals.are_below(intervals.number(rows), by_name.union(by_number))


@register("subtree", duckdb("lines") + _RANKED + " SELECT b.id, depth FROM below JOIN b ON b.id = below.line_id WHERE below.id = 'R2'")
def subtree(spark, d):
    return intervals.subtree(intervals.number(view(spark, d, "lines")), "R2").select("id", "depth")


@register("subtree_counts", duckdb("lines", "messages") + _RANKED + """, m AS (SELECT line_id, count(*) AS n FROM messages GROUP BY line_id)
    SELECT below.id, count(*) AS lines, coalesce(sum(CASE WHEN below.line_id = below.id THEN n END), 0)::BIGINT AS own, coalesce(sum(n), 0)::BIGINT AS messages FROM below LEFT JOIN m ON m.line_id = below.line_id GROUP BY below.id""")
def subtree_counts(spark, d):
    return intervals.subtree_sums(intervals.number(view(spark, d, "lines")), view(spark, d, "messages"), F.lit(1), "messages")


@register("thread_totals", duckdb("threads") + _CHAINS + ", v AS (SELECT 'O' || o_orderkey AS id, o_totalprice::BIGINT AS price FROM orders) SELECT id, (n - depth)::BIGINT AS lines, price AS own, sum(price) OVER (PARTITION BY root_id ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS price_below FROM p JOIN v USING (id)")
def thread_totals(spark, d):
    prices = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("O"), "o_orderkey").alias("line_id"), F.bround("o_totalprice").cast("long").alias("price"))
    return intervals.subtree_sums(intervals.number(view(spark, d, "threads")), prices, F.col("price"), "price_below")


@register("way_to_line", duckdb("lines") + _RANKED + " SELECT w.id, w.depth FROM b, b AS w WHERE b.id = 'C7' AND list_contains(b.ids, w.id)")
def way_to_line(spark, d):
    return intervals.way_to(intervals.number(view(spark, d, "lines")), "C7").select("id", "depth")
