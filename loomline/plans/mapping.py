"""The data model over the test tables: views in SQL that Spark and DuckDB both read, but for how they write times.

lines: region, nation and customer as a tree of three levels; messages: events, on the line of their user; tasks: orders; tagged: parts
as lines whose tags are the words of their names, in groups by brand; threads: orders as lines in twenty deep chains; notes: documents; talk: conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"epoch": "TIMESTAMP_NTZ'2020-01-01 00:00:00'", "minutes": "timestampadd(MINUTE, {0}, TIMESTAMP_NTZ'2020-01-01 00:00:00')", "words": "split({0}, ' ')", "each": "explode", "k": "get_json_object(props, '$.k')", "none": "CAST(NULL AS TIMESTAMP_NTZ)"}
DUCKDB = {"epoch": "TIMESTAMP '2020-01-01 00:00:00'", "minutes": "(TIMESTAMP '2020-01-01 00:00:00' + to_minutes(CAST({0} AS BIGINT)))", "words": "string_split({0}, ' ')", "each": "unnest", "k": "json_extract_string(props, '$.k')", "none": "CAST(NULL AS TIMESTAMP)"}

#: View: (tables that it reads, SQL).
VIEWS = {
    "lines": (
        ["region", "nation", "customer"],
        """SELECT 'R' || r_regionkey AS id, r_name AS name, CAST(NULL AS STRING) AS parent_line_id, {minutes[r_regionkey]} AS created_at, {none} AS updated_at FROM region
        UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey, {minutes[100 - n_nationkey]}, {minutes[n_nationkey * 7]} FROM nation
        UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || c_nationkey, {minutes[c_custkey % 50]}, CASE WHEN c_custkey % 3 = 0 THEN {none} ELSE {minutes[c_custkey * 3]} END FROM customer""",
    ),
    "messages": (
        ["events"],
        """SELECT 'E' || event_id AS id, event_type || ' ' || event_id || ' of ' || user_id AS content, ts AS timestamp, CASE WHEN event_id % 4 = 0 THEN {none} ELSE ts END AS updated_at, 'C' || user_id AS line_id,
        CASE event_type WHEN 'purchase' THEN 'task' WHEN 'error' THEN 'document' WHEN 'signup' THEN 'session' WHEN 'view' THEN CAST(NULL AS STRING) ELSE 'text' END AS type, event_type AS author,
        CASE CAST({k} AS INT) % 5 WHEN 0 THEN '{{"completed":true,"priority":"high"}}' WHEN 1 THEN '{{"completed":false,"priority":"low"}}' WHEN 2 THEN '{{"completed":"yes"}}' WHEN 3 THEN '{{"priority":"urgent","timeSpent":15}}' ELSE CAST(NULL AS STRING) END AS metadata,
        CASE WHEN event_id % 50 = 0 THEN true WHEN event_id % 50 = 1 THEN CAST(NULL AS BOOLEAN) ELSE false END AS deleted FROM events""",
    ),
    "orders_as_tasks": (
        ["orders"],
        """SELECT 'O' || o_orderkey AS id, 'order ' || o_orderkey || ' ' || o_orderpriority AS content, o_orderdate AS timestamp, CASE WHEN o_orderkey % 3 = 0 THEN {none} ELSE o_orderdate END AS updated_at, 'C' || o_custkey AS line_id, 'task' AS type,
        CASE o_orderpriority WHEN '1-URGENT' THEN '{{"priority":"urgent",' WHEN '2-HIGH' THEN '{{"priority":"high",' WHEN '5-LOW' THEN '{{"priority":"low",' WHEN '4-NOT SPECIFIED' THEN '{{"priority":"none",' ELSE '{{' END || CASE WHEN o_orderstatus = 'F' THEN '"completed":true}}' ELSE '"completed":false}}' END AS metadata, false AS deleted FROM orders""",
    ),
    "tagged": (["part"], "SELECT 'P' || p_partkey AS id, p_name AS name, {words[p_name]} AS tag_ids FROM part"),
    "tags": (["part"], "SELECT id, id AS name, CAST(NULL AS STRING) AS color, CASE WHEN length(id) % 3 = 0 THEN CAST(NULL AS STRING) ELSE min(p_brand) END AS group_id FROM (SELECT {each}({words[p_name]}) AS id, p_brand FROM part) AS w GROUP BY id"),
    "tag_groups": (["part"], """SELECT DISTINCT p_brand AS id, 'group ' || p_brand AS name, CAST(substr(p_brand, 7) AS INT) AS "order", CAST(NULL AS STRING) AS color FROM part"""),
    "threads": (["orders"], "SELECT 'O' || o_orderkey AS id, 'order ' || o_orderkey AS name, 'O' || lag(o_orderkey) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS parent_line_id, o_orderdate AS created_at, {none} AS updated_at FROM orders"),
    "notes": (["documents"], "SELECT 'D' || doc_id AS id, text AS content, source AS line_id, lang AS author FROM documents"),
    "talk": (["conversations"], "SELECT 'V' || conv_id || '-' || turn AS id, 'V' || conv_id AS line_id, role AS author, text AS content, {minutes[conv_id * 3 + turn * 11]} AS timestamp FROM conversations"),
}


class _Times:
    def __init__(self, pattern: str):
        self.pattern = pattern

    def __getitem__(self, expression: str) -> str:
        return self.pattern.format(expression)


def _sql(name: str, dialect: dict[str, str]) -> str:
    return VIEWS[name][1].format(minutes=_Times(dialect["minutes"]), words=_Times(dialect["words"]), k=dialect["k"], none=dialect["none"], each=dialect["each"], epoch=dialect["epoch"])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _sql(name, SPARK).replace('"order"', "`order`")
    for table in VIEWS[name][0]:
        text = text.replace(f"FROM {table}", f"FROM parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(text)


def duckdb(*names: str) -> str:
    """The views as common table expressions, to go before a query."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_sql(n, DUCKDB)})" for n in names)
