"""Every registered query of the reference's operators, over the test tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import dates, json, text
from loomline.model import Snapshot
from loomline.operators import hierarchy, integrity, lines, mutations, ordered, sessions, sync, tags, tasks, timeline
from loomline.plans.mapping import duckdb, view
from loomline.plans.registry import ORACLES, QUERIES, register
from loomline.sources import csv

__all__ = ["ORACLES", "QUERIES"]

NOW = "2024-02-10 12:34:56"
_PATHS = """, h AS (SELECT id, name, name AS full_path, 0 AS depth, [id] AS ids FROM lines WHERE parent_line_id IS NULL
    UNION ALL SELECT l.id, l.name, h.full_path || ' -> ' || l.name, h.depth + 1, list_append(h.ids, l.id) FROM lines l JOIN h ON l.parent_line_id = h.id)"""
_TASKS = """, t AS (SELECT m.id, m.content, coalesce(json_extract_string(m.metadata, '$.completed') = 'true', false) AS completed,
    CASE WHEN json_extract_string(m.metadata, '$.priority') IN ('urgent', 'high', 'medium', 'low') THEN json_extract_string(m.metadata, '$.priority') ELSE 'medium' END AS priority,
    m.line_id, coalesce(l.name, m.line_id) AS line_name, m.timestamp AS created_at, m.updated_at FROM orders_as_tasks m LEFT JOIN lines l ON l.id = m.line_id)"""
_LIVE = ", live AS (SELECT * FROM messages WHERE NOT coalesce(deleted, false))"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def live(spark, d):
    return timeline.of_line(view(spark, d, "messages"), "__timeline__")


def task_rows(spark, d):
    return tasks.rows(view(spark, d, "orders_as_tasks"), view(spark, d, "lines")).drop("completed_at")


# sessions and hierarchy


@register(
    "session_digest",
    duckdb("lines", "messages") + _PATHS + """,
    f AS (SELECT m.*, h.full_path, CASE WHEN type = 'task' THEN content || ' - ' || type || ' - ' || CASE WHEN lower(coalesce(json_extract_string(metadata, '$.completed'), '')) IN ('t', 'true', '1', 'yes') THEN '完了'
        WHEN coalesce(json_extract_string(metadata, '$.completed'), '') = '' THEN '不明' ELSE '未完了' END WHEN type = 'document' THEN type || ' - ' || left(content, 30) ELSE left(content, 200) END AS shown
        FROM messages m JOIN h ON h.id = m.line_id WHERE type IS NOT NULL AND NOT deleted AND length(content) >= 7),
    g AS (SELECT *, lag(timestamp) OVER (PARTITION BY line_id ORDER BY timestamp, id) AS prev FROM f),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR timestamp - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY timestamp) AS grp FROM g)
    SELECT full_path, strftime(min(timestamp), '%Y-%m-%d %H:%M') AS start_time, strftime(max(timestamp), '%Y-%m-%d %H:%M') AS end_time, string_agg(shown, chr(10) ORDER BY timestamp, id) AS combined_content
    FROM s GROUP BY line_id, full_path, grp""",
)
def session_digest(spark, d):
    return sessions.session_digest(view(spark, d, "messages"), view(spark, d, "lines"))


@register("line_paths", duckdb("lines") + _PATHS + " SELECT id, name, full_path, depth FROM h")
def line_paths(spark, d):
    return hierarchy.paths(view(spark, d, "lines"))


@register("line_ancestry", duckdb("lines") + _PATHS + " SELECT id, array_to_string(ids[:-2], '/') AS ancestors FROM h")
def line_ancestry(spark, d):
    return hierarchy.ancestor_ids(view(spark, d, "lines")).select("id", F.array_join("ancestors", "/").alias("ancestors"))


_RANKED = """, r AS (SELECT *, row_number() OVER (PARTITION BY parent_line_id ORDER BY created_at, id) AS n, row_number() OVER (PARTITION BY parent_line_id ORDER BY created_at DESC, id DESC) = 1 AS last FROM lines),
    b AS (SELECT id, name, 0 AS depth, last, lpad(n::VARCHAR, 10, '0') AS sort_path, []::BOOLEAN[] AS chain FROM r WHERE parent_line_id IS NULL
    UNION ALL SELECT r.id, r.name, b.depth + 1, r.last, b.sort_path || '.' || lpad(r.n::VARCHAR, 10, '0'), list_append(b.chain, b.last) FROM r JOIN b ON r.parent_line_id = b.id)"""


@register("branch_tree", duckdb("lines", "messages") + _RANKED + " SELECT b.id, name, depth, sort_path, (SELECT count(*) FROM messages m WHERE m.line_id = b.id) AS message_count FROM b")
def branch_tree(spark, d):
    return hierarchy.branch_tree(view(spark, d, "messages"), view(spark, d, "lines"))


@register(
    "tree_prefixes",
    duckdb("lines") + _RANKED + """ SELECT id, last AS is_last_child, CASE WHEN depth = 0 THEN '' ELSE array_to_string(list_transform(chain[2:], lambda x: CASE WHEN x THEN '  ' ELSE '│ ' END), '') || CASE WHEN last THEN '└─' ELSE '├─' END END AS prefix FROM b""",
)
def tree_prefixes(spark, d):
    t = hierarchy.tree(view(spark, d, "lines"))
    return t.select("id", "is_last_child", hierarchy.tree_prefix(F.col("depth"), F.col("is_last_child"), F.col("parent_chain")).alias("prefix"))


@register(
    "branch_statistics",
    duckdb("lines", "messages") + _PATHS + """ SELECT (SELECT count(*) FROM lines) AS total_lines, (SELECT count(*) FROM messages) AS total_messages,
    (SELECT count(*) FROM lines WHERE parent_line_id <> '') AS total_branches, max(depth) AS max_depth, (SELECT count(*) FROM messages)::DOUBLE / (SELECT count(*) FROM lines) AS avg_messages_per_line FROM h""",
)
def branch_statistics(spark, d):
    return lines.statistics(view(spark, d, "messages"), view(spark, d, "lines"))


@register("lines_by_depth", duckdb("lines") + _PATHS + " SELECT depth, count(*) AS lines FROM h GROUP BY depth")
def lines_by_depth(spark, d):
    return lines.by_depth(view(spark, d, "lines"))


@register("child_counts", duckdb("lines") + " SELECT parent_line_id, count(*) AS children FROM lines WHERE parent_line_id IS NOT NULL GROUP BY 1")
def child_counts(spark, d):
    return hierarchy.child_counts(view(spark, d, "lines"))


@register("deletable_lines", duckdb("lines") + " SELECT id FROM lines l WHERE NOT EXISTS (SELECT 1 FROM lines c WHERE c.parent_line_id = l.id)")
def deletable_lines(spark, d):
    return hierarchy.deletable(view(spark, d, "lines")).select("id")


@register("cycle_check", duckdb("lines") + " SELECT id FROM lines WHERE id IN ('C1', 'C2', 'C3', 'N3', 'N4') OR parent_line_id IN ('N3', 'N4') ")
def cycle_check(spark, d):
    # a line under itself, two under each other, and two above each other with all that is below them
    rows = view(spark, d, "lines")
    turned = F.when(F.col("id") == "C1", "C1").when(F.col("id") == "C2", "C3").when(F.col("id") == "C3", "C2").when(F.col("id") == "N3", "N4").when(F.col("id") == "N4", "N3").otherwise(F.col("parent_line_id"))
    return hierarchy.cycles(rows.withColumn("parent_line_id", turned)).select("id")


@register(
    "reparent_circular",
    duckdb("lines") + _PATHS + """ SELECT l.id AS source, 'C3' AS target, list_contains((SELECT ids FROM h WHERE id = 'C3'), l.id) AS circular FROM lines l""",
)
def reparent_circular(spark, d):
    rows = view(spark, d, "lines")
    return hierarchy.would_cycle(rows, rows.select(F.col("id").alias("source"), F.lit("C3").alias("target")))


@register("expanded_lines", duckdb("lines") + _PATHS + " SELECT id FROM lines WHERE parent_line_id IS NULL UNION SELECT unnest(ids[:-2]) FROM h WHERE id = 'C7'")
def expanded_lines(spark, d):
    return hierarchy.expanded_by_default(view(spark, d, "lines"), "C7")


# lines


@register("messages_per_line", duckdb("lines", "messages") + " SELECT l.id, count(m.id) AS messages FROM lines l LEFT JOIN messages m ON m.line_id = l.id GROUP BY l.id")
def messages_per_line(spark, d):
    return lines.message_counts(view(spark, d, "messages"), view(spark, d, "lines"))


@register(
    "chars_per_line",
    duckdb("lines", "messages") + _LIVE + " SELECT l.id, count(m.id) AS messages, coalesce(sum(length(content)), 0)::BIGINT AS characters FROM lines l LEFT JOIN live m ON m.line_id = l.id GROUP BY l.id",
)
def chars_per_line(spark, d):
    return lines.character_counts(view(spark, d, "messages"), view(spark, d, "lines"))


@register(
    "last_message_per_line",
    duckdb("messages") + _LIVE + " SELECT line_id, id, timestamp, content FROM live QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY timestamp DESC, id DESC) = 1",
)
def last_message_per_line(spark, d):
    return lines.last_messages(view(spark, d, "messages"))


@register("recent_lines_top30", duckdb("lines") + " SELECT id, coalesce(updated_at, created_at) AS changed_at FROM lines WHERE id NOT IN ('C1', 'main', '__timeline__') ORDER BY changed_at DESC, id LIMIT 30")
def recent_lines_top30(spark, d):
    return lines.recent(view(spark, d, "lines"), "C1").select("id", "changed_at")


@register(
    "line_display_info",
    duckdb("lines", "messages") + _LIVE + f""", last AS (SELECT line_id, content, timestamp FROM live QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY timestamp DESC, id DESC) = 1),
    j AS (SELECT l.id, content, floor(epoch(TIMESTAMP '{NOW}' - coalesce(timestamp, updated_at, created_at))) AS s FROM lines l LEFT JOIN last ON line_id = l.id)
    SELECT id, coalesce(CASE WHEN length(content) > 20 THEN left(content, 20) || '...' ELSE content END, '') AS preview,
    CASE WHEN floor(s / 60) < 1 THEN '今' WHEN s < 3600 THEN floor(s / 60)::INT || '分前' WHEN s < 86400 THEN floor(s / 3600)::INT || '時間前' WHEN s < 2592000 THEN floor(s / 86400)::INT || '日前' ELSE floor(floor(s / 86400) / 30)::INT || 'ヶ月前' END AS relative_time,
    (SELECT count(*) FROM lines c WHERE c.parent_line_id = j.id) AS branches FROM j""",
)
def line_display_info(spark, d):
    return lines.display_info(view(spark, d, "messages"), view(spark, d, "lines"), now())


@register("branching_lines", duckdb("lines", "messages") + " SELECT id FROM lines WHERE parent_line_id = (SELECT 'N' || substr(line_id, 2)::INT % 25 FROM messages WHERE id = 'E1')")
def branching_lines(spark, d):
    on_nations = view(spark, d, "messages").withColumn("line_id", F.concat(F.lit("N"), (F.substring("line_id", 2, 20).cast("int") % 25).cast("string")))
    return lines.branching_from(on_nations, view(spark, d, "lines"), "E1").select("id")


# timeline


@register(
    "timeline_transitions",
    duckdb("lines", "messages") + _LIVE + """, p AS (SELECT *, lag(line_id) OVER (ORDER BY timestamp, id) AS prev FROM live)
    SELECT p.id, timestamp, line_id, coalesce(name, line_id) AS line_name FROM p LEFT JOIN lines l ON l.id = line_id WHERE line_id IS DISTINCT FROM prev""",
)
def timeline_transitions(spark, d):
    return timeline.transitions(live(spark, d), view(spark, d, "lines"))


def _page_sql(number: int) -> str:
    return duckdb("messages") + _LIVE + f""", c AS (SELECT count(*) AS n, greatest(1, ceil(count(*) / 200.0)::INT) AS pages FROM live), q AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS back FROM live)
    , w AS (SELECT id, timestamp FROM q, c WHERE ceil(back / 200.0) = least({number}, pages)) SELECT id, timestamp, (row_number() OVER (ORDER BY timestamp, id) - 1)::INT AS "index" FROM w"""


@register("timeline_page1", _page_sql(1))
def timeline_page1(spark, d):
    return timeline.page(live(spark, d), 1).select("id", "timestamp", "index")


@register("timeline_page2", _page_sql(2))
def timeline_page2(spark, d):
    return timeline.page(live(spark, d), 2).select("id", "timestamp", "index")


@register("timeline_oldest_page", _page_sql(10**9))
def timeline_oldest_page(spark, d):
    return timeline.page(live(spark, d), 10**9).select("id", "timestamp", "index")


@register(
    "timeline_filtered",
    duckdb("messages") + _LIVE + """ SELECT id FROM live WHERE type = 'task' AND (json_extract_string(metadata, '$.completed') IS NULL OR json_extract_string(metadata, '$.completed') <> 'true')
    AND timestamp >= DATE '2024-01-05' AND timestamp < DATE '2024-01-21' AND (lower(content) LIKE '%purchase 1%' OR lower(author) LIKE '%purchase 1%')""",
)
def timeline_filtered(spark, d):
    return timeline.filtered(live(spark, d), "task", "incomplete", "2024-01-05", "2024-01-20", keyword="PURCHASE 1").select("id")


@register(
    "display_groups_10min",
    duckdb("messages") + _LIVE + """, p AS (SELECT *, lag(line_id) OVER w AS pl, lag(timestamp) OVER w AS pt FROM live WINDOW w AS (ORDER BY timestamp, id))
    SELECT id, sum(CASE WHEN pl = line_id AND timestamp - pt < INTERVAL 10 MINUTE THEN 0 ELSE 1 END) OVER (ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING)::BIGINT AS "group" FROM p""",
)
def display_groups_10min(spark, d):
    return timeline.display_groups(live(spark, d)).select("id", "group")


@register(
    "display_groups_talk",
    duckdb("talk") + """, p AS (SELECT *, lag(line_id) OVER w AS pl, lag(timestamp) OVER w AS pt FROM talk WINDOW w AS (ORDER BY timestamp, id))
    SELECT id, sum(CASE WHEN pl = line_id AND timestamp - pt < INTERVAL 10 MINUTE THEN 0 ELSE 1 END) OVER (ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING)::BIGINT AS "group" FROM p""",
)
def display_groups_talk(spark, d):
    return timeline.display_groups(view(spark, d, "talk")).select("id", "group")


@register("date_separators", duckdb("messages") + _LIVE + " SELECT id, strftime(timestamp, '%Y-%m-%d') AS day FROM live QUALIFY row_number() OVER (PARTITION BY timestamp::DATE ORDER BY timestamp, id) = 1")
def date_separators(spark, d):
    return timeline.date_separators(live(spark, d)).withColumn("day", F.col("day").cast("string"))


@register("range_select", duckdb("messages") + _LIVE + " SELECT id FROM live WHERE (timestamp, id) BETWEEN (SELECT (timestamp, id) FROM live WHERE id = 'E102') AND (SELECT (timestamp, id) FROM live WHERE id = 'E333')")
def range_select(spark, d):
    return timeline.range_between(live(spark, d), "E333", "E102").select("id")


@register("first_after_day", duckdb("messages") + _LIVE + " SELECT id, timestamp FROM live WHERE timestamp >= DATE '2024-01-10' ORDER BY timestamp, id LIMIT 1")
def first_after_day(spark, d):
    return timeline.first_after(live(spark, d), "2024-01-10").select("id", "timestamp")


@register(
    "copied_rows",
    duckdb("messages") + """ SELECT id, '* ' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ', "' || replace(replace(CASE WHEN length(content) > 200 THEN left(content, 100) || '...' ELSE content END, chr(10), '\\n'), '"', '""') || '", ' || coalesce(type, 'text')
    || coalesce(', "' || replace(metadata, '"', '""') || '"', '') AS "row" FROM messages WHERE length(content) > 0""",
)
def copied_rows(spark, d):
    return timeline.copied_rows(view(spark, d, "messages")).select("id", "row")


@register("display_text", duckdb("messages") + """ SELECT id, CASE WHEN type = 'task' THEN content || ' - task - ' || CASE WHEN json_extract_string(metadata, '$.completed') IN ('true', 'yes') THEN '完了' WHEN json_extract_string(metadata, '$.completed') IS NULL THEN '不明' ELSE '未完了' END
    WHEN type = 'document' THEN type || ' - ' || left(content, 30) ELSE left(content, 200) END AS display_text FROM messages""")
def display_text(spark, d):
    return view(spark, d, "messages").select("id", sessions.display_text(F.col("type"), F.col("content"), F.col("metadata")).alias("display_text"))


@register("metadata_text", "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS metadata_text FROM events")
def metadata_text(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", json.metadata_text(F.col("props")).alias("metadata_text"))


# tasks


@register("task_rows", duckdb("lines", "orders_as_tasks") + _TASKS + " SELECT * FROM t")
def task_rows_query(spark, d):
    return task_rows(spark, d)


@register("task_counts_by_priority", duckdb("lines", "orders_as_tasks") + _TASKS + " SELECT p AS priority, (SELECT count(*) FROM t WHERE priority = p) AS tasks FROM (VALUES ('urgent'), ('high'), ('medium'), ('low')) v(p)")
def task_counts_by_priority(spark, d):
    return tasks.counts_by_priority(task_rows(spark, d))


@register("task_counts_by_line", duckdb("lines", "orders_as_tasks") + _TASKS + " SELECT line_name, count(*) AS tasks FROM t GROUP BY line_name")
def task_counts_by_line(spark, d):
    return tasks.counts_by_line(task_rows(spark, d))


@register("task_totals", duckdb("lines", "orders_as_tasks") + _TASKS + " SELECT count(*) FILTER (completed) AS completed, count(*) FILTER (NOT completed) AS incomplete, count(*) AS total FROM t")
def task_totals(spark, d):
    return tasks.totals(task_rows(spark, d))


_BY = {
    "priority": ("CASE priority WHEN 'urgent' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC", True),
    "content": ("content", False),
    "completed": ("completed", False),
    "line_name": ("line_name DESC", True),
    "created_at": ("created_at DESC", True),
    "updated_at": ("updated_at NULLS FIRST", False),
}


def _task_order(key: str, descending: bool):
    return lambda spark, d: ordered.with_position(task_rows(spark, d), tasks.sort_columns(key, descending, None)).select("id", F.col("position").cast("int"))


for _key, (_order, _descending) in _BY.items():
    register("task_sorted" if _key == "priority" else f"task_sorted_by_{_key}", duckdb("lines", "orders_as_tasks") + _TASKS + f" SELECT id, row_number() OVER (ORDER BY {_order}, id)::INT AS position FROM t")(_task_order(_key, _descending))


@register(
    "task_search",
    duckdb("lines", "orders_as_tasks") + _TASKS + " SELECT id FROM t WHERE NOT completed AND priority IN ('urgent', 'low') AND line_name IN ('Customer#000000011', 'Customer#000000100') AND contains(lower(content), 'order 1')",
)
def task_search(spark, d):
    return tasks.filtered(task_rows(spark, d), False, ["urgent", "low"], ["Customer#000000011", "Customer#000000100"], "ORDER 1").select("id")


@register("task_priorities", duckdb("lines", "orders_as_tasks") + _TASKS + " SELECT DISTINCT priority, CASE priority WHEN 'urgent' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank FROM t")
def task_priorities(spark, d):
    return tasks.priorities(task_rows(spark, d))


# tags

_USES = ", u AS (SELECT t.*, (SELECT count(*) FROM (SELECT unnest(tag_ids) AS x FROM tagged) WHERE x = t.id) AS count FROM tags t)"


@register("tag_usage", duckdb("tagged", "tags") + _USES + " SELECT id, name, count FROM u")
def tag_usage(spark, d):
    return tags.uses(view(spark, d, "tagged"), view(spark, d, "tags")).select("id", "name", "count")


@register(
    "tag_group_rollup",
    duckdb("tagged", "tags", "tag_groups") + _USES + """ SELECT 'group' AS kind, g.id, g.name, coalesce(sum(u.count), 0)::BIGINT AS count FROM tag_groups g LEFT JOIN u ON u.group_id = g.id GROUP BY g.id, g.name
    UNION ALL SELECT 'tag', id, name, count FROM u WHERE group_id IS NULL""",
)
def tag_group_rollup(spark, d):
    return tags.rollup(view(spark, d, "tagged"), view(spark, d, "tags"), view(spark, d, "tag_groups"))


@register("tags_missing_on_line", duckdb("tagged", "tags") + " SELECT id FROM tags WHERE id NOT IN (SELECT unnest(tag_ids) FROM tagged WHERE id = 'P7')")
def tags_missing_on_line(spark, d):
    return tags.missing_on(view(spark, d, "tagged"), view(spark, d, "tags"), "P7").select("id")


@register("lines_with_tag", duckdb("tagged") + " SELECT id FROM tagged WHERE list_contains(tag_ids, 'small')")
def lines_with_tag(spark, d):
    return tags.lines_with(view(spark, d, "tagged"), view(spark, d, "tags"), "small").select("id")


@register("tags_by_group", duckdb("tags", "tag_groups") + " SELECT g.id, g.name, coalesce((SELECT string_agg(t.name, ',' ORDER BY t.name) FROM tags t WHERE t.group_id = g.id), '') AS tag_names FROM tag_groups g")
def tags_by_group(spark, d):
    return tags.by_group(view(spark, d, "tags"), view(spark, d, "tag_groups")).withColumn("tag_names", F.array_join("tag_names", ","))


@register("tag_labels", duckdb("tagged") + " SELECT id, array_to_string(list_transform(tag_ids[:2], lambda x: '#' || x), ' ') AS label FROM tagged")
def tag_labels(spark, d):
    return tags.labels(view(spark, d, "tagged"), view(spark, d, "tags"))


# integrity, synchronisation and mutations


@register("orphan_messages", duckdb("lines", "messages") + " SELECT id FROM messages WHERE line_id NOT IN (SELECT id FROM lines WHERE id NOT LIKE 'C1%')")
def orphan_messages(spark, d):
    return integrity.orphan_messages(view(spark, d, "messages"), view(spark, d, "lines").filter("id NOT LIKE 'C1%'")).select("id")


@register("dangling_parents", duckdb("lines") + " SELECT id FROM lines WHERE parent_line_id LIKE 'N1%'")
def dangling_parents(spark, d):
    return integrity.dangling_parents(view(spark, d, "lines").filter("id NOT LIKE 'N1%'")).select("id")


@register("placeholder_lines", duckdb("messages", "lines") + " SELECT DISTINCT line_id AS id, '[復元] ' || line_id AS name FROM messages WHERE line_id LIKE 'C1%' UNION ALL SELECT id, name FROM lines WHERE id NOT LIKE 'C1%'")
def placeholder_lines(spark, d):
    return integrity.with_placeholders(view(spark, d, "messages"), view(spark, d, "lines").filter("id NOT LIKE 'C1%'")).select("id", "name")


@register("diff_by_content", duckdb("notes") + " SELECT id FROM notes WHERE coalesce(content, '') NOT IN (SELECT coalesce(content, '') FROM notes WHERE author = 'en')")
def diff_by_content(spark, d):
    notes = view(spark, d, "notes")
    return integrity.missing_by_content(notes, notes.filter("author = 'en'")).select("id")


@register("message_counts", duckdb("messages") + " SELECT count(*) AS total, count(*) FILTER (coalesce(deleted, false)) AS deleted, count(*) FILTER (NOT coalesce(deleted, false)) AS kept, count(DISTINCT line_id) AS lines FROM messages")
def message_counts(spark, d):
    return integrity.counts(view(spark, d, "messages"))


def _changed(spark, d):
    return sync.changed_since(view(spark, d, "messages"), F.lit("2024-01-20").cast("timestamp_ntz"))


@register("incremental_since", duckdb("messages") + " SELECT id, updated_at FROM messages WHERE updated_at > TIMESTAMP '2024-01-20'")
def incremental_since(spark, d):
    return _changed(spark, d).select("id", "updated_at")


@register("upsert_merge", duckdb("messages") + " SELECT id, CASE WHEN updated_at > TIMESTAMP '2024-01-20' THEN 'new ' || content ELSE content END AS content FROM messages WHERE NOT (updated_at IS NULL AND timestamp > TIMESTAMP '2024-01-25')")
def upsert_merge(spark, d):
    old = view(spark, d, "messages").filter("timestamp <= TIMESTAMP_NTZ'2024-01-25 00:00:00'")
    return sync.upsert(old, _changed(spark, d).withColumn("content", F.concat(F.lit("new "), "content"))).select("id", "content")


@register("insert_if_absent", duckdb("messages") + " SELECT id, content FROM messages WHERE timestamp <= TIMESTAMP '2024-01-25' OR updated_at > TIMESTAMP '2024-01-20'")
def insert_if_absent(spark, d):
    old = view(spark, d, "messages").filter("timestamp <= TIMESTAMP_NTZ'2024-01-25 00:00:00'")
    return sync.insert_if_absent(old, _changed(spark, d).withColumn("author", F.lit("x"))).select("id", "content")


@register("high_water_mark", duckdb("lines", "messages") + " SELECT greatest((SELECT max(timestamp) FROM messages), (SELECT max(updated_at) FROM messages), (SELECT max(updated_at) FROM lines)) AS mark")
def high_water_mark(spark, d):
    return sync.high_water_mark(view(spark, d, "messages"), view(spark, d, "lines"))


def _snapshot(spark, d):
    return Snapshot(view(spark, d, "messages"), view(spark, d, "lines"), view(spark, d, "tags"), view(spark, d, "tag_groups"))


@register(
    "move_messages",
    duckdb("lines", "messages") + f""", moved AS (SELECT * FROM messages WHERE author = 'click' AND line_id <> 'C5')
    SELECT 'message' AS kind, id, CASE WHEN id IN (SELECT id FROM moved) THEN 'C5' ELSE line_id END AS line, CASE WHEN id IN (SELECT id FROM moved) THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM messages
    UNION ALL SELECT 'line', id, id, CASE WHEN id = 'C5' OR id IN (SELECT line_id FROM moved) THEN TIMESTAMP '{NOW}' ELSE updated_at END FROM lines""",
)
def move_messages(spark, d):
    s = _snapshot(spark, d)
    out = mutations.move_messages(s, s.messages.filter("author = 'click'").select("id"), "C5", now())
    return out.messages.select(F.lit("message").alias("kind"), "id", F.col("line_id").alias("line"), "updated_at").unionByName(out.lines.select(F.lit("line").alias("kind"), "id", F.col("id").alias("line"), "updated_at"))


@register("cascade_delete", duckdb("lines", "messages") + " SELECT 'line' AS kind, id FROM lines WHERE id NOT LIKE 'C2%' UNION ALL SELECT 'message', id FROM messages WHERE line_id NOT LIKE 'C2%'")
def cascade_delete(spark, d):
    s = _snapshot(spark, d)
    out = mutations.delete_lines(s, s.lines.filter("id LIKE 'C2%'").select("id"))
    return out.lines.select(F.lit("line").alias("kind"), "id").unionByName(out.messages.select(F.lit("message").alias("kind"), "id"))


@register("deletion_status", duckdb("lines") + " SELECT id, CASE WHEN id LIKE 'X%' THEN 'unknown' WHEN id IN (SELECT parent_line_id FROM lines) THEN 'has_children' ELSE 'ok' END AS status FROM (SELECT id FROM lines UNION ALL SELECT 'X' || id FROM lines)")
def deletion_status(spark, d):
    rows = view(spark, d, "lines")
    return mutations.deletion_status(rows, rows.select("id").union(rows.select(F.concat(F.lit("X"), "id"))))


@register("partial_update", duckdb("messages") + f" SELECT id, CASE WHEN author = 'view' THEN 'set' ELSE content END AS content, CASE WHEN author = 'view' THEN NULL ELSE metadata END AS metadata, CASE WHEN author = 'view' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM messages")
def partial_update(spark, d):
    m = view(spark, d, "messages")
    changes = m.filter("author = 'view'").select("id", F.lit("set").alias("content"), F.lit(True).alias("set_content"), F.lit(None).cast("string").alias("metadata"), F.lit(True).alias("set_metadata"), F.lit("nobody").alias("type"), F.lit(False).alias("set_type"))
    return mutations.update(m, changes, now()).select("id", "content", "metadata", "updated_at")


@register("reorder_groups", duckdb("tag_groups") + """ SELECT id, CASE id WHEN 'Brand#9' THEN 0 WHEN 'Brand#1' THEN 1 WHEN 'Brand#5' THEN 2 ELSE "order" END AS position FROM tag_groups""")
def reorder_groups(spark, d):
    return mutations.reorder_groups(view(spark, d, "tag_groups"), ["Brand#9", "Brand#1", "Brand#5"]).select("id", F.col("order").alias("position"))


@register("unlink_group", duckdb("tags") + " SELECT id, CASE WHEN group_id <> 'Brand#1' THEN group_id END AS group_id FROM tags")
def unlink_group(spark, d):
    return mutations.delete_group(_snapshot(spark, d), "Brand#1").tags.select("id", "group_id")


@register("export_summary", duckdb("lines", "messages", "tags", "tag_groups") + """, c AS (SELECT 'lines' AS "table", count(*) AS n FROM lines UNION ALL SELECT 'messages', count(*) FROM messages UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'tag_groups', count(*) FROM tag_groups)
    SELECT "table", n AS rows FROM c UNION ALL SELECT 'total', sum(n)::BIGINT FROM c""")
def export_summary(spark, d):
    return csv.summary(_snapshot(spark, d))


@register("csv_lines", duckdb("talk") + """ SELECT id || ',' || CASE WHEN regexp_matches(content, '[,\\n"]') THEN '"' || replace(content, '"', '""') || '"' ELSE content END || ',' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%gZ') AS line FROM talk""")
def csv_lines(spark, d):
    return csv.csv_lines(view(spark, d, "talk"), ["id", "content", "timestamp"])


# text, links and times


@register("doc_title_body", duckdb("notes") + " SELECT id, string_split(content, chr(10))[1] AS title, array_to_string(string_split(content, chr(10))[2:], chr(10)) AS body FROM notes")
def doc_title_body(spark, d):
    return view(spark, d, "notes").select("id", text.title_of(F.col("content")).alias("title"), text.body_of(F.col("content")).alias("body"))


@register(
    "doc_summary",
    duckdb("notes") + """, s AS (SELECT id, content, unnest(regexp_split_to_array(content, '[。！？\n]')) AS part, generate_subscripts(regexp_split_to_array(content, '[。！？\n]'), 1) AS i FROM notes),
    c AS (SELECT *, sum(length(part) + 1) OVER (PARTITION BY id ORDER BY i) - 1 AS upto FROM s), f AS (SELECT id, string_agg(part || '。', '' ORDER BY i) AS summary FROM c WHERE upto <= 100 GROUP BY id)
    SELECT n.id, CASE WHEN length(content) <= 100 THEN content ELSE coalesce(f.summary, left(content, 100) || '...') END AS summary FROM notes n LEFT JOIN f ON f.id = n.id""",
)
def doc_summary(spark, d):
    return view(spark, d, "notes").select("id", text.summary(F.col("content")).alias("summary"))


@register("reading_time", "SELECT doc_id, ceil(n_chars / 400.0)::BIGINT AS minutes FROM documents")
def reading_time(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.reading_minutes(F.col("n_chars")).alias("minutes"))


@register(
    "url_extract",
    "SELECT page_id, url, array_to_string(regexp_extract_all('see ' || url || ' and ' || url || ' now', 'https?://[^\\s]+'), ' ') AS urls, CASE WHEN length(url) > 50 THEN left(url, 47) || '...' ELSE url END AS label, length(regexp_replace('see ' || url || ' now', 'https?://[^\\s]+', '', 'g'))::INT AS rest FROM pages",
)
def url_extract(spark, d):
    u = F.col("url")
    twice, once = F.concat(F.lit("see "), u, F.lit(" and "), u, F.lit(" now")), F.concat(F.lit("see "), u, F.lit(" now"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.array_join(text.urls(twice), " ").alias("urls"), text.url_label(u).alias("label"), text.length_without_urls(once).alias("rest"))


@register(
    "slash_command",
    duckdb("messages") + """, c AS (SELECT id, CASE author WHEN 'click' THEN '/task_high  ' || content || ' ' WHEN 'view' THEN ' /task ' || content WHEN 'error' THEN '/document ' || content WHEN 'signup' THEN '/tasks ' || content ELSE '/task' END AS input, author, content FROM messages)
    SELECT id, CASE author WHEN 'click' THEN 'task' WHEN 'view' THEN 'task' WHEN 'error' THEN 'document' ELSE 'text' END AS type, CASE author WHEN 'signup' THEN trim(input) WHEN 'purchase' THEN '/task' ELSE trim(content) END AS content,
    CASE author WHEN 'click' THEN 'high' WHEN 'view' THEN 'medium' END AS priority FROM c""",
)
def slash_command(spark, d):
    a, c = F.col("author"), F.col("content")
    given = F.when(a == "click", F.concat(F.lit("/task_high  "), c, F.lit(" "))).when(a == "view", F.concat(F.lit(" /task "), c)).when(a == "error", F.concat(F.lit("/document "), c)).when(a == "signup", F.concat(F.lit("/tasks "), c)).otherwise("/task")
    return view(spark, d, "messages").select("id", text.command_of(given).alias("p")).select("id", "p.type", "p.content", "p.priority")


@register(
    "relative_time",
    duckdb("messages") + f""", s AS (SELECT id, epoch(TIMESTAMP '2024-01-25 12:00:00' - timestamp) AS s FROM messages) SELECT id, CASE WHEN s < 60 THEN '今' WHEN s < 3600 THEN floor(s / 60)::INT || '分前' WHEN s < 86400 THEN floor(s / 3600)::INT || '時間前'
    WHEN s < 2592000 THEN floor(s / 86400)::INT || '日前' ELSE floor(s / 2592000)::INT || 'ヶ月前' END AS relative_time FROM s""",
)
def relative_time(spark, d):
    return view(spark, d, "messages").select("id", dates.relative_time(F.col("timestamp"), F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")).alias("relative_time"))


@register(
    "separator_labels",
    """SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderdate::DATE = DATE '1998-08-02' THEN '今日' WHEN o_orderdate::DATE = DATE '1998-08-01' THEN '昨日' ELSE CASE WHEN year(o_orderdate) = 1998 THEN '' ELSE year(o_orderdate) || '年' END || month(o_orderdate) || '月' || day(o_orderdate) || '日 (' ||
    ['日', '月', '火', '水', '木', '金', '土'][dayofweek(o_orderdate) + 1] || ')' END AS label FROM orders""",
)
def separator_labels(spark, d):
    label = dates.separator_label(F.col("o_orderdate"), F.lit("1998-08-02 09:00:00").cast("timestamp_ntz"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").cast("string").alias("day"), label.alias("label")).distinct()


@register(
    "duration_minutes",
    """SELECT l_orderkey, l_linenumber, greatest(0, floor(epoch(l_shipdate - o_orderdate) / 60 + 0.5))::BIGINT AS minutes, CASE WHEN greatest(0, floor(epoch(l_shipdate - o_orderdate) / 60 + 0.5))::BIGINT // 60 > 0 THEN (greatest(0, floor(epoch(l_shipdate - o_orderdate) / 60 + 0.5))::BIGINT // 60) || '時間' ELSE '' END
    || (greatest(0, floor(epoch(l_shipdate - o_orderdate) / 60 + 0.5))::BIGINT % 60) || '分' AS duration FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def duration_minutes(spark, d):
    joined = spark.read.parquet(f"{d}/lineitem.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", dates.duration_minutes(F.col("o_orderdate"), F.col("l_shipdate")).alias("minutes")).withColumn("duration", dates.duration_text(F.col("minutes")))


@register(
    "session_events",
    """WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM p)
    SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL""",
)
def session_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("line_id"))
    return sessions.with_session(e).groupBy(F.col("line_id").alias("user_id"), "session").agg(F.count("*").alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@register(
    "edited_flags",
    duckdb("messages") + " SELECT id, coalesce(abs(epoch(updated_at - (timestamp - to_seconds(length(content) * 20)))) >= 300, false) AS shows_edited FROM messages",
)
def edited_flags(spark, d):
    m = view(spark, d, "messages")
    created = F.timestamp_add("SECOND", -F.length("content") * 20, F.col("timestamp"))
    return m.select("id", dates.shows_edited(created, F.col("updated_at")).alias("shows_edited"))


@register("running_value", "SELECT event_id, sum(event_id) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running, lag(event_id) OVER (ORDER BY ts, event_id) AS previous FROM events")
def running_value(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    held = ordered.with_previous(e, "ts", "event_id", ["event_id"])
    return ordered.with_running_sum(held, F.col("event_id"), "running", "ts", "event_id").select("event_id", "running", F.col("prev_event_id").alias("previous"))


@register("line_labels", duckdb("lines", "messages") + _RANKED + " SELECT id, sort_path, repeat('  ', depth) || name || CASE WHEN n > 0 THEN ' (' || n || ' msgs)' ELSE '' END AS label FROM (SELECT b.*, (SELECT count(*) FROM messages m WHERE m.line_id = b.id) AS n FROM b)")
def line_labels(spark, d):
    return hierarchy.labels(view(spark, d, "messages"), view(spark, d, "lines"))


@register("path_to_line", duckdb("lines") + _PATHS + " SELECT (generate_subscripts(ids, 1) - 1)::INT AS position, unnest(ids) AS id FROM h WHERE id = 'C12'")
def path_to_line(spark, d):
    return hierarchy.path_to(view(spark, d, "lines"), "C12")


@register("short_ancestry", duckdb("lines") + ", a AS (SELECT id, '' AS ancestry, name FROM lines WHERE parent_line_id IS NULL UNION ALL SELECT l.id, CASE WHEN a.ancestry = '' THEN a.name ELSE a.ancestry || '>' || a.name END, l.name FROM lines l JOIN a ON l.parent_line_id = a.id) SELECT id, ancestry FROM a")
def short_ancestry(spark, d):
    return hierarchy.short_ancestry(view(spark, d, "lines"))


@register("find_line", duckdb("lines") + " SELECT id, name FROM lines WHERE name = 'Customer#000000042'")
def find_line(spark, d):
    return lines.find(view(spark, d, "lines"), "Customer#000000042").select("id", "name")


@register("find_line_fallback", duckdb("lines") + " SELECT id FROM lines ORDER BY created_at, id LIMIT 1")
def find_line_fallback(spark, d):
    return lines.find(view(spark, d, "lines"), "nobody").select("id")


@register("event_level_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def event_level_counts(spark, d):
    return lines.level_counts(spark.read.parquet(f"{d}/events.parquet"), "event_type")


@register(
    "message_line_flags",
    duckdb("lines", "messages") + _LIVE + """ SELECT m.id, line_id, coalesce(name, line_id) AS line_name, line_id IS DISTINCT FROM lag(line_id) OVER (ORDER BY timestamp, m.id) AS starts_line, line_id = 'C3' AS on_current_line FROM live m LEFT JOIN lines l ON l.id = line_id""",
)
def message_line_flags(spark, d):
    return timeline.line_flags(live(spark, d), view(spark, d, "lines"), "C3")


@register("message_kinds", duckdb("messages") + " SELECT coalesce(type, 'text') AS kind, count(*) AS messages FROM messages GROUP BY 1")
def message_kinds(spark, d):
    return timeline.kinds(view(spark, d, "messages")).groupBy("kind").agg(F.count("*").alias("messages"))


@register("months_over", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH + to_days((day(o_orderdate) - 1)::INT), '%Y-%m-%d') AS month_back FROM orders")
def months_over(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", dates.months_over(F.col("o_orderdate"), -1).cast("string").alias("month_back"))


@register(
    "available_tags",
    duckdb("tagged", "tags", "tag_groups") + """ SELECT g.id AS group_id, g.name AS group_name, g."order" AS position, string_agg(t.name, ',' ORDER BY t.name) AS tag_names FROM tags t JOIN tag_groups g ON g.id = t.group_id WHERE t.id NOT IN (SELECT unnest(tag_ids) FROM tagged WHERE id = 'P7') GROUP BY ALL""",
)
def available_tags(spark, d):
    out = tags.available_on(view(spark, d, "tagged"), view(spark, d, "tags"), view(spark, d, "tag_groups"), "P7")
    return out.select("group_id", "group_name", F.col("order").alias("position"), F.array_join("tag_names", ",").alias("tag_names"))


@register("dotted_preview", duckdb("messages") + " SELECT id, CASE WHEN event.type IS NULL THEN author ELSE type || ' • ' || author END AS dotted FROM messages AS event")
def dotted_preview(spark, d):
    return view(spark, d, "messages").select("id", text.dotted(F.coalesce("type", F.lit("")), F.col("author")).alias("dotted"))


@register("kept_metadata", duckdb("messages") + """ SELECT id, CASE WHEN json_extract_string(metadata, '$.priority') IS NOT NULL THEN '{"priority":"' || json_extract_string(metadata, '$.priority') || '"}' END AS kept FROM messages""")
def kept_metadata(spark, d):
    return view(spark, d, "messages").select("id", json.kept_keys(F.col("metadata"), ["priority"]).alias("kept"))


@register("undo_move", duckdb("messages") + f" SELECT id, line_id, CASE WHEN author = 'click' AND line_id <> 'C5' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM messages")
def undo_move(spark, d):
    s = _snapshot(spark, d)
    moving = s.messages.filter("author = 'click'").select("id", "line_id")
    moved = mutations.move_messages(s, moving, "C5", now())
    return mutations.undo_move(moved, moving, now()).messages.select("id", "line_id", "updated_at")


@register("affected_lines", duckdb("messages") + " SELECT DISTINCT line_id AS id FROM messages WHERE author = 'click' UNION SELECT 'C5'")
def affected_lines(spark, d):
    m = view(spark, d, "messages")
    return mutations.affected_lines(m, m.filter("author = 'click'").select("id"), "C5")


@register("ids_not_found", duckdb("messages", "lines") + " SELECT id FROM lines WHERE id NOT IN (SELECT line_id FROM messages)")
def ids_not_found(spark, d):
    used = view(spark, d, "messages").select(F.col("line_id").alias("id"))
    return integrity.ids_not_found(view(spark, d, "lines").select("id"), used)


@register("integrity_report", duckdb("lines", "messages") + """ SELECT 'message_without_line' AS "check", count(*) AS rows FROM messages WHERE line_id NOT IN (SELECT id FROM lines) UNION ALL SELECT 'line_without_parent', count(*) FROM lines WHERE parent_line_id NOT IN (SELECT id FROM lines)
    UNION ALL SELECT 'self_reference', count(*) FROM lines WHERE id = parent_line_id UNION ALL SELECT 'cycle', 0""")
def integrity_report(spark, d):
    return integrity.report(view(spark, d, "messages"), view(spark, d, "lines"))


from loomline.plans import more_queries, tree_queries, kept_queries  # noqa: E402, F401, I001  the rest, which use what is above
