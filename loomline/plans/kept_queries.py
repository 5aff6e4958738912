"""Registered queries on tables that are kept: parts and what changed in them, page directories, CSV in blocks, streams; with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.model import ALL_LINES
from loomline.operators import timeline
from loomline.operators.stored import new_path
from loomline.plans.mapping import duckdb, view
from loomline.plans.more_queries import as_text
from loomline.plans.registry import register
from loomline.sources import changes, csv_records
from loomline.sources.directory import Directory
from loomline.sources.parts import Parts
from loomline.streaming import groups, sessions

_LIVE = ", live AS (SELECT * FROM messages WHERE NOT coalesce(deleted, false))"
_AT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_SINCE = dt.datetime(2024, 1, 20)


def stamped(df):
    """Times with a zone, as a table of parts has them."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def _messages(spark, d):
    return stamped(view(spark, d, "messages")).select("id", "content", "updated_at", "line_id", "deleted")


# parts

_CHANGED = ", n AS (SELECT *, substr(id, 2)::BIGINT AS k FROM messages)"


@register("merged_parts", duckdb("messages") + _CHANGED + f""" SELECT id, CASE WHEN k % 100 = 7 THEN 'new ' ELSE '' END || content AS content, {_AT.format("CASE WHEN k % 100 = 7 THEN TIMESTAMP '2030-01-01' ELSE updated_at END")} AS changed FROM n WHERE NOT coalesce(deleted, false) OR k % 100 <> 7 UNION ALL SELECT 'new', 'one more', '2030-01-01 00:00:00'""")
def merged_parts(spark, d):
    m = _messages(spark, d)
    table = Parts.create(m, new_path(spark, "parts"), parts=16)
    late = F.lit("2030-01-01 00:00:00").cast("timestamp")
    batch = m.filter(F.substring("id", 2, 20).cast("long") % 100 == 7).withColumns({"content": F.concat(F.lit("new "), "content"), "updated_at": late})
    more = spark.createDataFrame([("new", "one more", "R1")], "id string, content string, line_id string").withColumns({"updated_at": late, "deleted": F.lit(False)})
    replayed = batch.withColumns({"content": F.lit("older"), "updated_at": F.lit("2029-01-01 00:00:00").cast("timestamp")})
    table.merge(batch.unionByName(more).unionByName(replayed), number=0, gone=F.col("updated_at").isNotNull() & (F.col("updated_at") >= late) & F.coalesce(F.col("deleted"), F.lit(False)))
    table.merge(replayed, number=0)  # the batch is in already
    return table.read().select("id", "content", as_text("updated_at").alias("changed"))


@register("part_differences", duckdb("messages") + _CHANGED + " SELECT id AS key, CASE WHEN k % 1000 = 3 THEN 'deleted' ELSE 'changed' END AS change FROM n WHERE k % 1000 = 3 OR k % 1000 = 4 AND line_id <> 'C4' UNION ALL SELECT 'more-' || id, 'inserted' FROM n WHERE k % 5000 = 9")
def part_differences(spark, d):
    m = _messages(spark, d)
    table = Parts.create(m, new_path(spark, "parts"))
    k = F.substring("id", 2, 20).cast("long")
    source = m.filter(k % 1000 != 3).withColumn("line_id", F.when(k % 1000 == 4, "C4").otherwise(F.col("line_id")))
    return table.differences(source.unionByName(m.filter(k % 5000 == 9).withColumn("id", F.concat(F.lit("more-"), "id"))))


@register("hard_deletes", duckdb("messages") + _CHANGED + " SELECT id, content FROM n WHERE k % 500 <> 3")
def hard_deletes(spark, d):
    m = _messages(spark, d)
    table = Parts.create(m, new_path(spark, "parts"))
    table.drop_deleted(m.filter(F.substring("id", 2, 20).cast("long") % 500 != 3))
    return table.read().select("id", "content")


@register("changes_since", duckdb("messages") + f" SELECT id, content, {_AT.format('updated_at')} AS changed FROM messages WHERE updated_at > TIMESTAMP '2024-01-20'")
def changes_since(spark, d):
    path = new_path(spark, "parts")
    Parts.create(_messages(spark, d), path)
    changes.register(spark)
    return spark.read.format(changes.FORMAT).load(path).filter(F.col("updated_at") > F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id", "content", as_text("updated_at").alias("changed"))


@register("streamed_changes", duckdb("messages") + f" SELECT id, content, {_AT.format('updated_at')} AS changed FROM messages WHERE updated_at > TIMESTAMP '2024-01-20' UNION ALL SELECT id, 'again', '2030-01-01 00:00:00' FROM messages WHERE id LIKE 'E%77'")
def streamed_changes(spark, d):
    path, out, marks = (new_path(spark, label) for label in ("parts", "changes", "marks"))
    m = _messages(spark, d)
    table = Parts.create(m, path)
    changes.register(spark)
    since = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.lit("2024-01-20 00:00:00"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    for _ in range(2):
        stream = spark.readStream.format(changes.FORMAT).option("since", since).load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        table.merge(m.filter(F.col("id").like("E%77")).withColumns({"content": F.lit("again"), "updated_at": F.lit("2030-01-01 00:00:00").cast("timestamp")}))
    return spark.read.parquet(out).select("id", "content", as_text("updated_at").alias("changed"))


# pages


def _directory(spark, d, size=500):
    """The live messages: those of January first, then the others in any order."""
    live = stamped(timeline.of_line(view(spark, d, "messages"), ALL_LINES)).select("id", "timestamp", "line_id")
    early = F.col("timestamp") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    made = Directory.create(live.filter(early | (F.substring("id", 2, 20).cast("long") % 10 != 0)), new_path(spark, "directory"), size)
    made.append(live.filter(~early & (F.substring("id", 2, 20).cast("long") % 10 == 0)))
    return made


@register("directory_page", duckdb("messages") + _LIVE + """ SELECT id, row_number() OVER (ORDER BY timestamp, id)::INT - 1 AS index FROM (SELECT * FROM live ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 200)""")
def directory_page(spark, d):
    return _directory(spark, d).page(11, 20).select("id", "index")


@register("directory_days", duckdb("messages") + _LIVE + """, p AS (SELECT id, timestamp, row_number() OVER (ORDER BY timestamp, id) - 1 AS place, count(*) OVER () AS n FROM live), days AS (SELECT unnest(['2024-01-05', '2024-01-20', '2024-01-28']) AS day)
    SELECT day, arg_min(id, place) AS id, min(place)::INT AS place, ((any_value(n) - 1 - min(place)) // 50 + 1)::INT AS page FROM days JOIN p ON p.timestamp >= day::TIMESTAMP GROUP BY day""")
def directory_days(spark, d):
    made, out = _directory(spark, d), None
    for day in ("2024-01-05", "2024-01-20", "2024-01-28"):
        row = made.first_after(day).select(F.lit(day).alias("day"), "id", F.col("place").cast("int").alias("place"), F.lit(made.page_of(day, 50)).alias("page"))
        out = row if out is None else out.unionByName(row)
    return out


# files and streams


@register("csv_in_blocks", "SELECT doc_id::VARCHAR AS id, sha256(text) AS text, source FROM documents WHERE text <> ''")
def csv_in_blocks(spark, d):
    path, documents = new_path(spark, "csv"), spark.read.parquet(f"{d}/documents.parquet").filter("text <> ''")
    documents.select(F.col("doc_id").cast("string").alias("id"), "text", "source").write.options(header=True, quote='"', escape='"').csv(path)
    return csv_records.rows(spark, path, ["id", "text", "source"], block=1 << 18).select("id", F.sha2("text", 256).alias("text"), "source")


_GROUPS = """, g AS (SELECT id, line_id, timestamp, lag(timestamp) OVER w AS prev FROM messages WINDOW w AS (PARTITION BY line_id ORDER BY timestamp, id)),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR timestamp - prev >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY timestamp, id) AS grp FROM g)
    SELECT line_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS end, count(*) AS messages, arg_min(id, (timestamp, id)) AS first_id FROM s GROUP BY line_id, grp"""


def _crowded(spark, d):
    """Messages on ten lines only, so that many are less than ten minutes apart."""
    return view(spark, d, "messages").withColumn("line_id", F.concat(F.lit("C"), F.substring("line_id", 2, 20).cast("long") % 10))


_CROWDED = duckdb("messages").replace("messages AS (", "all_messages AS (", 1) + ", messages AS (SELECT * REPLACE ('C' || (substr(line_id, 2)::BIGINT % 10) AS line_id) FROM all_messages)"


@register("groups_of_lines", _CROWDED + _GROUPS)
def groups_of_lines(spark, d):
    return timeline.groups_of_lines(_crowded(spark, d)).select("line_id", as_text("start").alias("start"), as_text("end").alias("end"), "messages", "first_id")


@register("streamed_line_groups", _CROWDED + _GROUPS)
def streamed_line_groups(spark, d):
    """Out of order and with replays, in several batches, then a moment that lets the watermark pass all of them."""
    source, out, marks = (new_path(spark, label) for label in ("messages", "groups", "marks"))
    m = stamped(_crowded(spark, d)).select("id", "line_id", "timestamp")
    k = F.substring("id", 2, 20).cast("long") % 3
    for n in range(3):
        m.filter((k == n) | (k == 0)).write.mode("append").parquet(source)
    last = m.agg(F.max("timestamp")).first()[0]
    spark.createDataFrame([("end", "the end", last + dt.timedelta(days=1700))], m.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(T.StructType(m.schema.fields)).option("maxFilesPerTrigger", 4).parquet(source)
    groups.line_groups(stream, lateness="40000 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("line_id", as_text("start").alias("start"), as_text("end").alias("end"), "messages", "first_id")


@register("streamed_sessions", duckdb("messages") + """, g AS (SELECT line_id, timestamp, lag(timestamp) OVER w AS prev, id FROM messages WINDOW w AS (PARTITION BY line_id ORDER BY timestamp, id)),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR timestamp - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY timestamp, id) AS grp FROM g)
    SELECT line_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS end, count(*) AS messages FROM s GROUP BY line_id, grp""")
def streamed_sessions(spark, d):
    """The second half of the messages first, all of them, then the first half and a third of the others again."""
    source, out, marks = (new_path(spark, label) for label in ("messages", "sessions", "marks"))
    m = stamped(view(spark, d, "messages")).select("id", "line_id", "timestamp")
    k = F.substring("id", 2, 20).cast("long")
    m.filter(k % 2 == 1).write.parquet(source)
    m.filter((k % 2 == 0) | (k % 3 == 0)).write.mode("append").parquet(source)
    last = m.agg(F.max("timestamp")).first()[0]
    spark.createDataFrame([("end", "the end", last + dt.timedelta(days=1700))], m.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(T.StructType(m.schema.fields)).option("maxFilesPerTrigger", 4).parquet(source)
    sessions.session_counts(stream, lateness="40000 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("line_id", as_text("start").alias("start"), as_text("end").alias("end"), "messages")


@register("streamed_snapshot", duckdb("messages") + _CHANGED + " SELECT id, CASE WHEN k % 90 = 5 THEN 'second ' ELSE '' END || content AS content FROM n WHERE NOT coalesce(deleted, false) AND k % 90 <> 6")
def streamed_snapshot(spark, d):
    """All messages, then changed and deleted ones as another batch, which is offered once more."""
    source, out, marks = (new_path(spark, label) for label in ("messages", "snapshot", "marks"))
    m, k = _messages(spark, d), F.substring("id", 2, 20).cast("long") % 90
    late = F.lit("2030-01-01 00:00:00").cast("timestamp")
    for batch in (m, m.filter(k.isin(5, 6)).withColumns({"content": F.concat(F.lit("second "), "content"), "updated_at": late, "deleted": F.coalesce("deleted", F.lit(False)) | (k == 6)}), m.limit(0)):
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(T.StructType(m.schema.fields)).parquet(source)
        sessions.keep_snapshot(stream, out, marks, parts=16).awaitTermination()
    return Parts(spark, out).read().select("id", "content")
