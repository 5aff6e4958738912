"""Timelines: filtered messages in order, pages from the newest, transitions between lines and groups for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import dates, json, text
from loomline.model import ALL_LINES, PAGE_SIZE
from loomline.operators.ordered import with_previous, with_running_sum


def of_line(messages: DataFrame, line_id: str) -> DataFrame:
    """Messages of a line, or of all, that are not deleted; a null flag means not deleted."""
    kept = messages.filter(~F.coalesce(F.col("deleted"), F.lit(False)))
    return kept if line_id == ALL_LINES else kept.filter(F.col("line_id") == line_id)


def has_type(kind: str) -> Column:
    return F.lit(True) if kind == "all" else F.coalesce(F.col("type") == kind, F.lit(False))


def has_completion(state: str) -> Column:
    """all, completed or incomplete; messages that are no tasks always pass."""
    if state == "all":
        return F.lit(True)
    done = json.is_completed(F.col("metadata"))
    return F.coalesce(F.col("type") != "task", F.lit(True)) | (done if state == "completed" else ~done)


def in_days(start: str | None, end: str | None) -> Column:
    """From the first moment of the start day to the last one of the end day."""
    day = lambda d: F.to_date(F.lit(d))
    test = F.lit(True)
    if start:
        test = test & (F.col("timestamp") >= day(start))
    if end:
        test = test & (F.col("timestamp") < F.date_add(day(end), 1))
    return test


def has_tag(part: str | None) -> Column:
    if not part:
        return F.lit(True)
    return F.coalesce(F.exists("tags", lambda t: text.contains_ci(t, part)), F.lit(False))


def has_keyword(part: str | None) -> Column:
    if not part:
        return F.lit(True)
    return text.contains_ci(F.col("content"), part) | text.contains_ci(F.coalesce("author", F.lit("")), part)


def filtered(timeline: DataFrame, kind: str = "all", completion: str = "all", start: str | None = None, end: str | None = None, tag: str | None = None, keyword: str | None = None) -> DataFrame:
    return timeline.filter(has_type(kind) & has_completion(completion) & in_days(start, end) & has_tag(tag) & has_keyword(keyword))


def page(timeline: DataFrame, number: int = 1, size: int = PAGE_SIZE, bucket: str = "day") -> DataFrame:
    """A page of messages in order, with index from 0; page 1 has the newest, the last page may be short.

    The number is brought into the range of pages; there is one at least. Messages are counted by units of time (bucket) when this is called, a row for each unit;
    then only the units that hold the page are read again and sorted.
    """
    unit = F.date_trunc(bucket, "timestamp")
    kind = dict(timeline.dtypes)["timestamp"]
    counts = timeline.groupBy(unit.alias("at")).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("at")).select(F.col("at").cast("string").alias("unit"), "n").collect()  # a row for each unit of time
    total = sum(r["n"] for r in counts)
    number = max(1, min(number, -(-total // size)))
    newer, units, skipped = (number - 1) * size, [], 0
    for r in counts:
        if skipped + r["n"] <= newer and not units:
            skipped += r["n"]
        elif skipped + sum(u["n"] for u in units) < newer + size:
            units.append(r)
    if not units:
        return timeline.limit(0).withColumn("index", F.lit(0))
    inside = unit.between(F.lit(units[-1]["unit"]).cast(kind), F.lit(units[0]["unit"]).cast(kind)) if None not in (units[0]["unit"], units[-1]["unit"]) else F.lit(True)
    wanted = min(total - newer, size)
    near = timeline.filter(inside).orderBy(F.desc("timestamp"), F.desc("id")).limit(newer - skipped + wanted).orderBy("timestamp", "id").limit(wanted)
    return near.withColumn("index", F.row_number().over(W.orderBy("timestamp", "id")) - 1)  # one page of rows


def page_info(total: int, number: int = 1, size: int = PAGE_SIZE) -> dict:
    pages = max(1, -(-total // size))
    current = max(1, min(number, pages))
    return {"current_page": current, "total_pages": pages, "total_messages": total, "page_size": size, "has_older": current < pages}


def transitions(timeline: DataFrame, lines: DataFrame, bucket: str = "day") -> DataFrame:
    """Messages whose line is another than that of the message before, with the line's name or else its id."""
    moved = with_previous(timeline.select("id", "timestamp", "line_id"), "timestamp", "id", ["line_id"], bucket=bucket).filter(~F.col("line_id").eqNullSafe(F.col("prev_line_id")))
    return _named(moved, lines).select("id", "timestamp", "line_id", "line_name")


def page_transitions(shown: DataFrame, lines: DataFrame) -> DataFrame:
    """The same within one page, by index."""
    moved = shown.withColumn("_before", F.lag("line_id").over(W.orderBy("index"))).filter(~F.col("line_id").eqNullSafe(F.col("_before")))
    return _named(moved, lines).select("index", "line_id", "line_name")


def _named(df: DataFrame, lines: DataFrame) -> DataFrame:
    return df.join(lines.select(F.col("id").alias("line_id"), F.col("name").alias("_name")), "line_id", "left").withColumn("line_name", F.coalesce("_name", "line_id")).drop("_name")


def display_groups(timeline: DataFrame, minutes: int = 10, bucket: str = "day") -> DataFrame:
    """timeline with group from 1: a message joins the one shown before it if both are of one line and less than ``minutes`` apart."""
    held = with_previous(timeline, "timestamp", "id", ["timestamp", "line_id"], bucket=bucket)
    apart = dates.seconds_between(F.col("prev_timestamp"), F.col("timestamp"))
    joins = F.coalesce((F.col("line_id") == F.col("prev_line_id")) & (apart >= 0) & (apart < minutes * 60), F.lit(False))
    return with_running_sum(held, F.when(joins, 0).otherwise(1), "group", "timestamp", "id", bucket=bucket).drop("prev_timestamp", "prev_line_id")


def groups_of_lines(timeline: DataFrame, minutes: int = 10, bucket: str = "day") -> DataFrame:
    """(line_id, start, end, messages, first_id) of the display groups that each line has by itself: less than ``minutes`` from each message to the next."""
    held = with_previous(timeline.select("id", "line_id", "timestamp"), "timestamp", "id", ["timestamp"], ["line_id"], bucket)
    joins = F.coalesce(dates.seconds_between(F.col("prev_timestamp"), F.col("timestamp")) < minutes * 60, F.lit(False))
    grouped = with_running_sum(held, F.when(joins, 0).otherwise(1), "group", "timestamp", "id", ["line_id"], bucket)
    first = F.min_by("id", F.struct("timestamp", "id"))
    return grouped.groupBy("line_id", "group").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("messages"), first.alias("first_id")).drop("group")


def date_separators(timeline: DataFrame, bucket: str = "day") -> DataFrame:
    """The first message of each day shown, with the day."""
    held = with_previous(timeline.select("id", "timestamp"), "timestamp", "id", ["timestamp"], bucket=bucket)
    return held.filter(F.col("prev_timestamp").isNull() | ~dates.same_day(F.col("timestamp"), F.col("prev_timestamp"))).select("id", F.to_date("timestamp").alias("day"))


def range_between(timeline: DataFrame, first: str, second: str) -> DataFrame:
    """The messages from one to another, both included, whichever comes first; none if either is missing."""
    ends = timeline.filter(F.col("id").isin(first, second)).agg(F.min(F.struct("timestamp", "id")).alias("_from"), F.max(F.struct("timestamp", "id")).alias("_to"), F.count("*").alias("_n"))
    place = F.struct("timestamp", "id")
    return timeline.crossJoin(F.broadcast(ends)).filter((F.col("_n") == len({first, second})) & (place >= F.col("_from")) & (place <= F.col("_to"))).drop("_from", "_to", "_n")  # ends is one row


def first_after(timeline: DataFrame, day: str) -> DataFrame:
    """The first message at or after the start of a day."""
    return timeline.filter(F.col("timestamp") >= F.to_date(F.lit(day))).orderBy("timestamp", "id").limit(1)


def newest(timeline: DataFrame, count: int) -> DataFrame:
    return timeline.orderBy(F.desc("timestamp"), F.desc("id")).limit(count)


def copied_rows(timeline: DataFrame) -> DataFrame:
    """(id, timestamp, line_id if there is one, row): messages with content as lines of a copied log."""
    c = F.col
    extra = F.when(c("metadata").isNotNull(), F.concat(F.lit(', "'), F.replace(c("metadata"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise("")
    row = F.concat(F.lit("* "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(", "), text.quoted(c("content")), F.lit(", "), F.coalesce("type", F.lit("text")), extra)
    kept = ["line_id"] if "line_id" in timeline.columns else []
    return timeline.filter(F.length("content") > 0).select("id", "timestamp", *kept, row.alias("row"))


def copied_document(timeline: DataFrame, heading: Column) -> DataFrame:
    """(line_id, document): the heading and the copied rows of each line in order."""
    rows = copied_rows(timeline)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id", "row"))), lambda r: r["row"])
    return rows.groupBy("line_id").agg(F.concat(F.lit("## "), heading, F.lit("\n"), F.array_join(texts, "\n")).alias("document"))


def copied_chunks(timeline: DataFrame, heading: Column, size: int = 10_000, bucket: str = "day") -> DataFrame:
    """(line_id, chunk, document): the document of a line in pieces of so many rows, numbered from 0, which joined by line breaks are copied_document's. No row is as large as a whole line."""
    rows = with_running_sum(copied_rows(timeline), F.lit(1), "_nth", "timestamp", "id", ["line_id"], bucket)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id", "row"))), lambda r: r["row"])
    made = rows.withColumn("chunk", F.floor((F.col("_nth") - 1) / size).cast("long")).groupBy("line_id", "chunk").agg(F.array_join(texts, "\n").alias("rows"))
    return made.select("line_id", "chunk", F.concat(F.when(F.col("chunk") == 0, F.concat(F.lit("## "), heading, F.lit("\n"))).otherwise(""), "rows").alias("document"))


def line_flags(timeline: DataFrame, lines: DataFrame, current: str, bucket: str = "day") -> DataFrame:
    """(id, line_id, line_name, starts_line, on_current_line): whether a message is the first of a stretch of its line, and whether that is the current one."""
    held = with_previous(timeline.select("id", "timestamp", "line_id"), "timestamp", "id", ["line_id"], bucket=bucket)
    flags = held.withColumn("starts_line", ~F.col("line_id").eqNullSafe(F.col("prev_line_id"))).withColumn("on_current_line", F.col("line_id") == current)
    return _named(flags, lines).select("id", "line_id", "line_name", "starts_line", "on_current_line")


def kinds(messages: DataFrame) -> DataFrame:
    """messages with kind, the type by which they are shown; none is text."""
    return messages.withColumn("kind", F.coalesce("type", F.lit("text")))


def newest_of_lines(timeline: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` messages of each line."""
    place = F.row_number().over(W.partitionBy("line_id").orderBy(F.desc("timestamp"), F.desc("id")))
    return timeline.withColumn("_place", place).filter(F.col("_place") <= count).drop("_place")
