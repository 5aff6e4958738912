"""The tree of lines: paths, ancestors, depth-first order, cycles and what may be moved where.

Ways up are walked by pointer doubling (``doubling``); what needs no list of ancestors, such as depths and whether a line is below another, comes from sums and from
the intervals of ``intervals``. A line whose parent id is not in the table is an orphan; an empty parent id means none, except where said. Ids are unique and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.model import MAIN_LINE
from loomline.operators import doubling
from loomline.operators.stored import all_of, own_name


def next_line() -> Column:
    """The parent's id, null for none."""
    return F.nullif(F.col("parent_line_id"), F.lit(""))


def ancestry(lines: DataFrame) -> DataFrame:
    """lines with chain (ancestors that exist, root first, without the line itself), depth, and how the walk ended.

    ended: "root", "orphan" (missing_id is the parent that is not there) or "cycle" (the next parent was met already). A line that
    leads into a cycle counts as ended by it. Chains are as long as the lines are deep; see depths for what needs none.
    """
    rank = F.col("_rank") if "_rank" in lines.columns else F.lit(None).cast("string")
    found = doubling.chains(lines.select("id", next_line().alias("next"), "name", rank.alias("rank")), ["name", "rank"])
    return lines.join(found.select("id", "chain", F.size("chain").alias("depth"), "ended", "missing_id"), "id")


def depths(lines: DataFrame) -> DataFrame:
    """(id, depth, root_id, ended, missing_id) without chains; root_id is the last ancestor that exists, or the line itself. Of lines that ended in a cycle depth and root_id are null."""
    found = doubling.totals(lines.select("id", next_line().alias("next"), F.lit(1).alias("one")), {"levels": "one"}, {})
    whole = F.col("ended") != "cycle"
    return found.select("id", F.when(whole, F.col("levels") - 1).cast("int").alias("depth"), F.when(whole, F.col("top")).alias("root_id"), "ended", "missing_id")


def paths(lines: DataFrame, joiner: str = " -> ", orphans: str = "drop") -> DataFrame:
    """(id, name, full_path, depth): names from the root to the line.

    orphans: "drop" leaves out orphans, their descendants and lines with an empty parent id, as an inner join from the roots does; "root" has
    orphans begin paths of their own. Lines in or under cycles have no path.
    """
    if orphans not in ("drop", "root"):
        raise ValueError("orphans is 'drop' or 'root'")
    known = lines.filter("parent_line_id is null or parent_line_id <> ''") if orphans == "drop" else lines
    reached = ancestry(known).filter(F.col("ended").isin("root") if orphans == "drop" else F.col("ended") != "cycle")
    names = F.array_append(F.transform("chain", lambda c: c["name"]), F.col("name"))
    return reached.select("id", "name", F.array_join(names, joiner).alias("full_path"), "depth")


def ancestor_ids(lines: DataFrame, dangling: bool = True) -> DataFrame:
    """(id, ancestors): ids root first, without the line. dangling: whether the id of a missing parent is put in front."""
    ids = F.transform("chain", lambda c: c["id"])
    with_missing = F.when(F.col("missing_id").isNotNull(), F.array_prepend(ids, F.col("missing_id"))).otherwise(ids)
    return ancestry(lines).select("id", (with_missing if dangling else ids).alias("ancestors"))


def with_sibling_rank(lines: DataFrame, orphans: str = "root") -> DataFrame:
    """lines with sibling_rank from 1, is_last_child and is_root. Siblings are in order of created_at and id; among roots the main line is first.

    Siblings are ranked by the day of created_at, none before all, and the days of a parent are counted: neither a parent of very many lines nor the roots are one task's.
    """
    parents = lines.select(F.col("id").alias("_parent")).distinct()
    held = lines.join(parents, F.col("parent_line_id") == F.col("_parent"), "left")
    rootless = F.col("parent_line_id").isNull() | (F.col("parent_line_id") == "")
    held = held.withColumn("is_root", rootless | F.col("_parent").isNull() if orphans == "root" else rootless).drop("_parent")
    day = F.when(F.col("is_root") & (F.col("id") == MAIN_LINE), "").otherwise(F.coalesce(F.to_date("created_at").cast("string"), F.lit("0")))
    held = held.withColumn("_of", F.when(F.col("is_root"), "").otherwise(F.col("parent_line_id"))).withColumn("_day", day)
    siblings = W.partitionBy("_of")
    before = F.sum("_n").over(siblings.orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    days = held.groupBy("_of", "_day").agg(F.count("*").alias("_n")).select("_of", "_day", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(siblings).alias("_all"))
    nth = F.row_number().over(W.partitionBy("_of", "_day").orderBy("created_at", "id"))
    ranked = held.withColumn("_nth", nth).join(days, ["_of", "_day"]).withColumn("sibling_rank", (F.col("_nth") + F.col("_before")).cast("int"))
    return ranked.select(*lines.columns, "is_root", "sibling_rank", (F.col("sibling_rank") == F.col("_all")).alias("is_last_child"))


def tree(lines: DataFrame, orphans: str = "root") -> DataFrame:
    """lines in depth-first order by sort_path, with depth, is_last_child and parent_chain (for each ancestor whether it is a last child).

    orphans: "root" has them as roots, "drop" leaves them and what is below out. Lines in or under cycles are left out.
    """
    ranked = with_sibling_rank(lines, orphans).withColumn("_rank", F.concat(F.lpad(F.col("sibling_rank").cast("string"), 10, "0"), F.when(F.col("is_last_child"), "z").otherwise("a")))
    reached = ancestry(ranked).filter(F.col("ended") != "cycle" if orphans == "root" else F.col("ended") == "root")
    ranks = F.array_append(F.transform("chain", lambda c: c["rank"]), F.col("_rank"))
    last = F.transform("chain", lambda c: c["rank"].endswith("z"))
    return reached.select(*lines.columns, "depth", "is_last_child", last.alias("parent_chain"), F.array_join(F.transform(ranks, lambda r: F.left(r, F.lit(10))), ".").alias("sort_path"))


def tree_prefix(depth: Column, is_last: Column, parent_chain: Column) -> Column:
    """The branch drawing before a line's name; nothing for roots."""
    upper = F.transform(F.slice(parent_chain, F.lit(2), F.greatest(depth - 1, F.lit(0))), lambda last: F.when(last, "  ").otherwise("│ "))
    return F.when(depth == 0, "").otherwise(F.concat(F.array_join(upper, ""), F.when(is_last, "└─").otherwise("├─")))


def branch_tree(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """The flattened tree (id, name, depth, sort_path) with message_count, deleted messages included, 0 where there are none."""
    counts = messages.groupBy(F.col("line_id").alias("id")).agg(F.count("*").alias("message_count"))
    return tree(lines).select("id", "name", "depth", "sort_path").join(counts, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def cycles(lines: DataFrame) -> DataFrame:
    """(id, cycle_chain): lines in a cycle or leading into one, with the ids met, nearest first."""
    found = ancestry(lines).filter("ended = 'cycle'")
    return found.select("id", F.concat(F.array("id"), F.reverse(F.transform("chain", lambda c: c["id"]))).alias("cycle_chain"))


def would_cycle(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (source, target) with circular: whether the source is the target, is above it, or the target is in a cycle already or leads into one.

    A source is above a target if its interval has the target's number. Within a cycle there are no numbers: every target there is circular whatever the source.
    """
    from loomline.operators.intervals import number

    places = number(lines)
    first, at, second, start, stop, known = (own_name(moves, n) for n in ("_target", "_at", "_source", "_from", "_to", "_known"))
    target = lines.select(F.col("id").alias(first)).join(places.select(F.col("id").alias(first), F.col("entry").alias(at), F.lit(True).alias(known)), first, "left")
    source = places.select(F.col("id").alias(second), F.col("entry").alias(start), F.col("exit").alias(stop))
    held = moves.join(target, F.col("target") == F.col(first), "left").join(source, F.col("source") == F.col(second), "left")
    above = F.coalesce(F.col(at).between(F.col(start), F.col(stop)), F.lit(False))
    loops = F.col(first).isNotNull() & F.col(known).isNull()
    return held.select(*all_of(moves), (F.coalesce(F.col("source") == F.col("target"), F.lit(False)) | above | loops).alias("circular"))


def connections(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """moves with the names of source, target and the source's present parent, and circular."""
    name = lambda key, out: lines.select(F.col("id").alias(key), F.col("name").alias(out))
    parent = lines.select(F.col("id").alias("source"), F.col("parent_line_id").alias("parent_id"))
    named = would_cycle(lines, moves).join(name("source", "source_name"), "source", "left").join(name("target", "target_name"), "target", "left")
    return named.join(parent, "source", "left").join(name("parent_id", "parent_name"), "parent_id", "left").select("source", "source_name", "target", "target_name", "parent_id", "parent_name", "circular")


def child_counts(lines: DataFrame) -> DataFrame:
    return lines.filter("parent_line_id is not null and parent_line_id <> ''").groupBy("parent_line_id").agg(F.count("*").alias("children"))


def children_of(lines: DataFrame, line_id: str) -> DataFrame:
    return lines.filter(F.col("parent_line_id") == line_id)


def parent_of(lines: DataFrame, line_id: str) -> DataFrame:
    return lines.join(lines.filter(F.col("id") == line_id).select(F.col("parent_line_id").alias("id")), "id", "left_semi")


def deletable(lines: DataFrame) -> DataFrame:
    """Lines that may be deleted: without children, and not the main line."""
    parents = lines.select(F.col("parent_line_id").alias("id")).filter("id is not null")
    return lines.filter(F.col("id") != MAIN_LINE).join(parents, "id", "left_anti")


def expanded_by_default(lines: DataFrame, current: str) -> DataFrame:
    """(id): the roots and the ancestors of the current line; of one in or under a cycle the roots alone."""
    from loomline.operators.intervals import number, way_to

    up = way_to(number(lines), current).filter(F.col("id") != current).select("id")
    return lines.filter("parent_line_id is null or parent_line_id = ''").select("id").union(up).distinct()


def path_to(lines: DataFrame, line_id: str) -> DataFrame:
    """(position, id): the way from the root to a line; nothing for a line that no root leads to."""
    from loomline.operators.intervals import number, way_to

    return way_to(number(lines, "drop"), line_id).select(F.col("depth").alias("position"), "id")


def short_ancestry(lines: DataFrame) -> DataFrame:
    """(id, ancestry): names of the ancestors that exist, without the main line, joined by ">"."""
    names = F.transform(F.filter("chain", lambda c: c["id"] != MAIN_LINE), lambda c: c["name"])
    return ancestry(lines).select("id", F.array_join(names, ">").alias("ancestry"))


def labels(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, sort_path, label): names indented by depth, with the number of messages where there are any."""
    t = branch_tree(messages, lines)
    count = F.when(F.col("message_count") > 0, F.concat(F.lit(" ("), F.col("message_count").cast("string"), F.lit(" msgs)"))).otherwise("")
    return t.select("id", "sort_path", F.concat(F.repeat(F.lit("  "), F.col("depth")), "name", count).alias("label"))


def options(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, sort_path, message_count, has_children, no_parent, no_deletion): of each line whether it can't be chosen as a parent, having no messages, or be deleted, being the main line or having children."""
    t = branch_tree(messages, lines)
    parents = child_counts(lines).select(F.col("parent_line_id").alias("id"), F.lit(True).alias("_has"))
    held = t.join(parents, "id", "left").withColumn("has_children", F.coalesce("_has", F.lit(False)))
    return held.select("id", "sort_path", "message_count", "has_children", (F.col("message_count") == 0).alias("no_parent"), ((F.col("id") == MAIN_LINE) | F.col("has_children")).alias("no_deletion"))
