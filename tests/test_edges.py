"""Hand-built rows for what the test tables do not hold: broken trees, exact gaps, nulls, odd texts and files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomline import model
from loomline.functions import dates, json, text
from loomline.operators import hierarchy, integrity, lines, mutations, sessions, sync, tags, tasks, timeline
from loomline.sources import csv, snapshots
from loomline.sources.parts import Parts

T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


@pytest.fixture(scope="module")
def tree(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [
        ("first", "First", None, 0), ("main", "Main", None, 5), ("a", "A", "main", 1), ("b", "B", "main", 2), ("aa", "AA", "a", 3), ("orphan", "Orphan", "gone", 4), ("below", "Below", "orphan", 5),
        ("self", "Self", "self", 6), ("x", "X", "y", 7), ("y", "Y", "x", 8), ("into", "Into", "x", 9), ("blank", "Blank", "", 10),
    ]
    return spark.createDataFrame([(i, n, p, None, day(d), None) for i, n, p, d in rows], model.LINES)


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def test_siblings_are_ranked_over_days_and_ties(spark):
    hours = [None, 30, 30, 3, 200, 200, 27, 75, None, 4]
    rows = [(f"k{n}", f"K{n}", "main", None, None if h is None else T0 + dt.timedelta(hours=h), None) for n, h in enumerate(hours)]
    rows += [("early", "Early", None, None, T0 - dt.timedelta(days=9), None), ("main", "Main", None, None, T0, None), ("undated", "Undated", "gone", None, None, None)]
    made = spark.createDataFrame(rows, model.LINES)
    wanted = ["k0", "k8", "k3", "k9", "k6", "k1", "k2", "k7", "k4", "k5"]
    ranked = {r["id"]: (r["sibling_rank"], r["is_last_child"], r["is_root"]) for r in hierarchy.with_sibling_rank(made).collect()}
    assert {i: ranked[i] for i in wanted} == {i: (n, n == 10, False) for n, i in enumerate(wanted, 1)}
    assert [ranked[i] for i in ("main", "undated", "early")] == [(1, False, True), (2, False, True), (3, True, True)]
    dropped = {r["id"]: (r["sibling_rank"], r["is_last_child"], r["is_root"]) for r in hierarchy.with_sibling_rank(made, "drop").collect()}
    assert dropped["undated"] == (1, True, False) and dropped["early"] == (2, True, True) and len(dropped) == len(rows)


def test_insert_leaves_old_rows_and_takes_a_key_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    new = spark.createDataFrame([("a", 9), ("c", 4), ("c", 5), (None, 6), (None, 6)], "id string, n int")
    found = [(r["id"], r["n"]) for r in sync.insert_if_absent(old, new).collect()]
    assert sorted(found, key=str) in [sorted([("a", 1), ("b", 2), (None, 3), ("c", c), (None, 6), (None, 6)], key=str) for c in (4, 5)]


def test_paths_by_policy_for_orphans(tree):
    found = {r["id"]: r["full_path"] for r in hierarchy.paths(tree).collect()}
    assert found == {"first": "First", "main": "Main", "a": "Main -> A", "b": "Main -> B", "aa": "Main -> A -> AA"}
    rooted = {r["id"]: r["full_path"] for r in hierarchy.paths(tree, orphans="root").collect()}
    assert rooted["below"] == "Orphan -> Below" and rooted["blank"] == "Blank" and not {"self", "x", "y", "into"} & set(rooted)


def test_ancestors_with_and_without_missing_parents(tree):
    with_missing = {r["id"]: r["ancestors"] for r in hierarchy.ancestor_ids(tree).collect()}
    assert with_missing["below"] == ["gone", "orphan"] and with_missing["aa"] == ["main", "a"] and with_missing["blank"] == [] and with_missing["into"] == ["y", "x"]
    assert {r["id"]: r["ancestors"] for r in hierarchy.ancestor_ids(tree, dangling=False).collect()}["below"] == ["orphan"]


def test_tree_order_cycles_and_prefixes(tree):
    t = hierarchy.tree(tree).orderBy("sort_path").collect()
    assert [r["id"] for r in t] == ["main", "a", "aa", "b", "first", "orphan", "below", "blank"]
    drawn = {r["id"]: r["p"] for r in hierarchy.tree(tree).select("id", hierarchy.tree_prefix(F.col("depth"), F.col("is_last_child"), F.col("parent_chain")).alias("p")).collect()}
    assert drawn["a"] == "├─" and drawn["b"] == "└─" and drawn["aa"] == "│ └─" and drawn["main"] == ""
    assert ids(hierarchy.cycles(tree)) == {"self", "x", "y", "into"}


def test_circular_moves_and_deletion(spark, tree):
    moves = spark.createDataFrame([("main", "aa"), ("aa", "b"), ("a", "a"), ("b", "x"), ("b", "nowhere")], "source string, target string")
    assert [r["circular"] for r in hierarchy.would_cycle(tree, moves).orderBy("source", "target").collect()] == [True, False, False, True, True]
    with pytest.raises(ValueError):
        mutations.reparent(tree, "main", "aa", F.lit(T0))
    moved = mutations.reparent(tree, "aa", "b", F.lit(T0)).filter("id = 'aa'").first()
    assert moved["parent_line_id"] == "b" and moved["updated_at"] == T0
    assert ids(hierarchy.deletable(tree)) == {"first", "b", "aa", "below", "into", "blank"}
    wanted = spark.createDataFrame([("main",), ("a",), ("b",), ("no",), (None,)], "id string")
    status = {r["id"]: r["status"] for r in mutations.deletion_status(tree, wanted).collect()}
    assert status == {"main": "protected", "a": "has_children", "b": "ok", "no": "unknown", None: "unknown"}
    assert mutations.fallback_line(tree, "a").first()["id"] == "main" and mutations.fallback_line(tree, "main").first()["id"] == "first"
    assert ids(hierarchy.expanded_by_default(tree, "aa")) == {"first", "main", "blank", "a"}


def test_integrity_report_and_repairs(spark, tree):
    m = spark.createDataFrame([("m1", "t", T0, "main"), ("m2", "t", T0, "lost")], "id string, content string, timestamp timestamp, line_id string")
    assert {r["check"]: r["rows"] for r in integrity.report(m, tree).collect()} == {"message_without_line": 1, "line_without_parent": 2, "self_reference": 1, "cycle": 4}
    assert integrity.without_self_references(tree).filter("id = 'self'").first()["parent_line_id"] is None
    assert integrity.with_placeholders(m, tree).filter("id = 'lost'").first()["name"] == "[復元] lost"


def message(i, seconds, line="l", deleted=False, kind="text", content=None, metadata=None, author=None, tags_=None):
    return (f"m{i:03d}", f"content {i}" if content is None else content, T0 + dt.timedelta(seconds=seconds), None, line, tags_, None, author, None, kind, metadata, deleted, None)


def test_session_gap_is_exactly_thirty_minutes_or_less(spark):
    m = spark.createDataFrame([message(0, 0), message(1, 1800), message(2, 3600.001), message(3, 3600.001), message(4, 90_000), message(5, 0, "k")], model.MESSAGES)
    assert [r["session"] for r in sessions.with_session(m).orderBy("line_id", "id").collect()] == [1, 1, 1, 2, 2, 3]


def test_sessions_cross_midnight(spark):
    late = (dt.datetime(2024, 3, 1, 23, 50) - T0).total_seconds()
    m = spark.createDataFrame([message(0, late), message(1, late + 1200)], model.MESSAGES)
    assert {r["session"] for r in sessions.with_session(m).collect()} == {1}


def test_display_groups_part_at_ten_minutes(spark):
    m = spark.createDataFrame([message(0, 0), message(1, 599.999), message(2, 1199.999), message(3, 1200, "k"), message(4, 1201)], model.MESSAGES)
    assert [r["group"] for r in timeline.display_groups(m).orderBy("id").collect()] == [1, 1, 2, 3, 4]


def test_soft_delete_has_two_readings(spark):
    m = spark.createDataFrame([message(0, 0), message(1, 1, deleted=True), message(2, 2, deleted=None), message(3, 3, kind=None), message(4, 4, content="123456")], model.MESSAGES)
    assert ids(sessions.exported(m)) == {"m000"}
    assert ids(timeline.of_line(m, "l")) == {"m000", "m002", "m003", "m004"}
    assert ids(timeline.filtered(m, completion="completed")) == {f"m00{i}" for i in range(5)}


def test_task_completion_readings(spark):
    given = ["true", '"TRUE"', '"1"', '"yes"', '""', "null", "false"]
    m = spark.createDataFrame([message(i, i, kind="task", metadata=f'{{"completed":{v},"priority":"odd"}}') for i, v in enumerate(given)] + [message(7, 7, kind="task")], model.MESSAGES)
    labels = [r[0] for r in m.orderBy("id").select(json.completion_label(F.col("metadata"))).collect()]
    assert labels == ["完了", "完了", "完了", "完了", "不明", "不明", "未完了", "不明"]
    assert ids(timeline.filtered(m, "task", "completed")) == {"m000"}
    rows = tasks.rows(m, spark.createDataFrame([], model.LINES))
    assert {r["priority"] for r in rows.collect()} == {"medium"} and {r["line_name"] for r in rows.collect()} == {"l"}
    assert {r["priority"]: r["tasks"] for r in tasks.counts_by_priority(rows).collect()} == {"urgent": 0, "high": 0, "medium": 8, "low": 0}


@pytest.mark.parametrize("count", [0, 1, 200, 201, 400, 401])
def test_pages_from_the_newest(spark, count):
    m = spark.createDataFrame([message(i, i) for i in range(count)], model.MESSAGES)
    pages = max(1, -(-count // 200))
    for asked in (0, 1, 2, pages, pages + 1):
        number = max(1, min(asked, pages))
        stop = count - (number - 1) * 200
        got = timeline.page(m, asked).orderBy("index").collect()
        assert [r["id"] for r in got] == [f"m{i:03d}" for i in range(max(0, stop - 200), stop)]
        assert [r["index"] for r in got] == list(range(len(got)))
    assert timeline.page_info(count, 99)["current_page"] == pages


def test_filters_on_tags_keywords_and_days(spark):
    m = spark.createDataFrame([message(0, 0, tags_=["Foo", None]), message(1, 86_400, author="Ann"), message(2, 0, tags_=[])], model.MESSAGES)
    assert ids(timeline.filtered(m, tag="oO")) == {"m000"} and ids(timeline.filtered(m, keyword="ANN")) == {"m001"}
    assert ids(timeline.filtered(m, start="2024-03-02", end="2024-03-02")) == {"m001"}
    assert ids(timeline.range_between(m, "m001", "m000")) == {"m000", "m001", "m002"} and not ids(timeline.range_between(m, "m001", "nobody"))
    assert [r["line_name"] for r in timeline.page_transitions(timeline.page(m), spark.createDataFrame([], model.LINES)).collect()] == ["l"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    f = lambda fn, s, *a: one(spark, fn(F.lit(s), *a))
    assert f(text.utf16_length, "🔴a") == 3 and f(text.trimmed, "　 a \n") == "a"
    assert f(text.shortened, "x" * 50, 50) == "x" * 50 and f(text.shortened, "x" * 51, 50) == "x" * 50 + "..."
    assert f(text.url_label, "h" * 51) == "h" * 47 + "..." and f(text.length_without_urls, "a http://b.c d") == 4
    assert f(text.quoted, 'a\n"b"') == '"a\\n""b""\"' and f(text.quoted, "x" * 201) == '"' + "x" * 100 + '..."'
    assert f(text.summary, "短い。" * 10) == "短い。" * 10 and f(text.summary, "あ" * 101) == "あ" * 100 + "..."
    assert f(text.summary, "い" * 60 + "。" + "う" * 60) == "い" * 60 + "。"
    assert f(text.command_of, "/task_completed  x y").asDict() == {"type": "task", "content": "x y", "priority": "medium", "completed": True}
    assert f(text.command_of, "/task ")["type"] == "text" and f(text.command_of, "/session\ngo")["content"] == "go"
    assert f(text.valid_image_url, "data:x") and not f(text.valid_image_url, "https://x/placeholder.png") and not f(text.valid_image_url, "")


def test_date_functions(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, dates.duration_minutes(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:02:30"))) == 3
    assert one(spark, dates.duration_minutes(ts("2024-01-01 00:02:30"), ts("2024-01-01 00:00:00"))) == 0
    assert one(spark, dates.duration_text(F.lit(125))) == "2時間5分" and one(spark, dates.duration_text(F.lit(59))) == "59分"
    assert one(spark, dates.parse_date_time(F.lit("2024/02/31 09:05"))) == dt.datetime(2024, 3, 2, 9, 5)
    assert one(spark, dates.parse_date_time(F.lit("2024/13/01 09:05"))) is None and one(spark, dates.parse_date_time(F.lit("x"))) is None
    status = lambda a, b: one(spark, dates.session_times_status(F.lit(a), F.lit(b)))
    assert status("2024/01/01 10:00", "2024/01/01 10:00") == "end_not_after_start" and status("", "bad") == "bad_end" and status("2024/01/01 10:00", "") == "ok"
    assert one(spark, dates.new_time_spent(F.lit(50), ts("2024-01-01 10:00:00"), ts("2024-01-01 10:20:00"), ts("2024-01-01 10:00:00"), ts("2024-01-01 11:40:00"))) == 0
    now = ts("2024-03-01 12:00:00")
    assert one(spark, dates.relative_time(ts("2024-03-01 12:30:00"), now)) == "今" and one(spark, dates.relative_time(ts("2024-01-01 00:00:00"), now)) == "2ヶ月前"
    assert one(spark, dates.separator_label(ts("2023-12-25 00:00:00"), now)) == "2023年12月25日 (月)"
    assert one(spark, dates.edited_label(ts("2024-01-01 10:00:00"), ts("2024-01-01 11:05:00"))) == "11:05"


def test_date_texts_are_matched_once(spark, sf_dir):
    from loomline.plans.queries import QUERIES

    texts = ["2024/2/30 1:05", "2024/02/03 \t04:05", "2024/02/03 04:05\n", "2024/02/03\u000b04:05", "2024/13/01 04:05", "2024/02/03 24:00", "2024/02/03", "a2024/02/03 04:05", "", None]
    got = [one(spark, F.date_format(dates.parse_date_time(F.lit(t).cast("string")), "MM-dd HH:mm")) for t in texts]
    assert got == ["03-01 01:05", "02-03 04:05", "02-03 04:05", "02-03 04:05", None, None, None, None, None, None]
    plan = QUERIES["parsed_date_times"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "try_to_number" not in plan


def test_relative_times_of_late_lines_equal_their_sql(spark, sf_dir, tmp_path):
    """Customers whose keys put their times within the last day, and after the present."""
    import shutil

    import duckdb
    from compare import same

    from loomline.plans.queries import ORACLES, QUERIES

    for t in ("region", "nation"):
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path)
    late = duckdb.connect()
    late.sql(f"COPY (SELECT * REPLACE (715000 + c_custkey * 101 AS c_custkey) FROM '{sf_dir}/customer.parquet' UNION ALL SELECT * REPLACE (720000 - 10 * c_custkey AS c_custkey) FROM '{sf_dir}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    for t in ("region", "nation", "customer"):
        late.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    wanted = late.sql(ORACLES["relative_times"]).df()
    assert {"-1日前", "0日前"} <= set(wanted["relative_time"])
    same(QUERIES["relative_times"](spark, str(tmp_path)), wanted)


def test_metadata_functions(spark):
    assert one(spark, json.metadata_text(F.lit('{"b":1,"a":true,"c":null}'))) == "a: true, b: 1" and one(spark, json.metadata_text(F.lit(None).cast("string"))) is None
    assert one(spark, json.ids_of(F.lit('["a","b"]'))) == ["a", "b"] and one(spark, json.ids_of(F.lit("a"))) == ["a"]
    toggled = tasks.toggle_completed(F.lit('{"priority":"low","completed":true,"completedAt":"x"}'), F.lit(T0))
    assert one(spark, json.is_completed(toggled)) is False and one(spark, json.value(toggled, "completedAt")) is None and one(spark, json.value(toggled, "priority")) == "low"
    assert one(spark, json.is_completed(tasks.toggle_completed(F.lit(None).cast("string"), F.lit(T0))))
    running = F.lit('{"timeSpent":5,"checkedInAt":"2024-03-01T09:00:00Z","checkedOutAt":""}')
    assert one(spark, tasks.time_spent(running, F.lit("2024-03-01T10:00:00Z").cast("timestamp"))) == 65
    assert one(spark, json.value(json.default_metadata(F.lit("document"), F.lit(" abc "), F.lit(T0)), "wordCount")) == "3"


def snapshot(spark):
    m = [message(0, 0, content='a, "quoted"\nline'), message(1, 1, content="123", metadata='{"k":1}', tags_=["t"]), message(2, 2, content="", kind=None)]
    line = [("l", "Line", None, ["t"], T0, T0)]
    return model.Snapshot(spark.createDataFrame(m, model.MESSAGES), spark.createDataFrame(line, model.LINES), spark.createDataFrame([("t", "Tag", None, "g"), ("u", "Other", None, None)], model.TAGS), spark.createDataFrame([("g", "Group", "#fff", 3)], model.TAG_GROUPS))


def test_csv_round_trip_keeps_texts_and_drops_short_rows(spark, tmp_path):
    s = snapshot(spark)
    csv.export(s, str(tmp_path))
    back = csv.import_(spark, str(tmp_path))
    for name, table in s.tables().items():
        columns = [f"`{c}`" for c in csv.COLUMNS[name][1]]
        wanted, got = table.select(*columns), back.tables()[name].select(*columns)
        if name == "messages":
            wanted, got = (x.drop("has_bookmark") for x in (wanted, got))
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    (tmp_path / "short").mkdir()
    (tmp_path / "short/tags.csv").write_text('id,name,color,group_id\na,"x ""y""\nz",,\nb,short\n\nc,Name,red,g\n')
    got = csv.import_(spark, str(tmp_path / "short")).tags.orderBy("id").collect()
    assert [r["name"] for r in got] == ['x "y"\nz', "Name"] and got[0]["color"] is None
    assert csv.import_(spark, str(tmp_path / "short"), into=s).tags.count() == 4


def test_csv_fields(spark):
    assert one(spark, csv.csv_field(F.lit('a"b'), model.T.StringType())) == '"a""b"' and one(spark, csv.csv_field(F.lit("a\rb"), model.T.StringType())) == "a\rb"


def test_parquet_snapshot_registry_and_fallback(spark, tmp_path):
    s = snapshot(spark)
    snapshots.save(s, str(tmp_path / "p"))
    assert snapshots.open_(spark, "json", str(tmp_path / "none.json"), [("parquet", str(tmp_path / "p"))]).messages.count() == 3
    with pytest.raises(OSError):
        snapshots.open_(spark, "json", str(tmp_path / "none.json")).lines.count()
    with pytest.raises(ValueError):
        snapshots.open_(spark, "ftp", "x")


def test_json_document_in_the_old_form(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"messages":{"m":{"id":"m","content":"c","timestamp":"2024-01-01T00:00:00Z","lineId":"l","hasBookmark":true,"prevInLine":null}},"lines":[{"id":"l","name":"L","parentLineId":"p","messageIds":["m"],"updated_at":"2024-01-02T00:00:00Z"}],"branchPoints":{},"tags":{"t":{"id":"t","name":"T"}},"tagGroups":{"g":{"id":"g","name":"G","color":"c","order":1}}}')
    s = snapshots.from_json(spark, str(tmp_path / "d.json"))
    assert s.messages.first()["has_bookmark"] is True and s.lines.first()["parent_line_id"] == "p" and s.lines.first()["created_at"] == dt.datetime(2024, 1, 2)


def test_incremental_pull_equals_full_reload(spark):
    s = snapshot(spark)
    now = F.lit(T0 + dt.timedelta(days=2)).cast("timestamp")
    source = s.with_(messages=s.messages.withColumn("updated_at", F.when(F.col("id") != "m000", now)).withColumn("content", F.when(F.col("id") == "m001", "new").otherwise(F.col("content"))).withColumn("deleted", F.col("id") == "m002"))
    out = sync.pull(s, source, F.lit(T0).cast("timestamp"))
    assert {r["id"]: r["content"] for r in out.messages.collect()} == {"m000": 'a, "quoted"\nline', "m001": "new"}
    assert sorted(map(str, sync.upsert(s.messages, source.messages).collect())) == sorted(map(str, sync.upsert_joined(s.messages, source.messages).collect()))
    assert sync.high_water_mark(source.messages, source.lines).first()["mark"] == T0 + dt.timedelta(days=2)
    empty = s.with_(messages=s.messages.limit(0), lines=s.lines.limit(0))
    assert sync.high_water_mark(empty.messages, empty.lines).first()["mark"] == dt.datetime(1970, 1, 1)


def test_tags_and_groups(spark):
    s = snapshot(spark)
    assert {(r["kind"], r["id"]): r["count"] for r in tags.rollup(s.lines, s.tags, s.tag_groups).collect()} == {("group", "g"): 1, ("tag", "u"): 0}
    assert mutations.delete_group(s, "g", "delete").tags.count() == 1 and mutations.delete_group(s, "g").tags.filter("group_id is null").count() == 2
    assert tags.available_on(s.lines, s.tags, s.tag_groups, "l").count() == 0
    assert tags.in_group_colour(s.tags, s.tag_groups).orderBy("id").first()["color"] == "#fff"


def test_edit_and_create(spark):
    s = snapshot(spark)
    now = F.lit(T0).cast("timestamp")
    edited = mutations.edit_message(s.messages, "m001", "x", "text", now).filter("id = 'm001'").first()
    assert edited["metadata"] == '{"k":1}' and edited["content"] == "x" and edited["updated_at"] == T0
    assert '"priority":"medium"' in mutations.edit_message(s.messages, "m001", "x", "task", now).filter("id = 'm001'").first()["metadata"]
    new = spark.createDataFrame([("n", "hi", T0, "l")], "id string, content string, timestamp timestamp, line_id string")
    out = mutations.create_message_with_line_update(s, new, now)
    assert out.messages.count() == 4 and out.lines.first()["updated_at"] == T0


def test_empty_tables(spark):
    m, n = spark.createDataFrame([], model.MESSAGES), spark.createDataFrame([], model.LINES)
    assert sessions.session_digest(m, n).count() == 0 and hierarchy.branch_tree(m, n).count() == 0
    row = lines.statistics(m, n).first()
    assert row["total_lines"] == 0 and row["avg_messages_per_line"] == 0


def test_streams(spark, tmp_path):
    from loomline.streaming import sessions as streams

    m = spark.createDataFrame([message(0, 0), message(1, 1800), message(2, 7200), message(3, 90_000)], model.MESSAGES)
    m.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(model.MESSAGES).parquet(str(tmp_path / "in"))
    q = streams.session_counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["messages"] for r in spark.table("counted").collect()) == [1, 2]
    streams.keep_snapshot(stream, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    assert Parts(spark, str(tmp_path / "out")).read().count() == 4
