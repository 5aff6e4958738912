"""Deep and broken trees, intervals, tables of parts, page directories, CSV in blocks, streams and nested tags, against plain versions written out here."""

import csv as plain_csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from loomline import model
from loomline.operators import doubling, hierarchy, intervals, mutations, ordered, sync, tag_trees, tasks, timeline
from loomline.operators import stored as stored_tables
from loomline.sources import changes, csv, csv_records, published, snapshots
from loomline.sources.directory import Directory
from loomline.sources.parts import Parts, digest_tree, unequal_leaves
from loomline.streaming import groups
from loomline.streaming import sessions as streams

T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


def made_lines(spark, parents):
    """Lines from {id: parent}, created in this order."""
    return spark.createDataFrame([(i, i.upper(), p, None, T0 + dt.timedelta(minutes=n), None) for n, (i, p) in enumerate(parents.items())], model.LINES)


def plain_way(parents, i):
    """(ancestors nearest first, how it ended, missing id)."""
    way, at = [], parents[i]
    while at and at in parents and at != i and at not in way:
        way.append(at)
        at = parents[at]
    return way, ("root", None) if not at else ("orphan", at) if at not in parents else ("cycle", None)


def random_forest(seed, n=60):
    pick = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    parents = {i: pick.choice([None, "", "gone", *ids]) if pick.random() < 0.3 else ids[pick.randrange(max(1, k))] if k else None for k, i in enumerate(ids)}
    parents["main"] = None
    return parents


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("plain_up_to", [0, 1_000_000])
def test_ways_equal_plain_ones(spark, seed, plain_up_to, monkeypatch):
    monkeypatch.setattr(stored_tables, "PLAIN", plain_up_to)  # with and without salts
    parents = random_forest(seed)
    lines = made_lines(spark, parents)
    got = {r["id"]: ([c["id"] for c in r["chain"]][::-1], (r["ended"], r["missing_id"]), [c["name"] for c in r["chain"]][::-1]) for r in hierarchy.ancestry(lines).collect()}
    wanted = {i: (way, ended, [w.upper() for w in way]) for i in parents for way, ended in [plain_way(parents, i)]}
    assert got == wanted
    depths = {r["id"]: (r["depth"], r["root_id"], r["ended"], r["missing_id"]) for r in hierarchy.depths(lines).collect()}
    assert depths == {i: (len(way), (way or [i])[-1], *ended) if ended[0] != "cycle" else (None, None, *ended) for i, (way, ended, _) in wanted.items()}


def plain_numbers(parents, orphans):
    """{id: (depth, root, entry, exit)} by a walk."""
    below = {}
    for i, p in parents.items():
        way, (ended, _) = plain_way(parents, i)
        if ended == "cycle" or (ended == "orphan" and orphans == "drop"):
            continue
        below.setdefault(p if p in parents and p else "", []).append(i)
    out, at = {}, 0

    def visit(i, depth, root):
        nonlocal at
        at += 1
        entry = at
        for c in below.get(i, []):
            visit(c, depth + 1, root)
        out[i] = (depth, root, entry, at)

    for i in sorted(below.get("", []), key=lambda i: i != "main"):
        visit(i, 0, i)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("orphans", ["root", "drop"])
def test_intervals_equal_a_walk(spark, seed, orphans):
    parents = random_forest(seed)
    numbered = intervals.number(made_lines(spark, parents), orphans)
    wanted = plain_numbers(parents, orphans)
    assert {r["id"]: (r["depth"], r["root_id"], r["entry"], r["exit"]) for r in numbered.collect()} == wanted
    is_below = lambda a, b: a in wanted and b in wanted and wanted[b][2] < wanted[a][2] <= wanted[b][3]
    pairs = [(a, b, n) for n, (a, b) in enumerate((a, b) for a in [*parents, "no"] for b in ("main", "n0", "n7", "no", a))]
    got = intervals.are_below(numbered, spark.createDataFrame(pairs, "line string, above string, `a.b` int")).collect()
    assert {(r["line"], r["above"], r["a.b"]): r["is_below"] for r in got} == {p: is_below(p[0], p[1]) for p in pairs}
    for i in ("main", "n0", "no"):
        assert {r["id"] for r in intervals.subtree(numbered, i).collect()} == {a for a in wanted if a == i or is_below(a, i)}
        assert {r["id"] for r in intervals.way_to(numbered, i).collect()} == {a for a in wanted if a == i or is_below(i, a)}
    pick = random.Random(seed)
    values = [(pick.choice([*parents, "no"]), pick.randrange(10)) for _ in range(200)]
    own = {i: sum(v for line, v in values if line == i) for i in wanted}
    sums = intervals.subtree_sums(numbered, spark.createDataFrame(values, "line_id string, v long"), F.col("v"), "total", block=7)
    assert {r["id"]: (r["lines"], r["own"], r["total"]) for r in sums.collect()} == {i: (x - n + 1, own[i], own[i] + sum(own[a] for a in wanted if is_below(a, i))) for i, (_, _, n, x) in wanted.items()}


def test_a_chain_of_five_thousand_lines(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(doubling, "lookup", lambda *a, **b: rounds.append(1) or stored_tables.lookup(*a, **b))
    n = 5000
    lines = spark.range(n).select(F.concat(F.lit("k"), "id").alias("id"), F.concat(F.lit("K"), "id").alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id") - 1)).alias("parent_line_id"), F.lit(None).cast("timestamp").alias("created_at")).repartition(4)
    found = hierarchy.paths(lines, ">").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max_by("full_path", "depth").alias("path"), F.sum(F.size(F.split("full_path", ">")) - F.col("depth")).alias("ones")).first()
    assert len(rounds) <= 14 and (found["n"], found["depth"], found["ones"]) == (n, n - 1, n) and found["path"] == ">".join(f"K{i}" for i in range(n))
    rounds.clear()
    assert {(r["id"], r["depth"], r["root_id"]) for r in hierarchy.depths(lines).collect()} == {(f"k{i}", i, "k0") for i in range(n)} and len(rounds) <= 14
    numbered = intervals.number(lines)
    assert numbered.filter("entry <> depth + 1 OR exit <> 5000").count() == 0 and numbered.count() == n
    assert "array" not in intervals.are_below(numbered, spark.createDataFrame([("k9", "k3")], "line string, above string"))._jdf.queryExecution().toString().lower()


def test_a_long_cycle_and_what_leads_into_it(spark):
    n = 300
    parents = {f"c{i}": f"c{(i + 1) % n}" for i in range(n)} | {f"t{i}": f"t{i - 1}" if i else "c5" for i in range(40)} | {"free": None, "under": "free"}
    lines = made_lines(spark, parents)
    got = {r["id"]: r["cycle_chain"] for r in hierarchy.cycles(lines).collect()}
    assert got == {i: [i, *plain_way(parents, i)[0]] for i in parents if i not in ("free", "under")}
    assert {r["id"] for r in intervals.number(lines).collect()} == {"free", "under"}


@pytest.mark.parametrize("seed", range(2))
def test_contracted_trees_equal_walks(spark, seed, monkeypatch):
    """Many small parts, several contractions and hot parents, on forests with orphans, cycles and chains of mixed names."""
    parents = random_forest(seed, 120) | {f"c{i * 37 % 101}": f"c{(i + 1) * 37 % 101}" if i < 100 else None for i in range(101)} | {f"s{i}": "s" for i in range(20)} | {"s": "n3"} | {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)}
    for module, name, value in ((doubling, "SMALL", 60), (doubling, "PART", 25), (doubling, "HOT", 5), (intervals, "BROOD", 4)):
        monkeypatch.setattr(module, name, value)
    steps, whole = [], doubling._parts
    monkeypatch.setattr(doubling, "_parts", lambda state, size, step: steps.append((step, size)) or whole(state, size, step))
    lines = made_lines(spark, parents)
    depths = {r["id"]: (r["depth"], r["root_id"], r["ended"], r["missing_id"]) for r in hierarchy.depths(lines).collect()}
    ways = {i: plain_way(parents, i) for i in parents}
    assert depths == {i: (len(way), (way or [i])[-1], *ended) if ended[0] != "cycle" else (None, None, *ended) for i, (way, ended) in ways.items()}
    assert max(step for step, _ in steps) >= 2
    numbered = intervals.number(lines)
    assert {r["id"]: (r["depth"], r["root_id"], r["entry"], r["exit"]) for r in numbered.collect()} == plain_numbers(parents, "root")


def test_a_deep_chain_is_walked_in_its_parts(spark, monkeypatch):
    """300,000 lines in one chain: what is left after the parts have contracted it is a row or so for each part, so tables of the walk hold few rows beyond those of the lines."""
    made = []
    monkeypatch.setattr(doubling, "stored", lambda df, label: made.append((label, stored_tables.stored(df, label))) or made[-1][1])
    monkeypatch.setattr(doubling, "forget", lambda table: None)
    n = 300_000
    lines = spark.range(n).select(F.format_string("k%07d", "id").alias("id"), F.when(F.col("id") > 0, F.format_string("k%07d", F.col("id") - 1)).alias("parent_line_id"))
    found = hierarchy.depths(lines)
    assert found.filter(F.col("depth") != F.substring("id", 2, 7).cast("int")).count() == 0 and found.count() == n
    assert sum(t.count() for _, t in made) < 3.1 * n


def test_no_lines(spark):
    none = spark.createDataFrame([], model.LINES)
    assert hierarchy.depths(none).count() == hierarchy.ancestry(none).count() == intervals.number(none).count() == 0


# names that clash


def test_windows_and_mutations_take_any_column_names(spark):
    rows = [("a", T0, 1, 2, 3, 4, 5), ("b", T0 + dt.timedelta(days=1), 6, 7, 8, 9, 10), ("c", T0 + dt.timedelta(days=1), 11, 12, 13, 14, 15)]
    names = "id string, timestamp timestamp, _bucket int, _previous int, `x.y` int, _of0 int, _near int"
    df = spark.createDataFrame(rows, names)
    held = ordered.with_previous(df, "timestamp", "id", ["id", "x.y"], by=[]).orderBy("id").collect()
    assert [tuple(r)[:7] for r in held] == rows and [(r["prev_id"], r["prev_x.y"]) for r in held] == [(None, None), ("a", 3), ("b", 8)]
    by = ordered.with_previous(df.withColumn("x.y", F.lit(1)), "timestamp", "id", ["id"], by=["x.y"]).orderBy("id").collect()
    assert [r["prev_id"] for r in by] == [None, "a", "b"]
    summed = ordered.with_running_sum(df, F.col("_near"), "sum", "timestamp", "id").orderBy("id").collect()
    assert [tuple(r)[:7] for r in summed] == rows and [r["sum"] for r in summed] == [5, 15, 30]
    placed = ordered.with_position(df.withColumnsRenamed({"_near": "_range", "_of0": "_nth"}), [F.desc("id")]).orderBy("id").collect()
    assert [r["position"] for r in placed] == [3, 2, 1]


def test_updates_settle_repeated_ids(spark):
    table = spark.createDataFrame([("a", 1, T0, 7), ("b", 2, T0, 8), ("c", 3, None, 9)], "id string, n int, updated_at timestamp, `_hit.x` int")
    moves = spark.createDataFrame([("a", 10, True, 1), ("a", 11, True, 3), ("a", None, True, 2), ("b", None, True, 1), ("c", 5, False, 1), ("no", 1, True, 1)], "id string, n int, set_n boolean, at int")
    now = F.lit(T0 + dt.timedelta(days=1))
    got = {r["id"]: (r["n"], r["updated_at"], r["_hit.x"]) for r in mutations.update(table, moves, now, order="at").collect()}
    later = T0 + dt.timedelta(days=1)
    assert got == {"a": (11, later, 7), "b": (None, later, 8), "c": (3, later, 9)}
    once = [(r["id"], r["n"]) for r in mutations.update(table, moves).collect()]
    assert len(once) == 3 and dict(once)["a"] in (10, 11, None)


# tables of parts

ROWS = "id string, content string, updated_at timestamp, deleted boolean"


def day(n):
    return T0 + dt.timedelta(days=n)


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def made_parts(spark, path, n=200, parts=16):
    rows = [(f"k{i}", f"text {i}", day(i % 5) if i % 7 else None, None) for i in range(n)] + [(None, "keyless", day(1), False), (None, "keyless", day(1), False)]
    return rows, Parts.create(spark.createDataFrame(rows, ROWS), str(path), parts=parts)


def contents(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_batch_rewrites_the_parts_of_its_keys_only(spark, tmp_path):
    rows, table = made_parts(spark, tmp_path / "t")
    assert contents(table.read()) == sorted(rows, key=str) and len(table.manifest()) == 16
    before, old = files(tmp_path / "t/rows"), {r["part"]: r["folder"] for r in table.manifest()}
    batch = [("k3", "older", day(9), None), ("k3", "newer", day(10), None), ("k4", "gone", day(9), True), ("fresh", "new", day(8), False)]
    touched = table.merge(spark.createDataFrame(batch, ROWS), number=0, gone=F.col("deleted"))
    assert 1 <= len(touched) <= 3 and len(files(tmp_path / "t/rows") - before) == len(touched)
    now = {r["part"]: r["folder"] for r in table.manifest()}
    assert {p for p in now if now[p] != old.get(p)} == set(touched)
    wanted = [r for r in rows if r[0] not in ("k3", "k4")] + [batch[1], batch[3]]
    assert contents(table.read()) == sorted(wanted, key=str) and contents(table.read(table.number() - 1)) == sorted(rows, key=str)
    assert table.merge(spark.createDataFrame([("k5", "again", day(20), None)], ROWS), number=0) == [] and table.high_water_mark() == day(10)
    assert sum(r["rows"] for r in table.manifest()) == len(wanted)


def test_old_versions_and_their_rows_go(spark, tmp_path):
    _, table = made_parts(spark, tmp_path / "t", parts=4)
    for n in range(4):
        table.merge(spark.createDataFrame([(f"k{i}", f"{n}", day(10 + n), None) for i in range(50)], ROWS), keep=1)
    assert len(published.numbers(spark, f"{table.path}/versions")) == 1 and len(files(tmp_path / "t/rows")) == 4
    assert table.read().filter("content = '3'").count() == 50


def test_a_batch_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    rows, table = made_parts(spark, tmp_path / "t")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(published, "publish", dies)
        with pytest.raises(RuntimeError):
            table.merge(spark.createDataFrame([("k3", "half", day(9), None)], ROWS), number=5)
    again = Parts(spark, table.path)
    assert contents(again.read()) == sorted(rows, key=str) and again.batch() is None
    assert again.merge(spark.createDataFrame([("k3", "whole", day(9), None)], ROWS), number=5) and again.read().filter("content IN ('half', 'whole')").collect()[0]["content"] == "whole"
    assert not [n for n in published.names(spark, f"{table.path}/versions") if n.startswith("_draft")] and len(published.names(spark, f"{table.path}/rows")) == 2


def test_a_second_writer_is_told(spark, tmp_path):
    _, table = made_parts(spark, tmp_path / "t")
    with pytest.raises(FileExistsError):
        table._publish([], None, table.number())
    with pytest.raises(FileExistsError):
        made_parts(spark, tmp_path / "t")


def test_digest_trees():
    pick = random.Random(3)
    for size in (1, 2, 5, 16, 33):
        first = {i: (1, pick.randrange(1 << 60)) for i in range(size)}
        for changed in (set(), {0}, {size - 1}, set(range(size)), set(pick.sample(range(size), size // 2))):
            second = {i: (n, d + 1) if i in changed else (n, d) for i, (n, d) in first.items()}
            assert unequal_leaves(digest_tree(first), digest_tree(second)) == changed
            without = {i: v for i, v in first.items() if i not in changed}
            assert unequal_leaves(digest_tree(first), digest_tree(without)) == changed == unequal_leaves(digest_tree(without), digest_tree(first))


def test_differences_equal_a_full_outer_join_and_equal_parts_are_not_read(spark, tmp_path, monkeypatch):
    rows, table = made_parts(spark, tmp_path / "t", n=500, parts=64)
    other = [r if r[0] != "k17" else ("k17", "changed", *r[2:]) for r in rows if r[0] not in ("k1", "k2")] + [("more", "x", None, None)]
    source = spark.createDataFrame(other, ROWS)
    opened = []
    monkeypatch.setattr(Parts, "_of", lambda self, folders, was=Parts._of: opened.extend(folders) or was(self, folders))
    got = {(r["key"], r["change"]) for r in table.differences(source).collect()}
    assert got == {("k1", "deleted"), ("k2", "deleted"), ("k17", "changed"), ("more", "inserted")}
    a, b = ({r[0]: r[1:] for r in x if r[0]} for x in (rows, other))
    assert got == {(k, "inserted" if k not in a else "deleted" if k not in b else "changed") for k in a | b if a.get(k) != b.get(k)}
    assert len(opened) == len(table.unequal(source)) <= 4
    opened.clear()
    assert table.differences(spark.createDataFrame(rows, ROWS)).count() == 0 and not opened
    touched = table.drop_deleted(source)
    assert len(touched) <= 2 and {r["id"] for r in table.read().collect()} == {r[0] for r in rows} - {"k1", "k2"}


def numbers_of_tasks(df):
    """Partitions of the source's scan."""
    return df.rdd.getNumPartitions()


def test_changes_skip_parts_and_rows(spark, tmp_path):
    rows, table = made_parts(spark, tmp_path / "t", parts=16)
    table.merge(spark.createDataFrame([("k3", "new", day(30), None), ("k8", "new", day(31), None)], ROWS))
    changes.register(spark)
    read = lambda: spark.read.format(changes.FORMAT).load(table.path)
    assert contents(read()) == contents(table.read()) and numbers_of_tasks(read()) == 16
    late = read().filter(F.col("updated_at") > F.lit(day(10)))
    assert {r["id"] for r in late.collect()} == {"k3", "k8"} and numbers_of_tasks(late) <= 2
    assert {r["id"] for r in read().filter(F.col("updated_at") >= F.lit(day(31))).collect()} == {"k8"} and {r["id"] for r in read().filter(F.col("updated_at") == F.lit(day(30))).collect()} == {"k3"}
    assert numbers_of_tasks(read().filter(F.col("updated_at") > F.lit(day(99)))) == 1 and read().filter(F.col("updated_at") > F.lit(day(99))).count() == 0
    middle = read().filter((F.col("updated_at") > F.lit(day(1))) & (F.col("updated_at") < F.lit(day(3))))
    assert contents(middle) == sorted((r for r in rows if r[2] == day(2) and r[0] not in ("k3", "k8")), key=str)
    assert contents(table.read(since=day(10))) == contents(late)


def test_a_stream_of_changes_goes_on_from_its_mark(spark, tmp_path):
    rows, table = made_parts(spark, tmp_path / "t", parts=8)
    changes.register(spark)

    def run():
        stream = spark.readStream.format(changes.FORMAT).option("since", day(2).isoformat()).load(table.path)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination(120)
        return contents(spark.read.schema(ROWS).parquet(str(tmp_path / "out")))

    first = sorted((r for r in rows if r[2] and r[2] > day(2)), key=str)
    assert run() == first == run()
    new = [("k3", "new", day(30), None), ("k3000", "new", day(31), None)]
    table.merge(spark.createDataFrame(new, ROWS))
    assert run() == sorted(first + new, key=str)


def test_snapshots_are_replaced_whole(spark, tmp_path, monkeypatch):
    m = spark.createDataFrame([("m", "c", T0, None, "l", None, None, None, None, None, None, None, None)], model.MESSAGES)
    s = model.Snapshot(m, made_lines(spark, {"l": None}), spark.createDataFrame([], model.TAGS), spark.createDataFrame([], model.TAG_GROUPS))
    path = str(tmp_path / "s")
    snapshots.save(s, path)
    old = snapshots.load(spark, path)
    snapshots.save(old.with_(messages=old.messages.withColumn("content", F.lit("new"))), path)  # made from what it replaces
    assert snapshots.load(spark, path).messages.first()["content"] == "new" and old.messages.first()["content"] == "c"

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(published, "publish", dies)
    with pytest.raises(RuntimeError):
        snapshots.save(old.with_(lines=old.lines.limit(0)), path)
    assert snapshots.load(spark, path).lines.count() == 1
    assert published.numbers(spark, path) == [0, 1]


# page directories


def messages_at(spark, seconds, first=0):
    return spark.createDataFrame([(f"m{first + n:05d}", f"c {n}", T0 + dt.timedelta(seconds=s)) for n, s in enumerate(seconds)], "id string, content string, timestamp timestamp")


def test_directory_pages_equal_counted_ones(spark, tmp_path):
    pick = random.Random(2)
    times = [pick.choice([0, 60, 3600 * pick.randrange(200)]) for _ in range(700)]
    all_ = messages_at(spark, times)
    early = messages_at(spark, times[:400])
    book = Directory.create(early, str(tmp_path / "d"), size=50)
    ranges = book.ranges()
    assert sum(r["rows"] for r in ranges) == 400 and all(a["last_at"] <= b["first_at"] for a, b in zip(ranges, ranges[1:], strict=False))
    rest = messages_at(spark, times[400:], first=400)
    book.append(rest.unionByName(messages_at(spark, times[:5]).withColumn("content", F.lit("again"))))  # anywhere among the others, five replayed
    both = all_.withColumn("content", F.when(F.substring("id", 2, 9).cast("int") < 5, "again").otherwise(F.concat(F.lit("c "), F.when(F.substring("id", 2, 9).cast("int") < 400, F.substring("id", 2, 9).cast("int")).otherwise(F.substring("id", 2, 9).cast("int") - 400))))
    assert book.total() == 700
    for number, size in ((1, 20), (2, 20), (7, 50), (35, 20), (99, 20), (-3, 13), (1, 1000)):
        page = book.page(number, size)
        wanted = timeline.page(both, number, size)
        assert [tuple(r) for r in page.orderBy("index").collect()] == [tuple(r) for r in wanted.select(*page.columns).orderBy("index").collect()]
    rows = sorted((r["timestamp"], r["id"]) for r in both.collect())
    for n in (-1, 0, 1, 3, 8):
        d = (T0 + dt.timedelta(days=n)).date()
        after = [k for k, (t, _) in enumerate(rows) if t >= dt.datetime.combine(d, dt.time())]
        found = book.first_after(d.isoformat()).collect()
        assert [(r["id"], r["place"]) for r in found] == [(rows[k][1], k) for k in after[:1]]
        number = book.page_of(d.isoformat(), 20)
        assert number == ((699 - after[0]) // 20 + 1 if after else 1) and (not after or rows[after[0]][1] in {r["id"] for r in book.page(number, 20).collect()})


def test_a_page_opens_few_files_and_appends_rewrite_few_ranges(spark, tmp_path):
    book = Directory.create(messages_at(spark, range(0, 10_000, 10)), str(tmp_path / "d"), size=100)
    assert all(len(book.page(n, 40).inputFiles()) <= 2 for n in (1, 2, 9, 25))
    assert len(book.first_after("2024-03-01").inputFiles()) == 1
    before = files(tmp_path / "d/rows")
    last = book.ranges()[-1]["rows"]
    assert book.append(messages_at(spark, range(10_000, 10_300, 10), first=2000)) == (0 if last >= 100 else 1)
    assert len(files(tmp_path / "d/rows") - before) <= 3
    assert book.append(messages_at(spark, [5], first=3000)) == 1 and book.total() == 1031 and book.page(99, 40).first()["id"] == "m00000"
    assert book.append(messages_at(spark, [5], first=3000).limit(0)) == 0


def test_many_ranges_are_few_tasks(spark, tmp_path):
    """4,000 rows in ranges of 20: some 200 ranges, written by as many tasks as there are shuffle partitions."""
    book = Directory.create(messages_at(spark, range(4000)), str(tmp_path / "d"), size=20)
    book.append(messages_at(spark, range(0, 4000, 40), first=5000))
    ranges = book.ranges()
    assert len(ranges) >= 200 and max(r["rows"] for r in ranges) <= 20 and sum(r["rows"] for r in ranges) == book.total() == 4100
    assert all((a["last_at"], a["last_id"]) < (b["first_at"], b["first_id"]) for a, b in zip(ranges, ranges[1:], strict=False))
    writes = [len(p) for p in [{f.name.split("-")[1] for f in (tmp_path / "d/rows").glob(f"{w}-*/*/*/*.parquet")} for w in ("0000000001", "0000000002")] if p]
    assert writes and max(writes) <= 4


def test_an_empty_directory(spark, tmp_path):
    book = Directory.create(messages_at(spark, [1]).limit(0), str(tmp_path / "d"))
    assert book.total() == 0 and book.page().count() == 0 and book.first_after("2024-01-01").count() == 0 and book.page_of("2024-01-01") == 1
    book.append(messages_at(spark, [1, 0]))
    assert [(r["id"], r["index"]) for r in book.page().orderBy("index").collect()] == [("m00001", 0), ("m00000", 1)]


# CSV in blocks


def written_csv(rows, header=("a", "b", "c"), end="\n"):
    out = io.StringIO()
    plain_csv.writer(out, lineterminator=end).writerows([header, *rows])
    return out.getvalue()


PIECES = ["", "x", "a,b", 'say "hi"', '"', '""', "two\nlines", "\n", "\n\n", 'q"\n"q', "日本\n語", " pad ", "a\r\nb", ",", "x" * 300]


@pytest.mark.parametrize("block", [64, 333, 4096, 1 << 20])
def test_csv_in_blocks_equals_a_reader_that_goes_through_it(spark, tmp_path, block):
    pick = random.Random(block)
    for n in range(3):
        rows = [[pick.choice(PIECES) for _ in range(3)] for _ in range(150)]
        (tmp_path / f"{n}.csv").write_text(written_csv(rows), newline="")
    (tmp_path / "short.csv").write_text('a,b,c\n1,2\n\n   \n1,2,3,4\n"x\ny",2,3\n1,2,3', newline="")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text('a,"b\n",c\n', newline="")
    wanted = []
    for f in tmp_path.glob("*.csv"):
        read = [r for r in plain_csv.reader(io.StringIO(f.read_bytes().decode(), newline="")) if r]
        wanted += [tuple(x or None for x in r) for r in read[1:] if len(r) == 3]
    got = csv_records.rows(spark, str(tmp_path), ["a", "b", "c"], block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(wanted, key=str)


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [[str(i), f"line {i}\nand \"more\"" if i % 3 else "y" * 50, "z"] for i in range(20_000)]
    (tmp_path / "a.csv").write_text(written_csv(rows), newline="")
    tasks_ = []
    from loomline.sources import csv_records as module

    original = module.stored
    module.stored = lambda df, label: tasks_.append(df.rdd.getNumPartitions()) or original(df, label)
    try:
        found = csv_records.rows(spark, str(tmp_path), ["a", "b", "c"], block=1 << 16)
    finally:
        module.stored = original
    assert tasks_[0] >= 8 and found.count() == 20_000 and found.agg(F.sum("a")).first()[0] == sum(range(20_000))


def test_an_unclosed_quote_and_crlf(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\r\n1,2\r\n3,"x\r\ny"\r\n4,"never\nends\n5,6\n', newline="")
    got = [(r["first"], r["record"]) for r in csv_records.records(spark, str(tmp_path / "a.csv"), block=8).collect()]
    assert sorted(got) == sorted([(True, "a,b"), (False, "1,2"), (False, '3,"x\r\ny"'), (False, '4,"never\nends\n5,6')])


# streams


def test_streamed_groups_equal_those_of_the_timeline(spark, tmp_path):
    pick = random.Random(8)
    gaps = [0, 1, 599.999, 600, 600.001, 30, 5000]
    rows, at = [], {}
    for n in range(300):
        line = pick.choice(["a", "b", None])
        at[line] = at.get(line, 0) + pick.choice(gaps)
        rows.append((f"m{n:04d}", line, T0 + dt.timedelta(seconds=at[line])))
    schema = "id string, line_id string, timestamp timestamp"
    wanted = contents(timeline.groups_of_lines(spark.createDataFrame(rows, schema)))
    ordered_rows = sorted(rows, key=lambda r: r[2])
    for n in range(0, 300, 50):  # shuffled within batches and with some of the batch before, as late as half an hour
        batch = ordered_rows[n : n + 50] + [r for r in ordered_rows[max(0, n - 10) : n]]
        pick.shuffle(batch)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("zz", "end", T0 + dt.timedelta(days=4000))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = groups.line_groups(stream, lateness="60 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert contents(got.select("line_id", "start", "end", "messages", "first_id")) == wanted


def test_streamed_groups_keep_a_row_for_each_group(spark, tmp_path):
    """No state of single messages that a line's task looks through in each batch."""
    messages_at(spark, [0]).withColumn("line_id", F.lit("a")).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("id string, content string, timestamp timestamp, line_id string").parquet(str(tmp_path / "m"))
    plan = groups.line_groups(stream)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "session_window" in plan


def test_a_kept_snapshot_rewrites_touched_parts(spark, tmp_path):
    schema = model.MESSAGES
    row = lambda i, text, when, gone=False: (i, text, T0, when, "l", None, None, None, None, "text", None, gone, None)
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = lambda: streams.keep_snapshot(stream(), str(tmp_path / "out"), str(tmp_path / "marks"), parts=8).awaitTermination(120)
    spark.createDataFrame([row(f"m{i}", "old", day(0)) for i in range(40)], schema).write.parquet(str(tmp_path / "in"))
    run()
    before = files(tmp_path / "out/rows")
    spark.createDataFrame([row("m1", "new", day(1)), row("m2", "bye", day(1), True)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    table = Parts(spark, str(tmp_path / "out"))
    assert {r["id"]: r["content"] for r in table.read().collect()} == {f"m{i}": "new" if i == 1 else "old" for i in range(40) if i != 2}
    assert len(files(tmp_path / "out/rows") - before) <= 2


# nested tags

NESTED = "tree string, tags array<struct<id: string, name: string, subtags: array<struct<id: string, name: string, subtags: array<struct<id: string, name: string>>>>>>, `_tag` int"


def plain_tags(tags):
    return None if tags is None else [(t["id"], t["name"], plain_tags(t["subtags"]) if "subtags" in t else "lowest") for t in tags]


def tag(i, name, *below, levels=0):
    fields = [F.lit(i).alias("id"), F.lit(name).alias("name")]
    return F.struct(*fields, F.array(*below).alias("subtags")) if below else F.struct(*fields)


def test_edits_of_nested_tags(spark):
    rows = [("t", [("a", "A", [("b", "B", [("c", "C"), ("a", "deep a")]), ("d", "D", None)]), ("e", "E", None), (None, "none", [])], 1), ("n", None, 2), ("o", [], 3)]
    df = spark.createDataFrame(rows, NESTED)
    got = lambda out: {r["tree"]: plain_tags(r["tags"]) for r in out.collect()}
    start = got(df)
    assert start["t"][2] == (None, "none", [])
    renamed = got(tag_trees.update(df, "tags", tag("b", "new b")))
    assert renamed["t"][0] == ("a", "A", [("b", "new b", None), ("d", "D", None)]) and renamed["t"][1:] == start["t"][1:] and renamed["n"] is None and renamed["o"] == []
    whole = got(tag_trees.update(df, "tags", tag("a", "new a", tag("x", "X"))))
    assert whole["t"][0] == ("a", "new a", [("x", "X", None)])  # nothing below it is looked at
    lowest = got(tag_trees.update(df, "tags", tag("c", "new c")))
    assert lowest["t"][0][2][0][2] == [("c", "new c", "lowest"), ("a", "deep a", "lowest")]
    gone = got(tag_trees.delete(df, "tags", "a"))
    assert [t[0] for t in gone["t"]] == ["e", None] and gone["n"] is None
    deep = got(tag_trees.delete(df, "tags", F.lit("c")))
    assert deep["t"][0][2][0] == ("b", "B", [("a", "deep a", "lowest")])
    more = got(tag_trees.add_below(df, "tags", "d", tag("y", "Y")))
    assert more["t"][0][2][1] == ("d", "D", [("y", "Y", "lowest")])
    assert got(tag_trees.add_below(df, "tags", "e", tag("y", "Y", tag("z", "Z"))))["t"][1] == ("e", "E", [("y", "Y", [("z", "Z", "lowest")])])
    added = got(tag_trees.add(df, "tags", tag("y", "Y")))
    assert [r[-1] for r in (added["t"], added["n"], added["o"])] == [("y", "Y", None)] * 3
    for out in (tag_trees.add_below(df, "tags", "c", tag("y", "Y")), tag_trees.add_below(df, "tags", "b", tag("y", "Y", tag("z", "Z")))):
        with pytest.raises(Exception, match="no room"):
            out.collect()
    assert got(tag_trees.update(df, "tags", tag("nobody", "N"))) == start == got(tag_trees.delete(df, "tags", "nobody"))
    with pytest.raises(ValueError):
        tag_trees.delete(df, "tree", "a")
    assert {(r["path"], r["name"]) for r in tag_trees.flattened(df, "tags", ["tree"]).filter("path IS NOT NULL").collect()} == {("a", "A"), ("a/b", "B"), ("a/b/c", "C"), ("a/b/a", "deep a"), ("a/d", "D"), ("e", "E")}


# metadata and orders


def test_parsed_metadata(spark):
    from loomline.functions import json

    rows = [("ok", '{"n":1.5,"s":"x \\"y\\"","b":true,"z":null,"o":{"k":[1,2]},"i":7}'), ("bad", '{"n":1'), ("none", None), ("list", "[1,2]"), ("text", '"x"'), ("empty", "{}"), ("twice", '{"n":1,"n":2}')]
    df = spark.createDataFrame(rows, "id string, metadata string").withColumn("a.b", F.lit(1))
    v = json.parsed(F.col("metadata"))
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", *[json.field(v, k).alias(k) for k in ("n", "s", "b", "z", "o", "none")], json.field(v, "i", "int").alias("i"), json.field(v, "s", "int").alias("wrong")).collect()}
    assert got["ok"] == ("1.5", 'x "y"', "true", None, '{"k":[1,2]}', None, 7, None) and all(set(got[i]) == {None} for i, _ in rows[1:])
    assert {(r["id"], r["key"], r["value"]) for r in json.entries(df, "metadata").collect()} == {("ok", "n", "1.5"), ("ok", "s", 'x "y"'), ("ok", "b", "true"), ("ok", "z", None), ("ok", "o", '{"k":[1,2]}'), ("ok", "i", "7")}
    kept = {r["id"]: r["k"] for r in df.select("id", json.kept_values(v, ["i", "b", "z", "s"]).alias("k")).collect()}
    assert kept["ok"] == '{"i":7,"b":true,"s":"x \\"y\\""}' and set(kept.values()) == {kept["ok"], None}


def test_tasks_parse_their_metadata_once(spark):
    m = spark.createDataFrame([("m", "c", T0, None, "l", None, None, None, None, "task", '{"completed":true,"priority":"low","completedAt":"2024-03-02T00:00:00Z"}', None, None)], model.MESSAGES)
    rows = tasks.rows(m, made_lines(spark, {"l": None}))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parse_json") + rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
    r = rows.first()
    assert (r["completed"], r["priority"], r["completed_at"]) == (True, "low", dt.datetime(2024, 3, 2))


def test_order_in_the_collation(spark):
    wanted = ["1", "2", "a", "A", "b", "あ", "ア", "い", "か", "が", "き", "亜", "一", "漢", "日", "本"]
    rows = [(f"t{n}", c) for n, c in enumerate(wanted)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, content string")
    assert [r["content"] for r in tasks.with_position(df, "content").orderBy("position").collect()] == wanted
    turned = wanted[::-1]  # kana of both kinds are alike in this order, so that the id decides
    turned[9:11] = ["あ", "ア"]
    assert [r["content"] for r in tasks.with_position(df, "content", descending=True).orderBy("position").collect()] == turned
    assert [r["content"] for r in tasks.with_position(df, "content", collation=None).orderBy("position").collect()] == sorted(wanted)


def test_chunks_of_a_copied_document_join_to_it(spark):
    rows = [(f"m{n}", f"text {n}" if n % 5 else "", T0 + dt.timedelta(hours=n), "a" if n % 3 else "b", "text", None) for n in range(40)]
    df = spark.createDataFrame(rows, "id string, content string, timestamp timestamp, line_id string, type string, metadata string")
    heading = F.concat(F.lit("of "), F.col("line_id"))
    whole = {r["line_id"]: r["document"] for r in timeline.copied_document(df, heading).collect()}
    for size in (1, 3, 100):
        chunks = sorted((r["line_id"], r["chunk"], r["document"]) for r in timeline.copied_chunks(df, heading, size).collect())
        assert {line: "\n".join(t for i, _, t in chunks if i == line) for line in whole} == whole
        assert [c for i, c, _ in chunks if i == "a"] == list(range(len([c for i, c, _ in chunks if i == "a"])))


def test_csv_import_still_reads_folders(spark, tmp_path):
    (tmp_path / "tags.csv").mkdir()
    (tmp_path / "tags.csv/part-0.csv").write_text('id,name,color,group_id\na,"two\nlines",,g\n', newline="")
    assert [tuple(r) for r in csv.import_(spark, str(tmp_path)).tags.collect()] == [("a", "two\nlines", None, "g")]
    assert sync.upsert(spark.createDataFrame([("a", 1)], "id string, n int"), spark.createDataFrame([("a", 2)], "id string, n int")).first()["n"] == 2
