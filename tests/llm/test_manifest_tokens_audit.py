"""The Merkle manifest, the token files and the filter audit against plain versions written out here."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from loomline.llm import filter_audit, merkle, token_files
from loomline.llm.common import new_path
from loomline.llm.tokens import public_tokenizer

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
PLACE = public_tokenizer("word_bpe_49k.json")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# the manifest


def plain_tree(nodes, fan_out):
    """For each node its siblings as (left, right) level by level, and the top."""
    ways, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for way, i in zip(ways, at, strict=True):
            start = i - i % fan_out
            way.append(("".join(level[start:i]), "".join(level[i + 1 : start + fan_out])))
        level = [h(*level[i : i + fan_out]) for i in range(0, len(level), fan_out)]
        at = [i // fan_out for i in at]
    return ways, level[0]


def plain_manifest(rows, fan_out):
    """A bag of (id, source, leaf, proof, subroot, root)."""
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r), r[0]))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    below = [plain_tree([x[1] for x in sorted(by_source[s])], fan_out) for s in sources]
    if not below:
        return Counter()
    above, root = plain_tree([top for _, top in below], fan_out)
    return Counter(
        (x[2], s, x[1], tuple([*way, *above[n]]), top, root) for n, (s, (ways, top)) in enumerate(zip(sources, below, strict=True)) for x, way in zip(sorted(by_source[s]), ways, strict=True)
    )


def odd_documents(n, seed):
    pick = random.Random(seed)
    rows = [(pick.choice([None, *range(n)]), pick.choice([None, "", "b", "ä", "a", "hot", "hot", "hot", "hot"]), pick.choice([None, "en"]), pick.choice([None, 5, -3]), pick.choice([None, "", "a\nb", "日本語\n", "x" * 5000, f"text {n}"])) for _ in range(n)]
    return [*rows, *rows[:7], *rows[:3]]


@pytest.mark.parametrize(("fan_out", "levels", "most"), [(3, 6, 20_000), (3, 1, 2), (2, 2, 5), (4, 1, 3)])
@pytest.mark.parametrize("n", [0, 1, 2, 61])
def test_manifest_equals_a_plain_one(spark, fan_out, levels, most, n):
    if n in (1, 2) and most > 100:
        rows = [(4, "only", None, 1, "t"), (3, None, "en", 2, None)][:n]
    else:
        rows = odd_documents(n, n)[: 0 if n == 0 else None]
    df = spark.createDataFrame(rows, DOCS).withColumn("_group", F.lit("clash")).withColumn("proof", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(3)
    found = merkle.manifest(df, forest=merkle.Forest(fan_out, levels, most)).collect()
    got = Counter((r["doc_id"], r["source"], r["leaf"], tuple((s["left"], s["right"]) for s in r["proof"]), r["subroot"], r["root"]) for r in found)
    assert got == plain_manifest(rows, fan_out)


def test_a_changed_row_does_not_lead_to_the_root(spark):
    rows = odd_documents(30, 3)
    df = spark.createDataFrame(rows, DOCS)
    changed = merkle.leaf_of(*[F.concat(F.col("text"), F.lit(" ")) if c == "text" else F.col(c) for c in merkle.FIELDS])
    made = merkle.manifest(df, more={"other": changed})
    seen = made.select("leaf", "other", (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("good"), (merkle.folded(F.col("other"), F.col("proof")) == F.col("root")).alias("bad")).collect()
    assert all(r["good"] for r in seen) and all(r["bad"] == (r["leaf"] == r["other"]) for r in seen) and any(r["bad"] is False for r in seen)


def test_null_and_empty_fields_and_their_borders_differ(spark):
    rows = [(1, "s", None, 1, ""), (1, "s", "", 1, None), (1, "s", "a", 1, "b"), (1, "s", "a1:b", 1, ""), (11, "s", "", None, "")]
    assert len({r["leaf"] for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()}) == len(rows)


# token files


def plain_ids(texts, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PLACE)
    return [[*t.encode(x or "", add_special_tokens=False).ids, *([] if end is None else [end])] for x in texts]


WORDS = "the quick Brown fox, 12 lines; überall <|endoftext|> naïve don't 日本".split()


def some_texts(n, seed):
    pick = random.Random(seed)
    return [pick.choice([None, "", " \n"]) if pick.random() < 0.2 else " ".join(pick.choice(WORDS) for _ in range(pick.choice([1, 7, 400]))) for _ in range(n)]


@pytest.mark.parametrize(("length", "batch", "end"), [(2048, 64, 1), (7, 3, 1), (1, 1, 1), (64, 2, None)])
def test_token_files_round_trip(spark, length, batch, end):
    texts = some_texts(40, length)
    rows = [(i * 3 % 41, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("_text", F.lit(0)).repartition(5)
    path = new_path(spark, "test-tokens")
    shards = token_files.write_tokens(df, path, PLACE, end=end, length=length, batch=batch).orderBy("number").collect()

    ordered = sorted(rows)
    wanted = plain_ids([r[1] for r in ordered], end)
    starts = np.cumsum([0, *map(len, wanted)])
    found = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["id"])
    assert [r["id"] for r in found] == [r[0] for r in ordered]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in found] == wanted
    digests = {r["id"]: r["ids_crc32"] for r in token_files.read_documents(spark, path, digest=True).collect()}
    assert digests == {r["id"]: zlib.crc32(r["ids"]) for r in found} and [r["start"] for r in found] == starts[:-1].tolist() and [r["n_tokens"] for r in found] == [len(x) for x in wanted]

    whole = [i for x in wanted for i in x]
    system, folder = fs.FileSystem.from_uri(path)
    for shard in shards:
        file = token_files.TokenFile(system, f"{folder}/{shard['name']}.ids")
        assert shard["sequences"] == math.ceil(shard["tokens"] / length)
        pieces = [file.sequence(i) for i in range(shard["sequences"])]
        for ids, mask in pieces:
            assert ids.dtype == np.uint16 and len(ids) == len(mask) == length and not ids.flags.owndata and not ids.flags.writeable
        ids, mask = (np.concatenate(x) for x in zip(*((i, np.array(m)) for i, m in pieces), strict=True)) if pieces else (np.zeros(0, int),) * 2
        part = whole[shard["start"] : shard["start"] + shard["tokens"]]
        assert ids[: len(part)].tolist() == part and mask.astype(int).tolist() == [1] * len(part) + [0] * (len(mask) - len(part)) and not ids[len(part) :].any()
        for wrong in (-1, shard["sequences"], shard["sequences"] + 1000):
            with pytest.raises(IndexError):
                file.sequence(wrong)
        again = file.sequence(0)[0].tolist() if shard["sequences"] else []  # back after the last
        assert again == ids[: len(again)].tolist()
    assert sum(s["documents"] for s in shards) == len(rows) and sum(s["tokens"] for s in shards) == len(whole)
    read = token_files.read_sequences(spark, path).orderBy("shard", "sequence").collect()
    assert [i for r in read for i, m in zip(r["ids"], r["mask"], strict=True) if m] == whole


def test_token_files_of_odd_tables(spark):
    path = new_path(spark, "test-tokens")
    rows = [(None, "b"), (None, "a"), (2, "x"), (2, "x"), (2, "y"), (-1, None)]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PLACE)
    found = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in found] == [None, None, -1, 2, 2, 2]
    assert Counter((r["id"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in found) == Counter((i, tuple(x)) for (i, _), x in zip(rows, plain_ids([t for _, t in rows]), strict=True))
    with pytest.raises(FileExistsError):
        token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PLACE)
    empty = new_path(spark, "test-tokens")
    assert token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, PLACE).count() == 0
    assert token_files.read_documents(spark, empty).count() == 0 == token_files.read_sequences(spark, empty).count()
    system, folder = fs.FileSystem.from_uri(path)
    listed = {r["name"] for r in spark.read.parquet(f"{path}/shards").collect()}
    assert {x.base_name.split(".")[0] for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file} == listed


def test_an_id_that_does_not_fit_is_an_error(tmp_path):
    shard = token_files.ShardWriter(fs.LocalFileSystem(), str(tmp_path / "s"), pa.int64(), 4, 2, 2)
    with pytest.raises(ValueError):
        shard.add(1, np.array([70_000]))


def test_op12_on_the_test_table(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    wanted, start = [], 0
    for r, ids in zip(rows, plain_ids([r["text"] for r in rows]), strict=True):
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.query(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == wanted


# the audit

TEXTS = st.text(st.sampled_from("aB cC\t\n\x0b\x0c\r\x1c\x85 　é日😀#%&*|$-"), max_size=60)


def plain_counts(text):
    words = text.encode().split()
    return {"words": len(words), "distinct": len(set(words)), "capitals": sum("A" <= c <= "Z" for c in text), "signs": sum(c in "#$%&*|" for c in text), "code_points": len(text)}


def scanned(texts):
    a = pa.array(texts, pa.string())
    _, offsets, data = a.buffers()
    return filter_audit.scan(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int32)[: len(texts) + 1])


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8))
def test_scan_equals_plain_counts(texts):
    found = scanned(texts)
    assert [{k: int(v[i]) for k, v in found.items()} for i in range(len(texts))] == [plain_counts(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4), st.integers(1, 20))
def test_a_large_document_in_pieces(texts, piece):
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    assert {k: int(v[0]) for k, v in filter_audit.scan_large(data, piece).items()} == plain_counts(" ".join(texts))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    pick = random.Random(1)
    texts = [" ".join("".join(pick.choice("ab") for _ in range(pick.choice([1, 2, 8, 9, 16, 17, 40, 100]))) for _ in range(60)) for _ in range(20)]
    wanted = [plain_counts(t)["distinct"] for t in texts]
    assert scanned(texts)["distinct"].tolist() == wanted
    monkeypatch.setattr(filter_audit, "_MIX", [np.uint64(0)] * 3)  # all hashes are zero
    assert scanned(texts)["distinct"].tolist() == wanted


def test_failures_of_sliced_and_large_arrays():
    texts = ["", "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + "|", "x" * 2_000_000, "ä " * 700_000]
    plain = []
    for t in texts:
        c = plain_counts(t)
        plain.append((c["words"] < 50) + 2 * (100 * c["distinct"] < 65 * c["words"]) + 4 * (100 * c["capitals"] > 5 * c["code_points"]) + 8 * (c["signs"] > 0))
    for kind in (pa.string(), pa.large_string()):
        assert filter_audit.failures(pa.array(texts, kind)).tolist() == plain
        assert filter_audit.failures(pa.array(["zz", *texts, "zz"], kind).slice(1, len(texts))).tolist() == plain
        assert filter_audit.failures(pa.array([], kind)).tolist() == []


def plain_audit(rows, labels):
    """rows: (id, text, source); labels: (id, quality, toxic)."""
    good, toxic = ({i for i, q, t in labels if (q, t)[n] == 1 and i is not None} for n in (0, 1))
    docs = []
    for i, text, source in rows:
        c = plain_counts(text or "")
        fails = {x for x, f in zip("ABCD", (c["words"] < 50, 100 * c["distinct"] < 65 * c["words"], 100 * c["capitals"] > 5 * c["code_points"], c["signs"] > 0), strict=True) if f}
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows):
            fails.add("E")
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                out[part, "".join(order), step] = [len(left) - len(gone), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[f] += len(gone)
                left = [d for d in left if f not in d[1]]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_a_plain_one(spark):
    pick = random.Random(5)
    kinds = [None, "", "few words", "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " #", "A # " * 40]
    rows = [(pick.choice([None, *range(40)]), pick.choice(kinds), pick.choice([None, "", "s", "t"])) for _ in range(120)]
    rows += rows[:10]
    labels = [(pick.choice([None, *range(50)]), pick.choice([None, 0, 1]), pick.choice([None, 0, 1])) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_mask": F.lit("clash"), "_key": F.lit(1), "a.b": F.lit(1)}).repartition(4)
    found = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found}
    assert len(found) == len(got) == 3 * 600 and got == plain_audit(rows, labels)


def test_audit_of_an_empty_table(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
