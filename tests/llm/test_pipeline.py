"""The pipeline against a plain version of its stages, and on tables that are empty or odd."""

import importlib.util

import pytest
from pyspark.sql import functions as F
from test_operators import check_packing, plain_components, plain_fingerprint, plain_quality

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline


def test_stages_keep_what_plain_versions_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = docs.cache()
        left = {r["doc_id"] for r in docs.collect()}
        if name == "language ID":
            wanted = {i for i, t in kept.items() if any(c.isalpha() for c in t or "")}
        elif name == "quality classifier":
            wanted = {i for i, p in plain_quality(kept, labels).items() if p >= 0.5}
        elif name == "exact dedup":
            wanted = set({t: i for i, t in sorted(kept.items())}.values())
        else:
            ids = sorted(kept)
            classes = plain_components([plain_fingerprint(kept[i]) for i in ids])
            wanted = {min(i for i, c in zip(ids, classes, strict=True) if c == k) for k in set(classes)}
        assert left == wanted, name
        kept = {i: kept[i] for i in left}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in out} == set(kept)
    least = -(-sum(r["length"] for r in out) // 4096)
    assert check_packing(out, 4096) <= least + 1


def test_a_rejected_row_goes_without_the_others_of_its_id(spark, sf_dir):
    docs = spark.createDataFrame([(1, "123", "en", "a"), (1, "the house and the garden", "en", "a"), (None, "456", None, None), (None, "the man and the dog", "en", "a")], "doc_id long, text string, lang string, source string")
    left = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert left.columns == docs.columns and sorted(r["text"] for r in left.collect()) == ["the house and the garden", "the man and the dog"]


def test_a_poor_text_goes_without_the_others_of_its_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") >= 100, F.lit(None)).otherwise(F.col("doc_id")))
    texts = {n: (r["doc_id"], r["text"]) for n, r in enumerate(docs.collect())}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    # rows under their own numbers; those without an id have no label
    of = {i: n for n, (i, _) in texts.items() if i is not None}
    scores = plain_quality({i: t for i, t in texts.values() if i is not None} | {f"row {n}": t for n, (i, t) in texts.items() if i is None}, {i: y for i, y in labels.items() if i in of})
    good = sorted(texts[n][1] or "" for n in texts if scores[texts[n][0] if texts[n][0] is not None else f"row {n}"] >= 0.5)
    left = corpus_pipeline.good_quality(spark, docs, sf_dir)
    assert left.columns == docs.columns and sorted(r["text"] or "" for r in left.collect()) == good


def test_stages_take_any_columns_and_tell_rows_of_one_id_apart(spark, sf_dir):
    long = lambda n, end="": " ".join(f"{n}word{i}" for i in range(2_000)) + end
    rows = [(5, long("a"), "en"), (5, long("b"), "en"), (5, long("c"), "en"), (3, long("b"), "en"), (9, long("a", " x"), "en"), (9, long("b"), "en")]
    docs = spark.createDataFrame([(*r, "h", n, n, "x") for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, _file int, _best int, `a.b` string")
    for stage, wanted in ((corpus_pipeline.known_language, range(6)), (corpus_pipeline.no_exact_copies, (0, 2, 4, 5)), (corpus_pipeline.no_near_copies, (0, 2, 3))):
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns and sorted(r["_file"] for r in left.collect()) == sorted(wanted), stage


def test_pipeline_of_odd_and_of_no_documents(spark, sf_dir, tmp_path):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "a few words without an id", "en", None, 5), (3, "one two three four five six", "en", "a", 6), (3, "one two three four five six", "en", "a", 6)]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, frame in (("odd", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), ("none", spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"))):
        frame.withColumn("_id", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} == ({None, 3} if name == "odd" else set()) and len(out) == (2 if name == "odd" else 0)
