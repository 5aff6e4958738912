"""The exchanges of the tree merge of exact deduplication."""

import re

import pytest
from pyspark.sql import functions as F

from loomline.llm import exact_dedup
from loomline.llm.common import written


@pytest.mark.parametrize(("runs", "rounds"), [(2, 1), (4, 1), (5, 2), (16, 2), (17, 3)])
def test_a_round_is_one_exchange_by_run(spark, runs, rounds):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("text"))
    rows = written(exact_dedup.digest_rows(df, "doc_id", "text"), "digests")
    merged = exact_dedup.merged(rows, "max", runs)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    by_run = re.findall(r"Exchange shufflepartitionidpassthrough\(direct_shuffle_partition_id\(_run#\d+\), (\d+)\)", plan)
    assert by_run == [str(exact_dedup.FAN_IN**rounds)] * rounds  # four partners are two binomial steps at once: half as many rounds as bits
    below = [re.sub(r"[ :+*()\d-]", "", line) for line in plan.splitlines()]
    for n, line in enumerate(plan.splitlines()):
        if "Aggregate" in line and "_digest" in line and "partial" not in line:
            following = next(x for x in below[n + 1 :] if x.startswith(("Exchange", "Sort[", "HashAggregate", "SortAggregate", "ObjectHashAggregate")))
            assert not following.startswith("Exchangehashpartitioning")
    found = {r["_id"]: (r["_keep"]["wish"] if r["_keep"] else r["_id"], r["_size"]) for r in merged.collect()}
    assert found == {i: (max(j for j in range(300) if j % 40 == i % 40), len(range(i % 40, 300, 40))) for i in range(300)}
