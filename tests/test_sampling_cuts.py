"""Exact sampling cuts: one read of the wide rows, repeated keys, small and
empty quotas."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigfolio.operators import training as TR


def _hash(key, seed=42):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def _wide(spark, tmp_path, keys, labels=None):
    rows = [(k, (labels or ["a"] * len(keys))[i], f"text {i} " * 50) for i, k in enumerate(keys)]
    path = str(tmp_path / "wide")
    spark.createDataFrame(rows, "id long, label string, text string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def _text_rows_read(df):
    """Rows that scans of the text column gave, in the plan as it ran."""
    df.collect()
    seen, rows = set(), 0
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        if name == "ReusedExchangeExec":
            continue
        if name == "FileSourceScanExec" and node.id() not in seen:
            seen.add(node.id())
            if "text" in list(node.requiredSchema().fieldNames()):
                rows += node.metrics().apply("numOutputRows").value()
        for children in (node.children(), node.subqueries()):
            nodes += [children.apply(k) for k in range(children.size())]
    return rows


def test_text_is_scanned_once(spark, tmp_path):
    df = _wide(spark, tmp_path, list(range(3000)), [random.Random(k).choice("abc") for k in range(3000)])
    sample = TR.sample_n(df, 500, ["id"])
    assert _text_rows_read(sample) == 3000
    assert sorted(r.id for r in sample.collect()) == sorted(sorted(range(3000), key=_hash)[:500])
    split = TR.stratified_split(df, "label", 0.5, ["id"])
    assert _text_rows_read(split) == 3000
    rows = split.collect()
    assert len(rows) == 3000
    for label in "abc":
        train = {r.id for r in rows if r.label == label and r.split == "train"}
        own = sorted((r.id for r in rows if r.label == label), key=_hash)
        assert train == set(own[:len(train)])
    assert sum(r.split == "train" for r in rows) == 1500


@pytest.mark.parametrize("n", [1, 7, 150, 399, 400, 1000])
def test_repeated_keys(spark, tmp_path, n):
    """One key holds a third of the rows; the sample has n rows all the same."""
    keys = [k % 20 if k % 3 else 5 for k in range(400)]
    got = Counter(r.id for r in TR.sample_n(_wide(spark, tmp_path, keys), n, ["id"]).collect())
    have, want, left = Counter(keys), Counter(), n
    for k in sorted(have, key=_hash):
        want[k] = min(have[k], left)
        left -= want[k]
    assert got == +want


def test_split_of_repeated_keys_and_tiny_classes(spark, tmp_path):
    keys, labels = [k // 7 for k in range(210)] + [900], ["a"] * 100 + ["b"] * 100 + [None] * 10 + ["lone"]
    rows = TR.stratified_split(_wide(spark, tmp_path, keys, labels), "label", 0.5, ["id"]).collect()
    assert len(rows) == 211
    train = Counter(r.label for r in rows if r.split == "train")
    assert train["a"] == train["b"] == 50 and train["lone"] == 1 and train[None] in (5, 6)


def test_no_quota_and_no_rows(spark, tmp_path):
    df = _wide(spark, tmp_path, list(range(50)), ["a"] * 30 + ["b"] * 20).withColumn("h", TR.sample_hash(["id"], 1))
    quota = spark.createDataFrame([("a", 0), ("b", 3)], "label string, quota long")
    got = TR.select_smallest(df, quota, "h", ["label"], flag="in").collect()
    assert Counter((r.label, r["in"]) for r in got) == {("a", False): 30, ("b", False): 17, ("b", True): 3}
    assert TR.select_smallest(df.limit(0), 5, "h").count() == 0
