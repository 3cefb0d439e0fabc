"""Weak supervision: held-out accuracy, label model, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs_frame
from sigfolio.llm import toxicity as tx


@pytest.fixture(scope="module")
def tables(spark):
    base = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return tx.fit(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    got = (tx.score(docs, model).join(labels, "doc_id").filter(tx.fold() == 1)
           .select("toxic", (F.col("score") >= tx.THRESHOLD).alias("p")).collect())
    toxic, clean = [r["p"] for r in got if r["toxic"] == 1], [r["p"] for r in got if r["toxic"] == 0]
    assert np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.01


def test_fold_is_crc32_of_the_id(spark):
    got = {r["doc_id"]: r["f"] for r in spark.range(200).toDF("doc_id").select("doc_id", tx.fold().alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(200)}


def test_held_out_labels_change_nothing(tables, model):
    docs, labels = tables
    other = tx.fit(docs, labels.withColumn("toxic", F.when(tx.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert other.lexicon.index == model.lexicon.index and np.allclose(other.weight, model.weight)


def test_label_model_finds_good_voters_and_discounts_twins():
    rng = np.random.default_rng(0)
    y = rng.random(5000) < 0.2
    fires = lambda a, b: np.where(y, rng.random(5000) < a, rng.random(5000) < b)
    one = fires(0.8, 0.02)
    votes = np.stack([one, one, fires(0.7, 0.05), fires(0.3, 0.3), *[fires(0.01, 0.01) for _ in tx.PATTERNS], fires(0.95, 0.05)], axis=1).astype(float)
    distinct, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = tx.LabelModel().fit(distinct, counts)
    assert m.accuracy[0] > 0.85 > m.accuracy[3]
    assert m.correlation[0, 1] > 0.95 and m.discount[0] < 0.6
    assert np.mean((m.posterior(distinct)[of.ravel()] > 0.5) == y) > 0.95


def test_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "you stupid idiot, pathetic worthless scum"), (4, "a clean text"), (4, "a clean text"), (5, "idiot " * 30000)]
    got = {(r["doc_id"], k): r["score"] for k, r in enumerate(tx.score(docs_frame(spark, rows), model).collect())}
    assert len(got) == 6 and all(0 <= s <= 1 for s in got.values())
    by = {d: s for (d, _), s in got.items()}
    assert by[1] == by[2] < 0.5 and by[4] < 0.5 and by[None] >= tx.THRESHOLD
    assert tx.score(docs_frame(spark, []), model).count() == 0
    whole = tx.score_rows(docs_frame(spark, rows), model, "toxic_score")
    assert whole.columns == [*docs_frame(spark, rows).columns, "toxic_score"]


def test_no_usable_labels(spark):
    docs = docs_frame(spark, [(1, "a"), (2, "b")])
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    m = tx.fit(docs, labels)
    assert all(r["score"] < 0.5 for r in tx.score(docs, m).collect())


def test_scores_are_those_of_the_written_out_model(tables, model):
    """Every document of the table, its terms and votes worked out plainly."""
    import math
    import re
    docs = tables[0].filter("doc_id % 7 = 0").collect()
    got = {r["doc_id"]: r["score"] for r in tx.score(tables[0], model).collect()}
    n, place = len(model.lexicon.index), {v: k for k, v in enumerate(model.lexicon.voters)}
    for r in docs:
        text = r["text"] or ""
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        found = {f"w:{w}" for w in words} | {f"{k}:{w[:k]}" for k in (4, 5, 6, 7) for w in words if len(w) > k}
        for k, letter in ((5, "b"), (7, "c")):
            begun = [w[:k] for w in words if len(w) > k]
            found |= {f"{letter}:{b}" for b, count in Counter(begun).items() if count > 1}
        known = [t for t in found if t in model.lexicon.index]
        parts = text.split()
        upper, top = sum("A" <= c <= "Z" for c in text), max(Counter(parts).values(), default=0)
        fires = {"shouting": upper >= 20 and upper > 0.5 * len(text), "exclaiming": "!!" in text,
                 "censored": re.search(r"\b[^\W\d_]+[*#@$%]{2,}[^\W\d_]*", text) is not None, "repeating": len(parts) >= 20 and top > 0.3 * len(parts)}
        voters = {model.lexicon.voter[t] for t in known} | {place[p] for p, on in fires.items() if on}
        z = model.bias + sum(model.weight[model.lexicon.index[t]] for t in known) + sum(model.weight[n + v] for v in voters)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9
