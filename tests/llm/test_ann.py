"""Learned-partition search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigfolio.llm import ann

SCHEMA = "vec_id long, embedding array<float>, part int, v string, rank string, score string, i int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", 2) for i, v in rows], SCHEMA)


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def brute(rows, k, is_query=lambda i: i % 20 == 0):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {i: sorted(((j, float((w * v).sum())) for j, w in ok if j != i and len(w) == len(v)), key=lambda x: (-x[1], x[0]))[:k]
            for i, v in ok if is_query(i)}


def agree(got, want, tol=1e-12):
    assert set(got) == {q for q in want if want[q]}
    for q, rows in got.items():
        assert [i for i, _ in rows] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in rows], [s for _, s in want[q]], atol=tol)


def test_all_probes_equal_brute_force_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(1100 + i, rows[41][1]) for i in range(30)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] * 8), (2080, [float("inf")] + [1.0] * 7),
             (2100, [None] + [1.0] * 7), (None, rows[0][1]), (2120, [1.0, 2.0]), (2121, [2.0, 1.0]), (2140, [1.0, 0.0, 0.0])]
    df = frame(spark, rows + rows[:5])  # repeated rows
    got = result(ann.search(df, F.col("vec_id") % 20 == 0, k=20, probes=ann.PARTITIONS, block=64))
    agree(got, brute(rows, 20))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_with_production_parameters(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = result(ann.search(df, F.col("vec_id") % 20 == 0))
    want = brute([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    truth = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - truth[q, i]) < 1e-12 for q in got for i, s in got[q] if (q, i) in truth)


def test_nothing_to_search(spark):
    for rows in ([], [(20, [1.0, 2.0])], [(1, [1.0]), (2, [2.0])], [(20, None), (3, [1.0])]):
        assert ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    part = ann.balanced_cut(x, ann.neighbour_graph(x, 10), 8, rng)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.05 * 500 / 8)


def test_many_vectors_tie_at_the_last_rank():
    rng = np.random.default_rng(4)
    x = np.zeros((600, 64))
    for r in x:  # different vectors of 0 and 1, nearly all with the first sign
        r[0] = 1
        r[rng.choice(np.arange(1, 64), 3, replace=False)] = 1
    ids = rng.permutation(600) + 1
    q = np.zeros((1, 64))
    q[0, 0] = 1
    (places, scores), = ann.best_of(q @ x.T, x, q, ids, 5)
    assert ids[places].tolist() == [1, 2, 3, 4, 5] and scores.tolist() == [1.0] * 5
    s = q @ x.T
    s[0, 3:] = -np.inf
    (places, _), = ann.best_of(s, x, q, ids, 5)
    assert sorted(places.tolist()) == [0, 1, 2]
