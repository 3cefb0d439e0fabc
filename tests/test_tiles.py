"""Work in tiles: covariance of many tickers, similarity to many categories,
bar frames over many batches, against plain numpy."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigfolio.operators import market as M
from sigfolio.operators import portfolio as P
from sigfolio.operators import similarity as S


def _plain_cov(x):
    """Pairwise sample covariance x 252 of columns with gaps (NaN)."""
    n = x.shape[1]
    out = np.full((n, n), np.nan)
    for i in range(n):
        for j in range(n):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if ok.sum() > 1:
                a, b = x[ok, i], x[ok, j]
                out[i, j] = ((a - a.mean()) * (b - b.mean())).sum() / (ok.sum() - 1) * 252
    return out


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_covariance_with_gaps(spark, monkeypatch, blocks):
    monkeypatch.setattr(P, "TILE_DAYS", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(1000, 1, (50, 13))
    x[rng.random(x.shape) < 0.4] = np.nan
    x[:, 3] = np.nan          # a ticker without any return
    x[:49, 4] = np.nan        # and one with a single one
    day = [dt.date(2020, 1, 1) + dt.timedelta(days=3 * k) for k in range(50)]
    names = [f"T{k}" for k in range(12)] + ["é"]
    rows = [(g, names[j], day[i], None if np.isnan(x[i, j]) else float(x[i, j]) * g) for i in range(50) for j in range(13) for g in (1, 2)]
    df = spark.createDataFrame(rows, "g int, ticker string, date date, ret double")
    got = {(r.g, r.ticker_i, r.ticker_j): r.cov for r in P.annual_covariance(df, group=["g"], blocks=blocks).collect()}
    want = _plain_cov(x)
    known = [j for j in range(13) if j != 3]
    assert set(got) == {(g, min(names[i], names[j]), max(names[i], names[j])) for g in (1, 2) for i in known for j in known}
    for (g, a, b), c in got.items():
        w = want[names.index(a), names.index(b)] * g * g
        assert (c is None and np.isnan(w)) or abs(c - w) < 1e-6


def test_covariance_of_two_thousand_tickers(spark):
    days, n = 1000, 2000
    rows = (spark.range(days * n, numPartitions=8)
            .select(F.concat(F.lit("T"), (F.col("id") % n).cast("string")).alias("ticker"),
                    F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / n).cast("int")).alias("date"),
                    F.when(F.xxhash64("id") % 50 != 0, F.sin(F.col("id") * 0.37)).alias("ret")))
    began = time.time()
    got = P.annual_covariance(rows).agg(F.count("cov").alias("n"), F.countDistinct("ticker_i").alias("t")).first()
    assert (got.n, got.t) == (n * (n + 1) // 2, n)
    assert time.time() - began < 300  # less than a minute on four free cores


def _plain_bars(prices, requests, n, inclusive):
    out = {}
    for t, at in requests:
        bars = sorted((d, p) for k, d, p in prices if k == t and (d <= at if inclusive else d < at))[-n:]
        if bars:
            out[t, at] = bars
    return out


@pytest.mark.parametrize("inclusive", [False, True])
def test_bar_frames_over_batches(spark, inclusive):
    rng = random.Random(2)
    day = [dt.date(2021, 1, 1) + dt.timedelta(days=k) for k in range(300)]
    prices = [(t, d, round(rng.random(), 6)) for t, share in (("hot", 1.0), ("b", 0.1), ("c", 0.02), (None, 0.1)) for d in day if rng.random() < share]
    requests = [(t, d) for t in ("hot", "b", "c", "none", None) for d in rng.sample(day, 60)] * 2
    p = spark.createDataFrame(prices, "ticker string, date date, price double")
    r = spark.createDataFrame(requests, "ticker string, rebalance_date date")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(x.ticker, x.rebalance_date): [(b.date, b.price) for b in x.bars] for x in M.bar_slices(p, r, 5, inclusive=inclusive).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _plain_bars(prices, requests, 5, inclusive)


def _cos(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return 0.0
    a, b = np.array(a, float), np.array(b, float)
    norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return round(float((a * b).sum() / norm), 9) + 0.0 if norm > 0 else 0.0


@pytest.mark.parametrize("blocks", [None, 1, 5])
def test_top_categories_of_odd_vectors(spark, monkeypatch, blocks):
    """Ties, zero and NULL vectors, NULL parts, several lengths, equal keys."""
    monkeypatch.setattr(S, "SCORES", 50)
    rng = random.Random(4)
    vec = lambda: rng.choice([None, [0.0, 0.0], [1.0, None], [1.0], [], *([[float(rng.randint(-2, 2)) for _ in range(3)]] * 6)])
    texts = [(k % 40, vec()) for k in range(60)]
    cats = [(k, f"c{k}", vec()) for k in range(25)] + [(100 + k, f"d{k}", [1.0, 1.0, 0.0]) for k in range(8)]
    t = spark.createDataFrame(texts, "vec_id long, embedding array<double>")
    c = spark.createDataFrame(cats, "cat_idx long, category string, vec array<double>")
    vec_of = {n: v for _, n, v in cats}
    for k in (1, 4, 50):
        got = [(r.vec_id, r.rank, r.category, round(r.probability, 9) + 0.0) for r in S.topk_categories(t, c, k, blocks=blocks).collect()]
        want = [(key, rank, s) for key, v in texts for rank, s in enumerate(sorted((_cos(v, w) for _, _, w in cats), reverse=True)[:k], 1)]
        assert sorted((key, rank, s) for key, rank, _, s in got) == sorted(want)
        own = {}
        for key, v in texts:
            own.setdefault(key, []).append(v)
        assert all(any(_cos(v, vec_of[n]) == s for v in own[key]) for key, _, n, s in got)
    # equal vectors keep the order of the categories
    for key, v in [(1000, [1.0, 1.0, 0.0]), (1001, [0.3, 0.5, 7.0])]:
        one = spark.createDataFrame([(key, v)], "vec_id long, embedding array<double>")
        names = [r.category for r in S.topk_categories(one, c.filter("cat_idx >= 100"), 8, blocks=blocks).orderBy("rank").collect()]
        assert names == [f"d{k}" for k in range(8)]
    every = S.cross_similarity(t, c, blocks=blocks)
    assert every.count() == len(texts) * len(cats)


def test_very_many_categories(spark, monkeypatch):
    """The driver and the plan stay as small as with few."""
    monkeypatch.setattr(S, "TILE_CATEGORIES", 20_000)
    n = 100_000
    c = spark.range(n).select(F.col("id").alias("cat_idx"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"),
                              F.array(*(F.sin(F.col("id") * (k + 1)).cast("float") for k in range(8))).alias("vec"))
    t = c.filter("cat_idx % 9973 = 5").select(F.col("cat_idx").alias("vec_id"), F.col("vec").alias("embedding"))
    top = S.topk_categories(t, c, 2)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Subquery" not in plan and "scalar-subquery" not in plan
    rows = top.collect()
    assert len(rows) == 2 * t.count()
    assert all(r.category == f"c{r.vec_id}" and abs(r.probability - 1) < 1e-6 for r in rows if r.rank == 1)
