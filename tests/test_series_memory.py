"""Price series in pieces: what a task holds does not grow with the history
or the input, and the results are those of plain versions."""

import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sigfolio.operators import market as M
from sigfolio.operators.portfolio import complete_returns


def _plain_returns(dates, prices):
    wide = pd.DataFrame([(d, k, p) for k, (ds, ps) in enumerate(zip(dates, prices)) for d, p in zip(ds, ps)],
                        columns=["date", "name", "price"]).groupby(["date", "name"], dropna=False)["price"].mean().unstack().ffill()
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = wide.to_numpy()[1:] / wide.to_numpy()[:-1] - 1
    return ret[np.isfinite(ret).all(axis=1)]


def test_complete_returns_match_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 6)
        dates = [np.sort(rng.integers(0, 25, rng.integers(1, 15))) for _ in range(n)]
        prices = [np.where(rng.random(len(d)) < 0.1, 0.0, rng.integers(1, 9, len(d))).astype(float) for d in dates]
        got, want = complete_returns(dates, prices), _plain_returns(dates, prices)
        assert got.shape == want.shape
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_bars_without_a_date_are_the_last_day():
    nan = np.nan
    got = complete_returns([np.array([nan, 1.0, 2.0]), np.array([1, 2, 3])], [np.array([8.0, 1.0, 2.0]), np.array([1.0, 2.0, 3.0])])
    np.testing.assert_allclose(got, [[1.0, 1.0], [0.0, 0.5], [3.0, 0.0]])
    assert complete_returns([np.array([nan]), np.array([1, 2])], [np.array([1.0]), np.array([1.0, 2.0])]).shape == (0, 2)


def test_complete_returns_hold_no_dates_before_the_last_start():
    rng = np.random.default_rng(4)
    dates = [np.sort(rng.choice(4000, 30, replace=False)) for _ in range(1000)] + [np.arange(3980, 4000)]
    prices = [rng.random(len(d)) + 1 for d in dates]
    tracemalloc.start()
    got = complete_returns(dates, prices)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (19, 1001) and peak < 8e6  # 4000 dates of all names: over 100 MB


def test_bollinger_frames_pass_batches(spark):
    rng = np.random.default_rng(5)
    day = dt.date(2024, 1, 1)
    rows = [(t, day + dt.timedelta(days=i), None if t == "B" and i == 20 else float(rng.random() * 100), i)
            for t in ("A", "B", None) for i in range(40)] + [("C", day, 1.0, 0)]
    df = spark.createDataFrame(rows, "ticker string, date date, price double, other int").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        bands = M.bollinger_bands(df, 5, 2)
        got = {(r.ticker, r.date): r for r in bands.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in bands._jdf.queryExecution().toString()
    assert len(got) == len(rows) and bands.columns == ["ticker", "date", "price", "other", "middle", "upper", "lower"]
    for t in ("A", "B", "C", None):
        own = [r for r in rows if r[0] == t]
        for i, r in enumerate(own):
            frame = [x[2] for x in own[max(0, i - 4):i + 1]]
            g = got[t, r[1]]
            assert (g.price, g.other) == (r[2], r[3])
            if len(frame) < 5 or None in frame:
                assert (g.middle, g.upper, g.lower) == (None, None, None)
            else:
                m, s = np.mean(frame), np.std(frame)
                np.testing.assert_allclose((g.middle, g.upper, g.lower), (m, m + 2 * s, m - 2 * s), rtol=1e-12)


def test_tasks_that_sort_bars_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from sigfolio.plans import q_market
    monkeypatch.setattr(M, "SORT_ROWS", 50)
    (spark.range(600).selectExpr("id % 6 AS l_suppkey", "date_add(DATE'2020-01-01', cast(id / 6 AS int)) AS l_shipdate",
                                 "cast(id AS double) AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet")))
    bars = q_market.q_last_n_bars(spark, str(tmp_path))
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "13), REPARTITION_BY_NUM" in plan  # 600 bars and 6 x 4 requests, 50 a task
    assert bars.count() == 6 * (30 + 30 + 30)


def test_packed_returns_match_long_form(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(6):
        for t in ("A", "B", "C", *([None] if g == 5 else [])):
            days = np.sort(rng.choice(np.arange(-3, 15), rng.integers(1, 12), replace=False))
            price = [None if rng.random() < 0.1 else 0.0 if rng.random() < 0.1 else float(rng.integers(1, 9)) for _ in days]
            rows.append((g, t, [int(d) for d in days], price))
    rows += [(6, "A", [1, 2], [0.0, 1.0]), (7, "A", [4], [1.0]), (8, "A", [], [])]
    packed = spark.createDataFrame(rows, "g int, ticker string, date array<int>, price array<double>").repartition(3)
    long = packed.select("g", "ticker", F.explode(F.arrays_zip("date", "price")).alias("x")).select("g", "ticker", "x.*")
    ret = M.panel_returns(packed, group=["g"], packed=True)
    assert "Window" not in ret._jdf.queryExecution().toString()
    full, own = {}, {}
    for r in M.panel_returns(long, group=["g"]).collect():
        full.setdefault((r.g, r.ticker), []).append((r.date, r.ret))
    for r in M.complete_case_returns(M.panel_returns(long, group=["g"]), group=["g"]).collect():
        own.setdefault((r.g, r.ticker), []).append((r.date, r.ret))
    in_order = lambda x: {k: [v for _, v in sorted(d)] for k, d in x.items()}
    assert {(r.g, r.ticker): r.ret for r in ret.collect()} == in_order(full)
    assert {(r.g, r.ticker): r.ret for r in M.complete_case_returns(ret, group=["g"], packed=True).collect()} == in_order(own)
    assert own and len(own) < len(full)


def test_rebalance_check_writes_no_row_per_name_and_day(spark, monkeypatch):
    from sigfolio.plans import q_portfolio as Q
    rng = np.random.default_rng(7)
    day, cuts = dt.date(2024, 1, 1), []
    prices = spark.createDataFrame([(t, day + dt.timedelta(days=i), float(rng.integers(50, 99))) for t in "ABCD" for i in range(80) if rng.random() < 0.7],
                                   "ticker string, date date, price double").withColumn("price", F.col("price").cast("decimal(18,6)"))
    dates = [dt.date(2024, 2, 20), dt.date(2024, 3, 20)]
    held = spark.createDataFrame([(d, t) for d in dates for t in "ABCD"], "rebalance_date date, ticker string")
    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: cuts.append(cut(df)) or cuts[-1])
    got = Q.rebalance_check(held, prices).collect()
    assert [c.count() for c in cuts] == [8, 8, 8]
    assert sorted((r.rebalance_date, r.ticker) for r in got) == [(d, t) for d in dates for t in "ABCD"]
    assert all(r.weighted and r.optimal and r.total_weight == 1 for r in got)
    # weights that are not the least variance are found out
    w = cuts[1].withColumn("weight", F.when(F.col("ticker") == "A", 1.0).otherwise(0.0))
    wrong = Q.optimality(w, M.complete_case_returns(cuts[2], group=["rebalance_date"], packed=True)).collect()
    assert all(r.weighted for r in wrong) and {r.rebalance_date for r in wrong if not r.optimal} == set(dates)
