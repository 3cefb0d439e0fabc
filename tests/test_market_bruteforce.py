"""Price-window operators against brute force / pandas on random fixtures."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from sigfolio.operators import market as M


def _fixture(seed, n_tickers=4, n_days=40, p_null=0.15):
    rng = random.Random(seed)
    rows = []
    for t in range(n_tickers):
        day = dt.date(2020, 1, 1)
        for _ in range(n_days):
            day += dt.timedelta(days=rng.randint(1, 3))
            px = None if rng.random() < p_null else round(rng.choice([10.0, 10.5, 11.0, rng.uniform(5, 15)]), 2)
            rows.append((f"T{t}", day, px))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_match_exact_bruteforce(spark, seed):
    rows = _fixture(seed)
    df = spark.createDataFrame(rows, "ticker string, date date, price double")
    got = {(r.ticker, r.date): r.truth for r in M.label_truth(df, 5).collect()}
    want = {}
    for t in sorted({r[0] for r in rows}):
        series = [(d, Decimal(str(p))) for tk, d, p in sorted(rows, key=lambda x: x[1]) if tk == t and p is not None]
        for i, (d, p) in enumerate(series):
            win = [x for _, x in series[max(0, i - 4):i + 1]]
            want[(t, d)] = "buy" if len(win) == 5 and 5 * p <= sum(win) else "sell"
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_pct_change_matches_pandas_ffill(spark, seed):
    rows = _fixture(seed)
    df = spark.createDataFrame(rows, "ticker string, date date, price double")
    got = {(r.ticker, r.date): r.ret for r in M.pct_change(df).collect()}
    pdf = pd.DataFrame(rows, columns=["ticker", "date", "price"]).sort_values(["ticker", "date"])
    pdf["ret"] = pdf.groupby("ticker")["price"].transform(lambda s: s.ffill().pct_change(fill_method=None))
    for r in pdf.itertuples():
        g = got[(r.ticker, r.date)]
        if np.isnan(r.ret) or np.isinf(r.ret):
            assert g is None
        else:
            assert abs(g - r.ret) < 1e-12


def test_panel_returns_match_pandas_pivot(spark):
    rows = [r for r in _fixture(6, n_tickers=3, n_days=15, p_null=0.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, price double")
    got = {(r.ticker, r.date): r.ret for r in M.complete_case_returns(M.panel_returns(df)).collect()}
    wide = pd.DataFrame(rows, columns=["ticker", "date", "price"]).pivot_table(
        index="date", columns="ticker", values="price")
    ret = wide.ffill().pct_change(fill_method=None).dropna()
    want = {(t, d): ret.loc[d, t] for d in ret.index for t in ret.columns}
    assert set(got) == set(want)
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-12


def test_bollinger_matches_pandas(spark):
    rows = _fixture(7, n_tickers=2, n_days=50, p_null=0.0)
    df = spark.createDataFrame(rows, "ticker string, date date, price double")
    got = {(r.ticker, r.date): (r.middle, r.upper) for r in M.bollinger_bands(df, 30, 2).collect()}
    pdf = pd.DataFrame(rows, columns=["ticker", "date", "price"]).sort_values(["ticker", "date"])
    roll = pdf.groupby("ticker")["price"].rolling(30)
    pdf["mid"] = roll.mean().reset_index(level=0, drop=True)
    pdf["sd"] = roll.std(ddof=0).reset_index(level=0, drop=True)
    for r in pdf.itertuples():
        m, u = got[(r.ticker, r.date)]
        if np.isnan(r.mid):
            assert m is None
        else:
            assert abs(m - r.mid) < 1e-9 and abs(u - (r.mid + 2 * r.sd)) < 1e-9


def test_cumulative_return_first_row_zero(spark):
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate([0.5, 0.1, None, -0.2])],
                               "strategy_id string, date int, ret double")
    got = [r.cum_ret for r in M.cumulative_return(df).orderBy("date").collect()]
    assert got == pytest.approx([0.0, 0.1, 0.1, -0.1])
    comp = [r.cum_ret for r in M.cumulative_return(df, compound=True).orderBy("date").collect()]
    assert comp == pytest.approx([0.0, 0.1, 0.1, 1.1 * 0.8 - 1])


def test_resample_bars_ohlc(spark):
    ts = [dt.datetime(2024, 1, 1, 10, m) for m in (5, 1, 30, 59)]
    df = spark.createDataFrame([("A", t, v, i) for i, (t, v) in enumerate(zip(ts, [2.0, 1.0, 5.0, 3.0]))],
                               "ticker string, ts timestamp_ntz, value double, seq int")
    r = M.resample_bars(df, "1 hour", seq="seq").first()
    assert (r.open, r.high, r.low, r.close, r.n) == (1.0, 5.0, 1.0, 3.0, 4)
