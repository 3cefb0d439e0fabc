"""Join edge cases: NULL keys, fan-out, as-of ties; similarity ties and zero
vectors."""

import datetime as dt

from pyspark.sql import functions as F

from sigfolio.functions.vectors import cosine_similarity
from sigfolio.operators import joins as J
from sigfolio.operators import market as M
from sigfolio.operators import similarity as S


def test_join_ticker_null_keys_dropped_and_fan_out_kept(spark):
    filings = spark.createDataFrame([(1, "c1", "2020-01"), (2, None, "2020-01"), (3, "c2", "2020-02")],
                                    "doc_id int, cik string, ym string")
    members = spark.createDataFrame([("c1", "2020-01", "AAA"), ("c1", "2020-01", "AAB"), (None, "2020-01", "NUL"),
                                     ("c2", "2020-02", None)], "cik string, ym string, ticker string")
    got = sorted((r.doc_id, r.ticker) for r in J.join_ticker(filings, members).collect())
    assert got == [(1, "AAA"), (1, "AAB")]


def test_asof_strictly_before_and_same_ts_tie(spark):
    prices = spark.createDataFrame([("X", dt.date(2020, m, d)) for m in (1, 2, 3) for d in (2, 15)],
                                   "ticker string, date date")
    cal = M.first_trading_day(prices)
    ts = dt.datetime(2020, 1, 20, 10, 0)
    sig = spark.createDataFrame([("X", ts, 1, "buy"), ("X", ts, 2, "sell"),           # same ts: seq decides
                                 ("X", dt.datetime(2020, 2, 2, 9, 0), 3, "buy")],   # on the rebalance day
                                "ticker string, ts timestamp_ntz, seq int, position string")
    got = {r.rebalance_date: r.position for r in J.asof_last_signal(sig, cal).collect()}
    assert got == {dt.date(2020, 2, 2): "sell", dt.date(2020, 3, 2): "buy"}
    incl = {r.rebalance_date: r.position for r in J.asof_last_signal(sig, cal, inclusive=True).collect()}
    assert incl[dt.date(2020, 2, 2)] == "buy"


def test_cosine_zero_vector_and_topk_ties(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(cosine_similarity("a", "b").alias("c")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1.0) < 1e-12
    texts = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    cats = spark.createDataFrame([("second", 2, [0.0, 1.0]), ("first", 1, [0.0, 2.0]), ("hit", 3, [1.0, 0.0])],
                                 "category string, cat_idx int, vec array<double>")
    top = [(r["rank"], r.category) for r in S.topk_categories(texts, cats, k=5).orderBy("rank").collect()]
    assert top == [(1, "hit"), (2, "first"), (3, "second")]  # k capped; equal scores keep category order
    empty = cats.filter(F.lit(False))
    assert S.topk_categories(texts, empty, k=2).count() == 0


def _day(m, d=2):
    return dt.date(2020, m, d)


def test_a_name_is_held_from_its_first_bar_until_a_sell(spark):
    """Names without any signal are held too; a sell ends it, a buy resumes."""
    prices = spark.createDataFrame([(t, _day(m, d)) for t, first in (("A", 1), ("B", 1), ("C", 3)) for m in range(first, 7) for d in (2, 15)],
                                   "ticker string, date date")
    cal = M.first_trading_day(prices)
    sig = spark.createDataFrame([("A", dt.datetime(2020, 2, 10), 1, "buy"), ("A", dt.datetime(2020, 3, 10), 2, "sell"),
                                 ("A", dt.datetime(2020, 5, 10), 3, "buy"), ("D", dt.datetime(2020, 1, 1), 4, "buy")],
                                "ticker string, ts timestamp_ntz, seq int, position string")
    got = sorted((r.ticker, r.rebalance_date.month) for r in J.portfolio_membership(sig, cal, prices).collect())
    assert got == [("A", 2), ("A", 3), ("A", 6), ("B", 2), ("B", 3), ("B", 4), ("B", 5), ("B", 6), ("C", 4), ("C", 5), ("C", 6)]


def test_streaming_state_gives_the_same_holdings(spark):
    prices = spark.createDataFrame([("A", _day(m)) for m in range(1, 6)] + [("B", _day(m)) for m in range(2, 6)], "ticker string, date date")
    cal = M.first_trading_day(prices)
    sig = spark.createDataFrame([("A", dt.datetime(2020, 3, 1), 1, "sell"), ("B", dt.datetime(2020, 4, 20), 2, "sell")],
                                "ticker string, ts timestamp_ntz, seq int, position string")
    state = J.signal_periods(sig, cal)
    a = sorted(map(tuple, J.holdings(state, J.first_held(prices, cal), cal).collect()))
    assert a == sorted(map(tuple, J.portfolio_membership(sig, cal, prices).collect()))


def test_positions_from_summed_counts(spark):
    rows = [("s", dt.datetime(2020, 1, 1 + k % 3, k % 24), k) for k in range(30)] + [("t", dt.datetime(2020, 1, 2), 99), (None, dt.datetime(2020, 1, 5), 5)]
    df = spark.createDataFrame(rows, "strategy_id string, ts timestamp_ntz, id int")
    got = {(r.strategy_id, r.id): r.i for r in J.with_position(df, "ts", "strategy_id", "i", tie=["id"]).collect()}
    want = {}
    for s in ("s", "t", None):
        for k, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])), 1):
            want[s, r[2]] = k
    assert got == want


def test_blank_and_missing_answers(spark):
    """A blank cached answer is asked again; no answer stays NULL."""
    import pandas as pd
    from sigfolio.functions.text import hash_text
    from sigfolio.operators.classify import classify
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "id int, text string")
    cache = df.filter("id < 4").select(hash_text("text").alias("hashed_text"),
                                       F.when(F.col("id") == 1, "buy").when(F.col("id") == 2, "").alias("response"))
    assert sorted(r.id for r in J.cache_misses(df, cache, ["text"]).collect()) == [2, 3, 4]
    ask = lambda pdf: pd.Series([None if t == "four" else "asked" for t in pdf["text"]], index=pdf.index)
    got = {r.id: r.label for r in classify(df, ask, ["text"], cache).collect()}
    assert got == {1: "buy", 2: "asked", 3: "asked", 4: None}
    assert {r.label for r in classify(df, ask, ["text"]).collect()} == {"asked", None}


def test_single_row_and_null_classes_in_the_split(spark):
    from sigfolio.operators.training import stratified_split
    rows = [(i, "a") for i in range(8)] + [(100, "lone")] + [(200 + i, None) for i in range(8)]
    got = stratified_split(spark.createDataFrame(rows, "id int, label string"), "label", 0.5, ["id"]).collect()
    train = {}
    for r in got:
        train.setdefault(r.label, []).append(r.split == "train")
    assert len(got) == 17 and train["lone"] == [True]
    assert 3 <= sum(train["a"]) <= 5 and 3 <= sum(train[None]) <= 5


def test_metrics_without_a_value_are_null(spark):
    from sigfolio.operators.performance import performance_metrics
    eq = spark.createDataFrame([("one", _day(1), 5.0), ("zero", _day(1), 0.0), ("zero", _day(2), 0.0), ("ok", _day(1), 1.0), ("ok", _day(2), 2.0)],
                               "strategy_id string, date date, equity double")
    bench = spark.createDataFrame([(_day(2), 0.1)], "date date, bench_ret double")
    got = {r.strategy_id: r for r in performance_metrics(eq, bench).collect()}
    assert got["one"].cagr is None and got["zero"].max_drawdown is None and got["ok"].cagr > 0


def test_log_without_marker_and_with_two(spark):
    from sigfolio.sources.files import WEIGHTS_MARKER, parse_log_table
    logs = [("none", "a\nb\nc"), ("two", f"x\n{WEIGHTS_MARKER}\nh\n1,a\n2,b\ndone"), ("short", f"{WEIGHTS_MARKER}\nh"), ("null", None)]
    got = parse_log_table(spark.createDataFrame(logs, "log_id string, content string"), "k int, v string").collect()
    assert sorted(map(tuple, got)) == [("two", 3, 1, "a"), ("two", 4, 2, "b")]
