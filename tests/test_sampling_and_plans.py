"""Sampling invariants and physical-plan checks."""

from pyspark.sql import functions as F

from conftest import SF001, SF01
from sigfolio.functions import text as X
from sigfolio.operators import joins as J
from sigfolio.operators import market as M
from sigfolio.operators import training as TR
from sigfolio.plans import bindings as B


def _skewed(spark, n=20000):
    # one class holds a third of the rows
    return spark.range(n).withColumn("label", F.when(F.col("id") % 3 == 0, "hot")
                                     .otherwise(F.concat(F.lit("c"), (F.col("id") % 17).cast("string"))))


def test_sample_n_exact_and_deterministic(spark):
    df = _skewed(spark)
    a = {r.id for r in TR.sample_n(df, 777, ["id"], 5).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = {r.id for r in TR.sample_n(df.repartition(11), 777, ["id"], 5).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(a) == 777 and a == b
    assert TR.sample_n(df, 10 ** 9, ["id"]).count() == df.count()


def test_stratified_split_is_partition_with_quotas(spark):
    df = _skewed(spark)
    s = TR.stratified_split(df, "label", 0.5, ["id"], seed=3)
    assert s.count() == df.count() and s.select("id").distinct().count() == df.count()
    per = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    assert sum(v for (lab, sp), v in per.items() if sp == "train") == df.count() // 2
    for lab, c in n.items():
        assert abs(per.get((lab, "train"), 0) - c / 2) <= 1


def test_class_threshold(spark):
    df = _skewed(spark, 100)
    kept = TR.class_threshold(df, "label", 6).groupBy("label").count().collect()
    assert all(r["count"] >= 6 for r in kept)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_window_single_exchange_for_window(spark):
    plan = _plan(M.label_truth(B.prices(spark, SF001), 10))
    # one exchange for the (ticker, date) aggregate; the window reuses its partitioning
    assert plan.count("Exchange hashpartitioning") <= 2
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_text_job_has_no_python(spark):
    f = B.filing_texts(spark, SF001)
    df = X.with_top_passages(f.withColumn("s", X.extract_section("content", X.SECTIONS_10K["item_1A"])), "s", "s")
    plan = _plan(df)
    assert "Python" not in plan and "Exchange" not in plan
    # each section regex is evaluated once per requested group
    assert plan.count("regexp_extract_all") <= 4


def test_semi_membership_broadcast_and_pruned(spark):
    df = J.semi_membership(B.order_filings(spark, SF001), B.membership(spark, SF001))
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_pushdown_and_pruning(spark):
    o = B.table(spark, SF001, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    plan = _plan(o)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_asof_matches_bruteforce(spark):
    sig = B.signals(spark, SF001)
    cal = M.first_trading_day(B.prices(spark, SF001))
    got = {(r.ticker, r.rebalance_date): r.position for r in J.asof_last_signal(sig, cal).collect()}
    s = sig.select("ticker", "ts", "seq", "position").collect()
    starts = [r.start for r in cal.collect()]
    want = {}
    for d in starts:
        best = {}
        for r in s:
            if r.ts.date() < d:
                k = (r.ts, tuple(r.seq))
                if r.ticker not in best or k > best[r.ticker][0]:
                    best[r.ticker] = (k, r.position)
        for t, (_, p) in best.items():
            want[(t, d)] = p
    assert got == want


def test_last_n_bars_matches_bruteforce(spark):
    p = B.prices(spark, SF01).filter(F.col("ticker").isin("S1", "S2", "S3"))
    req = spark.createDataFrame([("S1", "1994-03-01"), ("S2", "1996-07-15"), ("S3", "1992-01-10")],
                                "ticker string, rebalance_date string") \
        .withColumn("rebalance_date", F.col("rebalance_date").cast("date"))
    got = {(r.ticker, r.rebalance_date, r.date) for r in M.last_n_bars(p, req, 30).collect()}
    rows = p.collect()
    want = set()
    for t, d in [(r.ticker, r.rebalance_date) for r in req.collect()]:
        hist = sorted(x.date for x in rows if x.ticker == t and x.date < d)[-30:]
        want |= {(t, d, x) for x in hist}
    assert got == want


def test_covariance_does_not_depend_on_blocks(spark):
    from sigfolio.operators import portfolio as P
    r = M.complete_case_returns(M.panel_returns(B.panel(spark, SF001)))
    a = {(x.ticker_i, x.ticker_j): round(x.cov, 12) for x in P.annual_covariance(r).collect()}
    b = {(x.ticker_i, x.ticker_j): round(x.cov, 12) for x in P.annual_covariance(r, blocks=1).collect()}
    assert a == b and len(a) == 15


def test_covariance_joins_on_dates(spark):
    """Returns are paired by date, not by position; fewer than two common
    dates give NULL."""
    import datetime as dt
    from sigfolio.operators import portfolio as P
    d = lambda k: dt.date(2020, 1, k)
    rows = [("A", d(1), 0.1), ("A", d(2), 0.3), ("A", d(3), -0.2), ("B", d(2), 0.2), ("B", d(3), 0.5), ("B", d(4), 0.9),
            ("C", d(8), 0.1), ("C", d(9), 0.2), ("E", d(1), 0.4)]
    got = {(x.ticker_i, x.ticker_j): x.cov for x in P.annual_covariance(spark.createDataFrame(rows, "ticker string, date date, ret double")).collect()}
    # A and B share 2 and 3 January: deviations (0.25, -0.25) and (-0.15, 0.15)
    assert abs(got["A", "B"] - 252 * (0.25 * -0.15 * 2)) < 1e-12
    assert got["A", "C"] is None and got["A", "E"] is None and got["E", "E"] is None
    assert abs(got["C", "C"] - 252 * 0.005) < 1e-12


def test_similarity_does_not_depend_on_blocks(spark):
    """Also with text rows that share a key: each keeps its own ranks."""
    from sigfolio.operators import similarity as S
    e = B.table(spark, SF001, "embeddings")
    e = e.unionByName(e.limit(7)).unionByName(e.limit(3).withColumn("vec_id", F.lit(1).cast("long")))
    c = B.categories(spark, SF001)
    for k in (1, 3):
        a, b = (sorted((x.vec_id, x.rank, x.category) for x in S.topk_categories(e, c, k, blocks=n).collect()) for n in (1, 4))
        assert a == b and len(a) == k * e.count()
    a, b = (sorted((x.vec_id, x.category) for x in S.cross_similarity(e, c, blocks=n).collect()) for n in (1, 3))
    assert a == b
    assert S.topk_categories(e, c.limit(0), 2).count() == 0


def test_membership_reads_each_input_once(spark):
    from sigfolio.operators import joins as J
    plan = _plan(J.semi_membership(B.order_filings(spark, SF001), B.membership(spark, SF001)))
    assert plan.count("FileScan parquet") + plan.count("Relation [") + plan.count("Relation parquet") <= 3


def test_process_forms_runs_its_text_work(spark):
    from sigfolio.plans.registry import QUERIES, load_all
    load_all()
    for name in ("process_forms", "process_forms_10q"):
        df = QUERIES[name](spark, SF001)
        assert "regexp_extract_all" in df._jdf.queryExecution().optimizedPlan().toString()


def test_stages_are_removed(spark):
    import glob
    from sigfolio.session import cut_lineage, stages
    with stages(spark) as held:
        assert cut_lineage(spark.range(3).toDF("x")).count() == 3
        path = held[0].removeprefix("file:")
        assert glob.glob(path + "/*.parquet")
    assert not glob.glob(path + "*")


def test_flagship_reads_materialised_intermediates(spark):
    """The solver output, the calendar and the per-period signals are
    materialised once; the returned plan only fills the universe."""
    from sigfolio.operators import portfolio as P
    df = P.monthly_rebalance(B.signals(spark, SF001), B.prices(spark, SF001), B.universe(spark, SF001))
    plan = _plan(df)
    assert "FlatMapGroupsInPandas" not in plan
    assert "lineitem" not in plan
    assert df.count() > 0
