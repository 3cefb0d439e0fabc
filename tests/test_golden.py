"""Golden cases (FIXTURES.md section 3) and reference-semantics edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from sigfolio.functions import text as X
from sigfolio.functions.dates import sas_serial_to_date
from sigfolio.operators import market as M
from sigfolio.operators import portfolio as P
from sigfolio.plans import bindings as B

KW = X.FILING_KEYWORDS


def _one(spark, col_expr, data, schema):
    return spark.createDataFrame(data, schema).select(col_expr.alias("r")).first()["r"]


def test_keyword_window_k2(spark):
    paras = ["a single risk of the trade", "a financial gap is a risk as well",
             "one more risk is a legal dispute", "we increase or decrease our dividends"]
    df = spark.createDataFrame([(paras,)], "p array<string>")
    r = df.select(X.keyword_counts("p", KW).alias("c")).select("c", X.max_keyword_window("c", 2).alias("s")).first()
    assert list(r["c"]) == [1, 2, 2, 3]
    assert r["s"] == 2


def test_keyword_window_tie_and_short(spark):
    paras = ["a single risk of the trade", "the weather is a risk too",
             "so is any risk we did not name", "a plain line"]
    df = spark.createDataFrame([(paras,), (paras[:1],), ([],)], "p array<string>")
    r = df.select(X.keyword_counts("p", KW).alias("c")).select("c", X.max_keyword_window("c", 2).alias("s")).collect()
    assert list(r[0]["c"]) == [1, 1, 1, 0] and r[0]["s"] == 0
    assert r[1]["s"] == 0 and r[2]["s"] == 0


def test_keyword_counts_substring_semantics(spark):
    df = spark.createDataFrame([("Brisk risks RISK",)], "t string")
    assert df.select(X.keyword_count("t", ["risk"]).alias("n")).first()["n"] == 3


def test_all_caps_line_becomes_break(spark):
    df = spark.createDataFrame([("ACME CORP\nbody\n\n\n\nTOP\nx",)], "t string")
    t = df.select(F.regexp_replace("t", "(?mdU)^[A-Z\\s\\x{1c}-\\x{1f}]+\\n", "\n").alias("t")).first()["t"]
    assert t == "\nbody\n\nx"
    paras = df.select(X.split_paragraphs("t").alias("p")).first()["p"]
    assert list(paras) == ["body", "x"]


def test_header_fields(spark):
    txt = ("ACCESSION NUMBER:\t\t0001\nCENTRAL INDEX KEY:\t\t\t0001487931\n"
           "COMPANY CONFORMED NAME:\t\t\tFISION Corp\nFILED AS OF DATE:\t\t20230103\n")
    df = spark.createDataFrame([(txt,), ("nothing",)], "c string")
    h = X.filing_header("c")
    rows = df.select(*[v.alias(k) for k, v in h.items()]).collect()
    assert (rows[0]["cik"], rows[0]["company_name"], rows[0]["date"]) == ("0001487931", "FISION Corp", "20230103")
    assert (rows[1]["cik"], rows[1]["company_name"], rows[1]["date"]) == ("Unknown", "Unknown", "Unknown")


def test_section_longest_first_wins_and_empty(spark):
    txt = "Item 1A aaa Item 1B ... ITEM 1A bbb Item 1B ... item 1a Item 1B"
    df = spark.createDataFrame([(txt,), ("Item 1AItem 1B",), ("none",)], "c string")
    r = df.select(X.extract_section("c", X.SECTIONS_10K["item_1A"]).alias("s")).collect()
    assert r[0]["s"] == "Item 1A aaa Item 1B"       # tie on body length: the first wins
    assert r[1]["s"] is None and r[2]["s"] is None  # empty body / no match -> NULL


def test_section_item1_matches_item10_front(spark):
    df = spark.createDataFrame([("Item 10 x Item 1A",)], "c string")
    assert df.select(X.extract_section("c", X.SECTIONS_10K["item_1"]).alias("s")).first()["s"] == "Item 10 x Item 1A"


def test_pct_change_gaps(spark):
    df = spark.createDataFrame([("A", i, p) for i, p in enumerate([100.0, None, 110.0, 0.0, 5.0])],
                               "ticker string, date int, price double")
    r = [x["ret"] for x in M.pct_change(df).orderBy("date").collect()]
    assert r[0] is None and r[1] == 0.0 and abs(r[2] - 0.1) < 1e-12 and r[3] == -1.0 and r[4] is None


def test_sas_serial(spark):
    df = spark.createDataFrame([(18264.9,), (None,)], "s double")
    r = df.select(sas_serial_to_date("s").alias("d")).collect()
    assert r[0]["d"] == dt.date(2010, 1, 2) and r[1]["d"] is None


def test_constant_price_is_buy_and_warmup_is_sell(spark):
    rows = [("A", i, "0.100000") for i in range(12)]
    df = spark.createDataFrame(rows, "ticker string, date int, price string") \
        .withColumn("price", F.col("price").cast("decimal(18,6)"))
    lab = [r["truth"] for r in M.label_truth(df, 10).orderBy("date").collect()]
    assert lab[:9] == ["sell"] * 9 and lab[9:] == ["buy"] * 3


def test_constant_double_price_is_buy(spark):
    df = spark.createDataFrame([("A", i, 0.1) for i in range(10)], "ticker string, date int, price double")
    assert [r["truth"] for r in M.label_truth(df, 10).orderBy("date").collect()][-1] == "buy"


def test_toy_frontier(spark):
    px = {"AAPL": [132, 134, 130], "NVDA": [540, 550, 555]}
    ret = np.array([[px[t][i + 1] / px[t][i] - 1 for t in ("AAPL", "NVDA")] for i in range(2)])
    mu = ret.mean(0) * 252
    cov = np.cov(ret, rowvar=False, ddof=1) * 252
    assert np.allclose(mu, [-1.852103, 3.478788], atol=1e-6)
    assert np.allclose(cov, [[0.255176, 0.053457], [0.053457, 0.011199]], atol=1e-6)
    w = P.min_variance(ret)
    assert np.allclose(w, [0, 1], atol=1e-9)
    assert abs(w @ mu - 3.478788) < 1e-6 and abs(np.sqrt(w @ cov @ w) - 0.105825) < 1e-6


def test_min_variance_panel_sf001(spark):
    """Golden weights of the events panel at sf0.01 (tolerance 1e-4)."""
    r = M.complete_case_returns(M.panel_returns(B.panel(spark, SF01))).withColumn("g", F.lit(1))
    w = {x["ticker"]: x["weight"] for x in P.min_variance_weights(r, group=["g"]).collect()}
    want = {"click": 0.22018, "error": 0.29319, "purchase": 0.0, "signup": 0.39020, "view": 0.09643}
    for k, v in want.items():
        assert abs(w[k] - v) < 1e-4


def test_label_slice_counts_sf001(spark):
    lab = M.label_truth(B.prices(spark, SF01), 10)
    got = {r["truth"]: r["count"] for r in lab.groupBy("truth").count().collect()}
    assert got == {"buy": 25723, "sell": 27584}


def test_longest_p_body_sf001(spark):
    p = B.table(spark, SF01, "pages")
    s = p.select(X.extract_section("html", r"(<p>)(.*?)(</p>)").alias("s")).filter(F.col("s").isNotNull())
    body = s.select(F.length(F.regexp_extract("s", "(?s)^<p>(.*)</p>$", 1)).alias("n"))
    r = body.agg(F.count("n").alias("pages"), F.sum("n").alias("chars")).first()
    assert (r["pages"], r["chars"]) == (239, 181185)


def test_keyword_total_sf001(spark):
    d = B.table(spark, SF01, "documents")
    c = d.select(X.keyword_counts(X.split_paragraphs("text", "\n"), ["the", "and", "de", "und"]).alias("c"))
    tot = c.select(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")).agg(F.sum("t")).first()[0]
    assert tot == 52175


@pytest.mark.parametrize("n,t", [(3, 10), (20, 8), (40, 60)])
def test_solver_kkt(n, t):
    rng = np.random.default_rng(n * 100 + t)
    ret = rng.normal(0, 0.02, (t, n)) + rng.normal(0, 0.01, (t, 1))
    w = P.min_variance(ret)
    cov = np.cov(ret, rowvar=False, ddof=1) * 252
    assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all()
    g = cov @ w
    on = w > 1e-12
    lam = g[on].mean()
    assert np.abs(g[on] - lam).max() < 1e-9 * max(1, abs(lam))
    assert (g[~on] >= lam - 1e-9).all()
    # no random feasible point does better
    for _ in range(200):
        v = rng.dirichlet(np.ones(n))
        assert w @ cov @ w <= v @ cov @ v + 1e-12
