"""Price windows, labels and returns bound to ``prices`` / ``panel`` / ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfolio.operators import market as M
from sigfolio.operators.joins import _expand
from sigfolio.plans import bindings as B
from sigfolio.plans.oracle import with_views
from sigfolio.plans.registry import query
from sigfolio.session import cut_lineage

W10 = "WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("rolling_mean", with_views("prices") + f"""
SELECT ticker, date, CAST(price AS DOUBLE) AS price,
       round(CASE WHEN count(price) OVER w = 10 THEN CAST(avg(price) OVER w AS DOUBLE) END, 6) AS prc_rolling
FROM prices {W10}""")
def q_rolling_mean(spark, sf):
    r = M.rolling_mean(B.prices(spark, sf), n=10)
    return r.select("ticker", "date", F.col("price").cast("double").alias("price"),
                    F.round(F.col("prc_rolling").cast("double"), 6).alias("prc_rolling"))


LABEL_SQL = f"""
SELECT ticker, date, CAST(price AS DOUBLE) AS price,
       CASE WHEN count(price) OVER w = 10 AND price * 10 <= sum(price) OVER w THEN 'buy' ELSE 'sell' END AS truth
FROM prices {W10}"""


@query("label_truth", with_views("prices") + LABEL_SQL)
def q_label_truth(spark, sf):
    r = M.label_truth(B.prices(spark, sf), n=10)
    return r.select("ticker", "date", F.col("price").cast("double").alias("price"), "truth")


@query("class_counts", with_views("prices") + f"SELECT truth, count(*) AS n FROM ({LABEL_SQL}) GROUP BY truth")
def q_class_counts(spark, sf):
    from sigfolio.operators.training import class_counts
    return class_counts(M.label_truth(B.prices(spark, sf), n=10), "truth")


@query("label_truth_forward", with_views("prices") + """
SELECT * FROM (
  SELECT ticker, date, CAST(price AS DOUBLE) AS price,
         CASE WHEN count(price) OVER f = 10 THEN
              CASE WHEN sum(price) OVER f > price * 10 THEN 'buy' ELSE 'sell' END END AS truth
  FROM prices WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
WHERE truth IS NOT NULL""")
def q_label_truth_forward(spark, sf):
    r = M.label_truth(B.prices(spark, sf), n=10, direction="forward").filter(F.col("truth").isNotNull())
    return r.select("ticker", "date", F.col("price").cast("double").alias("price"), "truth")


# prices with NULL cells (every 13th of a month) so the forward fill matters
GAPPY_SQL = "(SELECT ticker, date, CASE WHEN day(date) = 13 THEN NULL ELSE CAST(price AS DOUBLE) END AS price FROM prices)"


def _gappy(spark, sf):
    p = B.prices(spark, sf)
    return p.withColumn("price", F.when(F.dayofmonth("date") == 13, F.lit(None)).otherwise(F.col("price").cast("double")))


@query("pct_change", with_views("prices") + f"""
SELECT ticker, date, round(filled / lag(filled) OVER (PARTITION BY ticker ORDER BY date) - 1, 9) AS ret
FROM (SELECT ticker, date, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {GAPPY_SQL})""")
def q_pct_change(spark, sf):
    r = M.pct_change(_gappy(spark, sf))
    return r.select("ticker", "date", F.round("ret", 9).alias("ret"))


@query("bollinger_bands", with_views("prices") + """
SELECT ticker, date,
       round(CASE WHEN count(price) OVER b = 30 THEN avg(CAST(price AS DOUBLE)) OVER b END, 4) AS middle,
       round(CASE WHEN count(price) OVER b = 30 THEN avg(CAST(price AS DOUBLE)) OVER b + 2 * stddev_pop(CAST(price AS DOUBLE)) OVER b END, 4) AS upper,
       round(CASE WHEN count(price) OVER b = 30 THEN avg(CAST(price AS DOUBLE)) OVER b - 2 * stddev_pop(CAST(price AS DOUBLE)) OVER b END, 4) AS lower
FROM prices WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def q_bollinger(spark, sf):
    r = M.bollinger_bands(B.prices(spark, sf), 30, 2)
    return r.select("ticker", "date", *[F.round(c, 4).alias(c) for c in ("middle", "upper", "lower")])


@query("first_trading_day", with_views("month_cal") + "SELECT CAST(month AS DATE) AS month, start, next_start FROM month_cal")
def q_first_trading_day(spark, sf):
    return M.first_trading_day(B.prices(spark, sf))


@query("last_n_bars", with_views("month_cal") + """
SELECT ticker, rebalance_date, date, price FROM (
  SELECT r.ticker, r.rebalance_date, p.date, CAST(p.price AS DOUBLE) AS price,
         row_number() OVER (PARTITION BY r.ticker, r.rebalance_date ORDER BY p.date DESC) AS rn
  FROM (SELECT t.ticker, m.start AS rebalance_date FROM (SELECT DISTINCT ticker FROM prices) t, month_cal m) r
  JOIN prices p ON p.ticker = r.ticker AND p.date < r.rebalance_date)
WHERE rn <= 30""")
def q_last_n_bars(spark, sf):
    p = cut_lineage(B.prices(spark, sf))  # feeds the calendar, the requests and the bars
    cal = M.first_trading_day(p)
    req = cut_lineage(_expand(p.select("ticker").distinct(), cal.select(F.col("start").alias("rebalance_date")),
                              ["rebalance_date"]))
    r = M.last_n_bars(p, req, n=30, partitions=M.sort_partitions(spark, p.count() + req.count()))
    return r.select("ticker", "rebalance_date", "date", F.col("price").cast("double").alias("price"))


@query("resample_bars", """
SELECT event_type AS ticker, time_bucket(INTERVAL '1 hour', ts) AS bar_start,
       time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS bar_end,
       first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       last(value ORDER BY ts, event_id) AS close, count(*) AS n
FROM events GROUP BY 1, 2, 3""")
def q_resample_bars(spark, sf):
    ev = B.table(spark, sf, "events").withColumnRenamed("event_type", "ticker")
    return M.resample_bars(ev, "1 hour", key="ticker", ts="ts", value="value", seq="event_id")


PANEL_GRID_SQL = """
grid AS (SELECT t.ticker, d.date, p.price FROM (SELECT DISTINCT ticker FROM panel) t
         CROSS JOIN (SELECT DISTINCT date FROM panel) d LEFT JOIN panel p USING (ticker, date)),
filled AS (SELECT ticker, date, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM grid),
rets AS (SELECT ticker, date, f / lag(f) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM filled),
cc AS (SELECT * FROM rets QUALIFY count(ret) OVER (PARTITION BY date) = count(*) OVER (PARTITION BY date))
"""


def _cc_returns(spark, sf):
    return M.complete_case_returns(M.panel_returns(B.panel(spark, sf)))


PIVOTED = ("click", "error", "purchase", "signup", "view")


@query("pivot_prices", with_views("panel") + "SELECT date, " + ", ".join(
    f"avg(round(price, 6)) FILTER (WHERE ticker = '{t}') AS \"{t}\"" for t in PIVOTED) + " FROM panel GROUP BY date")
def q_pivot_prices(spark, sf):
    return M.pivot_prices(B.panel(spark, sf).withColumn("price", F.round("price", 6)), PIVOTED)


@query("complete_case_returns", with_views("panel") + "," + PANEL_GRID_SQL.strip() + """
SELECT ticker, date, round(ret, 9) AS ret FROM cc""")
def q_complete_case(spark, sf):
    return _cc_returns(spark, sf).select("ticker", "date", F.round("ret", 9).alias("ret"))


@query("annual_mean_returns", with_views("panel") + "," + PANEL_GRID_SQL.strip() + """
SELECT ticker, round(avg(ret) * 252, 9) AS mean_ret FROM cc GROUP BY ticker""")
def q_annual_mean(spark, sf):
    from sigfolio.operators.portfolio import annual_mean_returns
    r = annual_mean_returns(_cc_returns(spark, sf))
    return r.select("ticker", F.round("mean_ret", 9).alias("mean_ret"))


@query("annual_covariance", with_views("panel") + "," + PANEL_GRID_SQL.strip() + """
SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, round(covar_samp(a.ret, b.ret) * 252, 9) AS cov
FROM cc a JOIN cc b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2""")
def q_annual_cov(spark, sf):
    from sigfolio.operators.portfolio import annual_covariance
    r = annual_covariance(_cc_returns(spark, sf))
    return r.select("ticker_i", "ticker_j", F.round("cov", 9).alias("cov"))


@query("cumulative_return", with_views("equity") + """
SELECT strategy_id, date, round(ret, 9) AS ret,
       round(sum(CASE WHEN rn = 1 THEN 0 ELSE coalesce(ret, 0) END) OVER (PARTITION BY strategy_id ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS cum_ret
FROM (SELECT strategy_id, date, equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS ret,
             row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS rn FROM equity)""")
def q_cumulative(spark, sf):
    r = M.pct_change(B.equity(spark, sf), key="strategy_id", value="equity")
    r = M.cumulative_return(r, key="strategy_id")
    return r.select("strategy_id", "date", F.round("ret", 9).alias("ret"), F.round("cum_ret", 9).alias("cum_ret"))
