"""Portfolio and performance queries: solver, risk/return, monthly
rebalance (the flagship), equity curves and strategy metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfolio.operators import joins as J
from sigfolio.operators import market as M
from sigfolio.operators import performance as PF
from sigfolio.operators import portfolio as P
from sigfolio.plans import bindings as B
from sigfolio.plans.oracle import with_views
from sigfolio.plans.q_market import PANEL_GRID_SQL
from sigfolio.plans.q_joins import HELD_SQL
from sigfolio.plans.registry import query
from sigfolio.session import cut_lineage


def _cc_returns(spark, sf):
    return M.complete_case_returns(M.panel_returns(B.panel(spark, sf)))


@query("min_variance_weights", with_views("panel") + "," + PANEL_GRID_SQL.strip() + """,
m AS (SELECT a.ticker AS ta, b.ticker AS tb, var_samp(a.ret) AS va, var_samp(b.ret) AS vb, covar_samp(a.ret, b.ret) AS c
      FROM cc a JOIN cc b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2),
w AS (SELECT ta, tb, greatest(0, least(1, (vb - c) / (va + vb - 2 * c))) AS w FROM m)
SELECT ta || '|' || tb AS pair, ta AS ticker, round(w, 6) AS weight FROM w
UNION ALL SELECT ta || '|' || tb, tb, round(1 - w, 6) FROM w""")
def q_min_variance(spark, sf):
    """Minimum-variance weights of every pair of tickers, one group each; for
    two assets the optimum has a closed form, which is the SQL."""
    r = cut_lineage(_cc_returns(spark, sf))
    t = r.select("ticker").distinct()
    pairs = t.join(t.select(F.col("ticker").alias("other")), F.col("ticker") < F.col("other"))
    sides = pairs.select(F.concat_ws("|", "ticker", "other").alias("pair"), F.explode(F.array("ticker", "other")).alias("ticker"))
    w = P.min_variance_weights(r.join(sides, "ticker"), group=["pair"])
    return w.select("pair", "ticker", F.round("weight", 6).alias("weight"))


@query("portfolio_risk_return", with_views("panel") + "," + PANEL_GRID_SQL.strip() + """,
mu AS (SELECT ticker, avg(ret) * 252 AS mu FROM cc GROUP BY ticker),
cv AS (SELECT a.ticker AS ti, b.ticker AS tj, covar_samp(a.ret, b.ret) * 252 AS c FROM cc a JOIN cc b ON a.date = b.date GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM mu)
SELECT round((SELECT sum(mu) FROM mu) / n, 9) AS exp_return, round(sqrt((SELECT sum(c) FROM cv) / (n * n)), 9) AS volatility FROM n""")
def q_risk_return(spark, sf):
    r = cut_lineage(_cc_returns(spark, sf))  # feeds three aggregates: materialise once
    mu = P.annual_mean_returns(r)
    cov = P.annual_covariance(r)
    w = mu.select("ticker", (F.lit(1.0) / mu.agg(F.count(F.lit(1))).scalar()).alias("weight"))
    out = P.portfolio_risk_return(w, mu, cov)
    return out.select(F.round("exp_return", 9).alias("exp_return"), F.round("volatility", 9).alias("volatility"))


def rebalance(spark, sf):
    """Flagship: minimum-variance weights of the held names per month start,
    every universe ticker listed."""
    r = P.monthly_rebalance(B.signals(spark, sf), B.prices(spark, sf), B.universe(spark, sf))
    return r.select("rebalance_date", "ticker", F.round("weight", 6).alias("weight"))


REBAL_SQL = with_views("signals", "month_cal", "universe") + HELD_SQL + """,
bars AS (SELECT * FROM (
  SELECT h.rebalance_date, h.ticker, p.date, CAST(p.price AS DOUBLE) AS price,
         row_number() OVER (PARTITION BY h.rebalance_date, h.ticker ORDER BY p.date DESC) AS rn
  FROM held h JOIN prices p ON p.ticker = h.ticker AND p.date < h.rebalance_date) WHERE rn <= 30),
cal AS (SELECT DISTINCT rebalance_date, date FROM bars),
tk AS (SELECT DISTINCT rebalance_date, ticker FROM bars),
grid AS (SELECT c.rebalance_date, t.ticker, c.date, b.price FROM cal c JOIN tk t USING (rebalance_date)
         LEFT JOIN bars b ON b.rebalance_date = c.rebalance_date AND b.ticker = t.ticker AND b.date = c.date),
filled AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY rebalance_date, ticker ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM grid),
rets AS (SELECT rebalance_date, ticker, date, f / lag(f) OVER (PARTITION BY rebalance_date, ticker ORDER BY date) - 1 AS ret FROM filled),
cc AS (SELECT * FROM rets QUALIFY count(ret) OVER (PARTITION BY rebalance_date, date) = count(*) OVER (PARTITION BY rebalance_date, date)),
solved AS (SELECT rebalance_date FROM cc GROUP BY rebalance_date HAVING count(DISTINCT date) >= 2)
SELECT rebalance_date, ticker, true AS weighted, true AS optimal, CAST(1.0 AS DOUBLE) AS total_weight
FROM (SELECT DISTINCT rebalance_date, ticker FROM cc) WHERE rebalance_date IN (SELECT rebalance_date FROM solved)"""


def optimality(weights, ret, tol=1e-9):
    """Per date and ticker with a weight from the solver: ``weighted`` (it is
    one of the complete-case candidates and has a weight >= 0), ``optimal``
    (its covariance with the portfolio is no smaller than the portfolio's
    variance, the condition under which no weight can be moved to gain) and
    the date's total weight.

    ``ret`` are packed returns.  Only what a date has once goes to all tasks:
    its portfolio's returns and the names that are in it, which the solver
    keeps to one more than the date has days."""
    both, day = ["rebalance_date", "ticker"], ["rebalance_date", "__day"]
    held = weights.filter(F.col("weight") != 0)
    port = (ret.join(F.broadcast(held), both).select("rebalance_date", "weight", F.posexplode("ret").alias("__day", "__ret"))
            .groupBy(*day).agg(F.sum(F.col("weight") * F.col("__ret")).alias("port")))
    port = port.groupBy("rebalance_date").agg(F.array_sort(F.collect_list(F.struct("__day", "port"))).alias("__port"),
                                              F.avg("port").alias("__mean"), F.var_samp("port").alias("var"))
    # the portfolio's distances from its mean, by which the returns of a name add up to its covariance
    away = F.transform("__port", lambda p: F.try_divide(p["port"] - F.col("__mean"), F.size("__port") - F.lit(1)))
    port = port.select("rebalance_date", "var", away.alias("__away"))
    products = F.zip_with("ret", "__away", lambda r, p: r * p)
    cov = (ret.join(F.broadcast(port), "rebalance_date", "left")
           .select(*both, F.lit(True).alias("complete"), "var", F.aggregate(products, F.lit(0.0), lambda a, x: a + x).alias("cov")))
    total = weights.groupBy("rebalance_date").agg(F.round(F.sum("weight"), 6).alias("total_weight"))
    return (weights.join(cov, both, "left").join(total, "rebalance_date")
            .select("rebalance_date", "ticker", (F.col("complete").isNotNull() & (F.col("weight") >= 0)).alias("weighted"),
                    (F.col("cov") >= F.col("var") - tol).alias("optimal"), "total_weight"))


def rebalance_check(held, prices):
    """The flagship's weights for the holdings, checked for optimality on
    complete-case returns that are worked out anew, a row per name and date."""
    # solver and check both take doubles
    slices = cut_lineage(M.bar_slices(prices.withColumn("price", F.col("price").cast("double")), held))
    w = cut_lineage(P.min_variance_from_slices(slices))
    group = ["rebalance_date"]
    # a complete case needs a bar of every name on or before the day before it
    first = slices.groupBy(*group).agg(F.max(F.array_min(F.transform("bars", lambda b: b["date"]))).alias("from"))
    late = slices.join(F.broadcast(first), group).filter(F.col("from").isNotNull())
    # bars are in order: the last of those until then (any without a date come first) stands for that day
    until = F.size(F.filter("bars", lambda b: b["date"].isNull() | (b["date"] <= F.col("from"))))
    late = late.select(*group, "ticker", "from", F.slice("bars", until, F.size("bars")).alias("bars"))
    last = late.select(*group, "ticker", F.transform("bars", lambda b: F.unix_date(F.greatest(b["date"], F.col("from")))).alias("date"),
                       F.transform("bars", lambda b: F.when(b["date"].isNotNull(), b["price"])).alias("price"))
    ret = cut_lineage(M.panel_returns(last, group=group, packed=True))
    return optimality(w, M.complete_case_returns(ret, group=group, packed=True))


@query("monthly_rebalance", REBAL_SQL)
def q_rebalance(spark, sf):
    """The flagship's holdings, histories and solver; instead of the weights
    each candidate's optimality, which SQL can state."""
    p = cut_lineage(B.prices(spark, sf))
    held = J.portfolio_membership(B.signals(spark, sf), cut_lineage(M.first_trading_day(p)), p)
    return rebalance_check(held, p)


@query("equity_returns", with_views("equity") + """,
r AS (SELECT strategy_id, date, equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS ret,
             row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS rn FROM equity),
ix AS (SELECT date, ln(tot / lag(tot) OVER (ORDER BY date)) AS index_ret, row_number() OVER (ORDER BY date) AS rn
       FROM (SELECT CAST(ts AS DATE) AS date, sum(value) AS tot FROM events GROUP BY 1))
SELECT r.strategy_id, r.date, round(r.ret, 9) AS ret,
       round(sum(CASE WHEN r.rn = 1 THEN 0 ELSE coalesce(r.ret, 0) END) OVER (PARTITION BY r.strategy_id ORDER BY r.date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS cum_ret,
       round(ix.index_ret, 9) AS index_ret,
       round(sum(CASE WHEN ix.rn = 1 THEN 0 ELSE coalesce(ix.index_ret, 0) END) OVER (PARTITION BY r.strategy_id ORDER BY r.date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS cum_index_ret
FROM r LEFT JOIN ix USING (date)""")
def q_equity_returns(spark, sf):
    idx = _index_returns(spark, sf, log=True)  # the index side is a log-return series
    r = PF.equity_returns(B.equity(spark, sf), idx)
    return r.select("strategy_id", "date", *[F.round(c, 9).alias(c) for c in ("ret", "cum_ret", "index_ret", "cum_index_ret")])


def _index_returns(spark, sf, out="index_ret", log=False):
    """Daily total event value as an index; simple or log returns."""
    tot = (B.table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date"))
           .agg(F.sum("value").alias("tot")).withColumn("__k", F.lit(0)))
    r = M.pct_change(tot, key="__k", value="tot", out=out)
    if log:
        r = r.withColumn(out, F.log1p(out))
    return r.select("date", out)


@query("performance_metrics", with_views("equity") + """,
r AS (SELECT strategy_id, date, equity, equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS ret,
             equity / max(equity) OVER (PARTITION BY strategy_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd
      FROM equity),
ix AS (SELECT date, tot / lag(tot) OVER (ORDER BY date) - 1 AS bench_ret
       FROM (SELECT CAST(ts AS DATE) AS date, sum(value) AS tot FROM events GROUP BY 1)),
j AS (SELECT * FROM r LEFT JOIN ix USING (date))
SELECT strategy_id,
  round(pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / date_diff('day', min(date), max(date))) - 1, 9) AS cagr,
  round(avg(ret) / stddev_samp(ret) * sqrt(252), 9) AS sharpe,
  round(min(dd), 9) AS max_drawdown,
  round(avg(ret - bench_ret) / stddev_samp(ret - bench_ret) * sqrt(252), 9) AS information_ratio
FROM j GROUP BY strategy_id""")
def q_performance(spark, sf):
    r = PF.performance_metrics(B.equity(spark, sf), _index_returns(spark, sf, "bench_ret"))
    return r.select("strategy_id", *[F.round(c, 9).alias(c) for c in ("cagr", "sharpe", "max_drawdown", "information_ratio")])


@query("turnover", with_views("month_cal", "universe") + """,
w AS (SELECT m.start AS rebalance_date, p.ticker, CAST(p.price AS DOUBLE) / sum(CAST(p.price AS DOUBLE))
             OVER (PARTITION BY m.start) AS weight
      FROM month_cal m JOIN prices p ON p.date = m.start),
g AS (SELECT m.start AS rebalance_date, u.ticker, coalesce(w.weight, 0) AS weight
      FROM month_cal m CROSS JOIN universe u LEFT JOIN w ON w.rebalance_date = m.start AND w.ticker = u.ticker),
d AS (SELECT rebalance_date, abs(weight - coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY rebalance_date), 0)) AS chg
      FROM g),
t AS (SELECT rebalance_date, sum(chg) / 2 AS turnover, count(CASE WHEN chg > 0 THEN 1 END) AS n_trades FROM d GROUP BY 1)
SELECT rebalance_date, round(turnover, 9) AS turnover, n_trades,
       round(n_trades / date_diff('day', lag(rebalance_date) OVER (ORDER BY rebalance_date), rebalance_date), 9) AS trades_per_day
FROM t""")
def q_turnover(spark, sf):
    """Turnover of price-proportional weights set on every month start
    (universe-filled): the turnover operator on SQL-checkable weights."""
    from pyspark.sql import Window
    from sigfolio.operators.joins import join_universe_weights
    p = B.prices(spark, sf)
    cal = M.first_trading_day(p).select(F.col("start").alias("rebalance_date"))
    day = p.join(cal, p.date == cal.rebalance_date).select("rebalance_date", "ticker",
                                                           F.col("price").cast("double").alias("px"))
    w = day.withColumn("weight", F.col("px") / F.sum("px").over(Window.partitionBy("rebalance_date")))
    full = join_universe_weights(B.universe(spark, sf), w.select("rebalance_date", "ticker", "weight"),
                                 by=["rebalance_date"])
    r = PF.turnover(full)
    return r.select("rebalance_date", F.round("turnover", 9).alias("turnover"), "n_trades",
                    F.round("trades_per_day", 9).alias("trades_per_day"))
