"""Strategy performance: equity returns vs an index, CAGR, Sharpe, maximum
drawdown, information ratio, turnover.

Every series is keyed by ``strategy_id`` so many backtests are evaluated at
once; windows partition by that key (one equity curve per partition) and
the metrics are grouped aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigfolio.operators import market as M

DAYS_PER_YEAR = 365.25
ANNUAL = math.sqrt(M.TRADING_DAYS)


def equity_returns(equity: DataFrame, index: DataFrame | None = None, key: str = "strategy_id",
                   order: str = "date", value: str = "equity", index_ret: str = "index_ret") -> DataFrame:
    """Equity curve -> simple returns -> cumulative sum (first row 0), with
    the index return and its cumulative sum joined on date when given."""
    r = M.pct_change(equity, key=key, order=order, value=value, out="ret")
    r = M.cumulative_return(r, key=key, order=order, value="ret", out="cum_ret")
    if index is None:
        return r
    idx = index.withColumn("__k", F.lit(0))
    idx = M.cumulative_return(idx, key="__k", order=order, value=index_ret, out="cum_index_ret").drop("__k")
    return r.join(idx, order, "left")


def performance_metrics(equity: DataFrame, bench: DataFrame, key: str = "strategy_id", order: str = "date",
                        value: str = "equity", bench_ret: str = "bench_ret") -> DataFrame:
    """Per strategy: CAGR, annualised Sharpe (zero risk-free), maximum
    drawdown and information ratio against the benchmark returns.  A metric
    without a defined value (one day only, a zero curve) is NULL."""
    r = M.pct_change(equity, key=key, order=order, value=value, out="ret").join(bench, order, "left")
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("__dd", F.try_divide(F.col(value), F.max(value).over(run)) - 1)
    agg = r.groupBy(key).agg(
        F.min_by(value, order).alias("__v0"), F.max_by(value, order).alias("__v1"),
        F.datediff(F.max(order), F.min(order)).alias("__days"),
        F.avg("ret").alias("__mr"), F.stddev_samp("ret").alias("__sr"),
        F.avg(F.col("ret") - F.col(bench_ret)).alias("__ma"),
        F.stddev_samp(F.col("ret") - F.col(bench_ret)).alias("__sa"),
        F.min("__dd").alias("max_drawdown"))
    cagr = F.pow(F.try_divide(F.col("__v1"), F.col("__v0")), F.try_divide(F.lit(DAYS_PER_YEAR), F.col("__days"))) - 1
    return agg.select(key, cagr.alias("cagr"),
                      (F.try_divide(F.col("__mr"), F.col("__sr")) * ANNUAL).alias("sharpe"),
                      "max_drawdown",
                      (F.try_divide(F.col("__ma"), F.col("__sa")) * ANNUAL).alias("information_ratio"))


def turnover(weights: DataFrame, at: str = "rebalance_date", key: str = "ticker",
             weight: str = "weight") -> DataFrame:
    """Per rebalance date: one half of the summed absolute weight changes vs
    the previous date (missing weights count as 0), the number of tickers
    whose weight changed and trades per day since the previous date.
    Expects every ticker listed on every date (the universe-filled output of
    ``monthly_rebalance``)."""
    w = Window.partitionBy(key).orderBy(at)
    d = weights.withColumn("__prev", F.coalesce(F.lag(weight).over(w), F.lit(0.0)))
    d = d.withColumn("__chg", F.abs(F.col(weight) - F.col("__prev")))
    per = d.groupBy(at).agg((F.sum("__chg") / 2).alias("turnover"),
                            F.count(F.when(F.col("__chg") > 0, 1)).alias("n_trades"))
    # trades per calendar day since the previous rebalance date (looked up in
    # the sorted date list, a scalar subquery over one row per date)
    dates = per.agg(F.array_sort(F.collect_list(at))).scalar()
    per = per.withColumn("__dates", dates)
    prev = F.array_max(F.filter("__dates", lambda d: d < F.col(at)))
    gap = F.datediff(F.col(at), prev)
    return per.withColumn("trades_per_day", F.try_divide(F.col("n_trades").cast("double"), gap)).drop("__dates")
