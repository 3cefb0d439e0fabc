"""Portfolio construction: moments, minimum-variance weights, scaling,
risk/return and the monthly rebalance composition.

All rebalance dates are solved at once: holdings and histories are Spark jobs
grouped by ``rebalance_date``; only the calendar of a group's returns and the
quadratic program are numpy on Arrow tables, one group per rebalance date.  A group is one row per held name with its at most 30 bars, so its size
grows with the names held, which nothing caps: the program couples all names
of a portfolio.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigfolio.operators import market as M
from sigfolio.session import cut_lineage
from sigfolio.operators.joins import join_universe_weights, portfolio_membership

TRADING_DAYS = M.TRADING_DAYS
# Fixed values of the reference: portfolio cap and entry-weight rounding.
PORTFOLIO_CAP = 500
ENTRY_WEIGHT_DECIMALS = 3
#: Tiles of the tickers of a group unless the caller says otherwise.
TICKER_TILES = 8
#: Days of one matrix product.
TILE_DAYS = 1024


def annual_mean_returns(ret: DataFrame, key="ticker", value="ret", group: Sequence[str] = ()) -> DataFrame:
    """mean(daily return) x 252 per ticker."""
    return ret.groupBy(*group, key).agg((F.avg(value) * TRADING_DAYS).alias("mean_ret"))


def return_vectors(ret: DataFrame, key="ticker", order="date", value="ret",
                   group: Sequence[str] = ()) -> DataFrame:
    """(group..., ticker, dates, vec): the known returns ordered by date as
    one array per ticker, with their dates."""
    return (ret.filter(F.col(value).isNotNull()).groupBy(*group, key)
               .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("d"), F.col(value).alias("r"))))
                    .alias("__s"))
               .select(*group, key, F.transform("__s", lambda x: x["d"]).alias("dates"),
                       F.transform("__s", lambda x: x["r"]).alias("vec")))


def gram_covariance(days: list[np.ndarray], values: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sample covariance of series ``rows`` with series ``cols`` over the
    days that both have; NaN with fewer than two.

    With X the values (0 where unknown) and M the marks of what is known, the
    sums over common days are the products X'X, X'M, M'X and M'M, added up
    over tiles of days.  Values are taken from their series' mean, which
    moves no covariance and keeps the differences of large numbers out."""
    calendar = np.unique(np.concatenate(days)) if days else np.empty(0, "i8")
    at = [np.searchsorted(calendar, d) for d in days]
    centred = [v - v.mean() if len(v) else v for v in values]
    shape = len(rows), len(cols)
    n, sx, sy, sxy = (np.zeros(shape) for _ in range(4))
    for first in range(0, len(calendar), TILE_DAYS):
        width = min(TILE_DAYS, len(calendar) - first)
        x, m = np.zeros((len(days), width)), np.zeros((len(days), width))
        for k, (places, v) in enumerate(zip(at, centred)):
            low, high = np.searchsorted(places, [first, first + width])
            x[k, places[low:high] - first] = v[low:high]
            m[k, places[low:high] - first] = 1.0
        n += m[rows] @ m[cols].T
        sx += x[rows] @ m[cols].T
        sy += m[rows] @ x[cols].T
        sxy += x[rows] @ x[cols].T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 1, (sxy - sx * sy / n) / (n - 1), np.nan)


def annual_covariance(ret: DataFrame, key="ticker", order="date", value="ret",
                      group: Sequence[str] = (), blocks: int = TICKER_TILES) -> DataFrame:
    """Sample covariance x 252 for each pair ticker_i <= ticker_j over the
    dates on which both have a return; NULL with fewer than two such dates.

    A ticker's returns are one row; tickers are dealt to ``blocks`` tiles and
    a task works out one pair of tiles by matrix products, so a vector is
    copied once per tile (not per ticker) and a task holds two tiles of the
    trading calendar.  A second return of one date counts with its mean."""
    g = list(group)
    day = F.unix_date(F.col(order).cast("date")).alias(order)
    one = ret.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).groupBy(*g, key, order).agg(F.avg(F.col(value).cast("double")).alias(value))
    v = return_vectors(one.select(*g, key, day, value), key, order, value, g)
    tile = F.pmod(F.xxhash64(key), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    v = (v.select(*g, F.col(key).alias("ticker"), "dates", "vec", tile.cast("int").alias("__tile")).withColumn("__other", other)
         .withColumn("__a", F.least("__tile", "__other")).withColumn("__b", F.greatest("__tile", "__other")).drop("__other"))
    kind = v.schema["ticker"].dataType.simpleString()
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in v.schema.fields if f.name in g]

    def pairs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        days, values = (_lists(table.column(c)) for c in ("dates", "vec"))
        tile, low, high = (table.column(c).to_numpy() for c in ("__tile", "__a", "__b"))
        rows, cols = np.flatnonzero(tile == low[0]), np.flatnonzero(tile == high[0])
        cov = gram_covariance(days, values, rows, cols) * TRADING_DAYS
        # within one tile each pair is met twice
        names = table.column("ticker").to_numpy(zero_copy_only=False)
        i, j = np.broadcast_arrays(rows[:, None], cols[None, :])
        keep = (names[i] <= names[j]) if low[0] == high[0] else np.ones(i.shape, bool)
        i, j, c = i[keep], j[keep], cov[keep]
        swap = (names[i] > names[j]).astype(bool)
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = {x: table.column(x).take(pa.array(np.zeros(len(c), "i8"))) for x in g}
        return pa.table(out | {"ticker_i": table.column("ticker").take(pa.array(i)), "ticker_j": table.column("ticker").take(pa.array(j)),
                               "cov": pa.array(c, mask=np.isnan(c))})

    schema = ", ".join([*kinds, f"ticker_i {kind}", f"ticker_j {kind}", "cov double"])
    return v.groupBy(*g, "__a", "__b").applyInArrow(pairs, schema)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a list column, as views of its values."""
    a = column.combine_chunks()
    flat, at = a.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))]
    return [flat[x:y] for x, y in zip(at, at[1:])]


# --- minimum-variance solver (numpy, one rebalance date per call) ---------

class AffineSet:
    """The active points of the solver, with the inverse of the Cholesky
    factor R of 1 1' + Q'Q, whose solution of ones gives the point of their
    affine hull nearest to the origin.

    A point that comes in appends a column to the factor and its inverse, one
    that goes out leaves a Hessenberg matrix that rotations make triangular
    again: neither starts anew."""

    def __init__(self, points: np.ndarray, first: int):
        self.points, self.index = points, [first]
        p = points[:, first]
        self.r = np.array([[np.sqrt(1.0 + p @ p)]])
        self.inverse = 1.0 / self.r

    def add(self, j: int) -> bool:
        """False where point ``j`` lies in the hull but for rounding."""
        p, k = self.points[:, j], len(self.index)
        r = self.inverse.T @ (1.0 + self.points[:, self.index].T @ p)
        size = 1.0 + p @ p
        rest = size - r @ r
        if rest <= 1e-13 * size:
            return False
        rho = np.sqrt(rest)
        grown, inverse = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1))
        grown[:k, :k], grown[:k, k], grown[k, k] = self.r, r, rho
        inverse[:k, :k], inverse[:k, k], inverse[k, k] = self.inverse, -(self.inverse @ r) / rho, 1.0 / rho
        self.r, self.inverse = grown, inverse
        self.index.append(j)
        return True

    def keep(self, mask: np.ndarray) -> None:
        """Points without the mask go."""
        for k in np.flatnonzero(~mask)[::-1]:
            h = np.delete(self.r, k, axis=1)
            for i in range(k, h.shape[1]):
                a, b = h[i, i], h[i + 1, i]
                d = np.hypot(a, b)
                h[i:i + 2, i:] = np.array([[a / d, b / d], [-b / d, a / d]]) @ h[i:i + 2, i:]
            self.r = h[:-1]
            del self.index[k]
        self.inverse = np.linalg.inv(self.r)

    def nearest(self) -> np.ndarray:
        """Weights (they add up to 1, some may be negative)."""
        u = self.inverse @ self.inverse.sum(axis=0)
        return u / u.sum()


def min_norm_point(points: np.ndarray, tol: float = 1e-12, max_iter: int = 10_000) -> np.ndarray:
    """Weights w on the simplex minimising ||points @ w|| (Wolfe's exact
    minimum-norm-point algorithm; columns of ``points`` are the points).

    With ``points`` = centred returns scaled by sqrt(252 / (T - 1)) this is
    the long-only, fully invested minimum-variance portfolio: w' C w =
    ||X w||^2.  The active set stays affinely independent (at most T + 1
    names), so singular covariances (more names than bars) are handled and
    the answer is exact up to rounding, in a handful of iterations.  Each
    starts from the factor of the one before."""
    n = points.shape[1]
    sq = (points * points).sum(axis=0)
    scale = max(1.0, float(sq.max()))
    # the factor is that of 1 1' + Q'Q: points as large as 1 keep both parts
    unit = points / (np.sqrt(sq.max()) or 1.0)
    active = AffineSet(unit, int(np.argmin(sq)))
    lam = np.array([1.0])
    for _ in range(max_iter):
        x = points[:, active.index] @ lam
        g = points.T @ x
        j = int(np.argmin(g))
        if x @ x - g[j] <= tol * scale or j in active.index or not active.add(j):
            break
        lam = np.append(lam, 0.0)
        while True:  # minor cycle: affine minimiser of the active set
            mu = active.nearest()
            if np.all(mu > 1e-15):
                lam = mu
                break
            neg = mu <= 1e-15
            theta = np.min(lam[neg] / (lam[neg] - mu[neg]))
            lam = lam + theta * (mu - lam)
            keep = lam > 1e-15
            active.keep(keep)
            lam = lam[keep] / lam[keep].sum()
    w = np.zeros(n)
    w[active.index] = lam
    return w


def min_variance(returns: np.ndarray) -> np.ndarray:
    """Minimum-variance long-only weights for a (T x N) return matrix
    (annualised sample covariance, ddof = 1: the scale does not move the
    minimiser but keeps the objective comparable)."""
    t = returns.shape[0]
    x = (returns - returns.mean(axis=0)) * np.sqrt(TRADING_DAYS / (t - 1))
    return min_norm_point(x)


def _solver(group: Sequence[str]):
    """Per group: rows (ticker, dates, vec) of equal dates -> weights.  The
    arrays are stacked as they are: no pivot, fill or join in Python."""
    group = list(group)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker")
        x = np.stack(pdf["vec"].to_list(), axis=1)
        return pdf[group + ["ticker"]].assign(weight=min_variance(x).astype(float))
    return solve


def min_variance_weights(ret: DataFrame, group: Sequence[str] = ("rebalance_date",),
                         key="ticker", order="date", value="ret") -> DataFrame:
    """(group..., ticker, weight): long-only minimum-variance weights of each
    group, solved in parallel, one task per group.

    ``ret`` are complete-case returns: every ticker of a group on the same
    dates.  Spark folds them into one row per ticker, so a task gets (number
    of tickers of the group) arrays of (number of its dates) numbers -- all
    the solver needs, which cannot be spread further.  Groups with fewer
    than two dates have no covariance and give no rows."""
    group = list(group)
    if not group:
        raise ValueError("min_variance_weights needs a group key (one portfolio per group)")
    vec = (return_vectors(ret.withColumn(value, F.col(value).cast("double")), key, order, value, group)
           .filter(F.size("vec") > 1).select(*group, F.col(key).alias("ticker"), "vec"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vec.schema.fields if f.name in group)
    return vec.groupBy(*group).applyInPandas(_solver(group), schema + ", ticker string, weight double")


def complete_returns(dates: Sequence[np.ndarray], prices: Sequence[np.ndarray]) -> np.ndarray:
    """(T x N) simple returns of N price series on the union of their dates:
    each series carries its last price forward, and only dates on which all
    have a finite return stay (a zero previous price drops a date).

    No date before ``start``, the first bar of the name that begins last, can
    be complete: a name enters it with its last price until then, and the
    matrix has the later dates only."""
    n, sizes = len(dates), np.array([len(d) for d in dates])
    if not n or not sizes.all():
        return np.empty((0, n))
    name, at = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
    days, prices = np.concatenate(dates), np.concatenate(prices)
    days = np.where(np.isnan(days), np.inf, days)  # bars without a date are the last day's
    start = np.minimum.reduceat(days, at).max()
    known = np.maximum.reduceat(np.where(days <= start, days, -np.inf), at)[name]
    later = days >= known
    name, days, prices = name[later], np.maximum(days, start)[later], prices[later]
    calendar, day = np.unique(days, return_inverse=True)
    cell, size = day * n + name, len(calendar) * n
    count = np.bincount(cell, minlength=size)  # a day's prices are averaged
    with np.errstate(divide="ignore", invalid="ignore"):
        price = (np.bincount(cell, weights=prices, minlength=size) / count).reshape(-1, n)
        last = np.maximum.accumulate(np.where(count.reshape(-1, n) > 0, np.arange(len(calendar))[:, None], -1), axis=0)
        filled = np.where(last >= 0, price[last, np.arange(n)], np.nan)
        ret = filled[1:] / filled[:-1] - 1
    return ret[np.isfinite(ret).all(axis=1)]


def min_variance_from_slices(slices: DataFrame, group: str = "rebalance_date", key="ticker", order="date",
                             value="price") -> DataFrame:
    """Weights per group from ``market.bar_slices``: one row per name with its
    at most n bars goes to the group's task, which puts them on one calendar
    and solves.  (As Spark rows, that calendar would be names x the union of
    their dates, many times the bars.)"""
    known = F.filter("bars", lambda b: b[value].isNotNull())
    rows = slices.select(F.col(group), F.col(key).alias("ticker"), known.alias("__b")).filter(F.size("__b") > 0).select(
        group, "ticker", F.transform("__b", lambda b: F.unix_date(b[order])).alias("days"),
        F.transform("__b", lambda b: b[value].cast("double")).alias("vec"))
    kind = rows.schema[group].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("ticker").combine_chunks()
        ret = complete_returns(_lists(table.column("days")), _lists(table.column("vec")))
        if len(ret) < 2:
            table, weight = table.slice(0, 0), np.empty(0)
        else:
            weight = min_variance(ret)
        return pa.table({group: table.column(group), "ticker": table.column("ticker"), "weight": pa.array(weight, pa.float64())})

    # few bytes and much work: the dates are dealt to all tasks, whatever their size
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, group).groupBy(group).applyInArrow(solve, f"{group} {kind}, ticker string, weight double")


def portfolio_risk_return(weights: DataFrame, mu: DataFrame, cov: DataFrame,
                          group: Sequence[str] = ()) -> DataFrame:
    """Expected return w.mu and volatility sqrt(w' C w) from long tables
    (cov holds ticker_i <= ticker_j)."""
    g = list(group) or ["__g"]
    if not group:
        weights, mu, cov = (x.withColumn("__g", F.lit(0)) for x in (weights, mu, cov))
    ret = (weights.join(mu, [*g, "ticker"])
                  .groupBy(*g).agg(F.sum(F.col("weight") * F.col("mean_ret")).alias("exp_return")))
    wi = weights.select(*g, F.col("ticker").alias("ticker_i"), F.col("weight").alias("wi"))
    wj = weights.select(*g, F.col("ticker").alias("ticker_j"), F.col("weight").alias("wj"))
    quad = (cov.join(wi, [*g, "ticker_i"]).join(wj, [*g, "ticker_j"])
               .groupBy(*g).agg(F.sum(F.when(F.col("ticker_i") == F.col("ticker_j"), 1.0).otherwise(2.0)
                                      * F.col("wi") * F.col("wj") * F.col("cov")).alias("var")))
    out = ret.join(quad, g).select(*g, "exp_return",
                                   F.sqrt(F.greatest(F.col("var"), F.lit(0.0))).alias("volatility"))
    return out if group else out.drop("__g")


def scale_weights(df: DataFrame, by: str = "rebalance_date", weight: str = "weight",
                  out: str = "weight_scaled") -> DataFrame:
    """weight / total weight of its date."""
    return df.withColumn(out, F.try_divide(F.col(weight), F.sum(weight).over(Window.partitionBy(by))))


def equal_weights(signals: DataFrame, key="ticker", ts="ts", cap: int = PORTFOLIO_CAP) -> DataFrame:
    """(ticker, first_seen, weight): a symbol is bought at 1/N (N = number of
    symbols, capped at ``cap``) rounded to 3 decimals on first appearance."""
    first = signals.groupBy(key).agg(F.min(ts).alias("first_seen"))
    n = first.agg(F.least(F.count(F.lit(1)), F.lit(cap))).scalar()
    return first.select(key, "first_seen", F.bround(F.lit(1.0) / n, ENTRY_WEIGHT_DECIMALS).alias("weight"))


def monthly_rebalance(signals: DataFrame, prices: DataFrame, universe: DataFrame,
                      n_bars: int = M.HISTORY_BARS, inclusive: bool = False) -> DataFrame:
    """Month starts -> holdings (as-of last signal) -> last n bars per held
    ticker -> returns (forward-filled pivot, complete cases) -> minimum
    variance weights per date -> every universe ticker, missing -> 0.

    Prices, calendar, signals per period and weights are written while the
    plan is built: the call runs the work, the result only fills the
    universe.  In a ``stages()`` block what was written goes with the block."""
    # prices feed the calendar, the entries and the histories, the calendar
    # (one row per month) three steps: each is written once
    prices = cut_lineage(prices)
    cal = cut_lineage(M.first_trading_day(prices))
    held = portfolio_membership(signals, cal, prices, inclusive=inclusive)
    return weights_for_holdings(held, prices, universe, n_bars, inclusive)


def weights_for_holdings(held: DataFrame, prices: DataFrame, universe: DataFrame,
                         n_bars: int = M.HISTORY_BARS, inclusive: bool = False) -> DataFrame:
    """(rebalance_date, ticker) holdings -> last n bars -> minimum-variance
    weights per date -> every universe ticker listed, missing -> 0 (the
    second half of ``monthly_rebalance``, shared with the streaming form).
    The weights are written while the plan is built."""
    # the weights (dates x held names: small) feed both the date list and the
    # join of the universe fill; materialise them once so the solver runs once
    w = cut_lineage(min_variance_from_slices(M.bar_slices(prices, held, n_bars, inclusive=inclusive)))
    return join_universe_weights(universe, w, by=["rebalance_date"])
