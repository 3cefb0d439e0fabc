"""Point-in-time and keyed joins.

One plan per operator at every size: equi joins carry no hint, so adaptive
execution picks broadcast or sort-merge from real shuffle statistics and
splits skewed partitions.  Only the month calendar (one row per month) is
broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigfolio.functions.bloom import bloom_filter, may_contain
from sigfolio.functions.text import hash_text
from sigfolio.session import cut_lineage

def pair_join(a: DataFrame, b: DataFrame, keys: Sequence[str], n_blocks: int,
              block_key: str | None = None) -> DataFrame:
    """Every row of ``a`` meets every row of ``b`` with equal ``keys`` --
    without sending a whole key group to one task: ``a`` rows are spread
    over ``n_blocks`` blocks (by ``block_key`` hash), ``b`` rows are
    replicated once per block, and the equi-join runs on (keys, block).
    ``n_blocks`` is the caller's choice of tasks per key group."""
    # a deterministic block per row (a task retry recomputes the same block)
    bk = F.xxhash64(F.col(block_key)) if block_key else F.xxhash64(*[F.col(c) for c in a.columns])
    a2 = a.withColumn("__blk", F.pmod(bk, F.lit(n_blocks)))
    b2 = b.withColumn("__blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return a2.join(b2, [*keys, "__blk"]).drop("__blk")


def semi_membership(filings: DataFrame, members: DataFrame, key: str = "cik") -> DataFrame:
    """Keep filings whose key is a member; done before any text work."""
    return filings.join(members.select(key), key, "left_semi")


def join_ticker(filings: DataFrame, members: DataFrame, keys: Sequence[str] = ("cik", "ym"),
                ticker: str = "ticker") -> DataFrame:
    """Attach every ticker a filer had in the filing month (fan-out kept);
    filings without a ticker (or with a NULL key) are dropped."""
    m = members.select(*keys, ticker).filter(F.col(ticker).isNotNull()).distinct()
    return filings.join(m, list(keys), "inner")


def join_price_truth(filings: DataFrame, labelled: DataFrame, how: str = "left",
                     keys: Sequence[str] = ("date", "ticker"), truth: str = "truth") -> DataFrame:
    """Filings x labelled prices on (date, ticker), then rows without truth
    are dropped (``how='left'`` is therefore an inner join; ``'right'``
    keeps every labelled price and fans out on same-day filings)."""
    return filings.join(labelled, list(keys), how).filter(F.col(truth).isNotNull())


def join_texts_to_prices(prices: DataFrame, filings: DataFrame,
                         keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Every price row, with the filing texts of that day when present."""
    return prices.join(filings, list(keys), "left")


def join_universe_weights(universe: DataFrame, weights: DataFrame, key: str = "ticker",
                          by: Sequence[str] = (), weight: str = "weight") -> DataFrame:
    """Universe rows left-joined to weights; missing weight -> 0.

    With ``by`` (e.g. rebalance_date) every universe member is listed once
    per value of ``by`` found in the weights."""
    if by:
        dates = weights.select(*by).distinct()
        out = _expand(universe.select(key), dates, by).join(weights, [*by, key], "left")
    else:
        out = universe.join(weights, key, "left")
    return out.withColumn(weight, F.coalesce(F.col(weight), F.lit(0.0)))


def _expand(rows: DataFrame, dates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row of ``rows`` once per row of the small ``dates`` table.

    ``dates`` (rebalance dates: about 12 a year) is folded into one array --
    a scalar subquery evaluated once -- and each row explodes it: no shuffle,
    no join."""
    arr = dates.agg(F.sort_array(F.collect_list(F.struct(*by)))).scalar()
    return (rows.select(*rows.columns, F.explode(arr).alias("__s"))
                .select(*rows.columns, *[F.col("__s." + b).alias(b) for b in by]))


def with_position(df: DataFrame, order: str, series: str, out: str, step: str = "day",
                  tie: Sequence[str] = ()) -> DataFrame:
    """``out`` = position (from 1) of each row in its series by ``order``, a
    timestamp or date, and ``tie``, without sorting a whole series in one task: rows
    before a row's ``step`` come from summed counts (one row per series and
    step), and only the rows of one (series, step) are ranked together."""
    d = df.withColumn("__step", F.date_trunc(step, F.col(order)))
    before = Window.partitionBy(series).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    counts = (d.groupBy(series, "__step").agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
               .select(F.col(series).alias("__s"), F.col("__step").alias("__t"), "__base"))
    rank = F.row_number().over(Window.partitionBy(series, "__step").orderBy(order, *tie))
    same = F.col(series).eqNullSafe(F.col("__s")) & F.col("__step").eqNullSafe(F.col("__t"))
    return (d.withColumn("__r", rank).join(counts, same).withColumn(out, F.col("__base") + F.col("__r"))
             .drop("__step", "__r", "__s", "__t", "__base"))


def join_positional(a: DataFrame, b: DataFrame, order_a: str, order_b: str,
                    series: str = "strategy_id", step: str = "day", tie_a: Sequence[str] = (),
                    tie_b: Sequence[str] = ()) -> DataFrame:
    """Attach the i-th row of ``b`` to the i-th row of ``a`` within a series
    (pandas index alignment); rows of ``a`` beyond ``b`` get NULLs."""
    ia = with_position(a, order_a, series, "__i", step, tie_a)
    ib = with_position(b, order_b, series, "__i", step, tie_b)
    return ia.join(ib, [series, "__i"], "left").drop("__i")


def join_returns_on_date(portfolio: DataFrame, index: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Portfolio returns left-joined to index returns on date."""
    return portfolio.join(index, list(keys), "left")


# --- response cache -------------------------------------------------------

def latest_answers(cache: DataFrame, hash_col: str = "hashed_text", value: str = "response",
                   version: str = "updated_at") -> DataFrame:
    """(hash_col, value): one answer per hash, whatever the cache holds: the
    newest version that is not blank (without a version column, the greatest
    answer)."""
    order = F.struct(F.col(version), F.col(value)) if version in cache.columns else F.col(value)
    found = answered(cache.withColumn(value, F.col(value).cast("string")), value).filter(F.col("hashed_text").isNotNull())
    return found.groupBy(F.col("hashed_text").alias(hash_col)).agg(F.max_by(value, order).alias(value))


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a partner in ``keys``, rows that certainly have
    none), told apart by a Bloom filter of fixed size: the second never meet
    the join, so their texts are not shuffled."""
    may = may_contain(bloom_filter(keys, key), key)
    return df.filter(may), df.filter(~may)


def cache_lookup(df: DataFrame, cache: DataFrame, text_cols: Sequence[str],
                 hash_col: str = "hashed_text", out: str = "llm_response",
                 cache_value: str = "response") -> DataFrame:
    """Hash the texts and look the newest answer up; '' when absent or blank.
    Every row comes back once, however many cache rows its hash has."""
    known = latest_answers(cache, hash_col, cache_value).withColumnRenamed(cache_value, out)
    may, absent = split_by_keys(df.withColumn(hash_col, hash_text(*text_cols)), hash_col, known)
    found = may.join(known, hash_col, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))
    return found.unionByName(absent.withColumn(out, F.lit("")))


def cache_misses(df: DataFrame, cache: DataFrame, text_cols: Sequence[str],
                 hash_col: str = "hashed_text", cache_value: str = "response") -> DataFrame:
    """Rows whose text hash has no answer yet (the only ones sent to a
    model); a blank or NULL cached answer counts as none."""
    known = latest_answers(cache, hash_col, cache_value).select(hash_col)
    may, absent = split_by_keys(df.withColumn(hash_col, hash_text(*text_cols)), hash_col, known)
    return may.join(known, hash_col, "left_anti").unionByName(absent.select(hash_col, *[c for c in absent.columns if c != hash_col]))


def answered(cache: DataFrame, value: str = "response") -> DataFrame:
    """Cache entries that hold an answer."""
    return cache.filter(F.coalesce(F.col(value), F.lit("")) != "")


def cache_upsert(cache: DataFrame, new: DataFrame, key: str = "hashed_text",
                 value: str = "response", version: str = "updated_at") -> DataFrame:
    """Union old and new answers; per key the latest version wins
    (new rows win ties).  A portable MERGE: aggregate, no global sort."""
    old = cache.select(key, value, version, F.lit(0).alias("__src"))
    nw = new.select(key, value, version, F.lit(1).alias("__src"))
    order = F.struct(F.col(version), F.col("__src"))
    return (old.unionByName(nw).groupBy(key)
               .agg(F.max_by(value, order).alias(value), F.max(version).alias(version)))


def join_responses(requests: DataFrame, responses: DataFrame, key: str = "custom_id") -> DataFrame:
    """Re-attach answers to requests by id; a missing answer stays NULL."""
    return requests.join(responses, key, "left")


# --- as-of membership -----------------------------------------------------

def signal_periods(signals: DataFrame, calendar: DataFrame, key: str = "ticker", ts: str = "ts",
                   seq: str | None = "seq", value: str = "position", at: str = "rebalance_date",
                   inclusive: bool = False) -> DataFrame:
    """(key, at, value): the last signal of each key per rebalance period,
    where a signal first counts at the first rebalance date strictly after
    it (on or after with ``inclusive``).  A grouped ``max_by`` -- partial
    aggregation map-side, so a hot key collapses before the shuffle; also
    valid on a stream (update mode; state = keys x periods)."""
    day = F.col(ts).cast("date")
    order = F.struct(F.col(ts), F.col(seq)) if seq else F.col(ts)
    cal = F.broadcast(calendar.select("month", "start", "next_start"))
    visible_now = (day <= F.col("start")) if inclusive else (day < F.col("start"))
    bucketed = (signals.withColumn("month", F.trunc(day, "MM"))
                       .join(cal, "month")
                       .withColumn(at, F.when(visible_now, F.col("start")).otherwise(F.col("next_start")))
                       .filter(F.col(at).isNotNull()))
    return bucketed.groupBy(key, at).agg(F.max_by(value, order).alias(value))


def carry_forward(last: DataFrame, calendar: DataFrame, key: str = "ticker", value: str = "position",
                  at: str = "rebalance_date") -> DataFrame:
    """Every key on every rebalance date from its first period on, with the
    latest per-period value carried forward (a window per key over at most
    one row per rebalance date)."""
    dates = calendar.select(F.col("start").alias(at))
    start_of = last.groupBy(key).agg(F.min(at).alias("__from"))
    grid = _expand(start_of, dates, [at]).filter(F.col(at) >= F.col("__from")).drop("__from")
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return (grid.join(last.select(key, at, value), [key, at], "left")
                .withColumn(value, F.last(value, ignorenulls=True).over(w)))


def asof_last_signal(signals: DataFrame, calendar: DataFrame, key: str = "ticker", ts: str = "ts",
                     seq: str | None = "seq", value: str = "position", at: str = "rebalance_date",
                     inclusive: bool = False) -> DataFrame:
    """For every key and rebalance date: the latest signal dated strictly
    before the date (``inclusive`` -> on or before).

    ``calendar`` is the month table of ``first_trading_day``
    (month, start, next_start).  Signals are first reduced to the last one per
    (key, rebalance period) (``signal_periods``) and only that small table is
    carried forward per key (``carry_forward``).  That table is written while
    the plan is built: the call runs a job."""
    # the per-period table (keys x periods: small) is read twice by the
    # carry-forward; materialise it so the signals are scanned once
    last = cut_lineage(signal_periods(signals, calendar, key, ts, seq, value, at, inclusive))
    return carry_forward(last, calendar, key, value, at)


def first_held(prices: DataFrame, calendar: DataFrame, key: str = "ticker", order: str = "date",
               at: str = "rebalance_date", inclusive: bool = False) -> DataFrame:
    """(key, at): the first rebalance date after a symbol's first bar (on or
    after it with ``inclusive``)."""
    first = prices.groupBy(key).agg(F.min(order).alias("__first"))
    visible = (F.col("__first") <= F.col("start")) if inclusive else (F.col("__first") < F.col("start"))
    return (first.withColumn("month", F.trunc("__first", "MM"))
                 .join(F.broadcast(calendar.select("month", "start", "next_start")), "month")
                 .withColumn(at, F.when(visible, F.col("start")).otherwise(F.col("next_start")))
                 .filter(F.col(at).isNotNull()).select(key, at))


def portfolio_membership(signals: DataFrame, calendar: DataFrame, prices: DataFrame, key: str = "ticker",
                         value: str = "position", at: str = "rebalance_date", exit_value: str = "sell",
                         inclusive: bool = False, **kw) -> DataFrame:
    """Holdings per rebalance date: every symbol enters with its first bar in
    ``prices``, signals or not, and is out while its latest signal before the
    date is ``exit_value``.  The signals per period are written while the
    plan is built: the call runs a job."""
    periods = cut_lineage(signal_periods(signals, calendar, key, value=value, at=at, inclusive=inclusive, **kw))
    return holdings(periods, first_held(prices, calendar, key, at=at, inclusive=inclusive), calendar, key, value, at, exit_value)


def holdings(periods: DataFrame, entry: DataFrame, calendar: DataFrame, key: str = "ticker", value: str = "position",
             at: str = "rebalance_date", exit_value: str = "sell") -> DataFrame:
    """(at, key) of the symbols held: from ``entry`` (first rebalance date of
    each) on, unless the latest of ``periods`` (key, at, value) is the exit.
    The entry is a position without a signal; a signal of the same period
    comes after it.

    Each period holds until the key's next one, so one ordered pass per key
    (at most a row per rebalance date and the entry) gives spans of dates,
    and a span that is held lists its dates: the calendar meets no join."""
    blank = entry.select(key, at, F.lit("").alias(value), F.lit(0).alias("__src"))
    both = blank.unionByName(periods.select(key, at, value, F.lit(1).alias("__src")))
    both = both.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    run = Window.partitionBy(key).orderBy(at, "__src")
    spans = (both.withColumn("__until", F.lead(at).over(run))
             .withColumn("__from", F.max(F.when(F.col("__src") == 0, F.col(at))).over(Window.partitionBy(key)))
             .filter((F.col(value) != exit_value) & F.col("__from").isNotNull())
             .withColumn("__from", F.greatest(at, "__from")).filter(F.col("__until").isNull() | (F.col("__until") > F.col("__from"))))
    dates = calendar.agg(F.sort_array(F.collect_set("start"))).scalar()  # about 12 a year
    inside = F.filter("__dates", lambda d: (d >= F.col("__from")) & (F.col("__until").isNull() | (d < F.col("__until"))))
    return spans.withColumn("__dates", dates).select(F.explode(inside).alias(at), key)
