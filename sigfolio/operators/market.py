"""Price-series windows: rolling means, labels, returns, bars, bands.

Partitioning: every window here partitions by the series key (ticker or
strategy) and orders by date.  Inputs are one row per (key, date) -- the
bindings and ``resample_bars`` pre-aggregate to that grain first with a
map-side partial aggregate -- so a window partition is bounded by the length
of the trading calendar, not by the data volume behind a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reference: label window length and annualisation.
LABEL_WINDOW = 10
TRADING_DAYS = 252
BOLLINGER_N, BOLLINGER_K = 30, 2
HISTORY_BARS = 30
#: Rows that one task sorts.
SORT_ROWS = 500_000


def _w(key, order, tie: Sequence[str] = ()):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(*([order] + list(tie)))


def rolling_mean(df: DataFrame, n: int = LABEL_WINDOW, key="ticker", order="date",
                 value="price", out="prc_rolling", tie: Sequence[str] = ()) -> DataFrame:
    """Trailing n-row mean (current row included); NULL until n rows exist.
    Rows with a NULL value are dropped first."""
    w = _w(key, order, tie).rowsBetween(-(n - 1), 0)
    return (df.filter(F.col(value).isNotNull())
              .withColumn(out, F.when(F.count(value).over(w) == n, F.avg(value).over(w))))


def label_truth(df: DataFrame, n: int = LABEL_WINDOW, key="ticker", order="date", value="price",
                out="truth", direction: str = "trailing", tie: Sequence[str] = ()) -> DataFrame:
    """'buy' / 'sell' labels from a price window.

    trailing (the reference code): buy when price <= mean of the last n rows
    (current included); warm-up rows are 'sell'.  The comparison is exact:
    ``n * price <= sum(window)`` on decimals (floating prices are cast to
    DECIMAL(18,6)), never a float mean.
    forward (the documented variant): buy when the mean of the next n rows is
    greater than the price; rows without n following rows get NULL.
    """
    base = df.filter(F.col(value).isNotNull())
    if dict(base.dtypes)[value] in ("double", "float"):
        # compare exactly: floating prices are compared as DECIMAL(18,6)
        base = base.withColumn(value, F.col(value).cast("decimal(18,6)"))
    if direction == "trailing":
        w = _w(key, order, tie).rowsBetween(-(n - 1), 0)
        cnt, tot = F.count(value).over(w), F.sum(value).over(w)
        lab = F.when((cnt == n) & (F.col(value) * F.lit(n) <= tot), "buy").otherwise("sell")
    elif direction == "forward":
        w = _w(key, order, tie).rowsBetween(1, n)
        cnt, tot = F.count(value).over(w), F.sum(value).over(w)
        lab = F.when(cnt == n, F.when(tot > F.col(value) * F.lit(n), "buy").otherwise("sell"))
    else:
        raise ValueError(direction)
    return base.withColumn(out, lab)


def pct_change(df: DataFrame, key="ticker", order="date", value="price", out="ret") -> DataFrame:
    """Simple return vs the previous row after forward-filling NULL prices.

    Interior gaps give 0, leading NULLs stay NULL, a zero previous price gives
    NULL (pandas would give inf)."""
    w = _w(key, order)
    filled = "__filled"
    return (df.withColumn(filled, F.last(F.col(value).cast("double"), ignorenulls=True)
                          .over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn(out, F.try_divide(F.col(filled), F.lag(filled).over(w)) - F.lit(1.0))
              .drop(filled))


def pivot_grid(df: DataFrame, key="ticker", order="date", value="price",
               group: Sequence[str] = ()) -> DataFrame:
    """Long form of a (date x ticker) pivot: every ticker on every date of
    its group's calendar; duplicate cells averaged, missing cells NULL.

    The calendar is one sorted date array per group; each ticker row explodes
    it, so no pair of data rows is ever formed."""
    group = list(group)
    cells = df.groupBy(*group, key, order).agg(F.avg(value).alias(value))
    tickers = cells.select(*group, key).distinct()
    if group:
        cal = cells.groupBy(*group).agg(F.array_sort(F.collect_set(order)).alias("__cal"))
        grid = tickers.join(cal, group)
    else:  # one calendar: a scalar subquery, no join
        grid = tickers.withColumn("__cal", cells.agg(F.array_sort(F.collect_set(order))).scalar())
    grid = grid.select(*group, key, F.explode("__cal").alias(order))
    return grid.join(cells, [*group, key, order], "left")


def panel_returns(df: DataFrame, key="ticker", order="date", value="price", out="ret",
                  group: Sequence[str] = (), packed: bool = False) -> DataFrame:
    """pandas ``pivot_table(...).pct_change()`` in long form: forward fill
    across the union of dates, then simple returns.

    With ``packed`` a row is the whole series of a key: ``order`` its day
    numbers (ascending, each once) and ``value`` its prices; ``out`` are its
    returns on the calendar of its group, one for each day of it."""
    if packed:
        return _packed_returns(df, key, order, value, out, list(group))
    grid = pivot_grid(df, key, order, value, group)
    return pct_change(grid, key=[*group, key], order=order, value=value, out=out)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, which of them are known, length of each list)."""
    values = column.flatten()
    return (values.to_numpy(zero_copy_only=False), np.asarray(values.is_valid()),
            column.value_lengths().to_numpy(zero_copy_only=False))


def _packed_returns(series: DataFrame, key: str, order: str, value: str, out: str, group: list[str]) -> DataFrame:
    """The returns of ``panel_returns`` as one array per series.  Only the
    calendars, one row per group, go to all tasks; no row of a series is
    shuffled, and a cell of the grid is a number, not a row."""
    cal = (series.select(*group, F.explode(order).alias(order)).distinct()
                 .groupBy(*group).agg(F.array_sort(F.collect_list(order)).alias("__cal")))
    rows = series.select(*group, key, order, value).join(F.broadcast(cal), group).select(*group, key, order, value, "__cal")
    schema = T.StructType([*(rows.schema[c] for c in [*group, key]), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days, _, count = _flat(batch.column(order))
            price, known, _ = _flat(batch.column(value))
            cal, _, size = _flat(batch.column("__cal"))
            n, cells = np.arange(batch.num_rows), len(cal)
            known = known & np.repeat(np.asarray(batch.column(key).is_valid()), count)
            # cells are numbered row by row, a row's in the order of its calendar
            low, span = (int(cal.min()), int(cal.max()) - int(cal.min()) + 1) if cells else (0, 1)
            begin = np.repeat(np.cumsum(size) - size, size)
            cell = np.searchsorted(np.repeat(n, size) * span + (cal - low), np.repeat(n, count) * span + (days - low))[known]
            prices, last, at = np.full(cells, np.nan), np.full(cells, -1), np.arange(cells)
            prices[cell], last[cell] = price[known], cell
            last = np.maximum.accumulate(last)
            filled = prices[last]
            has = last >= begin  # else the price is another series'
            before, had = np.roll(filled, 1), np.roll(has, 1) & (at > begin)
            ok = has & had & (before != 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                ret = pa.array(filled / before - 1, mask=~ok)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), ret)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*group, key]), lists], names=[*group, key, out])

    return rows.mapInArrow(run, schema)


def pivot_prices(df: DataFrame, tickers: Sequence[str], key="ticker", order="date", value="price") -> DataFrame:
    """One row per date, one column per given ticker: the mean of its cells,
    NULL where it has none.  The column list is the caller's, so the plan is
    one aggregate and needs no pass to find the values."""
    return df.groupBy(order).pivot(key, list(tickers)).agg(F.avg(value))


def complete_case_returns(ret: DataFrame, key="ticker", order="date", value="ret",
                          group: Sequence[str] = (), packed: bool = False) -> DataFrame:
    """Keep only dates on which every ticker of the grid has a return.

    With ``packed`` (``panel_returns``) a row has the returns of a ticker, and
    those of the other days leave its array; ``ret`` is read twice."""
    if packed:
        days = ret.select(*group, F.posexplode(value).alias("__day", "__ret")).groupBy(*group, "__day")
        kept = (days.agg(F.count("__ret").alias("__n_ok"), F.count(F.lit(1)).alias("__n_all")).filter(F.col("__n_ok") == F.col("__n_all"))
                    .groupBy(*group).agg(F.array_sort(F.collect_list("__day")).alias("__kept")))
        return (ret.join(F.broadcast(kept), list(group))
                   .withColumn(value, F.transform("__kept", lambda i: F.get(value, i))).drop("__kept"))
    w = Window.partitionBy(*group, order)
    return (ret.withColumn("__n_ok", F.count(value).over(w))
               .withColumn("__n_all", F.count(F.lit(1)).over(w))
               .filter(F.col("__n_ok") == F.col("__n_all"))
               .drop("__n_ok", "__n_all"))


def cumulative_return(df: DataFrame, key="strategy_id", order="date", value="ret",
                      out="cum_ret", compound: bool = False) -> DataFrame:
    """Running sum of returns per series; the first row is forced to 0.
    ``compound=True`` gives prod(1 + r) - 1 instead."""
    w = _w(key, order)
    r = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.coalesce(F.col(value), F.lit(0.0)))
    step = df.withColumn("__r", r)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    if compound:
        acc = F.exp(F.sum(F.log1p(F.col("__r"))).over(run)) - 1
    else:
        acc = F.sum("__r").over(run)
    return step.withColumn(out, acc).drop("__r")


def every_kth(df: DataFrame, array_col: str, k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Explode an array keeping every k-th element (0, k, 2k, ...)."""
    return (df.select(*keep, F.posexplode(array_col).alias("pos", "value"))
              .filter(F.col("pos") % k == 0))


def bollinger_bands(df: DataFrame, n: int = BOLLINGER_N, k: float = BOLLINGER_K, key="ticker",
                    order="date", value="price") -> DataFrame:
    """n-row mean +- k population standard deviations; NULL until n rows.

    One exchange on the key; rows pass in order, the n - 1 before a batch go
    with it, and the frames of a batch are one array (a Spark window feeds
    every row to each of its aggregates n times)."""
    keys = [key] if isinstance(key, str) else list(key)
    placed = df.withColumn("__v", F.col(value).cast("double")).repartition(*keys).sortWithinPartitions(*keys, order)
    bands = ("middle", "upper", "lower")
    schema = T.StructType([*(f for f in df.schema if f.name not in bands), *(T.StructField(b, T.DoubleType()) for b in bands)])
    kept = [f.name for f in schema][:-len(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last rows of the batch before
        for batch in batches:
            if not batch.num_rows:
                continue
            held = 0 if before is None else before.num_rows
            rows = pa.Table.from_batches([batch] if before is None else [before, batch]).combine_chunks()
            ids = [rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in keys]
            new = np.r_[True, np.any([i[1:] != i[:-1] for i in ids], axis=0)]
            place = np.arange(rows.num_rows)
            known = np.r_[0, np.cumsum(np.asarray(rows.column("__v").is_valid()))]
            # full frames: n rows of one key, none NULL
            last = place[held:][place[held:] - np.maximum.accumulate(np.where(new, place, 0))[held:] >= n - 1]
            last = last[known[last + 1] - known[last + 1 - n] == n]
            v = rows.column("__v").combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False)
            middle, sd = (np.full(rows.num_rows, np.nan) for _ in range(2))
            if len(last):
                frames = np.lib.stride_tricks.sliding_window_view(v, n)[last + 1 - n]
                with np.errstate(invalid="ignore", over="ignore"):
                    middle[last], sd[last] = frames.mean(axis=1), frames.std(axis=1)
            none = np.ones(rows.num_rows, bool)
            none[last] = False
            with np.errstate(invalid="ignore", over="ignore"):
                out = [pa.array(x[held:], mask=none[held:]) for x in (middle, middle + k * sd, middle - k * sd)]
            own = rows.slice(held).select(kept).combine_chunks()
            yield from pa.table([*own.columns, *out], names=[*kept, *bands]).to_batches()
            # (slices of a table keep all of it: the rows to go on with are copied)
            before = rows.take(pa.array(place[max(0, len(place) - n + 1):])).combine_chunks().to_batches()[0] if n > 1 else None

    return placed.mapInArrow(run, schema)


def first_trading_day(df: DataFrame, order="date") -> DataFrame:
    """(month, start, next_start): first trading date of each month of the
    calendar, and the next month's first trading date.

    The month table is tiny (about 12 rows a year); the next month's start
    is looked up in its sorted list of starts, a scalar subquery computed
    once -- no single-partition window."""
    months = (df.groupBy(F.trunc(order, "MM").alias("month"))
                .agg(F.min(order).alias("start")))
    starts = months.agg(F.array_sort(F.collect_list("start"))).scalar()
    nxt = F.filter("__starts", lambda s: s > F.col("start"))
    return (months.withColumn("__starts", starts)
                  .withColumn("next_start", F.try_element_at(nxt, F.lit(1))).drop("__starts"))


def resample_bars(df: DataFrame, duration: str = "1 day", key="ticker", ts="ts", value="value",
                  seq: str | None = None) -> DataFrame:
    """OHLC bars from finer records: open/close by (ts, seq) order."""
    order = F.struct(F.col(ts), F.col(seq)) if seq else F.col(ts)
    return (df.groupBy(key, F.window(ts, duration).alias("bar"))
              .agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"),
                   F.min(value).alias("low"), F.max_by(value, order).alias("close"),
                   F.count(F.lit(1)).alias("n"))
              .select(key, F.col("bar.start").alias("bar_start"), F.col("bar.end").alias("bar_end"),
                      "open", "high", "low", "close", "n"))


def last_n_bars(prices: DataFrame, requests: DataFrame, n: int = HISTORY_BARS, key="ticker",
                order="date", at="rebalance_date", inclusive: bool = False, partitions: int | None = None) -> DataFrame:
    """For each request (key, at): the last n bars of ``key`` dated strictly
    before ``at`` (or on/before when ``inclusive``), a row each."""
    slices = bar_slices(prices, requests, n, key, order, at, inclusive, partitions)
    return slices.select(key, at, F.explode("bars").alias("__b")).select(key, at, "__b.*")


def sort_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of at most SORT_ROWS rows each on average, so that what a
    task sorts does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORT_ROWS))


def bar_slices(prices: DataFrame, requests: DataFrame, n: int = HISTORY_BARS, key="ticker",
               order="date", at="rebalance_date", inclusive: bool = False, partitions: int | None = None) -> DataFrame:
    """(key, at, bars): the bars of ``last_n_bars`` as one sorted array per
    request; requests without any bar have no row.

    One exchange on the key: bars and requests pass in one order, and the
    frame of the last ``n`` bars goes with them from batch to batch, so a task
    holds a batch and ``n`` bars, however long a key's history is.
    ``partitions`` (``sort_partitions``) fixes the tasks that sort them, which
    adaptive execution would else make as few as there are cores.
    """
    req = requests.select(key, at).distinct()
    rest = [c for c in prices.columns if c != key]
    bar = F.struct(*rest)
    none = F.lit(None).cast(T.StructType([prices.schema[c] for c in rest]))
    u = (prices.select(key, F.col(order).alias("__t"), F.lit(None).cast(req.schema[at].dataType).alias(at), bar.alias("__bar"))
               .unionByName(req.select(key, F.col(at).alias("__t"), at, none.alias("__bar"))))
    is_bar = F.col("__bar").isNotNull()
    tie = is_bar.desc() if inclusive else is_bar.asc()
    placed = (u.repartition(partitions, key) if partitions else u.repartition(key)).sortWithinPartitions(key, "__t", tie, "__bar").select(key, at, "__bar")
    kinds = {f.name: f.dataType for f in placed.schema}
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(at, kinds[at]), T.StructField("bars", T.ArrayType(kinds["__bar"]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = None  # the last bars of the key that the batch before ended with
        for batch in batches:
            rows = pa.Table.from_batches([batch] if frame is None else [frame, batch]).combine_chunks()
            if not rows.num_rows:
                continue
            known = np.asarray(rows.column("__bar").is_valid())
            code = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.r_[True, code[1:] != code[:-1]]
            bars = np.cumsum(known)  # bars up to each row, over all keys
            begin = np.maximum.accumulate(np.where(first, bars - known, 0))  # and before its key
            asked = np.flatnonzero(~known & (bars > begin))
            low = np.maximum(bars[asked] - n, begin[asked])
            sizes = bars[asked] - low
            place = np.flatnonzero(known)
            ends = np.cumsum(sizes)
            flat = place[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(low, sizes)]
            found = rows.select([key, at]).take(asked).combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), rows.column("__bar").take(flat).combine_chunks())
            out = pa.table({key: found.column(0), at: found.column(1), "bars": lists})
            yield from out.to_batches()
            last = place[place >= np.flatnonzero(first)[-1]][-n:]
            frame = rows.take(last).combine_chunks().to_batches()[0] if len(last) else None

    return placed.mapInArrow(run, schema)
