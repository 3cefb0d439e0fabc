"""Structured Streaming forms of the signal -> portfolio state.

Sources are file streams (any directory of parquet files) with an explicit
schema; event time is cast from TIMESTAMP_NTZ to TIMESTAMP for watermarks.
Filings wait for their month start, and keys for their first event, in keyed
state (``transformWithState``) that Spark keeps in RocksDB and checkpoints
incrementally, so a batch costs what it brings, however many came before.

Running results are written with ``foreachBatch``: each micro-batch has a
folder of its own that a retry writes anew, every few batches the folders are
folded into a snapshot, and ``latest_state`` reads the newest snapshot and
the batches after it -- an idempotent, replay-safe upsert of bounded size.
Checkpoints live below the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from sigfolio.session import list_names, path_exists, remove_path, scratch_path

#: Filings and a month's buckets take rows that come up to a whole month late.
MONTH_DELAY = "31 days"
#: Tasks that share the filings of one ticker and month.
SALTS = 8
#: Micro-batches between two snapshots of a log.
FOLD_EVERY = 10

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed list and value state needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str | None = None,
                ts: str = "ts", max_files: int | None = None) -> DataFrame:
    """Parquet file stream; ``ts`` cast to TIMESTAMP (UTC session)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(directory)
    return s.withColumn(ts, F.col(ts).cast("timestamp"))


class _UntilMonthStart(StatefulProcessor):
    """Filings of one (ticker, due, salt): kept until event time reaches
    ``due``, then all given out; a filing that comes later than that is given
    out with the next batch.  Ids that were given out are remembered for a
    month more, so that a record delivered again is not a second filing."""

    DAY_MS = 86_400_000

    def __init__(self, schema: T.StructType, key: Sequence[str], remember_days: int):
        self.schema, self.key, self.remember = schema, list(key), remember_days * self.DAY_MS

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.schema)
        self.given = handle.getListState("given", T.StructType([self.schema[k] for k in self.key]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due = key[1]
        if due is not None:  # a clock row only moves the watermark
            self.kept.appendList([tuple(r[n] for n in self.schema.names) for r in rows])
            at = dt.datetime.combine(due, dt.time(), dt.timezone.utc)
            self.handle.registerTimer(max(int(at.timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.kept.exists():
            self.given.clear()
            return
        seen, new = ({tuple(k) for k in self.given.get()} if self.given.exists() else set()), []
        names = self.schema.names
        at = [names.index(k) for k in self.key]
        for r in self.kept.get():
            record = tuple(r[i] for i in at)
            if record not in seen:
                seen.add(record)
                new.append(record)
                yield Row(**dict(zip(names, r)))
        self.kept.clear()
        if new:
            self.given.appendList(new)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.remember)

    def close(self) -> None:
        pass


def stream_signals(filings: DataFrame, key: Sequence[str] = ("doc_id",), ts: str = "ts", text: str = "text", ticker: str = "ticker",
                   due: str = "due", delay: str = MONTH_DELAY, clock: DataFrame | None = None, salts: int = SALTS,
                   remember_days: int = 31) -> DataFrame:
    """Filings with text, each given out once (append mode) when event time
    passes ``due``, the month start after its date.

    Until then they are kept for their ticker in keyed list state; the filings
    of a ticker and month are spread over ``salts`` tasks.  Event time runs
    ``delay`` behind the newest row, so a filing that comes up to that much
    late still goes with its month; one that comes later goes with the next
    batch instead of being lost.  ``clock`` is a stream with a column ``ts``
    (the market's calendar, say) that moves event time where no filings come.
    A record (``key``) delivered again is given out once; filings without
    text or date are left out."""
    keyed_state(filings.sparkSession)
    has_text = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    rows = filings.filter(has_text & F.col(ts).isNotNull())
    schema = rows.schema
    rows = rows.withColumn(due, F.add_months(F.trunc(ts, "MM"), 1)).withColumn("__salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    if clock is not None:
        rows = rows.unionByName(clock.select(F.col("ts").alias(ts)), allowMissingColumns=True)
    # the watermark's own column goes, or rows behind the watermark would be dropped
    rows = rows.withColumn("__clock", F.col(ts)).withWatermark("__clock", delay).drop("__clock")
    out = rows.groupBy(ticker, due, "__salt").transformWithState(
        _UntilMonthStart(schema, key, remember_days), schema, "append", "eventTime")
    return out.withColumn(due, F.add_months(F.trunc(ts, "MM"), 1))


def due_filings(kept: DataFrame, month_start, ticker: str = "ticker", due: str = "due") -> DataFrame:
    """Of the accumulated filings, those that the run at ``month_start``
    takes, with the number that each ticker has."""
    return (kept.filter(F.col(due) == F.lit(month_start).cast("date"))
                .groupBy(ticker, due).agg(F.count(F.lit(1)).alias("n_filings")))


def stream_latest_position(events: DataFrame, key: str = "user_id", value: str = "event_type",
                           ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """Running latest value per key (update mode): state is one row per key."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, seq)).alias(value),
                                   F.max(ts).alias("last_ts"))


class _FirstOnly(StatefulProcessor):
    """One row for a key, its first event, in the batch that brings it."""

    def __init__(self, order: Sequence[str], columns: Sequence[str]):
        self.order, self.columns = list(order), list(columns)

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            pdf = pdf if first is None else pd.concat([first, pdf])
            first = pdf.sort_values(self.order, kind="stable").iloc[:1]
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first[self.columns]

    def close(self) -> None:
        pass


def stream_first_seen(events: DataFrame, path: str, checkpoint: str, key: str = "user_id", value: str = "event_type",
                      ts: str = "ts", seq: str = "event_id", trigger_once: bool = True):
    """Act once on a key's first appearance: a row (key, first_ts, value) is
    appended for each key that no earlier batch has had.

    Each key has one value of state, so a batch costs what it brings.  Before
    the shuffle every task reduces what it reads to the first event per key of
    each block of rows, so that a key with a third of the rows arrives as few.
    Rows without a key are left out."""
    keyed_state(events.sparkSession)
    order = [ts, seq]
    rows = events.select(key, value, ts, seq).filter(F.col(key).isNotNull())

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(order, kind="stable").drop_duplicates(key)

    out = T.StructType([rows.schema[key], T.StructField(ts, rows.schema[ts].dataType), rows.schema[value]])
    first = (rows.mapInPandas(firsts, rows.schema).groupBy(key)
             .transformWithStateInPandas(_FirstOnly(order, [key, ts, value]), out, "append", "none"))
    w = (first.withColumnRenamed(ts, "first_ts").writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``stream_first_seen`` has emitted."""
    return spark.read.parquet(path)


def stream_daily_buckets(events: DataFrame, key: str = "event_type", ts: str = "ts", value: str = "value",
                         delay: str = MONTH_DELAY) -> DataFrame:
    """Daily tumbling aggregates with a watermark (months are rolled up
    from days at read time: calendar months are not fixed-width windows).

    Windows are epoch (UTC) days; the local calendar day is part of the key
    too, so with a non-UTC session a local day may span two windows and the
    roll-up still adds the right rows.  State is evicted per window."""
    return (events.withWatermark(ts, delay)
                  .groupBy(F.window(ts, "1 day").alias("w"), F.to_date(ts).alias("day"), key)
                  .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
                  .select(F.col("w.start").alias("w_start"), "day", key, "n", "total"))


def upsert_log(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True,
               key: Sequence[str] = (), every: int = FOLD_EVERY):
    """Run ``stream`` in update mode; every micro-batch becomes a folder of
    the log at ``path``, named by its batch.

    With ``key`` the log stays bounded: every ``every`` batches the newest row
    per key is written as a snapshot, and what the snapshot before it had
    covered is removed (the folders of the last one stay for readers that
    have begun)."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/__batch={batch_id}")
        if key and (batch_id + 1) % every == 0:
            fold_log(spark, path, key, batch_id)

    w = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Batches up to which there is a whole snapshot, ascending."""
    found = [int(n.split("=")[1]) for n in list_names(spark, f"{path}/_snapshots") if n.startswith("upto=")]
    return sorted(b for b in found if path_exists(spark, f"{path}/_snapshots/upto={b}/_SUCCESS"))


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in list_names(spark, path) if n.startswith("__batch="))


def _log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The newest snapshot and the batches after it, with ``__batch``."""
    snaps = [s for s in _snapshots(spark, path) if upto is None or s <= upto]
    base = snaps[-1] if snaps else -1
    later = [b for b in _batches(spark, path) if b > base and (upto is None or b <= upto)]
    parts = []
    if snaps:
        parts.append(spark.read.parquet(f"{path}/_snapshots/upto={base}"))
    if later:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/__batch={b}" for b in later])
        parts.append(rows.withColumn("__batch", F.col("__batch").cast("long")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _newest(log: DataFrame, key: Sequence[str]) -> DataFrame:
    cols = [c for c in log.columns if c not in key and c != "__batch"]
    st = log.groupBy(*key).agg(F.max_by(F.struct(*cols), "__batch").alias("__s"), F.max("__batch").alias("__batch"))
    return st.select(*key, "__s.*", "__batch")


def fold_log(spark: SparkSession, path: str, key: Sequence[str], upto: int) -> None:
    """Write the snapshot of all batches up to ``upto``; remove the snapshots
    and batches that the one before it made needless."""
    whole = _snapshots(spark, path)
    if upto not in whole:
        _newest(_log(spark, path, upto), key).write.mode("overwrite").parquet(f"{path}/_snapshots/upto={upto}")
    before = [s for s in whole if s < upto]
    for s in before[:-1]:
        remove_path(spark, f"{path}/_snapshots/upto={s}")
    for b in _batches(spark, path):
        if before and b <= before[-1]:
            remove_path(spark, f"{path}/__batch={b}")


def latest_state(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """Newest row per key: snapshot and younger batches (a grouped max, no sort)."""
    log = _log(spark, path)
    if log is None:
        raise FileNotFoundError(f"no batch of a log at {path}")
    return _newest(log, key).drop("__batch")


def run_append(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **options):
    """Append-mode file sink (availableNow); returns the finished query."""
    w = stream.writeStream.outputMode("append").format(fmt).option("path", path) \
              .option("checkpointLocation", checkpoint)
    for k, v in options.items():
        w = w.option(k, v)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def month_rollup(days: DataFrame, key: str = "event_type") -> DataFrame:
    """Calendar-month totals from daily buckets."""
    return (days.groupBy(F.trunc("day", "MM").alias("month"), key)
                .agg(F.sum("n").alias("n"), F.sum("total").alias("total")))


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink path, checkpoint path) below the shared checkpoint folder."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/ckpt"
