"""Streams over several files / micro-batches equal the batch answer, and a
re-run with no new input changes nothing (replay-safe upsert log)."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from conftest import SF001
from sigfolio.operators.joins import cache_upsert
from sigfolio.plans import bindings as B
from sigfolio.streaming import signals as S


def _split_events(spark, tmp_path):
    ev = B.table(spark, SF001, "events")
    src = str(tmp_path / "events_src")
    for i in range(3):  # three files, one per micro-batch
        ev.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    return ev, src


def test_latest_position_over_microbatches(spark, tmp_path):
    ev, src = _split_events(spark, tmp_path)
    stream = S.read_stream(spark, src, ev.schema, max_files=1)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    S.upsert_log(S.stream_latest_position(stream), out, ck).awaitTermination()
    assert spark.read.parquet(out).select("__batch").distinct().count() == 3
    got = {r.user_id: r.event_type for r in S.latest_state(spark, out, ["user_id"]).collect()}
    want = {r.user_id: r.e for r in ev.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want
    # a second run finds no new files: the log and the state are unchanged
    n = spark.read.parquet(out).count()
    S.upsert_log(S.stream_latest_position(S.read_stream(spark, src, ev.schema, max_files=1)), out, ck) \
        .awaitTermination()
    assert spark.read.parquet(out).count() == n
    assert {r.user_id: r.event_type for r in S.latest_state(spark, out, ["user_id"]).collect()} == want


def _day(month, day, hour=12):
    return dt.datetime(2024, month, day, hour, tzinfo=dt.timezone.utc)


def _arrive(spark, src, batches, schema="doc_id long, ticker string, ts timestamp, text string"):
    """One file per micro-batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def _given(stream, ck):
    """What each micro-batch gave out."""
    out = []
    w = stream.writeStream.outputMode("append").foreachBatch(lambda b, i: out.append(sorted(tuple(r) for r in b.select("doc_id", "due").collect())))
    w.option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return out


def test_filings_leave_at_their_month_start(spark, tmp_path):
    batches = [
        [(1, "a", _day(1, 5), "x"), (2, "b", _day(1, 20), "y"), (90, "a", _day(1, 6), "  "), (91, "a", None, "no date")],
        [(3, "a", _day(2, 10), "z"), (3, "a", _day(2, 10), "z")],
        [(4, "a", _day(1, 21), "twenty days late"), (5, "b", _day(3, 5), "w")],  # event time is now 3 February
        [(6, "a", _day(4, 20), "q"), (1, "a", _day(1, 5), "x")],                 # the first one again
        [(7, "a", _day(1, 2), "months late"), (8, "c", _day(5, 20), "r")],
        [(9, "c", _day(9, 20), "last")],
    ]
    stream = S.stream_signals(_arrive(spark, str(tmp_path / "src"), batches))
    feb, mar, apr, may, jun = (dt.date(2024, m, 1) for m in (2, 3, 4, 5, 6))
    given = _given(stream, str(tmp_path / "ck"))
    # each batch gives out what event time passed with the batch before it
    assert given[:3] == [[], [], []]
    assert given[3] == [(1, feb), (2, feb), (4, feb)]
    assert given[4] == [(3, mar)]
    assert given[5] == [(5, apr), (7, feb)]
    assert given[6:] == [[(6, may), (8, jun)]]
    # nothing is lost: the last filing waits in state for the next run, which goes on from the checkpoint
    more = S.stream_signals(_arrive(spark, str(tmp_path / "src"), [[(10, "c", _day(12, 30), "later")]]))
    assert _given(more, str(tmp_path / "ck"))[-1] == [(9, dt.date(2024, 10, 1))]


def test_a_clock_lets_the_month_start_come(spark, tmp_path):
    """One busy ticker over several tasks, every filing twice, and a clock."""
    ev = B.table(spark, SF001, "events")
    src, ticks = str(tmp_path / "events"), str(tmp_path / "ticks")
    parts = [ev.filter(F.col("event_id") % 3 == k) for k in range(3)]
    for p in [*parts, parts[0]]:
        p.coalesce(1).write.mode("append").parquet(src)
    end = ev.agg(F.add_months(F.max("ts").cast("date"), 3).cast("timestamp").alias("ts"))
    end.coalesce(1).write.parquet(ticks)
    stream = S.read_stream(spark, src, ev.schema).withColumn("ticker", F.lit("one"))
    stream = stream.withColumn("text", F.when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(F.col("event_type")))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    S.run_append(S.stream_signals(stream, ["event_id"], clock=spark.readStream.schema(end.schema).parquet(ticks)), out, ck)
    kept = spark.read.parquet(out)
    want = ev.filter(F.col("event_id") % 5 != 0)
    assert sorted(r.event_id for r in kept.collect()) == sorted(r.event_id for r in want.collect())
    due = {r.due: r.n for r in kept.groupBy("due").agg(F.count("*").alias("n")).collect()}
    assert due == {r.due: r.n for r in want.groupBy(F.add_months(F.trunc("ts", "MM"), 1).alias("due")).agg(F.count("*").alias("n")).collect()}
    first = min(due)
    assert [(r.ticker, r.n_filings) for r in S.due_filings(kept, first).collect()] == [("one", due[first])]


def test_first_seen_is_emitted_once_per_key(spark, tmp_path):
    ev, src = _split_events(spark, tmp_path)
    out, ck = str(tmp_path / "first"), str(tmp_path / "first_ck")
    S.stream_first_seen(S.read_stream(spark, src, ev.schema, max_files=1), out, ck).awaitTermination()
    got = S.first_seen(spark, out).collect()
    assert len(got) == len({r.user_id for r in got}) == ev.select("user_id").distinct().count()
    # a key's row is its first event of the first batch that has it
    seen, want = set(), {}
    files = sorted(f for f in os.listdir(src) if f.endswith(".parquet"))
    per_file = [spark.read.parquet(f"{src}/{f}") for f in sorted(files, key=lambda f: os.stat(f"{src}/{f}").st_mtime_ns)]
    for batch in per_file:
        rows = batch.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("e")).collect()
        want.update({r.user_id: r.e for r in rows if r.user_id not in seen})
        seen |= {r.user_id for r in rows}
    assert {r.user_id: r.event_type for r in got} == want
    # a later run with a known and a new key emits the new one only
    last = ev.limit(2).withColumn("user_id", F.when(F.col("event_id") == ev.first().event_id, F.lit(got[0].user_id)).otherwise(F.lit(10 ** 9)))
    last.coalesce(1).write.mode("append").parquet(src)
    S.stream_first_seen(S.read_stream(spark, src, ev.schema, max_files=1), out, ck).awaitTermination()
    again = S.first_seen(spark, out)
    assert again.count() == len(got) + 1 and again.filter(F.col("user_id") == 10 ** 9).count() == 1


def test_a_log_of_many_batches_stays_small(spark, tmp_path):
    """Fifty batches over ten keys: what a reader opens does not grow."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "k long, v long, ts timestamp"
    for b in range(50):
        spark.createDataFrame([(b % 10, b, _day(1, 1)), ((b + 1) % 10, b, _day(1, 1))], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    totals = stream.groupBy("k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    S.upsert_log(totals, out, ck, key=["k"], every=5).awaitTermination()
    want = {r.k: (r.total, r.n) for r in spark.read.schema(schema).parquet(src).groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n")).collect()}
    assert {r.k: (r.total, r.n) for r in S.latest_state(spark, out, ["k"]).collect()} == want
    assert len([n for n in os.listdir(out) if n.startswith("__batch=")]) <= 10
    assert len([n for n in os.listdir(f"{out}/_snapshots") if n.startswith("upto=")]) <= 2
    # a snapshot that was begun and not finished counts for nothing
    os.remove(f"{out}/_snapshots/upto=49/_SUCCESS")
    assert {r.k: (r.total, r.n) for r in S.latest_state(spark, out, ["k"]).collect()} == want
    S.fold_log(spark, out, ["k"], 49)
    assert {r.k: (r.total, r.n) for r in S.latest_state(spark, out, ["k"]).collect()} == want


def test_month_buckets_take_rows_of_the_whole_month(spark, tmp_path):
    import datetime as dt
    src, schema = str(tmp_path / "late_src"), "ts timestamp_ntz, event_type string, value double"
    batches = [[2, 3], [21, 22], [2, 30]]  # days of January; the third brings a row of the 2nd
    for days in batches:
        spark.createDataFrame([(dt.datetime(2024, 1, d, 12), "a", 1.0) for d in days], schema).coalesce(1).write.mode("append").parquet(src)
    out, ck = str(tmp_path / "late"), str(tmp_path / "late_ck")
    stream = S.read_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
    S.upsert_log(S.stream_daily_buckets(stream), out, ck).awaitTermination()
    days = S.latest_state(spark, out, ["w_start", "day", "event_type"])
    assert [r.n for r in S.month_rollup(days).collect()] == [6]


def test_cache_upsert_idempotent(spark):
    old = spark.createDataFrame([("h1", "buy", 1), ("h2", "sell", 1)], "hashed_text string, response string, updated_at long")
    new = spark.createDataFrame([("h2", "buy", 2), ("h3", "sell", 2)], "hashed_text string, response string, updated_at long")
    once = cache_upsert(old, new)
    twice = cache_upsert(once, new)
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    assert dict((r[0], r[1]) for r in a) == {"h1": "buy", "h2": "buy", "h3": "sell"}
