"""One model call per distinct new text, and a cache that keeps the answers."""

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigfolio.functions.bloom import bloom_filter, may_contain
from sigfolio.functions.text import hash_text
from sigfolio.operators import joins as J
from sigfolio.operators.classify import classify, compact_answers, read_answers
from sigfolio.session import cut_lineage, path_exists, scratch_path, stages


def counted(spark):
    """A classifier that counts the texts it is asked for."""
    calls = spark.sparkContext.accumulator(0)

    def ask(pdf):
        calls.add(len(pdf))
        return pd.Series([None if t == "mute" else f"say {t}" for t in pdf["text"]])
    return calls, ask


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


TEXTS = ["a", "a", "a", "b", "c", "c", "mute", None, "", "known", "known", "blank"] * 4


def cache(spark):
    """Two versions of one hash, one of them blank, and a hash seen twice."""
    rows = [("known", "old", 1), ("known", "new", 2), ("known", "", 3), ("blank", "", 9), ("other", "x", 1), (None, "y", 1)]
    c = spark.createDataFrame(rows, "text string, response string, updated_at long")
    return c.select(F.when(F.col("text").isNotNull(), hash_text("text")).alias("hashed_text"), "response", "updated_at")


def test_calls_are_the_distinct_misses(spark):
    calls, ask = counted(spark)
    got = classify(frame(spark, TEXTS), ask, ["text"], cache(spark))
    want = {"a": "say a", "b": "say b", "c": "say c", "mute": None, None: "say ", "": "say ", "known": "new", "blank": "say blank"}

    def ask_text(t):
        return "say None" if t is None else want[t]
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    assert calls.value == len({"a", "b", "c", "mute", "", "blank"})  # NULL and '' have one hash
    assert all(r.label in ({"say ", "say None"} if not r.text else {want[r.text]}) for r in rows)
    got.count()
    assert calls.value == 6  # reading the result again asks nothing


def test_second_run_asks_nothing(spark):
    store = scratch_path(spark, "answer-store")
    calls, ask = counted(spark)
    first = sorted(map(str, classify(frame(spark, TEXTS[:5]), ask, ["text"], store=store).collect()))
    assert calls.value == 3 and path_exists(spark, store)
    assert sorted(map(str, classify(frame(spark, TEXTS[:5]), ask, ["text"], store=store).collect())) == first
    assert calls.value == 3
    classify(frame(spark, ["b", "d", "mute"]), ask, ["text"], store=store).collect()
    assert calls.value == 5
    classify(frame(spark, ["mute"]), ask, ["text"], store=store).collect()
    assert calls.value == 6  # no answer is not cached
    compact = spark.read.parquet(compact_answers(spark, store))
    assert compact.count() == compact.select("hashed_text").distinct().count() == read_answers(spark, store).count() == 4


def test_lookup_keeps_the_rows(spark):
    df = frame(spark, TEXTS)
    got = J.cache_lookup(df, cache(spark).unionByName(cache(spark)), ["text"])
    assert sorted(r.id for r in got.collect()) == list(range(len(TEXTS)))
    assert {(r.text, r.llm_response) for r in got.collect()} == {(t, "new" if t == "known" else "") for t in TEXTS}
    miss = J.cache_misses(df, cache(spark), ["text"])
    assert sorted(r.id for r in miss.collect()) == [k for k, t in enumerate(TEXTS) if t != "known"]
    without = cache(spark).select("hashed_text", "response")
    assert J.cache_lookup(df, without, ["text"]).count() == len(TEXTS)


def test_empty_tables(spark):
    calls, ask = counted(spark)
    assert classify(frame(spark, []).limit(0), ask, ["text"], cache(spark)).count() == 0
    assert J.cache_lookup(frame(spark, TEXTS), cache(spark).limit(0), ["text"]).filter("llm_response = ''").count() == len(TEXTS)
    assert calls.value == 0


@pytest.mark.parametrize("bits", [8, 12, 20])
def test_bloom_filter_never_loses_a_key(spark, bits):
    keys = spark.range(0, 3000, 3).select(F.md5(F.col("id").cast("string")).alias("k"))
    probe = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("k"))
    rows = probe.select("id", may_contain(bloom_filter(keys, "k", bits), "k", bits).alias("may")).collect()
    assert all(r.may for r in rows if r.id % 3 == 0)
    if bits == 20:
        assert sum(r.may for r in rows) < 1010
    assert not probe.select(may_contain(bloom_filter(keys.limit(0), "k", bits), "k", bits).alias("m")).filter("m").count()
    assert not spark.sql("SELECT CAST(NULL AS STRING) AS k").select(may_contain(bloom_filter(keys, "k", bits), "k", bits).alias("m")).filter("m").count()


def test_texts_without_a_hit_are_not_shuffled(spark):
    """The certain misses are a branch of their own, without an exchange."""
    plan = J.cache_lookup(frame(spark, TEXTS).filter("id >= 0"), cache(spark), ["text"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_blocks_are_apart(spark):
    """Blocks that overlap, in one thread or in two, remove their own only."""
    df = spark.range(5)
    a = stages(spark)
    held_a = a.__enter__()
    cut_lineage(df)
    b = stages(spark)
    held_b = b.__enter__()
    kept = cut_lineage(df)
    a.__exit__(None, None, None)
    assert kept.count() == 5 and not path_exists(spark, held_a[0])
    b.__exit__(None, None, None)
    assert not path_exists(spark, held_b[0])
    go, seen = threading.Barrier(2, timeout=60), {}

    def work(name, wait):
        with stages(spark) as held:
            t = cut_lineage(df)
            go.wait()
            if wait:
                go.wait()  # the other block has ended
            seen[name] = (t.count() if wait else 5, len(held))
        if not wait:
            go.wait()
    threads = [threading.Thread(target=work, args=x) for x in (("one", True), ("two", False))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"one": (5, 1), "two": (5, 1)}
