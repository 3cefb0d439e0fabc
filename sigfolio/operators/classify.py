"""Pluggable text -> label classification: one call per distinct new text.

The classifier is any callable ``pandas.DataFrame -> pandas.Series`` (the
reference calls a hosted model; here the callable is injected).  Texts are
hashed, hits are looked up by joins and never leave the JVM, the distinct
hashes without an answer go through ``mapInPandas`` once each, their answers
are written, and every row then takes its answer from cache and new answers
together.  With a ``store`` the written answers are the cache of later runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigfolio.operators.joins import cache_lookup, cache_misses, cache_upsert
from sigfolio.session import cut_lineage, path_exists, scratch_path

ANSWERS = "hashed_text string, response string, updated_at long"
#: Texts that the classifier gets at once.
BATCH_TEXTS = 512


def keyword_rule(buy_word: str, sell_word: str, text_col: str = "text") -> Callable[[pd.DataFrame], pd.Series]:
    """A stand-in classifier: 'buy' when ``buy_word`` occurs at least as
    often as ``sell_word`` (case-insensitive substring counts)."""
    b, s = re.escape(buy_word.lower()), re.escape(sell_word.lower())

    def fn(pdf: pd.DataFrame) -> pd.Series:
        low = pdf[text_col].fillna("").str.lower()
        return pd.Series(["buy" if x >= y else "sell" for x, y in zip(low.str.count(b), low.str.count(s))],
                         index=pdf.index)
    return fn


def read_answers(spark: SparkSession, store: str) -> DataFrame:
    """The cache at ``store``; no rows where nothing was written yet."""
    if path_exists(spark, store):
        return spark.read.schema(ANSWERS).parquet(store)
    return spark.createDataFrame([], ANSWERS)


def ask_misses(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], text_cols: Sequence[str], cache: DataFrame | None = None,
               cache_value: str = "response") -> DataFrame:
    """(hashed_text, response, updated_at): the classifier's answers for the
    distinct text hashes that the cache has no answer for.

    ``fn`` gets the text columns of one row per hash.  A hash that many rows
    share is reduced before it is shuffled.  No answer (NULL or blank) is not
    an answer: the hash stays a miss."""
    texts = df.select(*text_cols)
    none = cache is None
    miss = cache_misses(texts, texts.sparkSession.createDataFrame([], ANSWERS) if none else cache, text_cols,
                        cache_value="response" if none else cache_value)
    names = list(text_cols)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH_TEXTS):
                pdf = batch.iloc[at:at + BATCH_TEXTS].reset_index(drop=True)
                got = pd.Series(fn(pdf[names])).to_numpy(dtype=object)
                yield pd.DataFrame({"hashed_text": pdf["hashed_text"], "response": [None if pd.isna(x) else str(x) for x in got]})

    asked = miss.dropDuplicates(["hashed_text"]).mapInPandas(ask, "hashed_text string, response string")
    return asked.filter(F.coalesce("response", F.lit("")) != "").withColumn("updated_at", F.unix_micros(F.current_timestamp()))


def classify(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], text_cols: Sequence[str],
             cache: DataFrame | None = None, out: str = "label", cache_value: str = "response", store: str | None = None) -> DataFrame:
    """Every row with its text's answer: the newest cached one, else the
    classifier's; a blank cached answer counts as none, and a classifier that
    gives no answer leaves NULL.  Equal texts are asked once.

    The new answers are written while the plan is built, to ``store`` if
    given (a cache folder that later calls read too, and that holds one row
    per text ever asked), else to the shared scratch folder: a retried or
    repeated action of the result calls nothing again."""
    spark = df.sparkSession
    caches = [] if cache is None else [cache.select("hashed_text", F.col(cache_value).cast("string").alias("response"),
                                                    _version(cache).alias("updated_at"))]
    if store is not None:
        caches.append(read_answers(spark, store))
    known = None
    for c in caches:
        known = c if known is None else known.unionByName(c)
    new = ask_misses(df, fn, text_cols, known)
    if store is None:
        answers = cut_lineage(new, "answers")
    else:
        # written apart and then added: the misses are worked out from the store itself
        cut_lineage(new, "answers").write.mode("append").parquet(store)
        answers = read_answers(spark, store)
    merged = answers if cache is None else caches[0].unionByName(answers)
    return cache_lookup(df, merged, text_cols, out=out).withColumn(out, F.nullif(F.col(out), F.lit("")))


def compact_answers(spark: SparkSession, store: str) -> str:
    """A new folder with the newest answer per hash of ``store``."""
    path = scratch_path(spark, "answers")
    answers = read_answers(spark, store)
    cache_upsert(answers.limit(0), answers).write.parquet(path)
    return path


def _version(cache: DataFrame):
    return (F.col("updated_at") if "updated_at" in cache.columns else F.lit(0)).cast("long")
