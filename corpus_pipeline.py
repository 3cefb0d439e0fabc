"""Training-data pipeline over ``documents``.

Five stages, each a call of one operator of ``sigfolio.llm``; the rows that a
stage keeps are written as Parquet and are the next one's documents:

1. toxicity: documents that score 0.7 or more go;
2. SimHash near-duplicates (4-word shingles, up to 4 bits): of each group the
   document with the smallest id stays;
3. suffix-array dedup: bytes that an earlier document has in a string of 50
   or more go, whole characters only, and n_chars follows;
4. benchmark decontamination: documents that hold a window of a benchmark
   item go;
5. byte-level BPE: digests of each text's ids and of the text decoded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigfolio.llm import decontaminate, simhash, suffix_dedup, toxicity
from sigfolio.llm.common import fresh_name, table
from sigfolio.llm.queries import bpe_digests
from sigfolio.session import remove_path, scratch_path, stages

#: Not expressible in SQL: trained scores, XXH64 fingerprints and BPE merges.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold.  NULL and empty texts have
    the classifier's bias for a score and stay where that is below it."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "score")
    return toxicity.score_rows(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component.  NULL and
    empty texts are one group; of rows of one id and text one stays."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that earlier documents have.  All rows stay;
    NULL texts become empty, a NULL id counts as later than all others."""
    return suffix_dedup.dedup_rows(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item.  Each row is
    judged by itself; NULL and empty texts stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; NULL and
    empty texts have no ids."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the
    shared folder and read again by the next.  What a stage writes on its way
    goes with it, and its rows go once the next stage's are written; those of
    the last but one stay, since the result is read from them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with stages(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
