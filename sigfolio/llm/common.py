"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigfolio.session import cut_lineage

#: Rows that go to a Python worker at once.  Texts may be long, so the bound
#: on a batch's memory is this many texts rather than Spark's 10,000.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``; never raise it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
             schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_of(name: str = "text") -> Column:
    """The text column with NULL as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or it with a number that makes it none of the frame's columns."""
    taken, k, out = {c.lower() for c in df.columns}, 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A digest of a row's id and whole text: tells rows apart where ids are
    NULL or not unique, and is the same for repeated rows."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.hex(F.col(id_col).isNull().cast("int")),
                             F.col(text_col).isNull().cast("string"), text_of(text_col)))


__all__ = ["BATCH_ROWS", "cut_lineage", "fresh_name", "map_rows", "row_key", "small_batches", "table", "text_of"]
