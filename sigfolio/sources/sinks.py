"""Writers: delimited files, per-symbol files, JSON lines, reports.

Parquet is the default interchange between stages; the text formats exist
for the reference's consumers.  All writers are distributed DataFrame
writers (no driver-side loops)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfolio.session import cut_lineage, few_listing_tasks
from sigfolio.sources.files import PACK_END, PACK_MARK, pack_text

def sink_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> str:
    """CSV / pipe files, quoted where needed, no index column."""
    (df.write.mode(mode).option("sep", sep).option("header", header).option("escape", '"')
       .option("quoteAll", False).csv(path))
    return path


def sink_by_symbol(df: DataFrame, path: str, symbol: str = "ticker", sep: str = "|",
                   mode: str = "overwrite", n_parts: int | None = None) -> DataFrame:
    """One headerless folder per lower-cased symbol (``__sym=<name>``) and
    return the sorted distinct symbol list (the index file).

    Range partitioning on (symbol, row hash) keeps small symbols in one file
    while a hot symbol is split across several tasks (sampled bounds), so no
    task writes a third of the data."""
    out = df.withColumn("__sym", F.lower(F.col(symbol)))
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    parts = n_parts or int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (out.repartitionByRange(parts, "__sym", spread).write.mode(mode).partitionBy("__sym")
        .option("sep", sep).option("header", False).option("escape", '"').csv(path))
    # the list comes from the folders that were written: no file is opened
    with few_listing_tasks(out.sparkSession):
        written = out.sparkSession.read.format("binaryFile").load(path)
    return written.select(F.col("__sym").cast("string").alias(symbol)).distinct().orderBy(symbol)


def sink_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON object per line.  A single string column is written as is
    (already rendered JSON); otherwise every row is rendered."""
    if len(df.columns) == 1 and dict(df.dtypes)[df.columns[0]] == "string":
        df.write.mode(mode).text(path)
    else:
        df.write.mode(mode).json(path)
    return path


def sink_report(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a (nested) report row set as JSON."""
    df.coalesce(1).write.mode(mode).json(path)
    return path


def sink_filings(df: DataFrame, path: str, name: str = "filing", content: str = "content", mode: str = "overwrite") -> str:
    """Write filings (year, quarter, name, content) for ``scan_filings`` with
    ``hive_layout`` and ``packed``: a file holds many filings, so the number
    of files grows with the bytes, not with the filings.

    A filing is its lines, as a text file would hold them: a line break ends
    the content (an empty one for NULL), and the contents of a name that comes
    more than once follow each other.  A pass over the names alone finds those;
    only their contents are shuffled, the others are written by the tasks that
    read them, a file per quarter each."""
    keys = ["year", "quarter", name]
    repeated = cut_lineage(df.groupBy(*keys).count().filter("count > 1").select(*[F.col(c).alias(f"__{c}") for c in keys]), "repeated_names")

    def packs(filings: DataFrame, lines: Column) -> DataFrame:
        record = F.concat(pack_text(F.coalesce(F.col(name), F.lit(""))), F.lit(PACK_MARK), pack_text(F.concat(lines, F.lit("\n"))))
        return filings.select("year", "quarter", record.alias("value"))

    line = F.coalesce(F.col(content), F.lit(""))
    if repeated.isEmpty():
        out = packs(df, line)
    else:
        same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
        together = df.join(repeated, same, "left_semi").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("__lines"))
        out = packs(df.join(repeated, same, "left_anti"), line).unionByName(packs(together, F.col("__lines")))
    out.write.mode(mode).partitionBy("year", "quarter").option("lineSep", PACK_END).text(path)
    return path


def compact_filings(filings: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Compact a corpus of many small filing files into Parquet partitioned
    by (year, quarter) -- the one pass after which every job reads columnar
    files.  Range partitioning on (year, quarter, path) keeps a busy quarter
    spread over several tasks and files."""
    (filings.repartitionByRange("year", "quarter", "path")
            .write.mode(mode).partitionBy("year", "quarter").parquet(path))
    return path


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
