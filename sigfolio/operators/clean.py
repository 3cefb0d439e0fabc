"""Schema and cell cleaning, filters and simple predicates.

All are narrow transformations (projection / filter) -- no shuffle -- except
``drop_empty_columns`` (one aggregate pass that returns one row of counts)
and ``positions_at_latest`` (a scalar-subquery max).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfolio.functions.text import NO_TEXT


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names and replace spaces with underscores."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of equally named columns (positional, so it also works
    when the names are ambiguous)."""
    names = df.columns
    tmp = df.toDF(*[f"__c{i}" for i in range(len(names))])
    seen, keep = set(), []
    for i, n in enumerate(names):
        if n not in seen:
            seen.add(n)
            keep.append(F.col(f"__c{i}").alias(n))
    return tmp.select(*keep)


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename through ``mapping`` and drop every column not mapped."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items() if src in df.columns])


def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def lower_cells(df: DataFrame) -> DataFrame:
    """Lower-case every string cell."""
    s = set(_string_cols(df))
    return df.select(*[F.lower(F.col(c)).alias(c) if c in s else F.col(c) for c in df.columns])


def fill_blank(df: DataFrame, value="") -> DataFrame:
    """NULL -> ``value`` in columns of the value's type ('' for strings,
    0 for numbers)."""
    return df.na.fill(value)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL in every row (one counting pass)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def strip_newlines(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Remove ``\\n`` from string cells."""
    s = set(cols or _string_cols(df))
    return df.select(*[F.replace(F.col(c), F.lit("\n"), F.lit("")).alias(c) if c in s else F.col(c)
                       for c in df.columns])


def strip_quotes(df: DataFrame, col: str = "ticker") -> DataFrame:
    """Remove single quotes from a column."""
    return df.withColumn(col, F.replace(F.col(col), F.lit("'"), F.lit("")))


def decode_bytes(df: DataFrame) -> DataFrame:
    """Binary cells -> UTF-8 strings."""
    return df.select(*[F.decode(F.col(f.name), "UTF-8").alias(f.name) if isinstance(f.dataType, T.BinaryType)
                       else F.col(f.name) for f in df.schema.fields])


def drop_null_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def drop_blank_label(df: DataFrame, label: str) -> DataFrame:
    return df.filter((F.col(label) != "") & F.col(label).isNotNull())


def has_text(*cols) -> Column:
    """True if any item has text (neither NULL nor the sentinel)."""
    conds = [F.col(c).isNotNull() & (F.col(c) != NO_TEXT) for c in cols]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def date_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """lo <= col <= hi (either bound optional); NULL dates dropped."""
    cond = F.col(col).isNotNull()
    if lo is not None:
        cond = cond & (F.col(col) >= F.lit(lo))
    if hi is not None:
        cond = cond & (F.col(col) <= F.lit(hi))
    return df.filter(cond)


def month_members(df: DataFrame, ym: str, month_col: str = "ym", ticker: str = "ticker") -> DataFrame:
    """Tickers in the index during month ``ym``."""
    return df.filter(F.col(month_col) == ym).select(ticker).distinct()


def members_by_month(df: DataFrame, month_col: str = "ym", ticker: str = "ticker") -> DataFrame:
    """Month -> sorted array of distinct member tickers (an index month has a
    bounded member list, so the per-month set is small)."""
    return df.groupBy(month_col).agg(F.array_sort(F.collect_set(ticker)).alias("tickers"))


def positions_at_latest(df: DataFrame, position: str, date: str = "date", key: str = "ticker",
                        pos_col: str = "position") -> DataFrame:
    """History strictly before the latest date of the keys holding
    ``position`` on that latest date."""
    d = df.withColumn("__max", df.agg(F.max(date)).scalar())
    keys = d.filter((F.col(date) == F.col("__max")) & (F.col(pos_col) == position)).select(key).distinct()
    return (d.filter(F.col(date) < F.col("__max")).join(keys, key, "left_semi").drop("__max"))


def last_per_group(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (a grouped max_by: partial
    aggregation map-side, no sort of the group)."""
    cols = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__r"))
              .select(key, "__r.*"))


def concat_history(prices: DataFrame, held: DataFrame, key: str = "ticker") -> DataFrame:
    """Price histories of the held symbols, stacked: one scan and a semi
    join instead of one history request per symbol."""
    return prices.join(held.select(key).distinct(), key, "left_semi")
