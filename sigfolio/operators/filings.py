"""The corpus job: raw filings -> header -> membership and tickers ->
sections -> best passages.

Membership and tickers are one join, on (cik, month) from the header, which
is cheap to extract, *before* the regex work; the tickers of a filing stay
one array until the last step, so the text is processed once per filing.
Catalyst cannot reorder this itself (the key derives from the same text), so
the order is fixed here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigfolio.functions import text as X
from sigfolio.functions.dates import compact_date, month_key


def text_reduction(df: DataFrame, before: str, after: str) -> DataFrame:
    """Characters before / after passage selection and their ratio."""
    return (df.agg(F.sum(F.length(before)).alias("chars_before"), F.sum(F.length(after)).alias("chars_after"))
              .withColumn("ratio", F.try_divide(F.col("chars_after"), F.col("chars_before"))))


def file_counts(df: DataFrame) -> DataFrame:
    """Filings per (year, quarter) plus a grand total row (rollup)."""
    return df.rollup("year", "quarter").agg(F.count(F.lit(1)).alias("n_files"))


def process_forms(raw: DataFrame, members: DataFrame | None = None, form: str = "10-K",
                  sections: Mapping[str, str] | None = None, keywords: Sequence[str] = X.FILING_KEYWORDS,
                  k: int | None = None, content: str = "content", sentinels: bool = False,
                  partitions: int | None = None, spread_by: Sequence[str] = ()) -> DataFrame:
    """Filing rows (cik, company_name, date, form, <items>) from raw text.

    With ``members`` (cik, ym, ticker) non-members are dropped before any
    section work and each filing gets its tickers for the filing month (a
    row each).  ``partitions`` deals the filings that are left out anew by
    ``spread_by`` before the section work: section regexes cost far more
    than reading, so a few large input files should not decide how many
    tasks share them.  ``sentinels=True`` writes 'No text available' for
    missing sections at the output boundary (NULL inside)."""
    if sections is None:
        sections = X.SECTIONS_10K if form == "10-K" else X.SECTIONS_10Q
    if k is None:
        k = X.RUN_LENGTH_10K if form == "10-K" else X.RUN_LENGTH_10Q
    h = X.filing_header(content)
    df = raw.select("*", *[v.alias(n) for n, v in h.items()]).withColumn("form", F.lit(form))
    df = df.withColumn("filing_date", compact_date("date")).withColumn("ym", month_key("filing_date"))
    if members is not None:
        # the few tickers of one filer and month
        named = (members.filter(F.col("ticker").isNotNull()).groupBy("cik", "ym")
                 .agg(F.sort_array(F.collect_set("ticker")).alias("__tickers")))
        df = df.join(named, ["cik", "ym"])
    if partitions is not None:
        df = df.repartition(partitions, *spread_by)
    for name, pat in sections.items():
        df = df.withColumn(name, X.extract_section(content, pat))
    for name in sections:
        df = X.with_top_passages(df, name, name, keywords, k)
    df = df.drop(content)
    if members is not None:
        df = df.withColumn("ticker", F.explode("__tickers")).drop("__tickers")
    if sentinels:
        df = df.select(*[F.coalesce(F.col(c), F.lit(X.NO_TEXT)).alias(c) if c in sections else F.col(c)
                         for c in df.columns])
    return df
