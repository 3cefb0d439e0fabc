"""Bind the driver's test tables to the schemas the operators expect.

Each function only reshapes a given table into the operator's input schema
(the job itself runs in ``sigfolio.operators``).  Every binding has an SQL
twin in ``sigfolio.plans.oracle`` so DuckDB sees the same input.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def prices(spark, sf_dir) -> DataFrame:
    """(ticker, date, price decimal(18,6)): one close per supplier and day."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
                       F.col("l_shipdate").cast("date").alias("date"))
              .agg(F.max("l_extendedprice").cast("decimal(18,6)").alias("price")))


def panel(spark, sf_dir) -> DataFrame:
    """(ticker, date, price double): dense daily panel from events."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("ticker"), F.col("ts").cast("date").alias("date"))
              .agg(F.max("value").alias("price")))


def signals(spark, sf_dir) -> DataFrame:
    """(ticker, ts, seq, position): returns 'A' -> buy, 'R' -> sell per supplier."""
    return signals_from(table(spark, sf_dir, "lineitem"))


def signals_from(li: DataFrame) -> DataFrame:
    """The signal projection of a lineitem frame (batch or stream)."""
    pos = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell")
    return (li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
                      F.col("l_shipdate").alias("ts"),
                      F.struct(F.col("l_orderkey"), F.col("l_linenumber")).alias("seq"),
                      pos.alias("position"))
              .filter(F.col("position").isNotNull()))


def universe(spark, sf_dir) -> DataFrame:
    """(ticker): every supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))


def membership(spark, sf_dir) -> DataFrame:
    """(cik, ym, ticker): customer/month pairs with orders; the BUILDING
    segment is left out so that some filers are non-members."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(F.col("o_custkey").cast("string").alias("cik"),
                     F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
                     F.col("c_name").alias("ticker"))
             .distinct())


def order_filings(spark, sf_dir) -> DataFrame:
    """Orders as filings: (cik, date, ym, text)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("cik"),
                    F.col("o_orderdate").cast("date").alias("date"),
                    F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
                    F.col("o_orderkey").alias("doc_id"),
                    F.col("o_orderpriority").alias("text"))


def doc_filings(spark, sf_dir) -> DataFrame:
    """Documents as filings: (doc_id, cik, date, text)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("cik"),
                    F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("date"),
                    "text")


def filing_texts(spark, sf_dir, *more) -> DataFrame:
    """(doc_id, content, more columns of documents): raw filing text, an SEC-style header and item sections around each
    document's text.

    German documents get no company-name line and French ones no date line,
    so the 'Unknown' paths are exercised; an all-caps line sits inside
    item 1A so the paragraph cleaner has work to do."""
    d = table(spark, sf_dir, "documents")
    date = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")), "yyyyMMdd")
    nl = F.lit("\n")
    content = F.concat(
        F.lit("ACCESSION NUMBER: 0000000000\nCENTRAL INDEX KEY:\t"), F.lpad(F.col("doc_id").cast("string"), 10, "0"),
        F.when(F.col("lang") != "de", F.concat(F.lit("\nCOMPANY CONFORMED NAME:  "), F.col("source"))).otherwise(F.lit("")),
        F.when(F.col("lang") != "fr", F.concat(F.lit("\nFILED AS OF DATE:   "), date)).otherwise(F.lit("")),
        F.lit("\n\nPART I\nItem 1. Business\n\n"), F.col("text"),
        F.lit("\n\nItem 1A. Risk Factors\n\n"), F.upper(F.col("lang")), F.lit(" RISK FACTORS\n"), F.col("text"),
        F.lit("\n\nItem 1B. Unresolved Staff Comments\n\nItem 7A. Market risk\n\n"), F.col("source"), nl,
        F.lit("\nItem 8. Financial Statements\n"))
    return d.select("doc_id", content.alias("content"), *more)


def scored(spark, sf_dir) -> DataFrame:
    """(doc_id, true_category, llm_model_category) from labels; every 11th
    prediction is the foreign label 'hold'."""
    lb = table(spark, sf_dir, "labels")
    t = F.when(F.col("quality") == 1, "buy").otherwise("sell")
    p = F.when(F.col("doc_id") % 11 == 0, "hold").when(F.col("toxic") == 1, "buy").otherwise("sell")
    return lb.select("doc_id", t.alias("true_category"), p.alias("llm_model_category"))


def training_table(spark, sf_dir) -> DataFrame:
    """documents joined to labels: (doc_id, text, lang, source, truth)."""
    d = table(spark, sf_dir, "documents")
    lb = table(spark, sf_dir, "labels")
    truth = F.when(F.col("quality") == 1, "buy").otherwise("sell")
    return d.join(lb, "doc_id").select("doc_id", "text", "lang", "source", truth.alias("truth"))


def categories(spark, sf_dir) -> DataFrame:
    """(category, cat_idx, vec): lowest vec_id per label is its category."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec"))
    return first.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("category"),
                        F.col("label").alias("cat_idx"), "vec")


def equity(spark, sf_dir) -> DataFrame:
    """(strategy_id, date, equity): cumulative daily event value per type."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("strategy_id"), F.col("ts").cast("date").alias("date"))
              .agg(F.sum("value").alias("equity")))


def supplier_filings(spark, sf_dir) -> DataFrame:
    """Order lines as supplier filings on the order date:
    (doc_id, line, ticker, date, text)."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"),
                      F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
                      F.col("o_orderdate").cast("date").alias("date"),
                      F.col("o_orderpriority").alias("text")))
