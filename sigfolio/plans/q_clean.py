"""Schema / cell cleaning, parsing and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfolio.functions import dates as D
from sigfolio.operators import clean as C
from sigfolio.plans import bindings as B
from sigfolio.plans.oracle import with_views
from sigfolio.plans.registry import query


@query("normalize_columns", "SELECT c_custkey, c_name AS customer_name, c_acctbal AS account_balance FROM customer")
def q_normalize_columns(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("C_CUSTKEY"),
                                               F.col("c_name").alias("Customer Name"),
                                               F.col("c_acctbal").alias("Account Balance"))
    return C.normalize_columns(c)


@query("drop_duplicate_columns", "SELECT c_custkey, c_name FROM customer")
def q_drop_dup_cols(spark, sf):
    c = B.table(spark, sf, "customer")
    dup = c.select("c_custkey", "c_name", F.col("c_mktsegment").alias("c_name"))
    return C.drop_duplicate_columns(dup)


@query("map_columns", """
SELECT md5(text) AS item_1, source AS item_1a, lang AS item_7a FROM documents""")
def q_map_columns(spark, sf):
    d = B.table(spark, sf, "documents")
    m = C.map_columns(d, {"text": "item_1", "source": "item_1a", "lang": "item_7a"})
    return m.select(F.md5("item_1").alias("item_1"), "item_1a", "item_7a")


@query("lower_cells", "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def q_lower_cells(spark, sf):
    return C.lower_cells(B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("fill_blank", """
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), '') AS o_orderpriority,
       coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END, 0) AS o_totalprice FROM orders""")
def q_fill_blank(spark, sf):
    o = B.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"))
    return C.fill_blank(C.fill_blank(o, ""), 0)


@query("drop_empty_columns", "SELECT c_custkey, c_name FROM customer")
def q_drop_empty(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("empty"))
    return C.drop_empty_columns(c)


@query("strip_newlines", "SELECT doc_id, md5(replace(text, chr(10), '')) AS text_md5 FROM documents")
def q_strip_newlines(spark, sf):
    d = C.strip_newlines(B.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5("text").alias("text_md5"))


@query("strip_quotes", "SELECT c_custkey, c_name AS ticker FROM customer")
def q_strip_quotes(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("'"), "c_name", F.lit("'")).alias("ticker"))
    return C.strip_quotes(c, "ticker")


@query("parse_date_auto", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def q_parse_date_auto(spark, sf):
    o = B.table(spark, sf, "orders")
    s = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")) \
         .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", D.parse_date_auto(s).alias("d"))


@query("sas_serial_to_date", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m') AS ym FROM orders""")
def q_sas(spark, sf):
    o = B.table(spark, sf, "orders")
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit(D.SAS_EPOCH).cast("date")).cast("double") + 0.9
    return o.select("o_orderkey", D.sas_serial_to_date(serial).alias("d"), D.sas_serial_to_date(serial, "yyyy-MM").alias("ym"))


@query("safe_price", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 0.0 ELSE c_acctbal END AS price FROM customer""")
def q_safe_price(spark, sf):
    c = B.table(spark, sf, "customer")
    s = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", D.safe_price(s).alias("price"))


@query("decode_bytes", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def q_decode_bytes(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("text"))
    return C.decode_bytes(d).select("doc_id", F.md5("text").alias("text_md5"))


@query("drop_null_key", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW'")
def q_drop_null_key(spark, sf):
    o = B.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("p"))
    return C.drop_null_key(o, ["p"]).select("o_orderkey")


@query("drop_blank_label", with_views("scored") + """
SELECT doc_id FROM scored WHERE llm_model_category <> 'hold'""")
def q_drop_blank(spark, sf):
    s = B.scored(spark, sf).withColumn("llm_model_category",
                                       F.when(F.col("llm_model_category") == "hold", "").otherwise(F.col("llm_model_category")))
    return C.drop_blank_label(s, "llm_model_category").select("doc_id")


@query("filter_date_range", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31'""")
def q_date_range(spark, sf):
    o = B.table(spark, sf, "orders")
    return C.date_range(o, "o_orderdate", "1994-01-01", "1995-12-31").select("o_orderkey")


@query("append_column", """
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'sell' WHEN l.toxic = 0 THEN 'buy' END AS llm_model_category
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_append_column(spark, sf):
    from sigfolio.operators.joins import join_responses
    d = B.table(spark, sf, "documents").select("doc_id")
    resp = B.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "sell").otherwise("buy").alias("llm_model_category"))
    return join_responses(d, resp, key="doc_id")
