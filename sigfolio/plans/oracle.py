"""DuckDB twins of the bindings in ``sigfolio.plans.bindings``.

``with_views("prices", "signals")`` returns a ``WITH`` prefix defining the
named derived views over the driver's base tables, so each oracle query is
``with_views(...) + main_sql``.  DuckDB 2.0 lambdas use ``lambda x: ...``.
"""

from __future__ import annotations

VIEWS = {
    "prices": """prices AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
         CAST(max(l_extendedprice) AS DECIMAL(18,6)) AS price
  FROM lineitem GROUP BY 1, 2)""",
    "panel": """panel AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, max(value) AS price
  FROM events GROUP BY 1, 2)""",
    "signals": """signals AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, l_shipdate AS ts,
         l_orderkey AS seq_o, l_linenumber AS seq_l,
         CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' END AS position
  FROM lineitem WHERE l_returnflag IN ('A', 'R'))""",
    "universe": """universe AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier)""",
    "membership": """membership AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS cik, strftime(o_orderdate, '%Y-%m') AS ym, c_name AS ticker
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING')""",
    "order_filings": """order_filings AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(o_orderdate AS DATE) AS date,
         strftime(o_orderdate, '%Y-%m') AS ym, o_orderkey AS doc_id, o_orderpriority AS text
  FROM orders)""",
    "doc_filings": """doc_filings AS (
  SELECT doc_id, source AS cik, CAST(DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER) AS DATE) AS date, text
  FROM documents)""",
    "scored": """scored AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'buy' ELSE 'sell' END AS true_category,
         CASE WHEN doc_id % 11 = 0 THEN 'hold' WHEN toxic = 1 THEN 'buy' ELSE 'sell' END AS llm_model_category
  FROM labels)""",
    "training_table": """training_table AS (
  SELECT d.doc_id, d.text, d.lang, d.source, CASE WHEN l.quality = 1 THEN 'buy' ELSE 'sell' END AS truth
  FROM documents d JOIN labels l USING (doc_id))""",
    "categories": """categories AS (
  SELECT 'label_' || CAST(label AS VARCHAR) AS category, label AS cat_idx, arg_min(embedding, vec_id) AS vec
  FROM embeddings GROUP BY label)""",
    "equity": """equity AS (
  SELECT event_type AS strategy_id, CAST(ts AS DATE) AS date, sum(value) AS equity
  FROM events GROUP BY 1, 2)""",
    "supplier_filings": """supplier_filings AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS line, 'S' || CAST(l_suppkey AS VARCHAR) AS ticker,
         CAST(o_orderdate AS DATE) AS date, o_orderpriority AS text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "labelled": """labelled AS (
  SELECT ticker, date, price, CASE WHEN count(price) OVER w = 10 AND price * 10 <= sum(price) OVER w
         THEN 'buy' ELSE 'sell' END AS truth
  FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""",
    "filing_texts": """filing_texts AS (
  SELECT doc_id, 'ACCESSION NUMBER: 0000000000' || chr(10) || 'CENTRAL INDEX KEY:' || chr(9) || lpad(CAST(doc_id AS VARCHAR), 10, '0')
    || CASE WHEN lang <> 'de' THEN chr(10) || 'COMPANY CONFORMED NAME:  ' || source ELSE '' END
    || CASE WHEN lang <> 'fr' THEN chr(10) || 'FILED AS OF DATE:   ' || strftime(DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER), '%Y%m%d') ELSE '' END
    || chr(10) || chr(10) || 'PART I' || chr(10) || 'Item 1. Business' || chr(10) || chr(10) || text
    || chr(10) || chr(10) || 'Item 1A. Risk Factors' || chr(10) || chr(10) || upper(lang) || ' RISK FACTORS' || chr(10) || text
    || chr(10) || chr(10) || 'Item 1B. Unresolved Staff Comments' || chr(10) || chr(10) || 'Item 7A. Market risk' || chr(10) || chr(10)
    || source || chr(10) || chr(10) || 'Item 8. Financial Statements' || chr(10) AS content
  FROM documents)""",
    "month_cal": """month_cal AS (
  SELECT month, start, lead(start) OVER (ORDER BY month) AS next_start FROM (
    SELECT date_trunc('month', date) AS month, min(date) AS start FROM prices GROUP BY 1))""",
}

# views that need other views first
DEPENDS = {"month_cal": ["prices"], "labelled": ["prices"]}


def with_views(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(VIEWS[n] for n in order) + "\n"
