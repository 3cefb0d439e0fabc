"""Joins, membership, cache and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfolio.functions.text import hash_text
from sigfolio.operators import clean as C
from sigfolio.operators import joins as J
from sigfolio.operators import market as M
from sigfolio.operators import portfolio as P
from sigfolio.operators import training as TR
from sigfolio.plans import bindings as B
from sigfolio.plans.oracle import with_views
from sigfolio.plans.registry import query


@query("semi_membership", with_views("order_filings", "membership") + """
SELECT doc_id, cik FROM order_filings WHERE cik IN (SELECT cik FROM membership)""")
def q_semi(spark, sf):
    return J.semi_membership(B.order_filings(spark, sf), B.membership(spark, sf)).select("doc_id", "cik")


@query("join_ticker", with_views("order_filings", "membership") + """
SELECT f.doc_id, f.cik, f.ym, m.ticker FROM order_filings f JOIN membership m ON f.cik = m.cik AND f.ym = m.ym""")
def q_join_ticker(spark, sf):
    return J.join_ticker(B.order_filings(spark, sf), B.membership(spark, sf)).select("doc_id", "cik", "ym", "ticker")


@query("members_by_month", with_views("membership") + """
SELECT ym, array_to_string(list_sort(list(DISTINCT ticker)), ',') AS tickers, count(DISTINCT ticker) AS n
FROM membership GROUP BY ym""")
def q_members_by_month(spark, sf):
    r = C.members_by_month(B.membership(spark, sf))
    return r.select("ym", F.array_join("tickers", ",").alias("tickers"), F.size("tickers").cast("long").alias("n"))


@query("month_members", with_views("membership") + "SELECT DISTINCT ticker FROM membership WHERE ym = '1995-06'")
def q_month_members(spark, sf):
    return C.month_members(B.membership(spark, sf), "1995-06")


@query("distinct_ciks", with_views("membership") + "SELECT DISTINCT cik FROM membership")
def q_distinct_ciks(spark, sf):
    return B.membership(spark, sf).select("cik").distinct()


@query("distinct_cik_month_ticker", with_views("membership") + "SELECT DISTINCT cik, ym, ticker FROM membership")
def q_distinct_cmt(spark, sf):
    return B.membership(spark, sf).select("cik", "ym", "ticker").distinct()


@query("distinct_symbols", with_views("signals") + "SELECT DISTINCT ticker FROM signals")
def q_distinct_symbols(spark, sf):
    return TR.distinct_symbols(B.signals(spark, sf))


@query("union_symbols", with_views("prices", "universe") + """
SELECT ticker FROM prices UNION SELECT ticker FROM universe""")
def q_union_symbols(spark, sf):
    return TR.union_symbols(B.prices(spark, sf), B.universe(spark, sf))


@query("minus_symbols", with_views("membership") + """
SELECT DISTINCT c_name AS ticker FROM customer WHERE c_name NOT IN (SELECT ticker FROM membership)""")
def q_minus_symbols(spark, sf):
    cust = B.table(spark, sf, "customer").select(F.col("c_name").alias("ticker"))
    return TR.minus_symbols(cust, B.membership(spark, sf))


@query("join_price_truth", with_views("supplier_filings", "labelled") + """
SELECT f.doc_id, f.line, f.ticker, f.date, CAST(l.price AS DOUBLE) AS price, l.truth
FROM supplier_filings f JOIN labelled l ON f.date = l.date AND f.ticker = l.ticker""")
def q_join_price_truth(spark, sf):
    lab = M.label_truth(B.prices(spark, sf))
    r = J.join_price_truth(B.supplier_filings(spark, sf), lab, how="left")
    return r.select("doc_id", "line", "ticker", "date", F.col("price").cast("double").alias("price"), "truth")


@query("join_price_truth_right", with_views("supplier_filings", "labelled") + """
SELECT f.doc_id, f.line, l.ticker, l.date, CAST(l.price AS DOUBLE) AS price, l.truth
FROM supplier_filings f RIGHT JOIN labelled l ON f.date = l.date AND f.ticker = l.ticker""")
def q_join_price_truth_right(spark, sf):
    lab = M.label_truth(B.prices(spark, sf))
    r = J.join_price_truth(B.supplier_filings(spark, sf), lab, how="right")
    return r.select("doc_id", "line", "ticker", "date", F.col("price").cast("double").alias("price"), "truth")


@query("join_texts_to_prices", with_views("supplier_filings", "prices") + """
SELECT p.ticker, p.date, CAST(p.price AS DOUBLE) AS price, f.doc_id, f.line
FROM prices p LEFT JOIN supplier_filings f ON f.date = p.date AND f.ticker = p.ticker""")
def q_texts_to_prices(spark, sf):
    r = J.join_texts_to_prices(B.prices(spark, sf), B.supplier_filings(spark, sf))
    return r.select("ticker", "date", F.col("price").cast("double").alias("price"), "doc_id", "line")


WEIGHTS_SQL = """, day_w AS (
  SELECT date, ticker, CAST(price AS DOUBLE) / sum(CAST(price AS DOUBLE)) OVER (PARTITION BY date) AS weight FROM prices)"""


def _day_weights(spark, sf):
    p = B.prices(spark, sf).withColumn("w", F.col("price").cast("double"))
    return P.scale_weights(p, by="date", weight="w", out="weight").select("date", "ticker", "weight")


@query("join_universe_weights", with_views("prices", "universe") + WEIGHTS_SQL + """
SELECT d.date, u.ticker, round(coalesce(w.weight, 0), 12) AS weight
FROM universe u CROSS JOIN (SELECT DISTINCT date FROM day_w) d LEFT JOIN day_w w ON w.ticker = u.ticker AND w.date = d.date""")
def q_universe_weights(spark, sf):
    r = J.join_universe_weights(B.universe(spark, sf), _day_weights(spark, sf), by=["date"])
    return r.select("date", "ticker", F.round("weight", 12).alias("weight"))


@query("scale_weights", with_views("prices") + WEIGHTS_SQL + """
SELECT date, ticker, round(weight, 12) AS weight FROM day_w""")
def q_scale_weights(spark, sf):
    return _day_weights(spark, sf).select("date", "ticker", F.round("weight", 12).alias("weight"))


ASOF_SQL = """, last_sig AS (
  SELECT s.ticker, m.start AS rebalance_date, arg_max(s.position, (s.ts, s.seq_o, s.seq_l)) AS position
  FROM signals s JOIN month_cal m ON CAST(s.ts AS DATE) < m.start
  GROUP BY 1, 2)"""


@query("asof_last_signal", with_views("signals", "month_cal") + ASOF_SQL + """
SELECT ticker, rebalance_date, position FROM last_sig""")
def q_asof(spark, sf):
    cal = M.first_trading_day(B.prices(spark, sf))
    return J.asof_last_signal(B.signals(spark, sf), cal).select("ticker", "rebalance_date", "position")


# every symbol is held from the first month start after its first bar, until
# the last signal strictly before a month start is a sell
HELD_SQL = ASOF_SQL + """, held AS (
  SELECT m.start AS rebalance_date, f.ticker
  FROM (SELECT ticker, min(date) AS first FROM prices GROUP BY ticker) f JOIN month_cal m ON f.first < m.start
  LEFT JOIN last_sig l ON l.ticker = f.ticker AND l.rebalance_date = m.start
  WHERE coalesce(l.position, '') <> 'sell')"""


@query("portfolio_membership", with_views("signals", "month_cal") + HELD_SQL + """
SELECT rebalance_date, ticker FROM held""")
def q_membership(spark, sf):
    p = B.prices(spark, sf)
    return J.portfolio_membership(B.signals(spark, sf), M.first_trading_day(p), p)


@query("equal_weights", with_views("signals") + """
SELECT ticker, min(ts) AS first_seen, round_even(1.0 / least(count(*) OVER (), 500), 3) AS weight
FROM signals GROUP BY ticker""")
def q_equal_weights(spark, sf):
    return P.equal_weights(B.signals(spark, sf))


@query("positions_at_latest", with_views("signals") + """
SELECT ticker, ts, position FROM signals
WHERE ts < (SELECT max(ts) FROM signals)
  AND ticker IN (SELECT ticker FROM signals WHERE ts = (SELECT max(ts) FROM signals) AND position = 'buy')""")
def q_positions_at_latest(spark, sf):
    return C.positions_at_latest(B.signals(spark, sf), "buy", date="ts").select("ticker", "ts", "position")


# --- response cache: answers for English documents, upserted with German ones

CACHE_SQL = """, cache_v1 AS (
  SELECT sha256(concat_ws(' ', coalesce(source, ''), coalesce(text, ''))) AS hashed_text,
         arg_max(CASE WHEN n_chars > 1000 THEN 'buy' ELSE 'sell' END, doc_id) AS response, max(doc_id) AS updated_at
  FROM documents WHERE lang = 'en' GROUP BY 1)"""


def _cache(spark, sf):
    d = B.table(spark, sf, "documents").filter(F.col("lang") == "en")
    new = d.select(hash_text("source", "text").alias("hashed_text"),
                   F.when(F.col("n_chars") > 1000, "buy").otherwise("sell").alias("response"),
                   F.col("doc_id").alias("updated_at"))
    empty = new.limit(0)
    return J.cache_upsert(empty, new)


@query("cache_lookup", with_views("training_table") + CACHE_SQL + """
SELECT d.doc_id, coalesce(c.response, '') AS llm_response FROM documents d
LEFT JOIN cache_v1 c ON c.hashed_text = sha256(concat_ws(' ', coalesce(d.source, ''), coalesce(d.text, '')))""")
def q_cache_lookup(spark, sf):
    d = B.table(spark, sf, "documents")
    return J.cache_lookup(d, _cache(spark, sf), ["source", "text"]).select("doc_id", "llm_response")


@query("cache_misses", with_views("training_table") + CACHE_SQL + """
SELECT d.doc_id FROM documents d
WHERE sha256(concat_ws(' ', coalesce(d.source, ''), coalesce(d.text, ''))) NOT IN (SELECT hashed_text FROM cache_v1)""")
def q_cache_misses(spark, sf):
    d = B.table(spark, sf, "documents")
    return J.cache_misses(d, _cache(spark, sf), ["source", "text"]).select("doc_id")


@query("cache_upsert", with_views("training_table") + CACHE_SQL + """,
new AS (SELECT sha256(concat_ws(' ', coalesce(source, ''), coalesce(text, ''))) AS hashed_text,
               CASE WHEN n_chars > 500 THEN 'buy' ELSE 'sell' END AS response, doc_id + 1000000 AS updated_at
        FROM documents WHERE lang IN ('de', 'en')),
u AS (SELECT *, 0 AS src FROM cache_v1 UNION ALL SELECT *, 1 AS src FROM new)
SELECT hashed_text, arg_max(response, (updated_at, src)) AS response, max(updated_at) AS updated_at
FROM u GROUP BY hashed_text""")
def q_cache_upsert(spark, sf):
    d = B.table(spark, sf, "documents").filter(F.col("lang").isin("de", "en"))
    new = d.select(hash_text("source", "text").alias("hashed_text"),
                   F.when(F.col("n_chars") > 500, "buy").otherwise("sell").alias("response"),
                   (F.col("doc_id") + 1000000).alias("updated_at"))
    return J.cache_upsert(_cache(spark, sf), new)


@query("join_positional", with_views("equity") + """
SELECT a.strategy_id, a.date, round(a.equity, 6) AS equity, b.ts FROM
 (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM equity) a
 LEFT JOIN (SELECT event_type AS strategy_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i
            FROM events) b USING (strategy_id, i)""")
def q_positional(spark, sf):
    ev = B.table(spark, sf, "events").select(F.col("event_type").alias("strategy_id"), "ts", "event_id")
    r = J.join_positional(B.equity(spark, sf), ev, "date", "ts", tie_b=["event_id"])
    return r.select("strategy_id", "date", F.round("equity", 6).alias("equity"), "ts")


@query("join_returns_on_date", with_views("equity") + """
SELECT s.strategy_id, s.date, round(s.ret, 9) AS ret, round(i.index_ret, 9) AS index_ret FROM
 (SELECT strategy_id, date, equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS ret FROM equity) s
 LEFT JOIN (SELECT date, tot / lag(tot) OVER (ORDER BY date) - 1 AS index_ret
            FROM (SELECT date, sum(value) AS tot FROM (SELECT CAST(ts AS DATE) AS date, value FROM events) GROUP BY date)) i
 USING (date)""")
def q_returns_on_date(spark, sf):
    s = M.pct_change(B.equity(spark, sf), key="strategy_id", value="equity")
    idx = (B.table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date"))
           .agg(F.sum("value").alias("tot")).withColumn("strategy_id", F.lit("index")))
    idx = M.pct_change(idx, key="strategy_id", value="tot", out="index_ret").select("date", "index_ret")
    r = J.join_returns_on_date(s, idx)
    return r.select("strategy_id", "date", F.round("ret", 9).alias("ret"), F.round("index_ret", 9).alias("index_ret"))


@query("last_per_group", with_views("signals") + """
SELECT ticker, arg_max(ts, (ts, seq_o, seq_l)) AS ts, arg_max(position, (ts, seq_o, seq_l)) AS position
FROM signals GROUP BY ticker""")
def q_last_per_group(spark, sf):
    r = C.last_per_group(B.signals(spark, sf), "ticker", ["ts", "seq"])
    return r.select("ticker", "ts", "position")


@query("concat_history", with_views("signals", "month_cal") + HELD_SQL + """
SELECT p.ticker, p.date, CAST(p.price AS DOUBLE) AS price FROM prices p
WHERE p.ticker IN (SELECT ticker FROM held WHERE rebalance_date = (SELECT max(rebalance_date) FROM held))""")
def q_concat_history(spark, sf):
    p = B.prices(spark, sf)
    held = J.portfolio_membership(B.signals(spark, sf), M.first_trading_day(p), p)
    last = held.agg(F.max("rebalance_date").alias("d")).withColumn("__g", F.lit(0))
    latest = (held.withColumn("__g", F.lit(0)).join(F.broadcast(last), "__g")
                  .filter(F.col("rebalance_date") == F.col("d")))
    r = C.concat_history(p, latest)
    return r.select("ticker", "date", F.col("price").cast("double").alias("price"))
