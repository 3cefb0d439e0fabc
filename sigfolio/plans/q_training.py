"""Training-set, prompt, message, request and response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfolio.functions.text import row_to_text
from sigfolio.operators import clean as C
from sigfolio.operators import messages as MS
from sigfolio.operators import market as M
from sigfolio.operators import training as TR
from sigfolio.plans import bindings as B
from sigfolio.plans.oracle import with_views
from sigfolio.plans.registry import query

SEED = 42
CATS = ["buy", "sell"]
TEXT_COLS = ["text", "lang", "source"]
ROW_TEXT_SQL = "concat_ws(' ', 'text: ' || coalesce(text, ''), 'lang: ' || coalesce(lang, ''), 'source: ' || coalesce(source, ''))"
PROMPT_SQL = f"'Classify the paragraph ''' || {ROW_TEXT_SQL} || ''' into one of these categories: buy, sell; only give name of the class'"
SYSTEM_SQL = "'" + MS.SYSTEM_MESSAGE + "'"


@query("distinct_rows", """
SELECT DISTINCT md5(text) AS text_md5, lang, source FROM (SELECT DISTINCT text, lang, source FROM documents)""")
def q_distinct_rows(spark, sf):
    d, _obs = TR.distinct_rows(B.table(spark, sf, "documents").select("text", "lang", "source"))
    return d.select(F.md5("text").alias("text_md5"), "lang", "source")


@query("sample_n", with_views("training_table") + f"""
SELECT doc_id, truth FROM training_table ORDER BY md5('{SEED}|' || CAST(doc_id AS VARCHAR)) LIMIT 100""")
def q_sample_n(spark, sf):
    return TR.sample_n(B.training_table(spark, sf), 100, ["doc_id"], SEED).select("doc_id", "truth")


@query("class_threshold", with_views("training_table") + """
SELECT doc_id, source FROM training_table WHERE source IN (
  SELECT source FROM training_table GROUP BY source HAVING count(*) >= 20)""")
def q_class_threshold(spark, sf):
    return TR.class_threshold(B.training_table(spark, sf), "source", 20).select("doc_id", "source")


SPLIT_SQL = with_views("training_table") + f""",
cc AS (SELECT truth, count(*) AS n FROM training_table GROUP BY truth),
tot AS (SELECT sum(n) AS total, floor(0.5 * sum(n)) AS ntrain FROM cc),
q1 AS (SELECT truth, ntrain * n / total AS cont, floor(ntrain * n / total) AS fl, ntrain FROM cc, tot),
q2 AS (SELECT truth, fl + CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, truth)
                              <= ntrain - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM q1),
ranked AS (SELECT t.doc_id, t.truth, row_number() OVER (PARTITION BY t.truth
             ORDER BY md5('{SEED}|' || CAST(t.doc_id AS VARCHAR)), t.doc_id) AS rn FROM training_table t)
SELECT r.doc_id, r.truth, CASE WHEN r.rn <= q2.quota THEN 'train' ELSE 'test' END AS split
FROM ranked r JOIN q2 USING (truth)"""


@query("stratified_split", SPLIT_SQL)
def q_split(spark, sf):
    return TR.stratified_split(B.training_table(spark, sf), "truth", 0.5, ["doc_id"], SEED).select("doc_id", "truth", "split")


@query("training_set", f"""
WITH src AS (
  SELECT DISTINCT lower(coalesce(text, '')) AS item_1, lower(coalesce(source, '')) AS item_1a,
         lower(coalesce(lang, '')) AS item_7a, lower(coalesce(truth, '')) AS true_category
  FROM ({with_views("training_table")} SELECT * FROM training_table)
  WHERE lower(coalesce(truth, '')) <> ''),
s AS (SELECT * FROM src ORDER BY md5(concat_ws('|', '{SEED}', item_1, item_1a, item_7a, true_category)),
      item_1, item_1a, item_7a, true_category LIMIT 100)
SELECT md5(item_1) AS item_1_md5, item_1a, item_7a, true_category FROM s
WHERE true_category IN (SELECT true_category FROM s GROUP BY 1 HAVING count(*) >= 20)""")
def q_training_set(spark, sf):
    from sigfolio.plans.workflows import training_set
    t = B.training_table(spark, sf).withColumnRenamed("text", "Item 1").withColumnRenamed("source", "Item 1A") \
        .withColumnRenamed("lang", "Item 7A")
    r = training_set(t, sample=100, threshold=20, seed=SEED)
    return r.select(F.md5("item_1").alias("item_1_md5"), "item_1a", "item_7a", "true_category")


@query("row_to_text", with_views("training_table") + f"""
SELECT doc_id, md5({ROW_TEXT_SQL}) AS text_md5, length({ROW_TEXT_SQL}) AS n_chars FROM training_table""")
def q_row_to_text(spark, sf):
    t = B.training_table(spark, sf).select("doc_id", row_to_text(TEXT_COLS).alias("t"))
    return t.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query("build_prompt", with_views("training_table") + f"""
SELECT doc_id, md5({PROMPT_SQL}) AS prompt_md5 FROM training_table""")
def q_build_prompt(spark, sf):
    t = B.training_table(spark, sf)
    return t.select("doc_id", F.md5(MS.build_prompt(row_to_text(TEXT_COLS), CATS)).alias("prompt_md5"))


@query("build_messages", with_views("training_table") + f"""
SELECT doc_id, 3 AS n_messages, 'system,user,assistant' AS roles,
       md5({SYSTEM_SQL} || chr(1) || {PROMPT_SQL} || chr(1) || truth) AS content_md5 FROM training_table""")
def q_build_messages(spark, sf):
    t = B.training_table(spark, sf)
    m = t.select("doc_id", MS.build_messages(MS.build_prompt(row_to_text(TEXT_COLS), CATS), truth=F.col("truth")).alias("m"))
    return m.select("doc_id", F.size("m").alias("n_messages"),
                    F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"),
                    F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "\u0001")).alias("content_md5"))


@query("training_records", with_views("training_table") + f"""
SELECT doc_id, 3 AS n_messages, md5({SYSTEM_SQL}) AS system_md5, md5({PROMPT_SQL}) AS user_md5, truth AS assistant
FROM training_table""")
def q_training_records(spark, sf):
    t = B.training_table(spark, sf).withColumnRenamed("truth", MS.TRUE_CATEGORY)
    rec = MS.training_records(t, TEXT_COLS + [MS.TRUE_CATEGORY], keep=["doc_id"], config=CATS)
    p = rec.select("doc_id", F.from_json("value", MS.RECORD_SCHEMA).alias("r")).select("doc_id", F.col("r.messages").alias("m"))
    return p.select("doc_id", F.size("m").alias("n_messages"), F.md5(F.col("m")[0]["content"]).alias("system_md5"),
                    F.md5(F.col("m")[1]["content"]).alias("user_md5"), F.col("m")[2]["content"].alias("assistant"))


REQ_SCHEMA = ("struct<custom_id: string, method: string, url: string, body: struct<max_tokens: int, model: string, "
              "messages: array<struct<role: string, content: string>>, temperature: double, top_p: int>>")


@query("batch_requests", with_views("training_table") + f"""
SELECT CAST(doc_id AS VARCHAR) AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 100 AS max_tokens,
       'gpt-4o-mini-2024-07-18' AS model, CAST(0.7 AS DOUBLE) AS temperature, 1 AS top_p, 2 AS n_messages,
       md5({PROMPT_SQL}) AS user_md5 FROM training_table""")
def q_batch_requests(spark, sf):
    t = B.training_table(spark, sf)
    req = MS.batch_requests(t, "doc_id", TEXT_COLS, CATS)
    r = req.select(F.from_json("value", REQ_SCHEMA).alias("r")).select("r.*")
    return r.select("custom_id", "method", "url", F.col("body.max_tokens").alias("max_tokens"),
                    F.col("body.model").alias("model"), F.col("body.temperature").alias("temperature"),
                    F.col("body.top_p").alias("top_p"), F.size("body.messages").alias("n_messages"),
                    F.md5(F.col("body.messages")[1]["content"]).alias("user_md5"))


def _answers(spark, sf):
    cv = B.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    ids = cv.select(F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("id"), "text")
    return MS.response_lines(ids, "id", "text")


@query("unwrap_responses", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) AS custom_id, md5(text) AS content_md5
FROM conversations WHERE role = 'assistant'""")
def q_unwrap(spark, sf):
    u = MS.unwrap_responses(_answers(spark, sf))
    return u.select("custom_id", F.md5("content").alias("content_md5"))


@query("join_responses", """
SELECT CAST(q.conv_id AS VARCHAR) || '-' || CAST(q.turn AS VARCHAR) AS custom_id, md5(q.text) AS request_md5,
       md5(a.text) AS response_md5
FROM conversations q LEFT JOIN conversations a
  ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
WHERE q.role = 'user'""")
def q_join_responses(spark, sf):
    from sigfolio.operators.joins import join_responses
    cv = B.table(spark, sf, "conversations")
    req = cv.filter(F.col("role") == "user").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("custom_id"),
        F.md5("text").alias("request_md5"))
    resp = MS.unwrap_responses(_answers(spark, sf)).select("custom_id", F.md5("content").alias("response_md5"))
    return join_responses(req, resp)


@query("order_responses", """
SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS custom_id, md5(text) AS content_md5 FROM conversations WHERE role = 'assistant'""")
def q_order_responses(spark, sf):
    cv = B.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    lines = MS.response_lines(cv.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), "id", "text")
    u = MS.order_responses(MS.unwrap_responses(lines))
    return u.select("custom_id", F.md5("content").alias("content_md5"))


@query("head_n", with_views("equity") + """
SELECT strategy_id, date, round(equity, 6) AS equity FROM equity
QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY date) <= 10""")
def q_head_n(spark, sf):
    r = TR.head_n(B.equity(spark, sf), 10, "date", series="strategy_id")
    return r.select("strategy_id", "date", F.round("equity", 6).alias("equity"))


@query("every_kth", """
SELECT event_id, pos, v AS value FROM (
  SELECT event_id, unnest(generate_series(0, len(vals) - 1)) AS pos, unnest(vals) AS v FROM (
    SELECT event_id, [CAST(json_extract(props, '$.k') AS BIGINT), CAST(json_extract(props, '$.k') AS BIGINT),
                      user_id, user_id] AS vals FROM events))
WHERE pos % 2 = 0""")
def q_every_kth(spark, sf):
    ev = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    arr = ev.select("event_id", F.array(k, k, F.col("user_id"), F.col("user_id")).alias("vals"))
    return M.every_kth(arr, "vals", 2, keep=["event_id"]).select("event_id", F.col("pos").cast("long").alias("pos"), "value")


@query("distinct_rows_counts", """
SELECT (SELECT count(*) FROM documents) AS n_pre,
       (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS n_post""")
def q_distinct_rows_counts(spark, sf):
    """Rows before / after the whole-row dedupe, in one aggregate."""
    rows = B.table(spark, sf, "documents").groupBy("text", "lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.sum("n").alias("n_pre"), F.count(F.lit(1)).alias("n_post"))
