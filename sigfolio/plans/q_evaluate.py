"""Classifier statistics bound to ``scored`` (labels as truth / prediction)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfolio.operators import evaluate as E
from sigfolio.plans import bindings as B
from sigfolio.plans.oracle import with_views
from sigfolio.plans.registry import query

T, P = "true_category", "llm_model_category"
# Fixed value of the reference configuration: the classifier's categories.
CONFIG_CATEGORIES = ["buy", "sell"]

CELLS = with_views("scored") + """,
prep AS (SELECT doc_id, lower(coalesce(true_category, '')) AS t, lower(coalesce(llm_model_category, '')) AS p FROM scored),
c AS (SELECT t, p, count(*) AS n FROM prep GROUP BY 1, 2),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS N FROM c),
a AS (SELECT t AS label, CAST(sum(n) AS BIGINT) AS support,
             CAST(sum(CASE WHEN t = p THEN n ELSE 0 END) AS BIGINT) AS tp FROM c GROUP BY t),
pr AS (SELECT p AS label, CAST(sum(n) AS BIGINT) AS predicted FROM c GROUP BY p),
pl AS (SELECT a.label, a.support, a.tp, coalesce(pr.predicted, 0) AS predicted, tot.N
       FROM a LEFT JOIN pr USING (label) CROSS JOIN tot)
"""


def _scored(spark, sf):
    return E.prepare(B.scored(spark, sf), T, P)


@query("accuracy", CELLS + "SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 12) AS accuracy FROM prep")
def q_accuracy(spark, sf):
    return E.accuracy(_scored(spark, sf), T, P).select(F.round("accuracy", 12).alias("accuracy"))


@query("per_class_accuracy", CELLS + """
SELECT label, round((N - support - predicted + 2 * tp) / N, 12) AS accuracy, support, CAST(predicted AS BIGINT) AS predicted FROM pl""")
def q_per_class(spark, sf):
    r = E.per_class_accuracy(_scored(spark, sf), T, P)
    return r.select("label", F.round("accuracy", 12).alias("accuracy"), "support", "predicted")


@query("worst_class", CELLS + """
SELECT label, accuracy FROM (
  SELECT pl.label, round_even((N - support - predicted + 2 * tp) / N, 2) AS accuracy, f.first
  FROM pl JOIN (SELECT t AS label, min(doc_id) AS first FROM prep GROUP BY t) f USING (label))
ORDER BY accuracy, first LIMIT 1""")
def q_worst(spark, sf):
    return E.worst_class(_scored(spark, sf), T, P, order="doc_id")


@query("confusion_matrix", CELLS + """
SELECT x.label AS true_label, y.label AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM a x CROSS JOIN a y LEFT JOIN c ON c.t = x.label AND c.p = y.label""")
def q_confusion(spark, sf):
    return E.confusion_matrix(_scored(spark, sf), T, P)


@query("classification_report", CELLS + """,
per AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
               support, tp, predicted FROM pl),
per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM per),
foreign_n AS (SELECT count(*) AS k FROM c WHERE p NOT IN (SELECT label FROM a)),
s AS (SELECT avg(precision) AS m_p, avg(recall) AS m_r, avg(f1_score) AS m_f, CAST(sum(support) AS BIGINT) AS sup,
             sum(precision * support) / sum(support) AS w_p, sum(recall * support) / sum(support) AS w_r,
             sum(f1_score * support) / sum(support) AS w_f, sum(tp) AS tp, sum(predicted) AS pred FROM per2),
mic AS (SELECT coalesce(tp / nullif(pred, 0), 0) AS mp, coalesce(tp / nullif(sup, 0), 0) AS mr FROM s),
rows AS (
  SELECT label, precision, recall, f1_score, support FROM per2
  UNION ALL SELECT 'macro avg', m_p, m_r, m_f, sup FROM s
  UNION ALL SELECT 'weighted avg', w_p, w_r, w_f, sup FROM s
  UNION ALL SELECT 'micro avg', mp, mr, coalesce(2 * mp * mr / nullif(mp + mr, 0), 0), sup FROM mic, s, foreign_n WHERE k > 0
  UNION ALL SELECT 'accuracy', s.tp / tot.N, s.tp / tot.N, s.tp / tot.N, tot.N FROM s, tot, foreign_n WHERE k = 0)
SELECT label, round(precision, 12) AS precision, round(recall, 12) AS recall, round(f1_score, 12) AS f1_score,
       CAST(support AS BIGINT) AS support FROM rows""")
def q_report(spark, sf):
    r = E.classification_report(_scored(spark, sf), T, P)
    return r.select("label", *[F.round(c, 12).alias(c) for c in ("precision", "recall", "f1_score")],
                    F.col("support").cast("long").alias("support"))


@query("label_set", CELLS + """
SELECT DISTINCT lower(t) AS label FROM prep WHERE lower(t) IN ('buy', 'sell')""")
def q_label_set(spark, sf):
    return E.label_set(_scored(spark, sf), T, CONFIG_CATEGORIES)


@query("intersect_categories", CELLS + """
SELECT DISTINCT lower(p) AS label FROM prep WHERE lower(p) IN ('buy', 'sell')""")
def q_intersect(spark, sf):
    s = _scored(spark, sf)
    cfg = spark.createDataFrame([(c,) for c in CONFIG_CATEGORIES], "label string")
    return s.select(F.lower(P).alias("label")).intersect(cfg)
