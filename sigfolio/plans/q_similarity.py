"""Vector similarity queries over ``embeddings`` (categories = the lowest
vec_id of each label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfolio.functions.vectors import cosine_similarity
from sigfolio.operators import similarity as S
from sigfolio.plans import bindings as B
from sigfolio.plans.oracle import with_views
from sigfolio.plans.registry import query



def _cos_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query("cosine_similarity", with_views("categories") + f"""
SELECT vec_id, round(CASE WHEN isnan(x) THEN 0 ELSE x END, 9) AS similarity FROM (
  SELECT e.vec_id, {_cos_sql('e.embedding', 'c.vec')} AS x FROM embeddings e JOIN categories c ON c.cat_idx = e.label)""")
def q_cosine(spark, sf):
    e = B.table(spark, sf, "embeddings")
    c = B.categories(spark, sf)
    j = e.join(c, e.label == c.cat_idx)
    return j.select("vec_id", F.round(cosine_similarity("embedding", "vec"), 9).alias("similarity"))


@query("cross_similarity", with_views("categories") + f"""
SELECT vec_id, cat_idx, category, round(CASE WHEN isnan(x) THEN 0 ELSE x END, 9) AS similarity FROM (
  SELECT e.vec_id, c.cat_idx, c.category, {_cos_sql('e.embedding', 'c.vec')} AS x FROM embeddings e, categories c)""")
def q_cross(spark, sf):
    r = S.cross_similarity(B.table(spark, sf, "embeddings"), B.categories(spark, sf))
    return r.select("vec_id", "cat_idx", "category", F.round("similarity", 9).alias("similarity"))


@query("topk_categories", with_views("categories") + f"""
SELECT vec_id, rank, category, round(x, 9) AS probability FROM (
  SELECT vec_id, category, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, cat_idx) AS rank FROM (
    SELECT e.vec_id, c.cat_idx, c.category,
           CASE WHEN isnan({_cos_sql('e.embedding', 'c.vec')}) THEN 0 ELSE {_cos_sql('e.embedding', 'c.vec')} END AS x
    FROM embeddings e, categories c))
WHERE rank <= 3""")
def q_topk(spark, sf):
    r = S.topk_categories(B.table(spark, sf, "embeddings"), B.categories(spark, sf), k=3)
    return r.select("vec_id", F.col("rank").cast("long").alias("rank"), "category",
                    F.round("probability", 9).alias("probability"))
