"""Connected components of a table of links, wholly as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def _oriented(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, each link once."""
    return (edges.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest
    node reachable.

    Alternates the large-star and the small-star step until the links are
    stars.  Every round is written to the shared folder.  Minima are partial
    aggregates and stars meet their links in a join, so the links of one node
    need not fit in one task.
    """
    e = cut_lineage(_oriented(edges), "links")
    state = _state(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _oriented(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _oriented(large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                          .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        e = cut_lineage(small, "links")
        now = _state(e)
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components: not done after {max_rounds} rounds")
