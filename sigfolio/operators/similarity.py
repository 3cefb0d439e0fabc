"""Vector similarity of texts to categories: cosine, all pairs, top-k.

Texts and categories are dealt to tiles, and a task scores one tile of texts
against one tile of categories by matrix products, so no task and no driver
holds a whole side: a text is copied once per tile of categories and a
category once per tile of texts.  A task keeps the best k of each text; what
the tiles of one text keep (k each) meets in one aggregate.

A similarity is the same whatever the tiles: products only choose candidates,
and their scores are summed again in one order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Categories of a tile, and texts of one.
TILE_CATEGORIES = 65_536
TILE_TEXTS = 65_536
#: Scores that are held at once.
SCORES = 1 << 22
#: By how much rounding may move a score.
MARGIN = 1e-9


def _unit(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: (places, vectors of norm 1).  Vectors that are
    NULL, zero, or hold a NULL have no direction and are left out."""
    lists = column.combine_chunks()
    lists = lists.cast(pa.list_(pa.float64()))
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    known = np.asarray(flat.is_valid())
    value, at = np.nan_to_num(flat.to_numpy(zero_copy_only=False), nan=np.nan), np.r_[0, np.cumsum(sizes)]
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        cells = at[rows][:, None] + np.arange(size)
        vec, ok = value[cells], known[cells].all(axis=1)
        norm = np.sqrt((vec * vec).sum(axis=1))
        ok &= norm > 0
        out[size] = rows[ok], vec[ok] / norm[ok][:, None]
    return out


def _tiles(texts: DataFrame, cats: DataFrame, key: str, tvec: str, name: str, idx: str, vec: str, blocks: int | None):
    """Both sides with (__t, __c), each row once for every tile of the other."""
    if blocks is not None and blocks <= 0:
        raise ValueError("blocks must be positive")
    n_c = blocks or max(1, -(-cats.count() // TILE_CATEGORIES))
    n_t = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // TILE_TEXTS))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # rows of equal keys stay rows of their own
    left = texts.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(tvec).alias("__tvec"))
    left = left.withColumn("__t", F.pmod(F.xxhash64("__row"), F.lit(n_t)).cast("int")).withColumn("__c", every(n_c))
    right = cats.select(F.col(idx).alias("__idx"), F.col(name).cast("string").alias("__name"), F.col(vec).alias("__vec"))
    right = right.withColumn("__c", F.pmod(F.xxhash64("__idx"), F.lit(n_c)).cast("int")).withColumn("__t", every(n_t))
    return left.groupBy("__t", "__c"), right.groupBy("__t", "__c"), left.schema, right.schema


def _scored(left: pa.Table, right: pa.Table, k: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text rows, category rows, similarities) of a pair of tiles, all or the
    best ``k`` of each text, some texts at a time.  A vector without a
    direction, or of another length, is 0 to the others."""
    n, m = left.num_rows, right.num_rows
    order = np.argsort(right.column("__idx").to_numpy(zero_copy_only=False), kind="stable")  # ties keep category order
    place = np.empty(m, "i8")
    place[order] = np.arange(m)
    texts, cats = _unit(left.column("__tvec")), _unit(right.column("__vec"))
    size_of = np.zeros(n, "i8")
    row_of = np.zeros(n, "i8")
    for size, (rows, _) in texts.items():
        size_of[rows], row_of[rows] = size, np.arange(len(rows))
    step = max(1, SCORES // max(m, 1))
    for size in np.unique(size_of).tolist():
        mine = np.flatnonzero(size_of == size)
        here, vecs = cats.get(size, (np.empty(0, "i8"), np.empty((0, max(size, 1)))))
        for a in range(0, len(mine), step):
            rows = mine[a:a + step]
            score = np.zeros((len(rows), m))
            own = texts[size][1][row_of[rows]] if size else None
            if size and len(here):
                score[:, here] = own @ vecs.T
            if k is None or k >= m:
                i, j = np.divmod(np.arange(len(rows) * m), m)
            else:  # all whose score may be among the best k but for rounding
                edge = np.partition(score, m - k, axis=1)[:, m - k]
                i, j = np.nonzero(score >= edge[:, None] - MARGIN)
            exact = np.zeros(len(i))
            if size and len(here):
                at = np.full(m, -1)
                at[here] = np.arange(len(here))
                with_dir = at[j] >= 0
                for b in range(0, len(i), step * 16):
                    part = np.flatnonzero(with_dir[b:b + step * 16]) + b
                    exact[part] = (own[i[part]] * vecs[at[j[part]]]).sum(axis=1)
            if k is not None:
                by = np.lexsort((place[j], -exact, i))
                i, j, exact = i[by], j[by], exact[by]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, exact = i[nth < k], j[nth < k], exact[nth < k]
            yield rows[i], j, exact


def _pairs(texts, cats, key, tvec, name, idx, vec, blocks, k) -> DataFrame:
    """(__row, __key, __idx, __name, __similarity) of every pair of tiles."""
    left, right, ls, rs = _tiles(texts, cats, key, tvec, name, idx, vec, blocks)
    schema = T.StructType([ls["__row"], ls["__key"], rs["__idx"], rs["__name"], T.StructField("__similarity", T.DoubleType())])

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        found = list(_scored(a, b, k)) if a.num_rows and b.num_rows else []
        i, j, s = (np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in enumerate(("i8", "i8", "f8")))
        return pa.table({"__row": a.column("__row").take(i), "__key": a.column("__key").take(i), "__idx": b.column("__idx").take(j),
                         "__name": b.column("__name").take(j), "__similarity": pa.array(s)})

    return left.cogroup(right).applyInArrow(score, schema)


def cross_similarity(texts: DataFrame, cats: DataFrame, key: str = "vec_id", tvec: str = "embedding",
                     name: str = "category", idx: str = "cat_idx", vec: str = "vec", blocks: int | None = None) -> DataFrame:
    """(key, cat_idx, category, similarity) for every text and category.

    ``blocks``: tiles of categories (None: by their number).  Counts rows of
    both sides while the plan is built."""
    found = _pairs(texts, cats, key, tvec, name, idx, vec, blocks, None)
    return found.select(F.col("__key").alias(key), F.col("__idx").alias("cat_idx"), F.col("__name").alias("category"),
                        F.col("__similarity").alias("similarity"))


def topk_categories(texts: DataFrame, cats: DataFrame, k: int = 1, key: str = "vec_id",
                    tvec: str = "embedding", name: str = "category", idx: str = "cat_idx", vec: str = "vec",
                    blocks: int | None = None) -> DataFrame:
    """(key, rank, category, probability): the k most similar categories
    of every text row; k is capped at the number of categories, ties keep
    category order; no categories -> no rows.  Counts rows of both sides
    while the plan is built."""
    if k <= 0:
        raise ValueError("k must be positive")
    found = _pairs(texts, cats, key, tvec, name, idx, vec, blocks, k)
    one = F.struct((-F.col("__similarity")).alias("neg"), F.col("__idx").alias("idx"), F.col("__name").alias("name"))
    best = found.groupBy("__row").agg(F.first("__key").alias(key), F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("__best"))
    return (best.select(key, F.posexplode("__best").alias("pos", "b"))
                .select(key, (F.col("pos") + 1).alias("rank"), F.col("b.name").alias("category"),
                        (-F.col("b.neg")).alias("probability")))
