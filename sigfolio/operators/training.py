"""Training-set construction: dedupe, exact seeded sampling, class
thresholds and stratified splits.

Sampling is by hash order: every row gets ``md5(seed | key...)`` and a
sample of n is the n smallest hashes -- deterministic, independent of the
partitioning, and reproducible in SQL.  Selection of the k smallest per
group is exact without sorting or collecting a group: radix selection on the
hashes (a histogram of their first 16 bits, at most 65,536 rows per group,
then the one bucket that the cut falls into) gives the exact cut, and one
filter over the wide rows takes what is below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_HEX = 4  # 16 bits -> 65,536 buckets


def sample_hash(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_threshold(df: DataFrame, label: str, n: int) -> DataFrame:
    """Keep only classes with at least n rows (partial aggregate, then a
    semi join with the qualifying class values)."""
    keep = class_counts(df, label).filter(F.col("n") >= n).select(label)
    return df.join(keep, label, "left_semi")


def distinct_rows(df: DataFrame, name: str = "distinct_rows"):
    """Whole-row dedupe; returns (df, Observation) where the observation
    carries ``n_pre`` once the result is consumed (``n_post`` = its count)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n_pre")).dropDuplicates(), obs


def _same(group: Sequence[str], prefix: str) -> Column:
    """Equal groups, NULL being a group of its own."""
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(prefix + g))
    return cond


def exact_cuts(keys: DataFrame, quota: DataFrame | int, h: str, group: Sequence[str] = ()) -> DataFrame:
    """(group..., cut, need, have): the hash of the ``quota``-th smallest row
    of each group, how many rows of that hash belong to the quota, and how
    many there are (a quota of 0: an empty cut).  Groups smaller than their
    quota have no row here.

    Radix selection on the hashes alone: a histogram of their first digits
    (partial aggregate) finds the bucket of the cut, and only its hashes --
    about 1/65,536 of the group -- are counted one by one."""
    group = list(group)
    d = keys.select(*group, h, F.substring(h, 1, HASH_BUCKET_HEX).alias("__b"))
    hist = d.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__c"))
    cum = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("__cum", F.sum("__c").over(cum))
    if isinstance(quota, DataFrame):
        q = quota.select(*[F.col(g).alias(f"__q_{g}") for g in group], "quota")
        hist = hist.join(q, _same(group, "__q_")).drop(*[f"__q_{g}" for g in group])
    else:
        hist = hist.withColumn("quota", F.lit(quota))
    edge = F.struct(F.col("__b").alias("b"), (F.col("quota") - F.col("__cum") + F.col("__c")).alias("need"))
    edge = (hist.filter(F.col("__cum") >= F.col("quota")).groupBy(*group).agg(F.min_by(edge, "__b").alias("__edge"))
            .select(*[F.col(g).alias(f"__e_{g}") for g in group], F.col("__edge.b").alias("__eb"), F.col("__edge.need").alias("__need")))
    # one row per group
    inside = d.join(F.broadcast(edge), _same(group, "__e_") & (F.col("__b") == F.col("__eb")))
    each = inside.groupBy(*group, h, "__need").agg(F.count(F.lit(1)).alias("have"))
    each = each.withColumn("__before", F.sum("have").over(
        Window.partitionBy(*group).orderBy(h).rowsBetween(Window.unboundedPreceding, 0)) - F.col("have"))
    none = F.col("__need") <= 0  # told by the group's first hash
    reached = each.filter((F.col("__before") < F.greatest("__need", F.lit(1))) & (F.col("__before") + F.col("have") >= F.col("__need")))
    return reached.select(*group, F.when(none, "").otherwise(F.col(h)).alias("cut"), (F.col("__need") - F.col("__before")).cast("long").alias("need"),
                          F.when(none, 0).otherwise(F.col("have")).cast("long").alias("have"))


def select_smallest(df: DataFrame, quota: DataFrame | int, h: str, group: Sequence[str] = (),
                    tie: Sequence[str] = (), flag: str | None = None) -> DataFrame:
    """Rows with the ``quota`` smallest ``h`` per group (ties by ``tie``).

    ``quota`` is an int (same for every group) or a DataFrame (group cols +
    ``quota``).  With ``flag`` every row is returned and ``flag`` marks the
    selected ones.

    The cut is found on hashes and groups alone and is exact; one filter then
    passes over the wide rows.  Only where more rows than needed share the
    cut's hash (repeated keys) are these rows ranked, by a second read of the
    table that adaptive execution leaves out where there are none."""
    group = list(group)
    cuts = exact_cuts(df, quota, h, group)
    named = cuts.select(*[F.col(g).alias(f"__k_{g}") for g in group], F.col("cut").alias("__cut"), F.col("need").alias("__need"),
                        (F.col("have") > F.col("need")).alias("__split"))
    helpers = [f"__k_{g}" for g in group] + ["__cut", "__need", "__split"]
    if group:  # one row per group
        j = df.join(F.broadcast(named), _same(group, "__k_"), "left")
    else:      # a single cut: a scalar subquery
        j = df.withColumn("__one", named.agg(F.first(F.struct(*helpers))).scalar()).select(*df.columns, "__one.*")
    at_cut = F.coalesce((F.col(h) == F.col("__cut")) & F.col("__split"), F.lit(False))
    main = j.filter(~at_cut).withColumn("__sel", F.col("__cut").isNull() | (F.col(h) <= F.col("__cut")))
    shared = df.join(F.broadcast(named.filter("__split")), _same(group, "__k_") & (F.col(h) == F.col("__cut")))
    rw = Window.partitionBy(*group, h).orderBy(*[F.col(t) for t in tie]) if tie else Window.partitionBy(*group, h).orderBy(h)
    shared = shared.withColumn("__sel", F.row_number().over(rw) <= F.col("__need"))
    out = main.drop(*helpers).unionByName(shared.drop(*helpers))
    return out.withColumnRenamed("__sel", flag) if flag else out.filter("__sel").drop("__sel")


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all rows if n >= size), chosen by seeded hash."""
    if n <= 0:
        return df
    h = df.withColumn("__h", sample_hash(keys, seed))
    return select_smallest(h, n, "__h", tie=keys).drop("__h")


def split_quotas(counts: DataFrame, label: str, frac: float) -> DataFrame:
    """Per-class train quota: n_train = floor(frac * N); each class gets
    floor(n_train * n_c / N) and the remainder goes to the largest
    fractional parts (ties by class value).  A class of one row goes to
    train, a NULL label is a class like any other.  One row per class."""
    # the class-count table has one row per class: tiny by construction
    c = counts.withColumn("__total", counts.agg(F.sum("n")).scalar()).withColumn("__g", F.lit(0))
    c = c.withColumn("__ntrain", F.floor(F.lit(frac) * F.col("__total")))
    c = c.withColumn("__cont", F.col("__ntrain") * F.col("n") / F.col("__total"))
    c = c.withColumn("__floor", F.floor("__cont"))
    c = c.withColumn("__rem", F.col("__cont") - F.col("__floor"))
    w = Window.partitionBy("__g").orderBy(F.col("__rem").desc(), F.col(label))
    c = c.withColumn("__left", F.col("__ntrain") - F.sum("__floor").over(Window.partitionBy("__g")))
    c = c.withColumn("quota", F.col("__floor") + F.when(F.row_number().over(w) <= F.col("__left"), 1).otherwise(0))
    quota = F.when(F.col("n") == 1, F.lit(1)).otherwise(F.col("quota"))
    return c.select(label, quota.cast("long").alias("quota"))


def stratified_split(df: DataFrame, label: str, frac: float, keys: Sequence[str], seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Adds ``out`` = 'train' / 'test' keeping class shares; the train side
    is the ``quota`` smallest seeded hashes of each class."""
    q = split_quotas(class_counts(df, label), label, frac)
    h = df.withColumn("__h", sample_hash(keys, seed))
    sel = select_smallest(h, q, "__h", group=[label], tie=keys, flag="__train")
    return sel.withColumn(out, F.when(F.col("__train"), "train").otherwise("test")).drop("__h", "__train")


def union_symbols(*dfs: DataFrame, col: str = "ticker") -> DataFrame:
    """Distinct union of symbol sets."""
    out = dfs[0].select(col)
    for d in dfs[1:]:
        out = out.unionByName(d.select(col))
    return out.distinct()


def minus_symbols(a: DataFrame, b: DataFrame, col: str = "ticker") -> DataFrame:
    """Symbols of a not in b."""
    return a.select(col).distinct().join(b.select(col), col, "left_anti")


def distinct_symbols(df: DataFrame, col: str = "ticker") -> DataFrame:
    """Sorted distinct symbol list."""
    return df.select(col).distinct().orderBy(col)


def head_n(df: DataFrame, n: int, order: str, series: str | None = None) -> DataFrame:
    """First n rows by ``order`` (per series when given)."""
    if series is None:
        return df.orderBy(order).limit(n)
    w = Window.partitionBy(series).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
