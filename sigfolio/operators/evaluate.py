"""Classifier evaluation: accuracy, per-class accuracy, confusion matrix,
classification report, worst class, label set.

Everything is derived from one partial aggregate, the (true, predicted)
cell counts -- a table of at most (#labels x #predicted values) rows -- so
the scored table is scanned once (``worst_class`` scans it once more for
the first-seen order of the labels).  Labels are the
distinct *true* values; predictions outside them count against accuracy but
are not rows or columns of the matrix (as in scikit-learn with ``labels=``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigfolio.session import cut_lineage


def prepare(df: DataFrame, t: str, p: str) -> DataFrame:
    """Blank NULLs and lower-case both label columns (reference order)."""
    return df.withColumn(t, F.lower(F.coalesce(F.col(t).cast("string"), F.lit("")))) \
             .withColumn(p, F.lower(F.coalesce(F.col(p).cast("string"), F.lit(""))))


def cells(df: DataFrame, t: str, p: str, materialise: bool = True) -> DataFrame:
    """(t, p, n) counts: the only pass over the data.  The table has at most
    (#labels x #predicted values) rows and feeds several aggregates, so it is
    checkpointed once (shared checkpoint folder) instead of re-scanning the
    scored table for each of them."""
    c = df.groupBy(F.col(t).alias("t"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(c) if materialise else c


def _per_label(c: DataFrame) -> DataFrame:
    """label, support (true count), predicted (pred count), tp, plus N."""
    actual = c.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"),
                                                      F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    pred = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    out = actual.join(pred, "label", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    return out.withColumn("N", c.agg(F.sum("n")).scalar())


def accuracy(df: DataFrame, t: str, p: str) -> DataFrame:
    """Share of rows with prediction == truth."""
    return df.agg(F.avg((F.col(t) == F.col(p)).cast("double")).alias("accuracy"))


def per_class_accuracy(df: DataFrame, t: str, p: str, c: DataFrame | None = None) -> DataFrame:
    """One-vs-rest accuracy per true label: (N - actual - pred + 2 TP) / N.
    ``c`` reuses already computed cell counts."""
    pl = _per_label(c if c is not None else cells(df, t, p))
    acc = (F.col("N") - F.col("support") - F.col("predicted") + 2 * F.col("tp")) / F.col("N")
    return pl.select("label", acc.alias("accuracy"), "support", "predicted")


def worst_class(df: DataFrame, t: str, p: str, order: str, decimals: int = 2) -> DataFrame:
    """Label with the lowest rounded accuracy; ties -> first seen (by order)."""
    first = df.groupBy(F.col(t).alias("label")).agg(F.min(order).alias("__first"))
    pc = per_class_accuracy(df, t, p).join(first, "label")
    key = F.struct(F.bround("accuracy", decimals), F.col("__first"))
    return pc.agg(F.min_by("label", key).alias("label"),
                  F.min_by(F.bround("accuracy", decimals), key).alias("accuracy"))


def confusion_matrix(df: DataFrame, t: str, p: str, c: DataFrame | None = None) -> DataFrame:
    """(true_label, pred_label, n) over labels x labels, zeros included."""
    c = c if c is not None else cells(df, t, p)
    labels = c.select(F.col("t").alias("label")).distinct()
    arr = labels.agg(F.collect_list("label").alias("__labels"))
    grid = (arr.select(F.explode("__labels").alias("true_label"), "__labels")
               .select("true_label", F.explode("__labels").alias("pred_label")))
    return (grid.join(c.withColumnRenamed("t", "true_label").withColumnRenamed("p", "pred_label"),
                      ["true_label", "pred_label"], "left")
                .select("true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n")))


def classification_report(df: DataFrame, t: str, p: str, c: DataFrame | None = None) -> DataFrame:
    """(label, precision, recall, f1_score, support) per label plus
    'macro avg', 'weighted avg' and 'accuracy' -- or 'micro avg' when some
    prediction is not a true label.  Zero division gives 0."""
    c = c if c is not None else cells(df, t, p)
    pl = _per_label(c)

    def div(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def f1(pr, rc):
        return div(2 * pr * rc, pr + rc)

    per = pl.select("label", div(F.col("tp"), F.col("predicted")).alias("precision"),
                    div(F.col("tp"), F.col("support")).alias("recall"), "support", "tp", "predicted", "N")
    per = per.withColumn("f1_score", f1(F.col("precision"), F.col("recall")))
    foreign = c.join(pl.select(F.col("label").alias("p")), "p", "left_anti").agg(F.count(F.lit(1)))
    agg = per.agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1_score").alias("m_f"),
        F.sum("support").alias("sup"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("w_r"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("w_f"),
        F.sum("tp").alias("tp"), F.sum("predicted").alias("pred"), F.max("N").alias("N"))
    agg = agg.withColumn("k", foreign.scalar())
    mic_p = div(F.col("tp"), F.col("pred"))
    mic_r = div(F.col("tp"), F.col("sup"))
    acc = F.col("tp") / F.col("N")
    is_micro = F.col("k") > 0
    summary = agg.select(F.explode(F.array(
        F.struct(F.lit("macro avg").alias("label"), F.col("m_p").alias("precision"), F.col("m_r").alias("recall"),
                 F.col("m_f").alias("f1_score"), F.col("sup").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("w_p").alias("precision"), F.col("w_r").alias("recall"),
                 F.col("w_f").alias("f1_score"), F.col("sup").alias("support")),
        F.when(is_micro, F.struct(F.lit("micro avg").alias("label"), mic_p.alias("precision"), mic_r.alias("recall"),
                                  f1(mic_p, mic_r).alias("f1_score"), F.col("sup").alias("support")))
         .otherwise(F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                             acc.alias("f1_score"), F.col("N").alias("support"))),
    )).alias("r")).select("r.*")
    return per.select("label", "precision", "recall", "f1_score", "support").unionByName(summary)


def label_set(df: DataFrame, t: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Sorted distinct lower-cased truth labels, intersected with the
    configured categories when given."""
    labels = df.select(F.lower(F.col(t)).alias("label")).distinct()
    if categories:
        cfg = df.sparkSession.createDataFrame([(c.lower(),) for c in categories], "label string")
        labels = labels.join(F.broadcast(cfg), "label", "left_semi")
    return labels.orderBy("label")


def evaluation_report(df: DataFrame, t: str, p: str) -> DataFrame:
    """One nested row: total accuracy, per-class accuracy, report and the
    confusion matrix (for ``sink_report``)."""
    c = cells(df, t, p)  # one scan; everything below reads the small cell table
    acc = c.agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    pc = per_class_accuracy(df, t, p, c).agg(F.map_from_entries(F.collect_list(
        F.struct("label", F.bround("accuracy", 2)))).alias("per_category_accuracy"))
    rep = classification_report(df, t, p, c).agg(F.collect_list(F.struct("*")).alias("classification_report"))
    cm = confusion_matrix(df, t, p, c).agg(F.collect_list(F.struct("*")).alias("confusion_matrix"))
    return acc.select("accuracy", *[x.scalar().alias(x.columns[0]) for x in (pc, rep, cm)])
