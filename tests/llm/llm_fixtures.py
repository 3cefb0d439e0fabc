"""Tables for the tests of the training-data operators."""


def docs_frame(spark, rows, extra=True):
    """(doc_id, text) rows as a documents table; extra columns clash on purpose."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F
        for name in ("group", "fp", "term", "size", "root", "rank", "id", "start", "shard", "score", "cell", "w"):
            df = df.withColumn(name, F.lit("x"))
    return df
