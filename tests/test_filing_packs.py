"""Packs of filings: every filing comes back whole, and the number of files
does not grow with the filings."""

import glob

from pyspark.sql import functions as F

from sigfolio.plans import q_io
from sigfolio.sources import files as SRC
from sigfolio.sources import sinks as SNK


def _files(root):
    return glob.glob(f"{root}/year=*/quarter=*/**/*.txt", recursive=True)


def test_packed_filings_come_back_as_files_would(spark, tmp_path):
    odd = "a\x1eb\x1fNc\x1fE\x1fS\x1f\r\n\n d "
    rows = [(2020, "QTR1", "20200101_10-K_edgar_data_1.txt", odd), (2020, "QTR1", "20200101_10-K-A_edgar_data_2.txt", "no"),
            (2021, "QTR4", "20211201_10-K_edgar_data_3.txt", None), (2020, "QTR2", "20200401_10-K_edgar_data_4.txt", "x"),
            (2020, "QTR2", "20200401_10-K_edgar_data_4.txt", "x"), (2020, "QTR3", "20200701_10-K_edgar_data_\x1e5.txt", ""),
            (2019, "QTR1", "20190101_10-K_edgar_data_6.txt", "other year"), (None, None, None, "no date"), (2020, "QTR1", None, "no name")]
    df = spark.createDataFrame(rows, "year int, quarter string, filing string, content string")
    packed, whole = str(tmp_path / "packs"), str(tmp_path / "files")
    SNK.sink_filings(df, packed)
    df.repartition(1).write.partitionBy("year", "quarter", "filing").text(whole)
    key = lambda r: (r.year, r.quarter, r.content)
    got = SRC.scan_filings(spark, packed, [2020, 2021], "10-K", hive_layout=True, packed=True).collect()
    want = SRC.scan_filings(spark, whole, [2020, 2021], "10-K", hive_layout=True).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 4
    assert {r.path.split("/")[-1] for r in got} == {r[2] for r in rows if r[2] and "10-K_" in r[2] and r[0] != 2019}
    assert all("/year=2020/quarter=QTR1/" in r.path for r in got if r.content == odd + "\n")


def test_files_of_the_exported_corpus_do_not_grow_with_filings(spark, tmp_path):
    def tables(n):
        sf = tmp_path / str(n)
        (spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'fr' AS lang", "'src' AS source")
              .coalesce(1).write.parquet(str(sf / "documents.parquet")))
        return str(sf)
    small, large = (_files(q_io._export_filings(spark, tables(n))) for n in (400, 1200))
    assert len(large) <= len(small) + 8 and len(large) < 60
    sf = str(tmp_path / "1200")
    assert q_io.q_scan_filings(spark, sf).count() == q_io.q_compact_filings(spark, sf).count() == 1200


def test_contents_are_worked_out_once_and_not_shuffled(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"text {i}"

    df = spark.range(0, 60, 1, 3).select(F.lit(2020).alias("year"), F.lit("QTR1").alias("quarter"), F.concat(
        F.lit("20200101_10-K_edgar_data_"), F.col("id"), F.lit(".txt")).alias("filing"), text("id").alias("content"))
    root = SNK.sink_filings(df, str(tmp_path / "once"))
    assert made.value == 60
    got = SRC.scan_filings(spark, root, [2020], "10-K", hive_layout=True, packed=True).collect()
    assert sorted(r.content for r in got) == sorted(f"text {i}\n" for i in range(60))


def test_only_repeated_names_are_put_together(spark, tmp_path):
    name = "20200101_10-K_edgar_data_{}.txt".format
    rows = [(2020, "QTR1", name(i), f"c{i}") for i in range(4)] + [(2020, "QTR1", name(2), "b2"), (2020, "QTR1", name(3), None),
            (2020, "QTR2", name(2), "other quarter"), (2020, "QTR1", None, "x"), (2020, "QTR1", None, "y"), (None, "QTR1", name(1), "z"), (None, "QTR1", name(1), "w")]
    df = spark.createDataFrame(rows, "year int, quarter string, filing string, content string").repartition(5)
    root = SNK.sink_filings(df, str(tmp_path / "twice"))
    got = SRC.scan_filings(spark, root, [2020], "10-K", hive_layout=True, packed=True).collect()
    assert sorted((r.quarter, r.path.split("/")[-1], r.content) for r in got) == [
        ("QTR1", name(0), "c0\n"), ("QTR1", name(1), "c1\n"), ("QTR1", name(2), "b2\nc2\n"), ("QTR1", name(3), "\nc3\n"),
        ("QTR2", name(2), "other quarter\n")]
    files = [open(f, newline="").read() for f in glob.glob(f"{root}/**/*.txt", recursive=True)]
    assert sum("x\ny\n" in f for f in files) == sum("w\nz\n" in f for f in files) == 1
