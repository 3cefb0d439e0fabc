"""The work around the folders of ``sink_by_symbol`` stays small."""

import os

from sigfolio.sources import files as SRC
from sigfolio.sources import sinks as SNK


def test_listing_of_symbol_folders_takes_few_tasks(spark, tmp_path):
    most = 4 * spark.sparkContext.defaultParallelism
    n, path = most + 40, str(tmp_path / "by_symbol")
    df = spark.range(n).selectExpr("concat('S', id) AS ticker", "cast(id AS string) AS price")
    spark.sparkContext.setJobGroup("symbols", "symbols")
    try:
        symbols = SNK.sink_by_symbol(df, path)
        back = SRC.scan_headerless_series(spark, path, 2, {"ticker": 0, "price": 1})
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("symbols") for s in tracker.getJobInfo(j).stageIds]
        tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i is not None]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert tasks and max(tasks) <= most
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    want = sorted(f"s{i}" for i in range(n))
    assert sorted(os.listdir(path))[-n:] == [f"__sym={s}" for s in want]
    assert [r.ticker for r in symbols.collect()] == want
    assert {(r.ticker, r.price) for r in back.collect()} == {(f"S{i}", str(i)) for i in range(n)}


def test_symbol_list_opens_no_file(spark, tmp_path):
    path = str(tmp_path / "by_symbol")
    symbols = SNK.sink_by_symbol(spark.createDataFrame([("A", 1.0), ("b", 2.0)], "ticker string, price double"), path)
    assert "Scan text" not in symbols._jdf.queryExecution().toString()
    assert [r.ticker for r in symbols.collect()] == ["a", "b"]
