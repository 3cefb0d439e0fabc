"""Spark session defaults and the shared checkpoint folder.

The library never picks a machine-local folder on a cluster: anything that
must outlive a task (stream checkpoints, lineage cuts, exported corpora) goes
below ``spark.checkpoint.dir`` as configured by the cluster; without that
setting only a local session gets a scratch folder.  What is written there
belongs to its caller's result: ``stages()`` gathers the paths and removes
them when the block ends.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "sigfolio") -> SparkSession:
    """Session with the settings every job here assumes (UTC, AQE, no UI)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # streaming state off-heap and incrementally checkpointed
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session without one is an error on a cluster, where a folder of one
    machine would lose what other machines write.  Only a local session
    (tests, a laptop) gets a scratch folder.
    """
    root = spark.conf.get(_CKPT_KEY, None) or None
    if root is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="sigfolio-ckpt-")
        spark.conf.set(_CKPT_KEY, root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root.  Within a
    ``stages()`` block it belongs to the block."""
    path = os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if _blocks.get():
        _blocks.get()[-1].append(path)
    return path


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of a folder or file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none where it does not exist."""
    fs, p = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


@contextlib.contextmanager
def few_listing_tasks(spark: SparkSession):
    """Readers made within list their folders in a few tasks per core.  Spark
    deals them to as many as 10,000, whose start takes far longer than the
    listing."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(int(before or 10_000), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table below the shared checkpoint
    folder and read it back: the plan is computed once (an RDD checkpoint
    would recompute it for the write), the result survives executor loss,
    and later jobs read a small columnar table.  Never localCheckpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: The open blocks of this thread (or task), innermost last.
_blocks: contextvars.ContextVar[tuple[list, ...]] = contextvars.ContextVar("sigfolio_blocks", default=())


def own_table(name: str) -> None:
    """A catalog table that goes with the innermost open block."""
    if _blocks.get():
        _blocks.get()[-1].append(("table", name))


@contextlib.contextmanager
def stages(spark: SparkSession):
    """Remove what ``cut_lineage`` and ``scratch_path`` give within the block
    once it ends: consume or write its results inside.

    Blocks may be nested (a path belongs to the innermost) and may end in any
    order; other threads have blocks of their own."""
    held: list = []
    _blocks.set((*_blocks.get(), held))
    try:
        yield held
    finally:
        _blocks.set(tuple(b for b in _blocks.get() if b is not held))
        for path in held:
            if isinstance(path, tuple):
                spark.sql(f"DROP TABLE IF EXISTS {path[1]}")
            else:
                remove_path(spark, path)
