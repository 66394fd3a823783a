"""Session construction and lineage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "paysift") -> SparkSession:
    """Local session for tests and the bench. On a cluster the caller's session is used as is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # checkpoint files of released DataFrames (tree levels, boosting rounds) are deleted
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir`` (a shared folder every executor can reach).
    Only a local-mode session without that setting (tests, laptop runs) gets a private scratch
    folder; on a cluster a missing setting is an error, never a machine-local folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (iterative plans checkpoint there)")
        conf_dir = tempfile.mkdtemp(prefix="paysift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: iterative plans (tree levels,
    boosting rounds) restart from here when an executor is lost, and the plan stays short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count (falls back to the default parallelism when the
    setting is not a number, e.g. ``auto``)."""
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        return spark.sparkContext.defaultParallelism


# Rows of a shuffled table that a task takes at most, where the keys allow.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, by ``keys`` in as many partitions as leave ``TASK_ROWS`` to a
    task. Unchanged where the session's shuffle partitions do already."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > shuffle_partitions(df.sparkSession) else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of tables that nothing refers to any
    more. It does so when the driver collects garbage, which may be long after a large shuffle."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables written to the shared checkpoint folder and deleted when the block ends. Unlike a
    checkpoint, a table that is read back has its true size for the planner: the estimates of
    joined checkpoints multiply from round to round."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
