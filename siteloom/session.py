"""Session defaults and lineage cutting that survives the loss of an executor."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "siteloom", cpus: str | None = None) -> SparkSession:
    """A session for local use; on a cluster the submitter's settings win over all of these."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus))))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")  # rows here cost more than their bytes say
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # files of frames that nothing refers to any more
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; a temporary one only on a local master, where
    none is named (tests, local runs).
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siteloom-checkpoint-")
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def of_one_scan(df: DataFrame) -> bool:
    """Whether a frame is made row by row from one table, so that making it again, narrowed to what is asked, costs less than
    keeping it.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    at = plan
    while at.children().size() == 1:
        if at.nodeName() not in ("Project", "Filter"):
            return False
        at = at.children().apply(0)
    return at.children().isEmpty()
