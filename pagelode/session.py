"""Spark session defaults and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Splits of fewer rows are not worth a shuffle; nor are splits whose last task ends at
#: less than so many times the time that equal ones would take.
FEW_ROWS, UNEVEN = 1000, 1.3


def local_session(cores: str = "8", partitions: int = 8, app: str = "pagelode"):
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="pagelode-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the table, nothing upstream is
    computed again, and values fixed by the write stay fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_all_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread an input that arrives in too few or too unequal splits for the cores.

    A file of one row group is one task, whatever number of splits it is cut into: the
    rows of each split say so, which takes no more than the files' footers. An input
    whose splits keep all cores busy is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores, key)
    counted = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    rows = [r["n"] for r in counted.collect()]
    rounds = -(-len(rows) // cores)
    if sum(rows) <= FEW_ROWS * cores or rounds * max(rows) * cores <= UNEVEN * sum(rows):
        return df
    return df.repartition(4 * cores, key)
