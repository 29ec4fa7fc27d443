"""Session helpers: size checks before a broadcast, and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it is counted to hold no more rows than this.
# The rows in question are narrow (ids, ranks, short query text).
BROADCAST_ROWS = 100_000
# Ranked candidates are two ids, a score and a rank each.
CANDIDATE_ROWS = 400_000
# While this holds, a query's shuffle files go when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "tessera"):
    """Single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most `max_rows` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """Spreads a small input over all cores; a large one has enough splits as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def hint_small(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint for a side already checked; otherwise the planner decides."""
    return F.broadcast(df) if small else df


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, if it names one.

    A local session without one gets a temporary folder that goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[application], ignore_errors=True)
    return _LOCAL_FOLDERS[application]


def intermediate_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a write's shuffle files go as it ends; its rows are in files by then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, partition_by: str | None = None, codec: str | None = None) -> DataFrame:
    """Writes the table once to the shared folder and reads it back.

    Cuts lineage, so later stages and lost executors re-read files instead of
    recomputing, and keeps the result columnar so readers prune columns.  The files
    stay until `drop_intermediate`; the shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = f"{intermediate_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if codec is not None:
        writer = writer.option("compression", codec)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    with freed_shuffles(spark):
        writer.parquet(path)
    # With the schema at hand no job has to read it from the files.
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediate(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables, once their readers are done."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(intermediate_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
