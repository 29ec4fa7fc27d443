"""Structured Streaming: ingest of landing folders and the event tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera import schemas
from tessera.operators.runlog import number_events
from tessera.plans.ingest import ingest_files
from tessera.plans.state import SnapshotLog
from tessera.session import materialize
from tessera.sources.files import (
    DOC_TYPES,
    LISTING,
    describe_files,
    extension,
    plain_path,
    read_listed,
    root_exists,
)


def stream_files(spark: SparkSession, root: str, files_per_batch: int = 10_000) -> DataFrame:
    """New files of an append-only folder; edits of a known path are not seen again."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(schemas.FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    return files.filter(extension(F.col("path")).isin(list(DOC_TYPES))).withColumn(
        "path", plain_path(F.col("path"))
    )


def ingest_stream(
    spark: SparkSession,
    root: str,
    checkpoint: str,
    log: SnapshotLog,
    files_per_batch: int = 10_000,
    listing: str | None = None,
    **options,
) -> StreamingQuery:
    """Ingests what has newly arrived below `root` into the log's latest state, then stops.

    Deletion detection is off: files outside the micro-batch are not missing.  The files of
    a batch are read once, with their fingerprints, into the shared folder.  A batch takes
    effect once: one that is replayed after a failure is passed over if its state was stored,
    and otherwise starts from the same state as before.  A batch without files adds no run.

    Spark's stream keeps the path of every file below `root` in the driver.  Where whatever
    lands the files also appends their (path, modificationTime, length) to a Parquet table,
    `listing`, the stream is that of the table, `files_per_batch` counts its files, and tasks
    read what it names by path.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if log.holds(checkpoint, batch_id):
            return
        files = materialize(describe_files(batch if listing is None else read_listed(batch)))
        if files.isEmpty():
            return
        result = ingest_files(files, [root], log.latest(), detect_deletions=False, **options)
        log.commit(result.state, checkpoint, batch_id)

    if listing is None:
        arrived = stream_files(spark, root, files_per_batch)
    else:
        arrived = stream_events(spark, listing, StructType.fromDDL(LISTING), files_per_batch)
    return (
        arrived.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_events(
    spark: SparkSession,
    path: str,
    schema: StructType = schemas.JOB_EVENTS,
    files_per_batch: int = 1,
) -> DataFrame:
    """Tail of an append-only parquet event log; the checkpoint is the cursor."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def copy_events(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Delivers each event once to `target`, then stops."""
    return (
        events.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def numbered_events(spark: SparkSession, target: str) -> DataFrame:
    """Events that `number_stream` has written, with their sequence and batch."""
    return spark.read.parquet(f"{target}/events")


def number_stream(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Numbers new events per job, on from the numbers of all earlier batches, then stops.

    `events` has (id, job_id, created_at, ...).  A batch is ordered as `number_events` orders
    it, and a late event comes after those of earlier batches.  Every batch has a folder of
    its own for its rows and for the last number of each job it met, and reads the last
    numbers of the batches before it: a replayed batch writes the same rows over its own.
    The last numbers are a narrow table met by a join, so that neither a busy job nor many
    jobs are the state of one task.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prior = None
        if batch_id > 0 and root_exists(spark, f"{target}/last"):
            prior = spark.read.parquet(f"{target}/last").filter(F.col("batch_id") < batch_id)
        rows = number_events(batch, prior)
        rows.write.mode("overwrite").parquet(f"{target}/events/batch_id={batch_id}")
        written = spark.read.schema(rows.schema).parquet(f"{target}/events/batch_id={batch_id}")
        last = written.groupBy("job_id").agg(F.max("sequence").alias("sequence"))
        last.write.mode("overwrite").parquet(f"{target}/last/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
