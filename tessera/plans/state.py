"""Corpus state: the tables an ingest reads and the new snapshot it returns."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.sources.files import root_exists

TABLE_SCHEMAS = {
    "documents": schemas.DOCUMENTS,
    "chunks": schemas.CHUNKS,
    "vectors": schemas.VECTORS,
    "runs": schemas.RUNS,
}
ID_BUCKETS = 4096


@dataclass(frozen=True)
class CorpusState:
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    runs: DataFrame


def empty_state(spark: SparkSession) -> CorpusState:
    return CorpusState(**{n: spark.createDataFrame([], s) for n, s in TABLE_SCHEMAS.items()})


def write_state(state: CorpusState, path: str) -> None:
    """Writes a snapshot into a new folder; a folder being read is never replaced."""
    for field in fields(state):
        getattr(state, field.name).write.parquet(f"{path}/{field.name}")


def read_state(spark: SparkSession, path: str) -> CorpusState:
    return CorpusState(
        **{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in TABLE_SCHEMAS.items()}
    )


class SnapshotLog:
    """Snapshots below one folder, and a ledger of the batches that made them.

    A snapshot is written first, into a folder of its own; the ledger row that names it is
    the commit.  A run that dies before that row leaves only a folder that nothing reads, and
    a batch found in the ledger has had its effect.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> DataFrame:
        """The ledger: version, source, batch_id and the snapshot's folder."""
        if not root_exists(self.spark, f"{self.folder}/ledger"):
            return self.spark.createDataFrame([], schemas.LEDGER)
        reader = self.spark.read.schema(schemas.LEDGER).option("recursiveFileLookup", "true")
        return reader.parquet(f"{self.folder}/ledger")

    def holds(self, source: str, batch_id: int) -> bool:
        """Whether a batch of a source (a stream's checkpoint) is in the ledger."""
        same = (F.col("source") == source) & (F.col("batch_id") == batch_id)
        return not self.entries().filter(same).isEmpty()

    def latest(self) -> CorpusState:
        """The snapshot entered last; an empty state before the first."""
        last = self.entries().agg(F.max_by("folder", "version").alias("folder")).first().folder
        return empty_state(self.spark) if last is None else read_state(self.spark, f"{self.folder}/{last}")

    def commit(self, state: CorpusState, source: str, batch_id: int) -> None:
        """Stores the state that a batch led to, then enters the batch."""
        name = f"snapshots/{uuid.uuid4().hex}"
        write_state(state, f"{self.folder}/{name}")
        version = self.entries().agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
        row = self.spark.createDataFrame([(version, source, batch_id, name)], schemas.LEDGER)
        # An entry that was cut short has no file yet and is written again.
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/{version}")


def dense_ids(df: DataFrame, key: str, name: str, start: int) -> DataFrame:
    """Numbers distinct keys from `start` without gaps, collisions or a global sort.

    Keys are numbered inside hash buckets and shifted by the sizes of the earlier
    buckets; only the bucket sizes (a fixed number of rows) meet in one task.
    """
    from pyspark.sql import Window

    bucketed = df.withColumn("id_bucket", F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)))
    earlier = Window.orderBy("id_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        bucketed.groupBy("id_bucket")
        .agg(F.count("*").alias("n"))
        .select("id_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    local = Window.partitionBy("id_bucket").orderBy(key)
    return (
        bucketed.withColumn("local", F.row_number().over(local))
        .join(F.broadcast(shifts), "id_bucket")  # at most ID_BUCKETS rows
        .withColumn(name, F.lit(start) + F.col("shift") + F.col("local") - 1)
        .drop("id_bucket", "local", "shift")
    )
