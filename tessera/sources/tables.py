"""Keyed table updates that produce new snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def upsert(current: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of `changes` replace those of `current` with the same key."""
    keys = [key] if isinstance(key, str) else list(key)
    kept = current.join(changes.select(*keys), keys, "left_anti")
    return kept.select(current.columns).unionByName(changes.select(current.columns))


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys that occur more than once: the check behind a uniqueness rule."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).count().filter("count > 1")


def replace_folder(df: DataFrame, path: str) -> None:
    """Puts `df` in place of the Parquet folder `path`, which `df` may read.

    The rows are written beside the folder first; only then are the two swapped by
    renaming, so that a run that dies before leaves the old folder whole.
    """
    path = path.rstrip("/")
    fresh, gone = (f"{path}.{uuid.uuid4().hex}.{word}" for word in ("new", "old"))
    df.write.parquet(fresh)
    context = df.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(context._jsc.hadoopConfiguration())
    for source, target in ((path, gone), (fresh, path)):
        if not store.rename(hadoop(source), hadoop(target)):
            raise OSError(f"{source} could not be renamed to {target}")
    store.delete(hadoop(gone), True)
    df.sparkSession.catalog.refreshByPath(path)
