"""File sources: discovery, fingerprints, decoding and parsing into documents."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as T
from tessera.session import materialize
from tessera.sources.html import html_parts

# --- fixed values -----------------------------------------------------------
DOC_TYPES = {
    ".md": "markdown",
    ".txt": "text",
    ".html": "html",
    ".htm": "html",
    ".pdf": "pdf",
}
# ----------------------------------------------------------------------------
TOO_LARGE = "FileTooLarge: the file is above spark.sql.sources.binaryFile.maxLength"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(T.source_name(path), r"(?<=.)\.[^.]+$", 0))


def doc_type(path: Column, strict: bool = False) -> Column:
    """Document type by file extension; null, or an error when strict, if unknown."""
    known = F.create_map(*(F.lit(v) for pair in DOC_TYPES.items() for v in pair))
    found = known[extension(path)]
    if not strict:
        return found
    problem = F.raise_error(F.concat(F.lit("Unsupported file type: "), extension(path)))
    return F.coalesce(found, problem.cast("string"))


def plain_path(path: Column) -> Column:
    """Path without the `file:` scheme, as local tools write it."""
    return F.regexp_replace(path, r"\Afile:/+", "/")


def root_exists(spark: SparkSession, root: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def is_hidden(name: str, folder: bool) -> bool:
    """Whether Spark's listing passes over a name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


LISTED = "path string, is_folder boolean, hidden boolean, length long, modificationTime timestamp"
LISTING = "path string, modificationTime timestamp, length long"
SPLIT_BYTES = 128 << 20  # of hidden files a task reads
LISTED_ROWS = 10_000  # names a task hands on at once


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each folder; below a hidden folder everything is hidden.  Links to folders are not followed."""
    kinds = pa.schema([
        ("path", pa.string()), ("is_folder", pa.bool_()), ("hidden", pa.bool_()), ("length", pa.int64()),
        ("modificationTime", pa.timestamp("us", tz="UTC")),
    ])
    for batch in batches:
        for row in batch.to_pylist():
            system, inner = pafs.FileSystem.from_uri(row["path"])
            scheme = row["path"].removesuffix(inner)
            infos = [system.get_file_info(inner)]  # a root may be a file
            if infos[0].type != pafs.FileType.File:
                infos = system.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
            for first in range(0, len(infos), LISTED_ROWS):
                found = []
                for info in infos[first:first + LISTED_ROWS]:
                    folder = info.type == pafs.FileType.Directory
                    if folder and isinstance(system, pafs.LocalFileSystem) and os.path.islink(info.path):
                        continue
                    found.append({
                        "path": scheme + info.path, "is_folder": folder,
                        "hidden": row["hidden"] or is_hidden(info.base_name, folder),
                        "length": info.size, "modificationTime": info.mtime,
                    })
                yield pa.RecordBatch.from_pylist(found, kinds)


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each file's content, one file a batch."""
    for batch in batches:
        for at in range(batch.num_rows):
            system, inner = pafs.FileSystem.from_uri(batch.column("path")[at].as_py())
            with system.open_input_stream(inner) as file:
                content = pa.array([file.read()], pa.binary())
            yield batch.slice(at, 1).append_column("content", content)


def hidden_files(spark: SparkSession, roots: Iterable[str], wanted: list[str]) -> DataFrame:
    """(path, modificationTime, length) of the files Spark's listing passes over below the roots.

    Folders are rows: each step lists those of one depth in tasks, until there are none.
    """
    folders = spark.createDataFrame([(plain_root(r), False) for r in roots], "path string, hidden boolean")
    cores = spark.sparkContext.defaultParallelism
    found = []
    while True:
        listed = materialize(folders.repartition(cores, "path").mapInArrow(_list_folders, LISTED))
        found.append(listed.where("hidden AND NOT is_folder"))
        folders = listed.where("is_folder").select("path", "hidden")
        if folders.isEmpty():
            break
    files = reduce(DataFrame.unionByName, found).where(extension(F.col("path")).isin(wanted))
    return files.select("path", "modificationTime", "length")


def read_listed(names: DataFrame) -> DataFrame:
    """Files of a listing (path, modificationTime, length) with a known extension, read in tasks.

    A file above the reader's size limit is a row without content, as in `scan_files`.
    """
    spark = names.sparkSession
    names = names.filter(extension(F.col("path")).isin(list(DOC_TYPES))).select(
        "path", "modificationTime", "length"
    )
    fitting = F.col("length") <= int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    size = names.filter(fitting).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(math.ceil(size / SPLIT_BYTES), spark.sparkContext.defaultParallelism)
    small = names.filter(fitting).repartition(tasks, "path").mapInArrow(_read_contents, schemas.FILES)
    large = names.filter(~fitting).withColumn("content", F.lit(None).cast("binary"))
    return small.unionByName(large).withColumn("path", plain_path(F.col("path")))


def plain_root(root: str) -> str:
    return re.sub(r"\Afile:/+", "/", root)


def scan_files(
    spark: SparkSession, roots: Iterable[str], extensions: Iterable[str] | None = None
) -> DataFrame:
    """Files below the roots with a wanted extension, each path once.

    Roots that do not exist are skipped; none at all gives an empty table.  Other files
    are left out by name when the folders are listed, so that their contents are never
    read; a wanted file above the reader's size limit is a row without content.  Files whose
    name, or a folder's name below the root, starts with `_` or `.` are hidden to Spark's
    listing: they are listed and read in tasks, with the file systems that Arrow knows.
    """
    wanted = sorted({e.lower() for e in (extensions or DOC_TYPES)})
    present = sorted({r.rstrip("/") or "/" for r in roots if root_exists(spark, r)})
    # A root below another one adds nothing, so no path can be read twice.
    outer = [r for r in present if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in present)]
    if not outer:
        return spark.createDataFrame([], schemas.FILES)
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_glob(wanted))
    )
    files = reader.load(outer).filter(extension(F.col("path")).isin(wanted))
    # The comparison of lengths reaches the reader, which then opens no larger file.
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    hidden = materialize(hidden_files(spark, outer, wanted))
    fitting = F.col("length") <= limit
    large = files.filter(~fitting).select("path", "modificationTime", "length")
    large = large.unionByName(hidden.filter(~fitting)).withColumn("content", F.lit(None).cast("binary"))
    small = files.filter(fitting)
    size = hidden.filter(fitting).agg(F.sum("length").alias("n")).first().n
    if size is not None:
        tasks = math.ceil(size / SPLIT_BYTES) + 1
        rows = hidden.filter(fitting).repartition(tasks, "path")
        small = small.unionByName(rows.mapInArrow(_read_contents, small.select(*hidden.columns, "content").schema))
    return small.unionByName(large).withColumn("path", plain_path(F.col("path")))


def name_glob(extensions: Iterable[str]) -> str:
    """Glob of names that end in one of the extensions, in any case."""
    either = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    return "*{" + ",".join(either) + "}"


def unread_hash() -> Column:
    """Stands in for the fingerprint of a file that is too large to be read."""
    return F.concat(F.lit("length:"), F.col("length").cast("string"))


def describe_files(files: DataFrame) -> DataFrame:
    """(source_path, doc_type, content_hash, modified_at, content)."""
    return files.select(
        F.col("path").alias("source_path"),
        doc_type(F.col("path")).alias("doc_type"),
        F.coalesce(T.content_hash(F.col("content")), unread_hash()).alias("content_hash"),
        F.date_trunc("second", F.col("modificationTime")).alias("modified_at"),
        "content",
    )


def decode_text(doc: DataFrame) -> DataFrame:
    """Adds `raw` text, `parse_status` and `parse_error`; bad UTF-8 fails the row only."""
    raw = F.col("content").cast("string")
    valid = F.coalesce(F.is_valid_utf8(raw), F.lit(False))
    return (
        doc.withColumn("parse_status", F.when(valid, "parsed").otherwise("failed"))
        .withColumn(
            "parse_error",
            F.when(raw.isNull(), TOO_LARGE).when(~valid, "UnicodeDecodeError: content is not valid UTF-8"),
        )
        .withColumn("raw", F.when(valid, raw))
    )


def parse_text_docs(doc: DataFrame) -> DataFrame:
    """Text, markdown and HTML rows with `raw` -> `text` and `title`."""
    stem = T.source_stem(T.source_name(F.col("source_path")))
    is_html = F.col("doc_type") == "html"
    parts = doc.withColumn("html", html_parts(F.when(is_html, F.col("raw"))))
    body = F.when(is_html, F.col("html.text")).otherwise(F.col("raw"))
    text = parts.withColumn("text", T.normalize_text(body))
    heading = F.nullif(T.normalize_text(F.col("html.heading")), F.lit(""))
    title = (
        F.when(
            is_html,
            F.coalesce(
                F.nullif(T.strip(F.col("html.title")), F.lit("")),
                heading,
                T.title_from_first_line(F.col("text"), stem),
            ),
        )
        .when(F.col("doc_type") == "markdown", T.title_from_markdown(F.col("text"), stem))
        .otherwise(T.title_from_first_line(F.col("text"), stem))
    )
    return text.withColumn("title", title).drop("html")
