"""Helpers the operators share: Arrow batches, span digests, whole-row packing."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, for work that makes Python objects of them."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(begin, SLICE_ROWS)


def over_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Applies `work` to slices of each Arrow batch: a narrow step with few rows in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(work, sliced(batches))

    return df.mapInArrow(run, schema)


class Covered:
    """Tells in logarithmic time whether a span overlaps one of the given spans."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.reach = list(accumulate((e for _, e in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                       ("score", pa.float32())])
SPANS = "spans array<struct<kind:string,start:int,end:int,score:float>>"


def span_table(doc_ids: pa.Array, spans: list[list[tuple]]) -> pa.RecordBatch:
    """doc_id with its list of (kind, start, end, score)."""
    flat = [s for row in spans for s in row]
    offsets = [0]
    for row in spans:
        offsets.append(offsets[-1] + len(row))
    kind, start, end, score = zip(*flat, strict=True) if flat else ((), (), (), ())
    values = pa.StructArray.from_arrays(
        [pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
         pa.array(score, pa.float32())],
        fields=list(SPAN_TYPE),
    )
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "spans"])


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
