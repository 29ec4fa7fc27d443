"""Exact k-nearest join of two vector tables in blocks.

Both tables are cut into *blocks*: rows of one pivot whose distances to it lie in one ring,
at most `BLOCK_VALUES` numbers, stored as one row with the pivot and the ring.  Pivots are a
bounded sample spread by farthest-first choice; they decide the speed, never the result.

A query block first meets one vector block, its *home*, which gives every query a k-th
distance t.  By the triangle inequality a vector within t of query q lies in a ring of pivot o
between d(q, o) - t and d(q, o) + t.  So each query block asks for an interval of rings a
pivot, and an equijoin on the pivot finds the vector blocks that reach into it; all others are
never read for it.  Those it needs come in slices of `SLICE_BLOCKS`, the nearest rings first,
and the running k-th distance of each query goes on ruling out blocks.

Ragged tables are refused.  What passes the driver is bounded: the pivots, and one
representative block for each pivot and `RINGS`-th of its radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import Nearest, to_matrix
from tessera.session import materialize

BLOCK_VALUES = 1 << 18
SLICE_BLOCKS = 16
PIVOTS = 64
RINGS = 16
CANDIDATES_A_PIVOT = 4
SLACK = 1e-7  # relative, far above the rounding of a distance

BLOCK = "block long, pivot int, low double, high double, n int, ids binary, rows binary"
FOUND = "query_id long, chunk_id long, distance double"
# Results of a home pair, and what its query block still needs.
HOME = f"{FOUND}, qblock long, pivot int, low double, high double, bounds binary"


@dataclass(frozen=True)
class Shape:
    rows: int
    width: int


def shape_of(vectors: DataFrame, message: str) -> Shape:
    """Rows and width of (id, vector); vectors of several lengths are refused."""
    size = F.size("vector")
    row = vectors.agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if row["n"] and row["least"] != row["most"]:
        raise ValueError(message)
    return Shape(row["n"], row["most"] or 0)


def choose_pivots(vectors: DataFrame, shape: Shape) -> np.ndarray:
    """At most `PIVOTS` vectors, each far from those before it, of a few picked by hash."""
    wanted = min(PIVOTS, -(-shape.rows * shape.width // BLOCK_VALUES))
    if wanted <= 1:
        return np.zeros((1, shape.width))
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted * CANDIDATES_A_PIVOT).toArrow()
    rows = to_matrix(picked.column("vector"), shape.width)
    far = ((rows - rows.mean(0)) ** 2).sum(1)
    chosen = []
    for _ in range(min(wanted, len(rows))):
        chosen.append(int(far.argmin() if not chosen else far.argmax()))
        own = ((rows - rows[chosen[-1]]) ** 2).sum(1)
        far = own if len(chosen) == 1 else np.minimum(far, own)
    return rows[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, one pivot at a time to keep memory at the rows' own size."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in pivots], axis=1)


def packed(vectors: DataFrame, shape: Shape, pivots: np.ndarray) -> DataFrame:
    """The blocks of (id, vector), stored.

    Rows are range-partitioned by pivot and radius, so that a pivot with most of the rows
    is many tasks; each task cuts its sorted rows.
    """
    most = max(1, BLOCK_VALUES // max(1, shape.width))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, most):
                part = batch.slice(begin, most)
                rows = to_matrix(part.column("vector"), shape.width)
                far = distances(rows, shared.value)
                pivot = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(rows)), pivot]),
                     part.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["pivot", "radius", "id", "row"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, pivot = TaskContext.get().partitionId() << 32, [], None

        def block() -> pa.RecordBatch:
            ids = np.array([h[1] for h in held], "<i8").tobytes()
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "pivot": pa.array([pivot], pa.int32()),
                "low": [held[0][0]], "high": [held[-1][0]], "n": pa.array([len(held)], pa.int32()),
                "ids": pa.array([ids], pa.binary()),
                "rows": pa.array([b"".join(h[2] for h in held)], pa.binary()),
            })

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for own, radius, i, row in zip(*columns, strict=True):
                if held and (own != pivot or len(held) >= most):
                    yield block()
                    number, held = number + 1, []
                pivot = own
                held.append((radius, i, row))
        if held:
            yield block()

    assigned = vectors.mapInArrow(assign, "pivot int, radius double, id long, row binary")
    ordered = assigned.repartitionByRange("pivot", "radius", "id").sortWithinPartitions("pivot", "radius", "id")
    return materialize(ordered.mapInArrow(pack, BLOCK))


def _block(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<f8").reshape(-1, width)


def _reach(radius: np.ndarray, low: float, high: float) -> np.ndarray:
    """Least distance that points at `radius` from a pivot may have to a ring around it."""
    return np.maximum(0, np.maximum(low - radius, radius - high)) * (1 - SLACK) - SLACK


def _home(blocks: DataFrame) -> list[dict]:
    """A block for each pivot and ring: the largest; at most PIVOTS * (RINGS + 1) rows."""
    widest = blocks.groupBy("pivot").agg(F.max("high").alias("widest"))
    ring = F.floor(RINGS * F.try_divide("high", "widest")).cast("int")
    pick = F.max(F.struct("n", "block", "low", "high")).alias("b")
    rows = (
        blocks.select("pivot", "block", "low", "high", "n").join(widest, "pivot")
        .groupBy("pivot", ring).agg(pick).select("pivot", "b.*").collect()
    )
    return [row.asDict() for row in rows]


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, distance) that hold the k nearest `vectors` of each query, by squared
    distance and then id, and a few further ones, each once.  Both tables are (id, vector)."""
    spark = vectors.sparkSession
    queries = queries.where(F.col("vector").isNotNull()).distinct()
    asked = shape_of(queries, "query vectors differ in length")
    nothing = spark.createDataFrame([], FOUND)
    if not asked.rows:
        return nothing
    stored = shape_of(vectors, "query and chunk vectors differ in length")
    if not stored.rows:
        return nothing
    if asked.width != stored.width:
        raise ValueError("query and chunk vectors differ in length")
    width, pivots = stored.width, choose_pivots(vectors, stored)
    held, asking = packed(vectors, stored, pivots), packed(queries, asked, pivots)
    asking = asking.select("block", "pivot", "low", "high", "ids", "rows")
    homes = home_pairs(asking, held, pivots, k)
    first = materialize(_first_pass(asking, held, homes, pivots, width, k))
    pairs = materialize(needed_pairs(first, held).join(homes, ["qblock", "block"], "left_anti"))
    found = first.where("query_id IS NOT NULL").select("query_id", "chunk_id", "distance")
    if pairs.isEmpty():
        return found
    return found.unionByName(_second_pass(asking, held, first, pairs, pivots, width, k))


def home_pairs(asking: DataFrame, held: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(qblock, block): each query block with its home."""
    homes = _home(held)
    between = distances(pivots, pivots)
    # The home of a pivot's queries is the block whose farthest point is least away.
    best = [
        min(homes, key=lambda h: (h["n"] < k, between[p, h["pivot"]] + h["high"], h["block"]))["block"]
        for p in range(len(pivots))
    ]
    home_of = held.sparkSession.createDataFrame(list(enumerate(best)), "pivot int, home long")
    homed = asking.select("block", "pivot").join(F.broadcast(home_of), "pivot")
    return homed.select(F.col("block").alias("qblock"), F.col("home").alias("block"))


def _first_pass(
    asking: DataFrame, held: DataFrame, homes: DataFrame, pivots: np.ndarray, width: int, k: int
) -> DataFrame:
    """Every query block against its home: results, needed rings and k-th distances (`HOME`)."""
    right = homes.join(held.select("block", F.col("ids").alias("v_ids"), F.col("rows").alias("v_rows")), "block")
    left = asking.select(F.col("block").alias("qblock"), "ids", "rows")
    shared = held.sparkSession.sparkContext.broadcast(pivots)

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        pivots = shared.value
        number = q.column("qblock")[0].as_py()
        query_ids, asked = _block(q.to_pylist()[0], width)
        best = Nearest(asked, k)
        for row in v.to_pylist():
            best.offer(*_block({"ids": row["v_ids"], "rows": row["v_rows"]}, width))
        which, chunk_ids, found = best.results()
        bounds = np.sqrt(best.bound())
        far = distances(asked, pivots)
        low, high = (far - bounds[:, None]).min(axis=0), (far + bounds[:, None]).max(axis=0)
        n, m = len(which), len(pivots)
        slack = SLACK * (1 + np.abs(far).max())
        none = pa.nulls
        return pa.table({
            "query_id": pa.concat_arrays([pa.array(query_ids[which]), none(m, pa.int64())]),
            "chunk_id": pa.concat_arrays([pa.array(chunk_ids), none(m, pa.int64())]),
            "distance": pa.concat_arrays([pa.array(found), none(m, pa.float64())]),
            "qblock": pa.array(np.full(n + m, number)),
            "pivot": pa.concat_arrays([none(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
            "low": pa.concat_arrays([none(n, pa.float64()), pa.array(low - slack)]),
            "high": pa.concat_arrays([none(n, pa.float64()), pa.array(high + slack)]),
            "bounds": pa.array([None] * n + [bounds.astype("<f8").tobytes()] + [None] * (m - 1), pa.binary()),
        })

    return left.groupBy("qblock").cogroup(right.groupBy("qblock")).applyInArrow(compare, HOME)


def needed_pairs(first: DataFrame, held: DataFrame) -> DataFrame:
    """(qblock, block): the vector blocks that reach into the rings a query block asks for."""
    wanted = first.where("pivot IS NOT NULL").select(
        "qblock", "pivot", F.col("low").alias("from"), F.col("high").alias("to")
    )
    rings = held.select("pivot", "block", "low", "high")
    return (
        wanted.join(rings, "pivot")
        .where((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")))
        .select("qblock", "block")
    )


def _second_pass(
    asking: DataFrame, held: DataFrame, first: DataFrame, pairs: DataFrame, pivots: np.ndarray, width: int, k: int
) -> DataFrame:
    """The needed vector blocks of each query block, a slice of them to a task."""
    shared = held.sparkSession.sparkContext.broadcast(pivots)
    slices = materialize(
        pairs.groupBy("qblock").agg((F.floor((F.count("*") - 1) / SLICE_BLOCKS) + 1).cast("int").alias("slices"))
    )
    dealt = F.pmod(F.xxhash64("block"), F.col("slices")).cast("int").alias("slice")
    bounds = first.where("bounds IS NOT NULL").select("qblock", "bounds")
    left = (
        asking.select(F.col("block").alias("qblock"), "ids", "rows")
        .join(bounds, "qblock").join(slices, "qblock")
        .select("qblock", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "ids", "rows", "bounds")
    )
    vectors = held.select(
        "block", "pivot", "low", "high", F.col("ids").alias("v_ids"), F.col("rows").alias("v_rows")
    )
    right = pairs.join(slices, "qblock").select(F.col("qblock"), dealt, "block").join(vectors, "block")

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()),
                             "distance": pa.array([], pa.float64())})
        row = q.to_pylist()[0]
        query_ids, asked = _block(row, width)
        far = distances(asked, shared.value)
        best = Nearest(asked, k, np.frombuffer(row["bounds"], "<f8") ** 2)
        blocks = [(_reach(far[:, b["pivot"]], b["low"], b["high"]), b) for b in v.to_pylist()]
        for reach, b in sorted(blocks, key=lambda x: (x[0].min(), x[1]["block"])):
            open_ = np.flatnonzero(reach <= np.sqrt(best.bound()))
            if len(open_):
                best.offer(*_block({"ids": b["v_ids"], "rows": b["v_rows"]}, width), open_)
        which, chunk_ids, found = best.results()
        return pa.table({"query_id": query_ids[which], "chunk_id": chunk_ids, "distance": found})

    left, right = (side.groupBy("qblock", "slice") for side in (left, right))
    return left.cogroup(right).applyInArrow(compare, FOUND)
