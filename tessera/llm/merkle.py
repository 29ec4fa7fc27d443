"""Merkle manifest of a table: a tree per group, a tree over the groups' roots, and proofs.

A row is a leaf, the digest of its columns.  Leaves of a group ascend by the order column;
every `arity` consecutive nodes become the digest of their digests until one is left, the
group's subroot.  Subroots, ordered by group, make the root in the same way.

Each level is one table of (tree, idx, digest).  *Sibling-shift joins* give every node its
siblings: the level is joined with itself on the index a sibling has, `idx XOR 1` in a
binary tree, and one equijoin for each offset within the run of `arity` slots otherwise.
Rows of slot zero then emit the parents.  Keys are unique in a level, so that no join is
skewed however large one group is, and the levels shrink in geometric progression.  Paths
go down the same way: a node's path is its siblings followed by its parent's path, so a
leaf meets one table instead of one for each level.  Everything is DataFrame functions.

Leaves are numbered without a global window: they are range-partitioned and sorted by
(group, order, digest), numbered inside their partition, and shifted by the sizes of the
partitions before, of which there is one row a partition.  A tree is known by the number
of its first leaf, which also orders the trees.

Defined results: a null column counts as `-` in the leaf, so null and empty differ; null
groups are one tree, the first; null order values come first, ties are ordered by leaf
digest, and equal rows are leaves of their own; a group of one row is its own subroot; one
group alone is the root; extra columns are not read, and names may clash with those used
here; an empty table gives an empty manifest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import BROADCAST_ROWS, hint_small, materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# Joins of a path table that are planned together before it is stored.
JOINS_A_PLAN = 6
# Nodes up to which a level's siblings go to all tasks, some 100 bytes each.
SMALL_NODES = 10_000
_ROWS_A_PARTITION = 33  # bits that monotonically_increasing_id gives to the row


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(column: Column) -> Column:
    """A digest as lower-case text; the siblings in one binary are one text, too."""
    return F.lower(F.hex(column))


def field(column: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


@dataclass(frozen=True)
class Manifest:
    """`leaves`: (tree, idx, n, digest, kept columns), `levels`: (tree, idx, n, digest, before,
    after) with the siblings' digests, the last tree being the one over the subroots."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None
    arity: int


@dataclass(frozen=True)
class _Size:
    """Trees, their leaves and the leaves of the largest, which bound the sizes of all levels."""

    trees: int
    total: int
    most: int


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `at`, the row's number in the order of the keys (nulls first)."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", _ROWS_A_PARTITION)
    # One row a partition: bounded by the number of partitions, whatever the data.
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    shifts = F.broadcast(sizes.select("part", before.alias("before")))
    within = F.col("at") - F.shiftleft(F.col("part"), _ROWS_A_PARTITION)
    return (
        ordered.withColumn("part", part)
        .join(shifts, "part")
        .withColumn("at", within + F.col("before"))
        .drop("part", "before")
    )


def _with_siblings(nodes: DataFrame, arity: int, small: bool) -> DataFrame:
    """Adds the digests of the siblings before and after each node, joined into one binary."""
    slot = F.pmod("idx", F.lit(arity))
    out = nodes
    for offset in range(1, arity):
        if arity == 2:
            sibling = F.col("idx").bitwiseXOR(F.lit(1))
        else:
            sibling = F.col("idx") - slot + F.pmod(slot + offset, F.lit(arity))
        shifted = nodes.select("tree", F.col("idx").alias("sibling"), F.col("digest").alias(f"s{offset}"))
        out = (
            out.withColumn("sibling", sibling)
            .join(hint_small(shifted, small), ["tree", "sibling"], "left")
            .drop("sibling")
        )
    by_slot = [(offset, F.pmod(slot + offset, F.lit(arity))) for offset in range(1, arity)]

    def joined(wanted) -> Column:
        # Siblings wrap around once, so both halves ascend in slot.
        parts = [F.when(wanted(s), F.col(f"s{o}")) for o, s in by_slot]
        return F.concat(*[F.coalesce(p, F.lit(b"")) for p in parts])

    return out.select(
        *nodes.columns, joined(lambda s: s < slot).alias("before"), joined(lambda s: s > slot).alias("after")
    )


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """Slot-zero rows of the trees that have several nodes emit the nodes above."""
    return level.where((F.col("n") > 1) & (F.pmod("idx", F.lit(arity)) == 0)).select(
        "tree",
        F.expr(f"idx div {arity}").alias("idx"),
        F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        digest(as_hex(F.col("digest")), as_hex(F.col("after"))).alias("digest"),
    )


def _levels(nodes: DataFrame, arity: int, size: _Size) -> list[DataFrame]:
    """Every level of the trees, with siblings; the last holds nothing but single nodes."""
    most, total = size.most, size.total
    levels = []
    while most > 1:
        small = total <= SMALL_NODES
        level = _with_siblings(nodes, arity, small)
        # A node is some 100 bytes, so that a small level is one file.
        level = materialize(level.coalesce(1) if small else level)
        levels.append(level)
        nodes = _parents(level, arity)
        most, total = -(-most // arity), total // arity + size.trees
    nothing = F.lit(b"")
    levels.append(materialize(nodes.withColumns({"before": nothing, "after": nothing})))
    return levels


def build_manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    tree_by: str = "lang",
    order_by: str = "doc_id",
    arity: int = 2,
    further: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest of `docs`; `further` are columns kept with each leaf."""
    if arity < 2:
        raise ValueError("arity must be at least 2")
    rows = docs.select(
        F.col(tree_by).cast("string").alias("group"),
        F.col(order_by).alias("order"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in (further or {}).items()]).alias("further"),
    )
    rows = _numbered(rows, ["group", "order", "digest"])
    trees = rows.groupBy("group").agg(F.min("at").alias("tree"), F.count("*").alias("n"))
    trees = materialize(trees)
    size = _Size(*trees.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first())
    same = {"same": F.coalesce("group", F.lit("")), "none": F.col("group").isNull()}
    # A group may hold a third of all rows: where the groups are few, each task has them all.
    sized = hint_small(trees.withColumns(same).drop("group"), size.trees <= BROADCAST_ROWS)
    leaves = (
        rows.withColumns(same)
        .join(sized, ["same", "none"])
        .select("group", "order", "further", "tree", (F.col("at") - F.col("tree")).alias("idx"), "n", "digest")
    )
    leaves = materialize(leaves)
    levels = _levels(leaves.select("tree", "idx", "n", "digest"), arity, size)
    tops = reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", "digest") for x in levels])
    subroots = materialize(_numbered(tops.withColumnRenamed("tree", "of"), ["of"]))
    count = size.trees
    nodes = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("at").alias("idx"), F.lit(count).cast("long").alias("n"), "digest"
    )
    top = _levels(nodes, arity, _Size(1, count, count))
    root = top[-1].select(as_hex(F.col("digest")).alias("root")).first()
    return Manifest(leaves, levels, subroots, top, root.root if root else None, arity)


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, path, subroot) of the lowest level's nodes; `tops` has those of the highest
    node of each tree as (tree, path, subroot).  A path is a list of (before, after)."""
    step = F.array(F.struct("before", "after"))
    below = None
    for turn, level in enumerate(reversed(levels)):
        own = level.where("n = 1").select("tree", "idx").join(tops, "tree")
        if below is None:
            below = own
        else:
            above = below.withColumnRenamed("idx", "up")
            inner = (
                level.where("n > 1")
                .withColumn("up", F.expr(f"idx div {arity}"))
                .join(above, ["tree", "up"])
                .select("tree", "idx", F.concat(step, "path").alias("path"), "subroot")
            )
            below = inner.unionByName(own)
        if turn % JOINS_A_PLAN == JOINS_A_PLAN - 1:
            below = materialize(below)
    return below


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its group, order, further columns, `leaf`, `subroot` and `path`: the
    siblings' digests (before, after) of each level up to the root."""
    whole = F.array().cast("array<struct<before:binary,after:binary>>")
    no_root = F.lit(None).cast("binary")
    start = manifest.top[-1].select("tree", whole.alias("path"), no_root.alias("subroot"))
    top = _paths(manifest.top, start, manifest.arity).select(F.col("idx").alias("at"), "path")
    tops = materialize(
        manifest.subroots.join(top, "at").select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"))
    )
    paths = _paths(manifest.levels, tops, manifest.arity)
    return manifest.leaves.join(paths, ["tree", "idx"]).select(
        "group", "order", "further", F.col("digest").alias("leaf"), "subroot", "path"
    )


def path_digest(path: Column) -> Column:
    """Digest of the siblings, level by level and left to right."""
    texts = F.transform(path, lambda p: F.concat(as_hex(p["before"]), as_hex(p["after"])))
    return digest(F.array_join(texts, ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(
        path, leaf, lambda node, p: digest(as_hex(p["before"]), as_hex(node), as_hex(p["after"]))
    )
