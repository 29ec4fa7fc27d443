"""Connected components by hooking and contraction.

In a round every node that has a smaller neighbour hooks to its least one, chains are cut
short by pointer jumping until each node points to a root, and the links are rewritten
between roots, without repeats.  So the next round sees only nodes that had no smaller
neighbour, and the links still between them; no round looks at settled nodes again.  Roots
are the least ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def _jumped(pointers: DataFrame) -> DataFrame:
    """(id, label): where the pointers of each id end; only those that still move are followed."""
    done = None
    while True:
        # An end points nowhere, so that ids whose target has no pointer of its own are done.
        onward = pointers.select(F.col("id").alias("label"), F.col("label").alias("far"))
        if done is not None:
            onward = onward.unionByName(done.select(F.col("id").alias("label"), F.col("label").alias("far")))
        moved = materialize(
            pointers.join(onward, "label", "left").select("id", F.coalesce("far", "label").alias("label"), "far")
        )
        ended = moved.where("far IS NULL").select("id", "label")
        done = ended if done is None else done.unionByName(ended)
        pointers = moved.where("far IS NOT NULL").select("id", "label")
        if pointers.isEmpty():
            return done


def connected(links: DataFrame) -> DataFrame:
    """(id, label): the least id reachable over the links (a, b), for every linked id but the
    least ones themselves."""
    links = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    found: list[DataFrame] = []
    while not links.isEmpty():
        # The greater end hooks to the least of its smaller neighbours.
        pointers = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
        labels = materialize(_jumped(materialize(pointers)))
        found.append(labels)
        a = labels.select(F.col("id").alias("a"), F.col("label").alias("far_a"))
        b = labels.select(F.col("id").alias("b"), F.col("label").alias("far_b"))
        left, right = F.coalesce("far_a", "a"), F.coalesce("far_b", "b")
        links = materialize(
            links.join(a, "a", "left")
            .join(b, "b", "left")
            .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
            .where("a <> b")
            .distinct()
        )
    if not found:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = found.pop()
    while found:
        labels = composed(found.pop(), labels)
    return materialize(labels)


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """(id, label) of ids that `first` or, after it, `then` gives another label."""
    far = then.select(F.col("id").alias("label"), F.col("label").alias("far"))
    mapped = first.join(far, "label", "left").select("id", F.coalesce("far", "label").alias("label"))
    return mapped.unionByName(then)
