"""SimHash near duplicates by the generalised pigeonhole principle.

A fingerprint has a bit for each of 64 places, set where more than half of the hashes of the
text's word shingles (repeats counted) have it set.  Two fingerprints link at `REACH` or fewer
differing bits.  Equal fingerprints are one representative.

*Parts.*  The 64 places are grouped into m parts, correlated places together: starting from
the place with the strongest ties, a part takes the place most correlated with those it
holds until it is full.  Correlations are over all representatives: tasks add up the 64 x 64
joint counts, and only that matrix reaches the driver.  Correlated places in one part make
few values common there and leave the others even.

*Thresholds.*  If part i has threshold t_i (-1: not probed) and the t_i + 1 add up to
REACH + 1, then two fingerprints within REACH have a part i where they differ in at most t_i
places: otherwise they would differ in the sum of t_i + 1 > REACH places.  Each fingerprint
gets thresholds of its own, by dynamic programming over the parts: what a threshold costs is
the probes it takes (all values within t_i of the fingerprint's own) and the candidates they
are estimated to meet, from the counts of the `LISTED` most common values and an even share
for the others.  A listed value with over `COMMON` members may not be probed.  A fingerprint without affordable
thresholds, as in a large group of near copies, is *dense*: its one part is the whole word
with threshold REACH.

*Probe and verify.*  A probe meets the fingerprints that hold its value in that part, and
counts of differing bits settle the pairs.  Nothing probes common values, so they are left
out of the index and no key is hot.  Pairs of dense fingerprints meet halfway: each goes to
all words within one bit of it, and those that meet at a word are within two bits of each
other, all of them; so a word needs one star instead of all its pairs.  A pair with one
fingerprint that is not dense is found by that one's probes.  So no link is lost.

The number of parts is chosen by cost from the number of representatives.

Defined results: a null or empty text, or one of white space, has fingerprint zero, which
links like any other; a text with fewer than `WORDS` words is one shingle; repeated rows give
repeated rows; rows that share a doc_id with different texts are linked by it; a null doc_id
gets its fingerprint and a null component, and links nothing; extra columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import over_batches, text_or_empty
from tessera.llm.contract import connected
from tessera.session import fits, hint_small, materialize

WORDS = 3
SEED = 42
REACH = 2
BITS = 64
FEW = 4  # members of a value up to which the even share is estimate enough
COMMON = 32  # members of a value up to which it may be probed
LISTED = 1 << 17  # counted values that go to all tasks: the most common ones
DENSE_COST = 2 * (BITS + 1)  # what the words around a fingerprint cost, written and read
_SIGN = 1 << 63


def fingerprint(text: str, size: int = WORDS) -> int:
    """Bytes lower-case and split at exactly A-Z and ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hashed(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)),
        np.uint64, len(words) - size + 1,
    )
    total = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 1 << 16):  # long texts in steps: 64 bytes a shingle
        part = hashes[begin : begin + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint of each row as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return over_batches(rows, work, "doc_id long, print long")


def joint_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many there are, and for how many of them places i and j are both set (64 x 64).

    Every task adds up its own matrix, so one row a task is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            for begin in range(0, len(values), 1 << 16):
                bits = np.unpackbits(values[begin : begin + (1 << 16)], axis=1).astype(np.float64)
                both += (bits.T @ bits).astype(np.int64)
            count += len(values)
        place = np.arange(BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(np.full(BITS, count)), pa.array(list(both), pa.list_(pa.int64()))],
            ["place", "count", "both"],
        )

    summed = [F.sum(F.col("both")[j]).alias(f"p{j}") for j in range(BITS)]
    rows = (
        prints.select("print").mapInArrow(run, "place int, count long, both array<long>")
        .groupBy("place").agg(F.sum("count").alias("count"), *summed).collect()
    )
    matrix = np.zeros((BITS, BITS))
    for row in rows:
        matrix[row.place] = [row[f"p{j}"] for j in range(BITS)]
    return (rows[0]["count"] if rows else 0), matrix


def correlated_parts(count: int, both: np.ndarray, parts: int) -> list[int]:
    """The places grouped into parts of nearly equal width, as masks; place 0 is the highest bit."""
    share = np.diag(both) / max(count, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    ties = np.abs((both / max(count, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(ties, 0)
    left, masks = list(range(BITS)), []
    for part in range(parts):
        width = BITS * (part + 1) // parts - BITS * part // parts
        own = [max(left, key=lambda place: (ties[place, left].sum(), -place))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda place: (ties[place, own].sum(), -place)))
            left.remove(own[-1])
        masks.append(sum(1 << (BITS - 1 - place) for place in own))
    return masks


def number_of_parts(count: int) -> int:
    """The number of parts, 2 or 3, for which an even spread of `count` fingerprints costs least."""

    def cost(parts: int) -> float:
        width = BITS // parts
        each = [sum(comb(width, k) for k in range(t + 1)) for t in even_thresholds(parts)]
        return parts + sum(each) * (1 + count / 2**width)

    return min((3, 2), key=cost)


def even_thresholds(parts: int) -> list[int]:
    units = REACH + 1
    return [units * (i + 1) // parts - units * i // parts - 1 for i in range(parts)]


@dataclass(frozen=True)
class Allocator:
    """Gives each fingerprint its thresholds: the parts' masks, the listed values of each part
    with their members, and the even share of members of any other value."""

    masks: np.ndarray
    values: list[np.ndarray]
    counts: list[np.ndarray]
    share: float

    def members(self, part: int, values: np.ndarray) -> np.ndarray:
        """Estimated members of the values; infinite where they may not be probed."""
        listed = self.values[part]
        if not len(listed):
            return np.full(values.shape, self.share)
        at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
        counts = self.counts[part][at]
        return np.where(listed[at] == values, np.where(counts > COMMON, np.inf, counts), self.share)

    def flips(self, part: int) -> np.ndarray:
        """Zero and every single bit of the part."""
        mask = int(self.masks[part])
        return np.array([0] + [1 << k for k in range(BITS) if mask >> k & 1], np.uint64)

    def thresholds(self, prints: np.ndarray) -> np.ndarray:
        """A threshold for each fingerprint and part; all are REACH + 1 where it is dense.

        Thresholds of 2 are not offered: that many probes cost more than being dense.
        """
        units, n, parts = REACH + 1, len(prints), len(self.masks)
        best = np.full((units + 1, n), np.inf)
        best[0] = 0
        chosen = []
        for part in range(parts):
            own = prints & self.masks[part]
            near = self.members(part, own[:, None] ^ self.flips(part)[None, :])
            cost = [np.zeros(n), 1 + near[:, 0], (1 + near).sum(axis=1)]
            options = np.stack([
                np.stack([best[u - k] + cost[k] if u >= k else np.full(n, np.inf) for k in range(3)])
                for u in range(units + 1)
            ])  # units used, units of this part, fingerprint
            chosen.append(options.argmin(axis=1))
            best = options.min(axis=1)
        out = np.full((n, parts), REACH + 1)
        left, rows = np.full(n, units), np.flatnonzero(best[units] < DENSE_COST)
        for part in reversed(range(parts)):
            taken = chosen[part][left, np.arange(n)]
            out[rows, part] = taken[rows] - 1
            left = left - taken
        return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _as_signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= _SIGN else mask


def _index(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(part, value, print) of each fingerprint and part."""
    entries = F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(_as_signed(m))).alias("value"))
        for i, m in enumerate(masks)
    ])
    return prints.select("print", F.explode(entries).alias("e")).select("e.part", "e.value", "print")


def listed_values(index: DataFrame, parts: int) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray]]:
    """The values with most members, at most `LISTED`, as a table and as sorted arrays a part."""
    counts = materialize(
        index.groupBy("part", "value").agg(F.count("*").alias("members")).where(F.col("members") > FEW)
    )
    step = F.floor(4 * F.log2("members")).cast("int")
    cut, total = None, 0
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    for row in sorted(sizes, key=lambda r: -r.step):
        total += row.n
        if total > LISTED:
            break
        cut = row.step
    listed = counts.where(step >= cut) if cut is not None else counts.limit(0)
    table = listed.toArrow()  # bounded by LISTED
    part = table.column("part").to_numpy()
    value = table.column("value").to_numpy().view(np.uint64)
    members = table.column("members").to_numpy().astype(float)
    orders = [rows[np.argsort(value[rows])] for rows in (np.flatnonzero(part == i) for i in range(parts))]
    return listed, [value[o] for o in orders], [members[o] for o in orders]


def similar_pairs(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints within REACH: all that connect them.

    Every link of a fingerprint that is not dense is among them; dense ones are tied by stars.
    """
    prints = prints.select("print")
    count, both = joint_counts(prints)
    masks = correlated_parts(count, both, number_of_parts(count))
    index = _index(prints, masks)
    listed, values, counts = listed_values(index, len(masks))
    narrowest = min(m.bit_count() for m in masks)
    allocator = Allocator(np.array(masks, np.uint64), values, counts, count / 2**narrowest)
    shared = prints.sparkSession.sparkContext.broadcast(allocator)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        allocator = shared.value
        own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        thresholds = allocator.thresholds(own)
        out = {"part": [], "value": [], "print": []}

        def add(part: int, chosen: np.ndarray, words: np.ndarray) -> None:
            out["part"].append(np.full(words.size, part, np.int32))
            out["value"].append(_signed(words.ravel()))
            out["print"].append(_signed(np.repeat(chosen, words.shape[1])))

        for part, mask in enumerate(allocator.masks):
            for threshold in (0, 1):
                chosen = own[thresholds[:, part] == threshold]
                flips = allocator.flips(part)[: None if threshold else 1]
                add(part, chosen, (chosen & mask)[:, None] ^ flips[None, :])
        dense = own[thresholds[:, 0] > REACH]
        around = np.array([0] + [1 << k for k in range(BITS)], np.uint64)
        add(-1, dense, dense[:, None] ^ around[None, :])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[k])) for k in out], list(out))

    probes = materialize(over_batches(prints, work, "part int, value long, print long"))
    # Nothing probes a common listed value, so its members leave the index; at most LISTED rows.
    common = listed.where(F.col("members") > COMMON).select("part", "value")
    held = index.join(F.broadcast(common), ["part", "value"], "left_anti")
    met = probes.where("part >= 0").select("part", "value", F.col("print").alias("a")).join(
        held.withColumnRenamed("print", "b"), ["part", "value"]
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= REACH
    verified = met.where((F.col("a") != F.col("b")) & near).select("a", "b")
    # At most 65 fingerprints lie around a word.
    stars = (
        probes.where("part < 0")
        .groupBy("value")
        .agg(F.min("print").alias("b"), F.collect_set("print").alias("all"))
        .where(F.size("all") > 1)
        .select(F.explode("all").alias("a"), "b")
        .where("a <> b")
    )
    both_ways = verified.unionByName(stars)
    return both_ways.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, print and component_id, the least doc_id reachable over links, of every row.

    A fingerprint's component holds every doc_id that has it, so one label a fingerprint does.
    """
    rows = materialize(fingerprints(docs))
    named = rows.where("doc_id IS NOT NULL")
    first = materialize(named.groupBy("print").agg(F.min("doc_id").alias("rep")))
    links = similar_pairs(first)
    # Between the least ids of the fingerprints, so that roots are the least ids of components.
    a = first.select(F.col("print").alias("a"), F.col("rep").alias("rep_a"))
    b = first.select(F.col("print").alias("b"), F.col("rep").alias("rep_b"))
    small = fits(first)
    links = (
        links.join(hint_small(a, small), "a").join(hint_small(b, small), "b")
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    )
    # Rows of one doc_id are one node, whatever their texts.
    several = named.join(_several(named), "doc_id", "left_semi").join(hint_small(first, small), "print")
    labels = connected(links.unionByName(several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    ends = first.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "print", F.coalesce("label", "rep").alias("component_id")
    )
    # A fingerprint's rows may be a third of the table: few fingerprints go to all tasks, and
    # many meet the rows in a join that splits such a key.
    ends = materialize(ends)
    whole = named.join(hint_small(ends, small), "print").select("doc_id", "print", "component_id")
    return whole.unionByName(
        rows.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    )


def _several(named: DataFrame) -> DataFrame:
    """Ids with more than one fingerprint."""
    low, high = F.min("print"), F.max("print")
    return named.groupBy("doc_id").agg((low < high).alias("several")).where("several").select("doc_id")
