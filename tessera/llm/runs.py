"""Periodic runs of words, found as maximal pairs.

A run is a stretch of words with smallest period q that no neighbour extends, at least
`REPEATS` periods and `LEAST` words long.  A *maximal pair* is two positions i < j whose
suffixes share exactly l words and whose left words differ.  With p = j - i, the stretch from
i to j + l has period p and can't be extended; and every run of length L is the pair (i, i + q)
with l = L - q.  So the pairs with l >= (REPEATS - 1) p are exactly the stretches sought, and
nothing has to be extended.  A multiple of the smallest period gives the same stretch again:
of pairs with one start and length the smallest distance is kept.

The pairs come from the LCP intervals of a suffix array, bottom up.  Each interval holds its
positions in order, with the class of each, its left word; joining two children of an
interval of depth l, the positions of the smaller are looked up among those of the larger
within reach l // (REPEATS - 1).  Classes need not be compared one by one: positions that
close overlap periodically, so that all those to the *right* of a position within reach are
of one class, and of those to its *left* only the farthest can be of another class.  So a
position costs two look-ups and its pairs, of which a run has at most its exponent.

Suffixes are sorted by prefix doubling, many documents at once: the first rank is that of
(document, word), so that suffixes of different documents never tie.  A suffix whose first
`SEED` words occur once in its document is in no pair that counts, and takes no part.

Defined results: a null or empty text, or one of white space, has no words and no runs;
repeated rows give repeated rows; a null doc_id stays; further columns are not read; an
empty table gives an empty table.  A document is worked on whole, in one task; memory
follows the longest document, as documents are joined up to `GROUP_WORDS` only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sliced, text_or_empty

REPEATS = 4  # least length in periods
LEAST = 6  # least length in words
SEED = 4  # every pair that counts shares more than that many words
GROUP_WORDS = 100_000
WHITE = "[\\x20\\x09-\\x0D]+"

Run = tuple[int, int, int]


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where in that order a new key begins."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.concatenate(([True], ordered[1:] != ordered[:-1]))


def repeated_suffixes(codes: np.ndarray) -> np.ndarray:
    """Suffix array of the positions whose first `SEED` codes occur there again.

    `codes` ends in a code of its own; codes of different documents differ.
    """
    n = len(codes)
    active, rank, first, h = np.arange(n), np.empty(n, np.int64), codes, 0
    kept = None
    while True:
        # Codes before the first round, then the rank of the prefix with that of what follows.
        keys = first[active] if h == 0 else rank[active] * n + rank[active + h]
        order, new = _classes(keys)
        active = active[order]
        if h == 0:
            base = np.zeros(n, np.int64)
        else:
            base = rank[active]
            group = np.concatenate(([True], base[1:] != base[:-1]))
        at = np.arange(len(active))
        starts = np.maximum.accumulate(np.where(new, at, 0))
        if h == 0:
            new_rank = starts
        else:
            new_rank = base + starts - np.maximum.accumulate(np.where(group, at, 0))
        rank[active] = new_rank
        shared = ~(new & np.concatenate((new[1:], [True])))
        active = active[shared]
        h = 2 * h or 1
        if h == SEED:
            kept = active
        if not len(active):
            break
        active = np.sort(active)
    if kept is None:
        return np.empty(0, np.int64)
    return kept[np.argsort(rank[kept])]


def common_prefixes(codes: list[int], suffixes: list[int]) -> list[int]:
    """Codes each suffix shares with the one before it, the first with none."""
    before = dict(zip(suffixes[1:], suffixes, strict=False))
    shared, length, last = {}, 0, None
    for i in sorted(suffixes):
        # What the suffix one to the left shares bounds this one's from below, as long as the
        # shifted partner is among the suffixes, too.
        length = length - 1 if last == i - 1 and length > SEED else 0
        j = before.get(i)
        if j is None:
            length = 0
        else:
            while codes[i + length] == codes[j + length]:
                length += 1
        shared[i], last = length, i
    return [shared[i] for i in suffixes]


def maximal_pairs(codes: list[int], suffixes: list[int], shared: list[int]) -> Iterator[Run]:
    """(i, p, l) of the maximal pairs (i, i + p) with l >= (REPEATS - 1) p."""

    def pairs(small: list[int], large: list[int], depth: int) -> Iterator[Run]:
        reach = depth // (REPEATS - 1)
        for x in small:
            own = codes[x - 1]
            at = bisect_left(large, x)
            far = bisect_left(large, x - reach)
            if far < at and codes[large[far] - 1] != own:
                yield large[far], x - large[far], depth
            if at < len(large) and large[at] <= x + reach and codes[large[at] - 1] != own:
                for y in large[at : bisect_right(large, x + reach)]:
                    yield x, y - x, depth

    def merged(small: list[int], large: list[int]) -> list[int]:
        if 16 * len(small) > len(large):
            return sorted(large + small)
        for x in small:
            large.insert(bisect_left(large, x), x)
        return large

    stack: list[list] = []
    for at, position in enumerate(suffixes):
        depth = shared[at + 1] if at + 1 < len(suffixes) else 0
        subtree = [position]
        while stack and stack[-1][0] > depth:
            level, held = stack.pop()
            small, large = sorted((held, subtree), key=len)
            yield from pairs(small, large, level)
            subtree = merged(small, large)
        if depth <= SEED:
            continue
        if stack and stack[-1][0] == depth:
            small, large = sorted((stack[-1][1], subtree), key=len)
            yield from pairs(small, large, depth)
            stack[-1][1] = merged(small, large)
        else:
            stack.append([depth, subtree])


def runs_of(documents: list[list[int]]) -> list[list[Run]]:
    """The runs (start, length, period) of each document, a list of word codes from 0."""
    sizes = np.array([len(d) for d in documents], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] + 1
    # A code of its own stands before each document and after the last.
    codes = np.empty(int(sizes.sum()) + len(documents) + 1, np.int64)
    most = 1 + max((max(d) for d in documents if d), default=0)
    for k, (begin, document) in enumerate(zip(begins, documents, strict=True)):
        codes[begin - 1] = -1 - k
        codes[begin : begin + len(document)] = document
        codes[begin : begin + len(document)] += k * most
    codes[-1] = -1 - len(documents)
    out: list[list[Run]] = [[] for _ in documents]
    suffixes = repeated_suffixes(codes)
    if not len(suffixes):
        return out
    plain, ordered = codes.tolist(), suffixes.tolist()
    found: dict[tuple[int, int], int] = {}
    for start, period, shared in maximal_pairs(plain, ordered, common_prefixes(plain, ordered)):
        key = (start, shared + period)
        if key[1] >= LEAST and period < found.get(key, key[1]):
            found[key] = period
    if found:
        spans = np.array([(s, n, p) for (s, n), p in found.items()], np.int64)
        owner = np.searchsorted(begins, spans[:, 0], side="right") - 1
        spans[:, 0] -= begins[owner]
        for k, run in zip(owner.tolist(), spans.tolist(), strict=True):
            out[k].append(tuple(run))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words are in no run after that run's first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def _groups(texts: list[str]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, documents together up to `GROUP_WORDS`."""
    group, size = [], 0
    for text in texts:
        words = text.encode().split()  # bytes split at exactly ASCII white space
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) in order, and `collapsed`, the text's words
    without those that a run repeats, joined by single spaces."""
    run_type = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, all_runs, collapsed = [], [], []
        for group in _groups(batch.column(1).to_pylist()):
            numbers: dict[bytes, int] = {}
            documents = [[numbers.setdefault(w, len(numbers)) for w in words] for words in group]
            for words, runs in zip(group, runs_of(documents), strict=True):
                counts.append(len(words))
                all_runs.append(runs)
                if runs:
                    keep = kept_words(len(words), runs)
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                collapsed.append(b" ".join(words))
        flat = np.array([r for runs in all_runs for r in runs], np.int64).reshape(-1, 3)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in all_runs]))).astype(np.int32)
        values = pa.StructArray.from_arrays(
            [pa.array(flat[:, c].copy()) for c in range(3)], fields=list(run_type)
        )
        texts = pa.array(collapsed, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), values), texts],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(work, sliced(batches))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        over, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, then of the least start and period; null if none."""
    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        ahead = F.struct(-left, a["start"], a["period"]) < F.struct(-right, b["start"], b["period"])
        return F.when(ahead, a).otherwise(b)

    return F.aggregate(runs, F.get(runs, 0), lambda best, r: better(best, r))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")
