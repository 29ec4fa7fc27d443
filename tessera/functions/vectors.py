"""Exact nearest-neighbour arithmetic on blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_ROWS = 1024
PAIR_VALUES = 1 << 21  # numbers in the vectors of pairs that are compared exactly at once


def to_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """List column of equal-length float lists as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), width)


class Nearest:
    """The best `k` (squared distance, id) of each query over all rows offered so far.

    A matrix product finds which rows can matter; only those distances are then computed
    exactly, so equal vectors get equal distances.  `bounds` are squared distances within
    which k rows are known to lie, for each query; rows beyond need not be found.  Queries,
    rows and pairs are taken in pieces, so that many equal vectors take no more memory.
    """

    def __init__(self, queries: np.ndarray, k: int, bounds: np.ndarray | None = None):
        self.queries = queries
        self.norms = (queries**2).sum(1)
        self.limit = np.full(len(queries), np.inf) if bounds is None else bounds * (1 + 1e-9)
        self.best_d = np.full((len(queries), k), np.inf)
        self.best_c = np.full((len(queries), k), np.iinfo(np.int64).max, dtype=np.int64)

    def bound(self) -> np.ndarray:
        """Squared distance beyond which a row is not among a query's best."""
        return np.minimum(self.best_d[:, -1], self.limit)

    def offer(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """Compares rows with the queries of number `which`, with all if none are given."""
        which = np.arange(len(self.queries)) if which is None else which
        for begin in range(0, len(which), BLOCK_ROWS):
            for first in range(0, len(ids), BLOCK_ROWS):
                part = slice(first, first + BLOCK_ROWS)
                self._compare(which[begin : begin + BLOCK_ROWS], ids[part], rows[part])

    def _compare(self, which: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        queries, norms, k = self.queries[which], self.norms[which], self.best_d.shape[1]
        row_norms = (rows**2).sum(1)
        rough = norms[:, None] + row_norms[None, :] - 2.0 * (queries @ rows.T)
        slack = 1e-9 * (norms.max() + row_norms.max() + 1.0)
        bound = self.bound()[which]
        if len(rows) > k:
            bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
        where_q, where_r = np.nonzero(rough <= (bound + slack)[:, None])
        step = max(1, PAIR_VALUES // max(1, rows.shape[1]))
        for at in range(0, len(where_q), step):
            q, r = where_q[at : at + step], where_r[at : at + step]
            exact = ((rows[r] - queries[q]) ** 2).sum(1)
            _merge(self.best_d, self.best_c, which[q], exact, ids[r])

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and squared distances found."""
        found = self.best_c != np.iinfo(np.int64).max
        return np.nonzero(found)[0], self.best_c[found], self.best_d[found]


def _merge(best_d, best_c, where_q, exact, ids) -> None:
    """Folds candidates, grouped by query, into the running best lists."""
    k = best_d.shape[1]
    queries, starts = np.unique(where_q, return_index=True)
    for q, start, end in zip(queries, starts, [*starts[1:], len(where_q)], strict=True):
        span = slice(start, end)
        d = np.concatenate([best_d[q], exact[span]])
        c = np.concatenate([best_c[q], ids[span]])
        order = np.lexsort((c, d))[:k]
        best_d[q], best_c[q] = d[order], c[order]
