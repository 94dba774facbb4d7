"""Distances between two blocks of vectors, evaluated inside a task with numpy.

A block is either a dense matrix or a list of sparse rows. Wide blocks use one matrix
product, whose last bits depend on the block shape; ``tol`` bounds that error and
``exact`` re-evaluates chosen pairs in a fixed order, so rankings never depend on how
the points were blocked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

METRICS = ("euclidean", "cosine", "jensenshannon")
NARROW = 4
TERM_CHUNK = 4096


def stack(frame, column: str) -> "np.ndarray | SparseBlock":
    """Vectors of a pandas column as a dense matrix, or its two sparse parts as sparse rows."""
    if column in frame:
        return np.stack(frame[column].to_numpy()).astype("float64", copy=False)
    return SparseBlock(*(list(frame[f"{column}__{part}"]) for part in ("idx", "val")))


class SparseBlock:
    """Rows of (sorted term ids, weights), also kept as one flat list of entries."""

    def __init__(self, idx, val):
        self.idx, self.val = idx, val
        sizes = [len(i) for i in idx]
        self.row = np.repeat(np.arange(len(idx)), sizes)
        self.flat_idx = np.concatenate(idx).astype("int64") if idx else np.empty(0, "int64")
        self.flat_val = np.concatenate(val).astype("float64") if val else np.empty(0)

    @property
    def integral(self):
        return bool((self.flat_val == np.floor(self.flat_val)).all())

    def __len__(self):
        return len(self.idx)

    def sq_norms(self):
        return np.bincount(self.row, self.flat_val * self.flat_val, minlength=len(self))

    def slice(self, lo, hi):
        return SparseBlock(self.idx[lo:hi], self.val[lo:hi])

    def entries(self, terms):
        """(row, position in ``terms``, weight) of the entries whose term is listed."""
        pos = np.searchsorted(terms, self.flat_idx)
        pos[pos == len(terms)] = 0
        hit = terms[pos] == self.flat_idx if len(terms) else np.zeros(len(pos), dtype=bool)
        return self.row[hit], pos[hit], self.flat_val[hit]

    def dot(self, other):
        """All inner products; memory is bounded by a chunk of shared terms."""
        shared = np.intersect1d(self.flat_idx, other.flat_idx)
        out = np.zeros((len(self), len(other)))
        sides = [(len(s), *s.entries(shared)) for s in (self, other)]
        for lo in range(0, len(shared), TERM_CHUNK):
            width = min(TERM_CHUNK, len(shared) - lo)
            parts = []
            for n, row, pos, val in sides:
                dense = np.zeros((n, width))
                now = (pos >= lo) & (pos < lo + width)
                dense[row[now], pos[now] - lo] = val[now]
                parts.append(dense)
            out += parts[0] @ parts[1].T
        return out

    def pair_dots(self, other, rows, cols):
        out = np.empty(len(rows))
        for n, (r, c) in enumerate(zip(rows, cols)):
            _, a, b = np.intersect1d(self.idx[r], other.idx[c], True, True)
            out[n] = (self.val[r][a] * other.val[c][b]).sum()
        return out


def _entropy(p):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log(p), 0.0)


class BlockDistance:
    """Distances of block ``a`` to block ``b`` with ``matrix()`` and ``exact(rows, cols)``."""

    def __init__(self, a, b, metric: str):
        if metric not in METRICS:
            raise ValueError(f"unknown distance {metric!r}")
        self.a, self.b, self.metric = a, b, metric
        self.sparse = isinstance(a, SparseBlock)
        self.wide = self.sparse or (a.shape[1] > NARROW and metric != "jensenshannon")
        self.tol = 0.0
        if metric == "jensenshannon":
            if self.sparse:
                raise ValueError("jensenshannon needs dense topic vectors")
            self.pa, self.pb = (m / m.sum(axis=1, keepdims=True) for m in (a, b))
        else:
            norms = (lambda m: m.sq_norms()) if self.sparse else (lambda m: (m * m).sum(axis=1))
            self.na, self.nb = norms(a), norms(b)
        if self.wide:
            # squared-distance error of a product is a small multiple of eps * |a| |b|
            # of points that have distances; one without must not take the bound from the others
            top = max(n[np.isfinite(n)].max(initial=0.0) for n in (self.na, self.nb))
            self.tol = 1e-6 * np.sqrt(top) if metric == "euclidean" else 1e-9
            if self.sparse and a.integral and b.integral:
                self.tol = 0.0  # products of counts are exact

    def matrix(self):
        if not self.wide:
            return self._narrow()
        dots = self.a.dot(self.b) if self.sparse else self.a @ self.b.T
        if self.metric == "cosine":
            return self._cosine(dots, self.na[:, None], self.nb[None, :])
        dots *= -2.0
        dots += self.na[:, None]
        dots += self.nb[None, :]
        return np.sqrt(np.maximum(dots, 0.0, out=dots), out=dots)

    @staticmethod
    def _cosine(dots, na, nb):
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - dots / (np.sqrt(na) * np.sqrt(nb))

    def stable(self):
        """Like ``matrix`` but equal pairs give equal bits in every block, so ties stay ties.

        Dense vectors are added up component by component; weighted sparse vectors, whose sums
        run over the terms a block shares, are rounded to ten decimals.
        """
        if not self.wide or not self.tol:
            return self.matrix()
        return np.round(self.matrix(), 10) if self.sparse else self._narrow()

    def stable_at(self, rows, cols, full=None):
        """``stable`` of chosen pairs, bit for bit; ``full`` is ``matrix()`` where the caller has it."""
        if self.metric == "jensenshannon" or self.sparse:
            return self.stable()[rows, cols] if full is None else (np.round(full[rows, cols], 10) if self.sparse and self.tol else full[rows, cols])
        acc = np.zeros(len(rows))
        for k in range(self.a.shape[1]):
            x, y = self.a[:, k][rows], self.b[:, k][cols]
            acc += (x - y) * (x - y) if self.metric == "euclidean" else x * y
        return np.sqrt(acc) if self.metric == "euclidean" else self._cosine(acc, self.na[rows], self.nb[cols])

    def _narrow(self):
        if self.metric == "jensenshannon":
            return np.stack([self._js(self.pa[r][None, :], self.pb) for r in range(len(self.pa))])
        acc = np.zeros((len(self.a), len(self.b)))
        term = np.empty_like(acc)
        combine = np.subtract if self.metric == "euclidean" else np.multiply
        for k in range(self.a.shape[1]):
            combine(self.a[:, k][:, None], self.b[:, k][None, :], out=term)
            if self.metric == "euclidean":
                np.multiply(term, term, out=term)
            acc += term
        if self.metric == "cosine":
            return self._cosine(acc, self.na[:, None], self.nb[None, :])
        return np.sqrt(acc)

    @staticmethod
    def _js(p, q):
        mid = (p + q) / 2.0
        div = (_entropy(p) / 2.0 + _entropy(q) / 2.0 - _entropy(mid)).sum(axis=1)
        # a row without mass has no distribution: it is nobody's neighbour
        return np.where(np.isnan(mid.sum(axis=1)), np.inf, np.sqrt(np.maximum(div, 0.0)))

    def exact(self, rows, cols):
        """Distances of chosen pairs, independent of the block they sit in."""
        if self.metric == "jensenshannon":
            return self._js(self.pa[rows], self.pb[cols])
        if self.sparse:
            dots = self.a.pair_dots(self.b, rows, cols)
        elif self.metric == "euclidean":
            return np.sqrt(np.square(self.a[rows] - self.b[cols]).sum(axis=1))
        else:
            dots = (self.a[rows] * self.b[cols]).sum(axis=1)
        if self.metric == "cosine":
            return self._cosine(dots, self.na[rows], self.nb[cols])
        return np.sqrt(np.maximum(self.na[rows] + self.nb[cols] - 2.0 * dots, 0.0))


def others(full, row_ids, col_ids):
    """The distances with infinity at the row's own point and where there is none; copied only if there are such."""
    if np.isin(row_ids, col_ids).any() or not np.isfinite(full.sum()):
        return np.where((row_ids[:, None] == col_ids[None, :]) | np.isnan(full), np.inf, full)
    return full


def nearest(dist: BlockDistance, full, row_ids, col_ids, k: int):
    """(row, col, distance) of the k nearest other points of every row, ties by id.

    The k-th distance to every few columns bounds the k-th distance to all, so only what it leaves is ordered.
    """
    full = others(full, row_ids, col_ids)
    kk = min(k, full.shape[1])
    every = max(1, min(8, full.shape[1] // (4 * kk)))
    cut = np.partition(full[:, ::every], kk - 1, axis=1)[:, kk - 1]
    rows, cols = np.divmod(np.flatnonzero(full <= (cut + 2.0 * dist.tol)[:, None]), full.shape[1])
    d = full[rows, cols]
    starts = np.searchsorted(rows, np.arange(len(row_ids)))
    if every > 1:
        order = np.lexsort((d, rows))
        kth = d[order][starts + kk - 1]
        near = d <= (kth + 2.0 * dist.tol)[rows]
        rows, cols, d = rows[near], cols[near], d[near]
    fine = np.isfinite(d)
    rows, cols, d = rows[fine], cols[fine], d[fine]
    if dist.tol:
        d = dist.exact(rows, cols)
    order = np.lexsort((col_ids[cols], d, rows))
    rows, cols, d = rows[order], cols[order], d[order]
    starts = np.searchsorted(rows, np.arange(len(row_ids)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep], d[keep]


def count_closer(dist: BlockDistance, full, col_ids, rows, ids, targets):
    """For look-up n: how many columns lie before (targets[n], ids[n]) around rows[n].

    ``full`` comes from ``others``, so the row's own point never counts.
    """
    lines = full[rows]
    t = targets[:, None]
    if not dist.tol:
        out = np.count_nonzero(lines < t, axis=1)
        n, c = np.divmod(np.flatnonzero(lines == t), full.shape[1])
        hit = col_ids[c] < ids[n]
    else:
        out = np.count_nonzero(lines < t - dist.tol, axis=1)
        n, c = np.divmod(np.flatnonzero(np.abs(lines - t) <= dist.tol), full.shape[1])
        d = dist.exact(rows[n], c)
        hit = (d < targets[n]) | ((d == targets[n]) & (col_ids[c] < ids[n]))
    return out + np.bincount(n, weights=hit, minlength=len(rows)).astype("int64")


def column_distance(a: Column, b: Column, metric: str) -> Column:
    """The distance of two array columns as a native expression, added up component by component.

    NULL where there is none: cosine of a vector without length, jensenshannon of one without mass, vectors that
    are NULL, hold NULL or differ in length.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown distance {metric!r}")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    term = lambda f: total(F.zip_with(a, b, f))
    if metric == "euclidean":
        value = F.sqrt(term(lambda x, y: (x - y) * (x - y)))
    elif metric == "cosine":
        length = F.sqrt(term(lambda x, y: x * x)) * F.sqrt(term(lambda x, y: y * y))
        value = F.when(length > 0, 1.0 - term(lambda x, y: x * y) / length)
    else:
        mass_a, mass_b = term(lambda x, y: x), term(lambda x, y: y)
        entropy = lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)

        def gain(x, y):
            p, q = x / mass_a, y / mass_b
            return entropy(p) / 2 + entropy(q) / 2 - entropy((p + q) / 2)

        value = F.when((mass_a > 0) & (mass_b > 0), F.sqrt(F.greatest(term(gain), F.lit(0.0))))
    return F.when(F.size(a) == F.size(b), value)
