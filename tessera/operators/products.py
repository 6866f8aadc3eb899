"""Sums of products over shared terms of a block of queries and a block of documents, exactly: the k best of each query, or
how many come before one of its own.

A block's common terms are one dense matrix product; the others are added posting by posting. So a term that all
documents hold costs one column, and what a task holds is bounded by its two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries scored at once, columns of the dense part at most, postings added at once, and documents counted at once.
ROWS, COLUMNS, ADDED, COUNTED = 256, 512, 1 << 19, 8192

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def codes(*terms: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The terms of several arrays as numbers, equal where they are equal."""
    whole = pa.chunked_array([c.cast(terms[0].type) for t in terms for c in (t.chunks if isinstance(t, pa.ChunkedArray) else [t])], terms[0].type)
    all_codes = pc.dictionary_encode(whole).unify_dictionaries().combine_chunks()
    all_codes = all_codes.indices if isinstance(all_codes, pa.DictionaryArray) else pa.concat_arrays([c.indices for c in all_codes.chunks])
    flat = all_codes.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum([len(t) for t in terms])[:-1])


def lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a column of lists, and the row each comes from."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return pa.concat_arrays([pa.array([], column.type.value_type), *(c.flatten() for c in column.chunks if len(c))]), np.repeat(np.arange(len(n)), n)


def _scores(q: Entries, d: Entries, n_q: int, n_d: int, limits: np.ndarray | None = None, dtype: type = np.float64) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(a, b, m, scores of the queries a to b and the first m documents), block after block of queries."""
    (qc, qr, qw), (dc, dr, dw) = q, d
    n = 1 + max(qc.max(initial=-1), dc.max(initial=-1))
    asked = np.zeros(n, bool)
    asked[qc] = True
    own = asked[dc]
    dc, dr, dw = dc[own], dr[own], dw[own]
    df = np.bincount(dc, minlength=n)
    wide = np.argsort(-df, kind="stable")[:COLUMNS]
    wide = wide[df[wide] > max(1, n_d // 64)]
    column = np.full(n, -1)
    column[wide] = np.arange(len(wide))
    dense = np.zeros((n_d, len(wide)), dtype)
    at = column[dc]
    dense[dr[at >= 0], at[at >= 0]] = dw[at >= 0]
    dc, dr, dw = dc[at < 0], dr[at < 0], dw[at < 0]
    order = np.argsort(dc, kind="stable")
    dr, dw = dr[order], dw[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(dc, minlength=n))])
    order = np.argsort(qr, kind="stable")
    qc, qr, qw = qc[order], qr[order], qw[order]
    for a in range(0, n_q, ROWS):
        b = min(a + ROWS, n_q)
        m = n_d if limits is None else int(limits[a:b].max())
        if not m:
            continue
        of = slice(*np.searchsorted(qr, (a, b)))
        c, r, w = qc[of], qr[of] - a, qw[of]
        at = column[c]
        common = np.zeros((b - a, len(wide)), dtype)
        common[r[at >= 0], at[at >= 0]] = w[at >= 0]
        s = common @ dense[:m].T
        c, r, w = c[at < 0], r[at < 0], w[at < 0]
        size = starts[c + 1] - starts[c]
        for part in np.split(np.arange(len(c)), np.flatnonzero(np.diff(np.cumsum(size) // ADDED)) + 1):
            own, own_n = part[size[part] > 0], size[part][size[part] > 0]
            if len(own):
                at = np.arange(own_n.sum()) + np.repeat(starts[c[own]] - (np.cumsum(own_n) - own_n), own_n)
                flat, gain = np.repeat(r[own] * m, own_n) + dr[at], np.repeat(w[own], own_n) * dw[at]
                if m < n_d:
                    flat, gain = flat[dr[at] < m], gain[dr[at] < m]
                s += np.bincount(flat, gain, minlength=s.size).reshape(s.shape).astype(dtype, copy=False)
        yield a, b, m, s


def best(q: Entries, d: Entries, n_q: int, n_d: int, k: int, tie: np.ndarray, limits: np.ndarray | None = None, dtype: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the k best documents of each query, in order, of those that share a term with it.

    q and d are entries (term, row, weight), a term once a row; scores are rounded to 9 digits, ties go to the smaller
    `tie`. With `limits` a query meets only so many of the first documents; queries come in order of it.
    """
    found = []
    for a, b, m, s in _scores(q, d, n_q, n_d, limits, dtype):
        if limits is not None:
            low = int(limits[a:b].min())
            s[:, low:][np.arange(low, m) >= limits[a:b, None]] = 0
        least = np.partition(s, m - k, axis=1)[:, m - k, None] - 2e-9 if m > k else np.zeros((1, 1))
        r, c = np.nonzero((s >= least) & (s > 0))
        score = np.round(s[r, c].astype(float), 9)
        order = np.lexsort((tie[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((r[first] + a, c[first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def ahead(q: Entries, d: Entries, n_q: int, n_d: int, k: int, least: np.ndarray, place: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many documents come before each query's own one, of score `least` and tie `place`; from k on some may be left out.

    A document of equal `tie` is the own one. Documents are met COUNTED at a time; queries with k before their own leave.
    """
    (qc, qr, qw), (dc, dr, dw) = q, d
    order = np.argsort(dr, kind="stable")
    dc, dr, dw = dc[order], dr[order], dw[order]
    counts = np.zeros(n_q, np.int64)
    for first in range(0, n_d, COUNTED):
        last = min(first + COUNTED, n_d)
        own = slice(*np.searchsorted(dr, (first, last)))
        open_q = np.flatnonzero(counts < k)
        at = np.full(n_q, -1)
        at[open_q] = np.arange(len(open_q))
        asked = at[qr] >= 0
        for a, b, _, s in _scores((qc[asked], at[qr[asked]], qw[asked]), (dc[own], dr[own] - first, dw[own]), len(open_q), last - first):
            now = open_q[a:b]
            want = least[now, None]
            counts[now] += np.count_nonzero(s > want + 2e-9, axis=1)
            r, c = np.nonzero((s >= want - 2e-9) & (s <= want + 2e-9) & (s > 0))
            score, c = np.round(s[r, c], 9), c + first
            before = (score > least[now[r]]) | (score == least[now[r]]) & (tie[c] < place[now[r]])
            np.add.at(counts, now[r[before & (tie[c] != place[now[r]])]], 1)
    return counts
