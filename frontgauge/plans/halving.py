"""Sums over the pairs of one array that are no worse in every column, by halving.

Along its last column a group is halved again and again. Two rows part at exactly one
node, where the lower is in the left half and the higher in the right one, so that only
the other columns remain to be compared, for all nodes of a level at once: a running sum
where one column is left. About n log(n)^(columns - 1) steps in place of n^2.
"""

from __future__ import annotations

import numpy as np

# Columns that are halved at most: with more of them comparing pairs is as fast.
HALVED = 4


def _add_lower(
    rows: np.ndarray, place: np.ndarray, start: np.ndarray, w: np.ndarray, out: np.ndarray
) -> None:
    """The same for two orders: rows in the one, their `place` in the other."""
    got = np.zeros(len(rows))
    start = start.astype(np.int32)
    for bit in reversed(range(int(place.max()).bit_length())):
        r = (place >> bit & 1).astype(bool)
        up_to = np.zeros(len(rows) + 1)
        np.cumsum(w * ~r, out=up_to[1:])
        got += (up_to[1:] - up_to[start]) * r
        if bit:
            lows, highs = np.flatnonzero(~r), np.flatnonzero(r)
            after = np.cumsum(r, dtype=np.int32) - r
            shift = after[start]
            start = np.concatenate([(start - shift)[lows], shift[highs] + np.int32(len(lows))])
            order = np.concatenate([lows, highs])
            rows, place, w, got = rows[order], place[order], w[order], got[order]
    out[rows] += got


def _add_before(
    orders: list[np.ndarray], start: np.ndarray, w: np.ndarray, src: np.ndarray, out: np.ndarray
) -> None:
    """Add to each query the weight of the sources before it in every order of its node.

    Each order lists the same rows, node after node; `start` is the place where the node
    of a place begins. Queries weigh 0.
    """
    last = orders[-1]
    if len(orders) == 1:
        up_to = np.concatenate([[0.0], np.cumsum(w[last])])
        out[last] += up_to[:-1] - up_to[start]
        return
    place = np.zeros(len(src), dtype=np.int32)
    place[last] = np.arange(len(last)) - start
    if len(orders) == 2:
        _add_lower(orders[0], place[orders[0]], start, w[orders[0]], out)
        return
    others = orders[:-1]
    for bit in reversed(range(int(place[last].max()).bit_length())):
        right = [(place[o] >> bit & 1).astype(bool) for o in others]
        # sources of the left halves, queries of the right ones
        part = [r != src[o] for r, o in zip(right, others)]
        if part[0].any():
            before = np.cumsum(part[0]) - part[0]
            inner = [o[m] for o, m in zip(others, part)]
            _add_before(inner, before[start][part[0]], w, src, out)
        if bit:
            r = right[0]
            after = np.cumsum(r) - r  # of the right halves, up to each place
            left = start - after[start]
            start = np.concatenate([left[~r], len(r) - r.sum() + after[start][r]])
            others = [np.concatenate([o[~m], o[m]]) for o, m in zip(others, right)]


def sums_below(
    src: np.ndarray, weight: np.ndarray, qry: np.ndarray, codes: tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """For each query row, the weight of source rows no worse in any column.

    With `codes` (of the sources, of the queries) only rows of equal codes meet.
    """
    v = np.concatenate([src, qry])
    is_src = np.arange(len(v)) < len(src)
    w = np.concatenate([weight, np.zeros(len(qry))])
    out = np.zeros(len(v))
    told = np.flatnonzero(~np.isnan(v).any(axis=1))  # an undefined number compares with none
    if told.size:
        group = np.concatenate(codes)[told] if codes else np.zeros(told.size, dtype=np.int64)
        # sources come first, so that they precede equal queries in a stable sort
        orders = [told[np.lexsort((v[told, k], group))] for k in range(v.shape[1])]
        _, first, count = np.unique(np.sort(group), return_index=True, return_counts=True)
        _add_before(orders, np.repeat(first, count), w, is_src, out)
    return out[len(src) :]


def pairs_below(v: np.ndarray, code: np.ndarray | None = None) -> int:
    """Ordered pairs (i, j), i = j included, with v[i] <= v[j] in every column (and equal codes)."""
    return int(sums_below(v, np.ones(len(v)), v, None if code is None else (code, code)).sum())


def row_codes(v: np.ndarray) -> np.ndarray:
    """A number per row, alike for equal rows."""
    order = np.lexsort(v.T)
    sorted_ = v[order]
    code = np.zeros(len(v), dtype=np.int64)
    code[order[1:]] = np.cumsum((sorted_[1:] != sorted_[:-1]).any(axis=1))
    return code


def equal_pairs_of(v: np.ndarray) -> int:
    """Ordered pairs, i = j included, alike in every column."""
    count = np.bincount(row_codes(v[~np.isnan(v).any(axis=1)]))
    return int((count * count).sum())
