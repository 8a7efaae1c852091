"""The k nearest partners of each point, exactly, inside an array.

Partners are taken in blocks of neighbours. A block's centre and radius bound how near any of
its partners can be, so a point passes over the blocks that hold none nearer than the k it has.
In the blocks that are left, products of matrices pick the pairs that may be near enough, with
room for their rounding; only these pairs are measured coordinate by coordinate.
"""

from __future__ import annotations

import numpy as np

# Bytes of the distances, and of the gaps of picked pairs, that are held at a time.
_STEP_BYTES = 8_000_000
_GAP_BYTES = 500_000

# The places of a partner that is still missing and of one whose id is NULL.
MISSING = np.iinfo(np.int64).max
LAST = MISSING - 1

# Rounding of a bound on distances, as a share of the vectors' lengths.
_SLACK = 1e-6

# distances, places and targets of each point's nearest partners so far, in order
Near = tuple[np.ndarray, np.ndarray, np.ndarray]


def no_partners(rows: int, k: int) -> Near:
    return np.full((rows, k), np.nan), np.full((rows, k), MISSING), np.full((rows, k), np.nan)


def _measured(x: np.ndarray, i: np.ndarray, sites: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j); squares are added in the order of the coordinates."""
    out = np.zeros(len(i))
    step = max(1, _GAP_BYTES // (8 * max(1, x.shape[1])))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        gap = x[i[part]] - sites[j[part]]
        for col in (gap * gap).T:
            out[part] += col
    return np.sqrt(out)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _keep_nearest(near: Near, i: np.ndarray, found: Near) -> None:
    """Put the pairs found for the points `i` among the nearest so far."""
    k = near[0].shape[1]
    rows = np.unique(i)
    point = np.concatenate([np.repeat(rows, k), i])
    dist, place, y = (np.concatenate([a[rows].ravel(), b]) for a, b in zip(near, found))
    # NaN comes last
    order = np.lexsort((y, place, dist, point))
    best = order[np.searchsorted(point[order], rows)[:, None] + np.arange(k)]
    for whole, part in zip(near, (dist, place, y)):
        whole[rows] = part[best]


def take_nearest(
    x: np.ndarray,
    sites: np.ndarray,
    target: np.ndarray,
    place: np.ndarray,
    near: Near,
    block: int,
    apart: tuple[np.ndarray, np.ndarray] | None = None,
) -> None:
    """Update `near` with `sites`: by distance, those at a NaN distance last, ties by place.

    `apart` has a code per point and per site: a point takes no site of its own code, but
    one of code -1 takes all.
    """
    dist, at, _ = near
    width, k = x.shape[1], dist.shape[1]
    own, half = _squares(x), 0.5 * _squares(sites)
    starts = range(0, len(sites), block)
    parts = [sites[j : j + block] for j in starts]
    longest = np.array([np.fmax.reduce(half[j : j + block], initial=0.0) for j in starts])
    centre = np.array([p.mean(axis=0) for p in parts]).reshape(len(parts), width)
    radius = np.sqrt([_squares(p - c).max() for p, c in zip(parts, centre)])
    rounding = 4 * (width + 8) * np.finfo(float).eps

    def others(point: np.ndarray, first: int, size: int) -> np.ndarray:
        mine, theirs = apart
        return (mine[point, None] != theirs[first : first + size]) | (mine[point, None] == -1)

    def visit(go: np.ndarray, b: int) -> None:
        j, part = starts[b], parts[b]
        # half the squared distance, less half the point's own square
        v = x[go] @ part.T
        np.subtract(half[j : j + block], v, out=v)
        room = rounding * (own[go] + 2 * longest[b]) + 1e-300
        most = 0.5 * (dist[go, -1] ** 2 - own[go]) + room
        few = np.flatnonzero(at[go, -1] == MISSING)
        if len(few):
            seen = v[few]
            seen = np.where(np.isnan(seen), np.inf, seen)
            if apart is not None:
                seen[~others(go[few], j, len(part))] = np.inf
            enough = seen.shape[1] >= k
            most[few] = np.partition(seen, k - 1, axis=1)[:, k - 1] + 2 * room[few] if enough else np.inf
        close = v <= most[:, None]
        close[~np.isfinite(most)] = True
        i, s = np.divmod(np.flatnonzero(close), len(part))
        i, s = go[i], s + j
        if apart is not None:
            told = (apart[0][i] != apart[1][s]) | (apart[0][i] == -1)
            i, s = i[told], s[told]
        d = _measured(x, i, sites, s)
        keep = ~(d > dist[i, -1])
        if keep.any():
            i, s = i[keep], s[keep]
            _keep_nearest(near, i, (d[keep], place[s], target[s]))

    with np.errstate(all="ignore"):
        step = max(1, _STEP_BYTES // (8 * max(1, min(block, len(sites)))))
        for first in range(0, len(x), step):
            rows = np.arange(first, min(first + step, len(x)))
            away = np.sqrt(np.maximum(0, own[rows, None] - 2 * (x[rows] @ centre.T) + _squares(centre)))
            least = away - radius - _SLACK * (np.sqrt(own[rows, None]) + np.sqrt(2 * longest))
            for b in np.argsort(least.min(axis=0), kind="stable"):
                go = rows[~(least[:, b] > dist[rows, -1])]
                if len(go):
                    visit(go, b)


def means(near: Near) -> np.ndarray:
    """Mean target of each point's partners; NaN where it has none."""
    _, place, y = near
    have = (place != MISSING).sum(axis=1)
    out = np.full(len(y), np.nan)
    for n in np.unique(have[have > 0]):
        out[have == n] = y[have == n][:, :n].mean(axis=1)
    return out
