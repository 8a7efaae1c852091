"""Non-dominated ranks by dividing, carrying the largest rank of the dominators.

A row's rank is one more than the largest rank among the rows that dominate it. In order
of the last objective (ties by the others) no row is dominated by a later one. So the first
half is ranked on its own; then every row of the second half is raised to one more than the
largest rank of the first half's rows that are no worse in the remaining objectives; then
the second half is ranked with what it was raised to as a start. Fronts are never peeled.

The same division serves a task, on arrays, and a group that no task holds, where the
halves are blocks of a settled table and raising is a distributed query (`weak_hits`).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import known
from ..session import limit, settle
from .dominance import fields, weak_hits
from .ordered import BLOCK, group_sizes, in_blocks, join_blocks, join_on
from .segments import per_group, split_groups

# Runs and pairs of runs this small are compared directly.
_RUN = 64
_PAIRS = 40_000


def swept_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks of distinct rows with up to three columns, by a sweep."""
    rank = np.zeros(len(v), dtype=np.int64)
    if v.shape[1] == 1:
        return np.unique(v[:, 0], return_inverse=True)[1] + 1
    if v.shape[1] == 2:
        # Rows in order of the first column; a front takes a row when the last
        # row it took is better in the second, and those values only grow.
        last: list[float] = []
        for i in np.lexsort((v[:, 1], v[:, 0])):
            r = bisect_right(last, v[i, 1])
            last[r : r + 1] = [v[i, 1]]
            rank[i] = r + 1
        return rank
    return _staircase_ranks(v)


def _staircase_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks of distinct rows with three columns, in about n log^2 n steps.

    In order of the third column (then the others) nothing is dominated by a later row.
    Of every front the rows so far form a staircase in the first two columns: ascending
    in the first, descending in the second. A row that a front dominates is dominated by
    all fronts before it, so its front is found by halving.
    """
    rank = np.zeros(len(v), dtype=np.int64)
    stairs: list[tuple[list[float], list[float]]] = []
    for i in np.lexsort((v[:, 1], v[:, 0], v[:, 2])):
        a, b = v[i, 0], v[i, 1]
        low, high = 0, len(stairs)
        while low < high:
            mid = (low + high) // 2
            firsts, seconds = stairs[mid]
            at = bisect_right(firsts, a) - 1
            if at >= 0 and seconds[at] <= b:
                low = mid + 1
            else:
                high = mid
        rank[i] = low + 1
        if low == len(stairs):
            stairs.append(([], []))
        firsts, seconds = stairs[low]
        # steps that this row makes needless: no better in either column
        at = end = bisect_left(firsts, a)
        while end < len(firsts) and seconds[end] >= b:
            end += 1
        firsts[at:end], seconds[at:end] = [a], [b]
    return rank


def divided_ranks(v: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Ranks of distinct rows, from 1; `start` holds what a row's rank is at least."""
    n = len(v)
    order = np.lexsort(v.T)
    u = np.ascontiguousarray(v[order])
    rank = np.ones(n, dtype=np.int64) if start is None else np.maximum(1, start[order])
    _rank_run(u, rank, 0, n)
    out = np.empty(n, dtype=np.int64)
    out[order] = rank
    return out


def _rank_run(u: np.ndarray, rank: np.ndarray, low: int, high: int) -> None:
    if high - low > _RUN:
        mid = (low + high) // 2
        _rank_run(u, rank, low, mid)
        _raise(u, rank, np.arange(low, mid), np.arange(mid, high), u.shape[1] - 1)
        _rank_run(u, rank, mid, high)
        return
    part, own = u[low:high], rank[low:high]
    worse = (part[:, None, :] <= part[None, :, :]).all(axis=2)
    for j in range(1, len(part)):
        above = own[:j][worse[:j, j]]
        if len(above):
            own[j] = max(own[j], above.max() + 1)


def _raise(u: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> None:
    """Raise `right` above the rows of `left` that are no worse in the first k columns."""
    if not len(left) or not len(right):
        return
    if k == 0:
        rank[right] = np.maximum(rank[right], rank[left].max() + 1)
        return
    a, b = u[left, k - 1], u[right, k - 1]
    if a.min() > b.max():
        return
    if a.max() <= b.min():
        _raise(u, rank, left, right, k - 1)
        return
    if k == 1:
        order = np.argsort(a, kind="stable")
        best = np.concatenate([[0], np.maximum.accumulate(rank[left[order]])])
        above = best[np.searchsorted(a[order], b, side="right")]
        rank[right] = np.where(above > 0, np.maximum(rank[right], above + 1), rank[right])
        return
    if len(left) * len(right) <= _PAIRS:
        ok = np.ones((len(left), len(right)), dtype=bool)
        for c in range(k):
            ok &= u[left, c][:, None] <= u[right, c][None, :]
        above = np.where(ok, rank[left][:, None], 0).max(axis=0)
        rank[right] = np.where(above > 0, np.maximum(rank[right], above + 1), rank[right])
        return
    # rows up to the middle value, and rows above it
    every = np.concatenate([a, b])
    middle = np.partition(every, len(every) // 2)[len(every) // 2]
    if every.max() == middle:  # it is the largest: then rows below it, and rows at it
        below = every[every < middle]
        middle = below.max()
    up_a, up_b = a > middle, b > middle
    _raise(u, rank, left[~up_a], right[~up_b], k)
    _raise(u, rank, left[~up_a], right[up_b], k - 1)
    _raise(u, rank, left[up_a], right[up_b], k)


def _leaf_ranks(rows: DataFrame, keys: list[str], objs: list[str], total: int) -> DataFrame:
    """Ranks within (keys, block), from the start that each row brings in `_start`."""
    cols = [*keys, *objs, BLOCK, "_no", "_rid"]

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        v, start = pdf[objs].to_numpy(float), pdf["_start"].to_numpy(np.int64)
        rank = np.zeros(len(pdf), dtype=np.int64)
        for at in split_groups(pdf, [*keys, BLOCK]):
            rank[at] = divided_ranks(v[at], start[at])
        return pdf[cols].assign(rank=rank)

    return per_group(rows, [*keys, BLOCK], local, fields(rows, cols) + ", rank long", total)


def ranks_by_halves(vec: DataFrame, keys: Sequence[str], objs: Sequence[str], most: int) -> DataFrame:
    """Ranks of settled, distinct vectors in groups of any size; `most` rows to a block.

    Blocks of all groups are worked off by their number within the group. After block t,
    the blocks of the left half that ends with it raise those of the right half beside it:
    as many distributed queries as the largest group has blocks, each row taking part in
    log(blocks) of them.
    """
    keys, objs = list(keys), list(objs)
    laid = in_blocks(vec, keys, [*reversed(objs)], most)
    first = Window.partitionBy(*keys)  # over blocks, not rows
    numbers = laid.df.select(*keys, BLOCK).distinct().withColumn(
        "_no", (F.col(BLOCK) - F.min(BLOCK).over(first)).cast("int")
    )
    rows = settle(
        join_blocks(laid.df, numbers, keys).withColumn("_rid", F.monotonically_increasing_id())
    )
    blocks = (rows.agg(F.max("_no")).first()[0] or 0) + 1
    done: list[DataFrame] = []
    raised: list[tuple[int, int, DataFrame]] = []
    for t in range(blocks):
        here = rows.where(F.col("_no") == t)
        starts = [r.where(F.col("_no") == t).select("_rid", "_start") for low, high, r in raised if low <= t < high]
        if starts:
            known = reduce(DataFrame.unionByName, starts).groupBy("_rid").agg(F.max("_start").alias("_start"))
            here = here.join(known, "_rid", "left")
        else:
            here = here.withColumn("_start", F.lit(1).cast("long"))
        here = here.withColumn("_start", F.coalesce("_start", F.lit(1).cast("long")))
        total, _ = group_sizes(rows.where(F.col("_no") == t), [])
        done.append(settle(_leaf_ranks(here, keys, objs, total)))
        width = (t + 1) & -(t + 1)  # blocks of the left half that ends here
        low, high = t + 1, min(t + 1 + width, blocks)
        if low < high:
            left = reduce(DataFrame.unionByName, done[t + 1 - width :])
            sides = left.withColumns({"_w": F.col("rank").cast("double"), "_src": F.lit(True), "_qry": F.lit(False)})
            right = rows.where((F.col("_no") >= low) & (F.col("_no") < high)).withColumns(
                {"rank": F.lit(0).cast("long"), "_w": F.lit(0.0), "_src": F.lit(False), "_qry": F.lit(True)}
            )
            both = settle(sides.unionByName(right).drop(BLOCK))
            best = weak_hits(both, keys, objs[:-1], best=True).where("_hits > 0")
            raised.append((low, high, settle(
                best.join(right.select("_rid", "_no"), "_rid").select(
                    "_rid", "_no", (F.col("_hits") + 1).cast("long").alias("_start")
                )
            )))
    return reduce(DataFrame.unionByName, done).select(*keys, *objs, "rank")


def ranked_vectors(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Distinct vectors of each group with their non-dominated rank; none with a NULL objective."""
    keys, objs = list(keys), list(objs)
    cols = [*keys, *objs]
    vec = settle(df.select(*cols).where(known(*objs)).distinct())
    # With two objectives ranking a group costs no more than sorting it, with three
    # little more.
    most = limit(df.sparkSession, "window.rows" if len(objs) == 2 else "sweep.rows")
    total, largest = group_sizes(vec, keys)
    if largest <= most:
        return _local_ranks(vec, keys, objs, total)
    if not keys:
        return ranks_by_halves(vec, keys, objs, most)
    big = settle(vec.groupBy(*keys).count().where(F.col("count") > most).select(*keys))
    small = _local_ranks(join_on(vec, big, keys, "left_anti"), keys, objs, total)
    rest = settle(join_on(vec, big, keys, "left_semi"))
    return small.unionByName(ranks_by_halves(rest, keys, objs, most))


def _local_ranks(vec: DataFrame, keys: list[str], objs: list[str], total: int) -> DataFrame:
    cols = [*keys, *objs]

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[objs].to_numpy(float)
        rank = np.zeros(len(pdf), dtype=np.int64)
        for at in split_groups(pdf, keys) if keys else [np.arange(len(pdf))]:
            rank[at] = swept_ranks(v[at]) if len(objs) <= 3 else divided_ranks(v[at])
        return pdf[cols].assign(rank=rank)

    return per_group(vec, keys, local, fields(vec, cols) + ", rank long", total)
