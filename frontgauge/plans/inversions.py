"""Inversions of a sequence: pairs out of order, counted by merging."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import limit, settle
from .dominance import tree_halves
from .ordered import BLOCK, group_sizes, in_blocks, running
from .segments import per_group, split_groups

# Runs this short are compared directly.
_RUN = 32


def merge_count(y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w[i] * w[j] over i < j with y[i] > y[j]."""
    n = len(y)
    starts = range(0, n, _RUN)
    out, runs = 0.0, []
    for a in starts:
        v, u = y[a : a + _RUN], w[a : a + _RUN]
        above = np.triu(v[:, None] > v[None, :], 1)
        out += float(u @ above @ u)
        order = np.argsort(v, kind="stable")
        runs.append((v[order], u[order]))
    while len(runs) > 1:
        merged = []
        for left, right in zip(runs[::2], runs[1::2]):
            up_to = np.concatenate([[0.0], np.cumsum(left[1])])
            # of the left run, what is above each value of the right one
            out += float(right[1] @ (up_to[-1] - up_to[np.searchsorted(left[0], right[0], side="right")]))
            v, u = (np.concatenate(z) for z in zip(left, right))
            order = np.argsort(v, kind="stable")
            merged.append((v[order], u[order]))
        runs = merged + runs[len(runs) - len(runs) % 2 :]
    return out


def inversions(tally: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per group `_inversions`: weight of pairs that rise in x and fall in y.

    `tally` is settled and holds each (x, y) of a group once, with its weight `_w`. Rows are
    laid in order of (x, y) and cut into blocks. A block is counted by merging. Between
    blocks, every row is copied to the nodes of a binary tree over the blocks, where the
    rows of the left half that lie above one of the right half are a running sum in order
    of y: log(blocks) copies, and no pair is listed.
    """
    keys = list(keys)
    laid = in_blocks(tally, keys, [x, y], limit(tally.sparkSession, "sweep.rows"))
    names = "".join(f"`{k}` {tally.schema[k].dataType.simpleString()}, " for k in keys)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y])
        v, w = pdf[y].to_numpy(float), pdf["_w"].to_numpy(float)
        groups = list(split_groups(pdf, [*keys, BLOCK]))
        out = pdf.iloc[[at[0] for at in groups]][keys]
        return out.assign(_inversions=[merge_count(v[at], w[at]) for at in groups])

    total, _ = group_sizes(tally, [])
    parts = per_group(laid.df, [*keys, BLOCK], inside, names + "_inversions double", total)
    if laid.split:
        marked = laid.df.withColumns(
            {"_rid": F.xxhash64(x, y), "_src": F.lit(True), "_qry": F.lit(True), "_role": F.lit(0)}
        )
        node = [*keys, "_level", "_node"]
        halves = settle(tree_halves(marked, keys, "_level", "_node"))
        # equal values of the left half come first, so that they are not above
        halves = halves.withColumn("_role", F.expr("if(_src, 0, 1)"))
        order = [y, "_role", x, "_rid"]
        weight = F.expr("if(_src, _w, 0D)")
        below = running(in_blocks(halves, node, order), node, order, {"_below": ("sum", weight)})
        rest = below.where("_qry").groupBy(*keys).agg((-F.sum(F.col("_w") * F.col("_below"))).alias("_inversions"))
        every = halves.groupBy(*node).agg(
            F.sum(weight).alias("_left"), F.sum(F.expr("if(_qry, _w, 0D)")).alias("_right")
        )
        pairs = every.groupBy(*keys).agg(F.sum(F.col("_left") * F.col("_right")).alias("_inversions"))
        parts = parts.unionByName(rest).unionByName(pairs)
    return parts.groupBy(*keys).agg(F.sum("_inversions").cast("long").alias("_inversions"))
