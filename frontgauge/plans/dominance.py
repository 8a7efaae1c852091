"""Who dominates whom, without comparing all pairs of a group.

Everything is minimised. Vectors are distinct within a group (copies are
collapsed first), so "no worse everywhere" by another row means domination.

A group too big for one task is cut into blocks along its last objective (ties
broken by the others). Within a block rows are compared directly. Between blocks
the lower block wins on the last objective by construction, so only the other
objectives remain to be compared: a problem with one objective less. To do that
for all block pairs at once, block numbers are read as leaves of a binary tree:
two blocks part at exactly one node, where the lower is in the left half and the
higher in the right half. Each row is thus copied once per tree level, not once
per other row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import known
from ..session import limit, settle
from .halving import HALVED, sums_below
from .ordered import (
    BLOCK,
    Laid,
    group_sizes,
    in_blocks,
    join_blocks,
    join_on,
    running,
    spread_groups,
)
from .segments import per_group, split_groups


# A group with this share of all rows has many in every Arrow batch.
_CROWD = 0.01

# Up to so many pairs, comparing them directly is the faster way to count.
_DIRECT = 1 << 24


def fields(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


# -- numpy helpers for groups of bounded size ---------------------------------


def front_mask(v: np.ndarray) -> np.ndarray:
    """Rows of v that no other row dominates; copies stay together."""
    keep = np.zeros(len(v), dtype=bool)
    # A dominator never has a larger sum, and with equal (rounded) sums it comes
    # first column by column, so the first row left is always on the front.
    left = np.lexsort((*v.T[::-1], v.sum(axis=1)))
    rest = np.ascontiguousarray(v[left].T)
    while left.size:
        worse = np.ones(left.size, dtype=bool)
        same = np.ones(left.size, dtype=bool)
        for col in rest:
            worse &= col >= col[0]
            same &= col == col[0]
        keep[left[same]] = True
        left, rest = left[~worse], rest[:, ~worse]
    return keep


def weak_tally(
    src: np.ndarray, weight: np.ndarray, qry: np.ndarray, step: int = 256
) -> np.ndarray:
    """For each query row, the weight of source rows no worse in any column."""
    if src.shape[1] <= HALVED and len(src) * len(qry) > _DIRECT:
        return sums_below(src, weight, qry)
    out = np.zeros(len(qry))
    for i in range(0, len(qry), step):
        part = qry[i : i + step]
        ok = np.ones((len(part), len(src)), dtype=bool)
        for k in range(src.shape[1]):
            ok &= src[None, :, k] <= part[:, None, k]
        out[i : i + step] = ok @ weight
    return out


def weak_best(src: np.ndarray, weight: np.ndarray, qry: np.ndarray, step: int = 256) -> np.ndarray:
    """For each query row, the largest weight of a source row no worse in any column, or 0."""
    out = np.zeros(len(qry))
    for i in range(0, len(qry), step):
        part = qry[i : i + step]
        ok = np.ones((len(part), len(src)), dtype=bool)
        for k in range(src.shape[1]):
            ok &= src[None, :, k] <= part[:, None, k]
        out[i : i + step] = np.where(ok, weight[None, :], 0).max(axis=1)
    return out


# -- distributed count and test -----------------------------------------------


def weak_hits(
    rows: DataFrame, keys: Sequence[str], objs: Sequence[str], count: bool = True, best: bool = False
) -> DataFrame:
    """(_rid, _hits): for each query, the weight of the sources no worse than it.

    `rows` holds keys, objs, _w (double weight), _src and _qry (may it act as
    source, as query) and _rid (long, unique). A row that is both counts itself.
    With count=False only "more than itself or not" is kept exact, which saves
    one round of copying. With best=True `_hits` is the largest of the sources' weights
    in place of their sum, 0 without any.
    """
    keys, objs = list(keys), list(objs)
    fold, name, tally = (F.max, "max", weak_best) if best else (F.sum, "sum", weak_tally)
    if not objs:
        total = rows.where("_src").groupBy(*keys).agg(fold("_w").alias("_hits"))
        hits = F.coalesce("_hits", F.lit(0.0)).alias("_hits")
        return join_on(rows.where("_qry"), total, keys, "left").select("_rid", hits)

    # Among equal values sources come first, so that they count.
    rows = rows.withColumn("_role", F.expr("if(_src, 0, 1)"))
    order = [*reversed(objs), "_role", "_rid"]
    if len(objs) == 1:
        laid = in_blocks(rows, keys, order)
        hits = {"_hits": (name, F.expr("if(_src, _w, 0D)"))}
        return running(laid, keys, order, hits).where("_qry").select("_rid", "_hits")
    if len(objs) == 2 and not count and not best:
        a, b = objs
        order = [a, "_role", "_rid"]
        laid = in_blocks(rows, keys, order)
        got = running(laid, keys, order, {"_low": ("min", F.when(F.col("_src"), F.col(b)))})
        hits = F.when(F.col("_low") <= F.col(b), 1.0).otherwise(0.0).alias("_hits")
        return got.where("_qry").select("_rid", hits)

    # sums are found by halving, without comparing all pairs of a block
    size = "sweep.rows" if not best and len(objs) <= HALVED else "compare.rows"
    laid = in_blocks(rows, keys, order, limit(rows.sparkSession, size))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        v, w = pdf[objs].to_numpy(float), pdf["_w"].to_numpy(float)
        src, qry = pdf["_src"].to_numpy(bool), pdf["_qry"].to_numpy(bool)
        hits = np.zeros(len(pdf))
        for at in split_groups(pdf, [*keys, BLOCK]):
            s, q = at[src[at]], at[qry[at]]
            if len(s) and len(q):
                hits[q] = tally(v[s], w[s], v[q])
        return pd.DataFrame({"_rid": pdf["_rid"].to_numpy()[qry], "_hits": hits[qry]})

    total, _ = group_sizes(laid.df, [])
    near = per_group(laid.df, [*keys, BLOCK], inside, "_rid long, _hits double", total)
    if not laid.split:
        return near
    level, node = f"_level{len(objs)}", f"_node{len(objs)}"
    halves = tree_halves(laid.df, keys, level, node)
    far = weak_hits(halves, [*keys, level, node], objs[:-1], count, best)
    return near.unionByName(far).groupBy("_rid").agg(fold("_hits").alias("_hits"))


def tree_halves(blocked: DataFrame, keys: Sequence[str], level: str, node: str) -> DataFrame:
    """Copy each row of a spread group to the tree nodes above its block."""
    blocks = blocked.select(*keys, BLOCK).distinct()
    whole = Window.partitionBy(*keys)  # over blocks, not rows
    ends = spread_groups(blocks, keys).withColumns(
        {"_lo": F.min(BLOCK).over(whole), "_hi": F.max(BLOCK).over(whole)}
    )
    rows = join_blocks(blocked, ends, keys)
    depth = F.length(F.bin(F.col("_lo").bitwiseXOR(F.col("_hi")).cast("long")))
    rows = rows.withColumn(level, F.explode(F.sequence(F.lit(0), depth - 1)))
    rows = rows.withColumns(
        {
            node: F.expr(f"shiftright({BLOCK}, {level} + 1)"),
            "_right": F.expr(f"shiftright({BLOCK}, {level}) & 1 = 1"),
        }
    )
    rows = rows.withColumns(
        {"_src": F.expr("_src and not _right"), "_qry": F.expr("_qry and _right")}
    )
    return rows.where("_src or _qry").drop(BLOCK, "_lo", "_hi", "_right", "_role")


def distinct_vectors(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """One settled row per distinct vector: copies counted in _w, numbered in _rid."""
    tally = df.groupBy(*keys, *objs).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    return settle(
        tally.withColumns(
            {"_rid": F.monotonically_increasing_id(), "_src": F.lit(True), "_qry": F.lit(True)}
        )
    )


# -- fronts -------------------------------------------------------------------


def _staircase(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Two-objective front vectors: a new low of b in order of a."""
    thin = df.groupBy(*keys, a).agg(F.min(b).alias(b))
    laid = in_blocks(thin, keys, [a])
    got = running(laid, keys, [a], {"_low": ("min", F.col(b))}, inclusive=False)
    return got.where(F.col("_low").isNull() | (F.col(b) < F.col("_low"))).select(*keys, a, b)


def _block_fronts(
    vec: DataFrame, keys: Sequence[str], objs: Sequence[str], total: int
) -> DataFrame:
    """The front of each group, or of each block where `keys` includes one."""
    cols = [*keys, *objs]

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[objs].to_numpy(float)
        keep = [at[front_mask(v[at])] for at in split_groups(pdf, keys)]
        return pdf.iloc[np.concatenate(keep)][cols]

    return per_group(vec, keys, local, fields(vec, cols), total)


def _few_vectors(df: DataFrame, cols: Sequence[str], rows: int) -> bool:
    """Will grouping by these columns leave little before the shuffle?"""
    different = F.approx_count_distinct(F.xxhash64(*cols), 0.1).alias("n")
    return df.agg(different).first()["n"] < rows / 20


def _thinned(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Drop rows dominated within their own Arrow batch, before anything is shuffled."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = b[objs].to_numpy(float)
            groups = split_groups(b, keys) if keys else [np.arange(len(b))]
            yield b.iloc[np.concatenate([at[front_mask(v[at])] for at in groups])]

    return df.mapInPandas(local, fields(df, [*keys, *objs]))


def front_vectors(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Distinct non-dominated vectors of each group, any number of objectives.

    A row with a NULL objective is on no front and keeps none off it.
    """
    keys, objs = list(keys), list(objs)
    df = df.where(known(*objs))
    if len(objs) == 1:
        return df.groupBy(*keys).agg(F.min(objs[0]).alias(objs[0]))
    if len(objs) == 2:
        return _staircase(df, keys, *objs)
    cols = [*keys, *objs]
    most = limit(df.sparkSession, "compare.rows")
    df = df.select(*cols)
    rows, largest = group_sizes(df, keys)
    if largest > most and largest > _CROWD * rows and not _few_vectors(df, [*keys, *objs[1:]], rows):
        df = _thinned(df, keys, objs)
    # Of rows alike in all but the first objective only the least can be on the
    # front; this is a plain aggregate, combined before the shuffle.
    vec = df.groupBy(*keys, *objs[1:]).agg(F.min(objs[0]).alias(objs[0])).select(*cols)
    if not keys:
        keys, vec = ["_all"], vec.withColumn("_all", F.lit(0))
    vec = settle(vec)
    total, largest = group_sizes(vec, keys)
    # Fronts of random blocks, while that thins the big groups out: whatever a
    # block drops is dominated in the whole group too.
    while largest > most:
        laid = in_blocks(vec.withColumn("_h", F.xxhash64(*objs)), keys, ["_h"], most)
        vec = settle(_block_fronts(laid.df, [*keys, BLOCK], objs, total).drop(BLOCK))
        before = largest
        total, largest = group_sizes(vec, keys)
        if largest > before // 2:
            break
    if largest <= most:
        return _block_fronts(vec, keys, objs, total).select(*cols)
    vec = distinct_vectors(vec, keys, objs)
    hits = weak_hits(vec.withColumn("_w", F.lit(1.0)), keys, objs, count=False)
    alone = hits.where("_hits <= 1").select("_rid")
    return vec.join(alone, "_rid", "left_semi").select(*cols)


def front_rows(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Rows on the front of their group, all copies kept; rows with a NULL objective are not."""
    keys, objs = list(keys), list(objs)
    df = df.where(known(*objs))
    if len(objs) == 2:
        _, largest = group_sizes(df, keys)
        if largest <= limit(df.sparkSession, "window.rows"):
            # One sort: a row is on the front if, in order of (a, b), no row up
            # to it has a lower b, nor the same b at a lower a.
            a, b = objs
            laid = Laid(df.withColumn(BLOCK, F.lit(0)), False)
            me = F.struct(F.col(b), F.col(a))
            got = running(laid, keys, [a, b], {"_low": ("min", me)})
            return got.where(F.col("_low") == me).drop("_low", BLOCK)
    return join_on(df, front_vectors(df, keys, objs), [*keys, *objs], "left_semi")
