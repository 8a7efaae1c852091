"""Dominance, fronts, ranks and selection. Every objective is minimised."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import known, ratio
from ..plans.dominance import distinct_vectors, front_mask, front_rows, weak_hits, weak_tally
from ..plans.ordered import join_on, neighbours, numbered
from ..plans.ranking import ranked_vectors
from ..plans.segments import by_size, group_codes, per_group_whole
from ..session import settle

# Up to this size a task keeps only its own first rows before the shuffle.
_LIMITED_WINDOW = 100


def dominance(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Add `dominators` and `dominated`: by how many rows a row is beaten, how many it beats.

    Counted without listing pairs. A row with a NULL objective beats none and has NULL counts.
    """
    keys, objs = list(keys), list(objs)
    vec = distinct_vectors(df.where(known(*objs)), keys, objs)
    up = weak_hits(vec, keys, objs).withColumnRenamed("_hits", "_up")
    flipped = vec.withColumns({c: -F.col(c) for c in objs})
    down = weak_hits(flipped, keys, objs).withColumnRenamed("_hits", "_down")
    counts = vec.join(up, "_rid").join(down, "_rid").select(
        *keys,
        *objs,
        (F.col("_up") - F.col("_w")).cast("long").alias("dominators"),
        (F.col("_down") - F.col("_w")).cast("long").alias("dominated"),
    )
    return join_on(df, counts, [*keys, *objs], "left")


# Places are turned round by this, so that the first has the largest weight; doubles are
# exact up to here.
_TURN = 1 << 52


def witness(df: DataFrame, keys: Sequence[str], objs: Sequence[str], id: str) -> DataFrame:
    """Add `dominator`: for each dominated row, the id of one row that dominates it.

    That is the first of its dominators in order of the objectives (copies: the smallest
    id), which is on the front itself. NULL on the front and where an objective is NULL.
    Whole small groups are settled in one shuffle. For others one query carries the place
    of the first row that is no worse, which is the row's own place where nothing dominates
    it; no pair is listed.
    """
    keys, objs = list(keys), list(objs)
    schema = T.StructType([*df.schema.fields, T.StructField("dominator", df.schema[id].dataType)])

    def told(table: pa.Table) -> pa.Table:
        first = _first_dominators(group_codes(table, keys), _values(table, objs), table[id])
        beaten = pa.array(first, mask=first < 0)
        return table.append_column("dominator", table[id].take(beaten))

    def small(rows: DataFrame, size: int) -> DataFrame:
        return per_group_whole(rows, keys, told, schema, size)

    def big(rows: DataFrame) -> DataFrame:
        return _witness_of_big(rows, keys, objs, id)

    return by_size(df, keys, small, big)


def _values(table: pa.Table, objs: Sequence[str]) -> np.ndarray:
    """Columns as numbers, NULL as NaN."""
    return np.column_stack([table[c].cast(pa.float64()).to_numpy() for c in objs])


def _first_dominators(group: np.ndarray, v: np.ndarray, ids: pa.ChunkedArray) -> np.ndarray:
    """Per row the place of the first row that dominates it, -1 where none does."""
    found = np.full(len(v), -1, dtype=np.int64)
    told = np.flatnonzero(~np.isnan(v).any(axis=1))
    if not told.size:
        return found
    by_id = pc.rank(ids, null_placement="at_end", tiebreaker="dense").to_numpy()
    order = told[np.lexsort((by_id[told], *v[told].T[::-1], group[told]))]
    w, g = v[order], group[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_group | np.concatenate([[True], (w[1:] != w[:-1]).any(axis=1)])
    heads, vector = np.flatnonzero(new), np.cumsum(new) - 1  # copies share their head
    u, first = w[heads], np.arange(len(heads))
    starts = np.flatnonzero(new_group[heads])
    for a, b in zip(starts, [*starts[1:], len(heads)]):
        # vectors are in order, and the first dominator of one is on the front
        on = a + np.flatnonzero(front_mask(u[a:b]))
        for i in range(a, b, 256):
            some = u[i : min(i + 256, b)]
            ok = np.ones((len(some), len(on)), dtype=bool)
            for k in range(u.shape[1]):
                ok &= u[on, k][None, :] <= some[:, None, k]
            first[i : i + len(some)] = on[ok.argmax(axis=1)]
    beaten = first[vector] != vector
    found[order[beaten]] = order[heads[first[vector[beaten]]]]
    return found


def _witness_of_big(df: DataFrame, keys: list[str], objs: list[str], id: str) -> DataFrame:
    vec = df.where(known(*objs)).groupBy(*keys, *objs).agg(F.min(id).alias("_id"))
    placed = numbered(settle(vec), keys, objs, "_place").withColumns(
        {
            "_w": (F.lit(_TURN) - F.col("_place")).cast("double"),
            "_rid": F.monotonically_increasing_id(),
            "_src": F.lit(True),
            "_qry": F.lit(True),
        }
    )
    placed = settle(placed)
    first = weak_hits(placed, keys, objs, best=True).select(
        "_rid", (F.lit(_TURN) - F.col("_hits")).cast("long").alias("_first")
    )
    beaten = placed.join(first, "_rid").where("_first < _place").select(*keys, *objs, "_first")
    heads = placed.select(*keys, F.col("_place").cast("long").alias("_first"), F.col("_id").alias("dominator"))
    told = join_on(beaten, heads, [*keys, "_first"]).drop("_first")
    return join_on(df, told, [*keys, *objs], "left")


def front(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Rows no other row of their group dominates; all copies of a vector stay.

    With three objectives or more put the one with most distinct values first:
    rows that differ only in it are reduced to the least by an aggregate.
    """
    return front_rows(df, keys, objs)


def front2(df: DataFrame, keys: Sequence[str], f1: str, f2: str) -> DataFrame:
    """The two-objective front: one sort per group, no comparison of pairs."""
    return front_rows(df, keys, [f1, f2])


def front_eps(df: DataFrame, keys: Sequence[str], objs: Sequence[str], eps: float) -> DataFrame:
    """The front widened by eps: rows no row still dominates when made eps worse everywhere."""
    keys, objs = list(keys), list(objs)
    if eps < 0:
        raise ValueError("eps must not be negative")
    if eps == 0:
        return front_rows(df, keys, objs)
    vec = distinct_vectors(df, keys, objs)
    # What beats a row by a margin is itself beaten by no less by a row of the front.
    best = front_rows(vec, keys, objs).withColumns({c: F.col(c) + F.lit(float(eps)) for c in objs})
    return _without_hits(df, vec, best, vec, keys, objs)


def front_weak(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Rows no other row beats strictly in all objectives at once.

    Whole small groups are settled in one shuffle, others through places and a query.
    """
    keys, objs = list(keys), list(objs)

    def kept(table: pa.Table) -> pa.Table:
        return table.filter(pa.array(_not_beaten(group_codes(table, keys), _places(table, objs))))

    def small(rows: DataFrame, size: int) -> DataFrame:
        return per_group_whole(rows, keys, kept, df.schema, size)

    return by_size(df, keys, small, lambda rows: _weak_front_of_big(rows, keys, objs))


def _places(table: pa.Table, objs: Sequence[str]) -> np.ndarray:
    """Places of the values of each column, the same for equal ones, NULL first."""
    out = []
    for c in objs:
        _, place = np.unique(table[c].cast(pa.float64()).to_numpy(), return_inverse=True)
        out.append(np.where(table[c].is_null().to_numpy(), 0, place + 1))
    return np.column_stack(out).astype(float)


def _not_beaten(group: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows of whole numbers that no row of their group is below in every column."""
    keep = np.zeros(len(v), dtype=bool)
    order = np.argsort(group, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        front = v[at][front_mask(v[at])]
        keep[at] = weak_tally(front, np.ones(len(front)), v[at] - 1) == 0
    return keep


def _weak_front_of_big(df: DataFrame, keys: list[str], objs: list[str]) -> DataFrame:
    vec = distinct_vectors(df, keys, objs)
    # With places for values, "below" is "no more than the place before".
    placed = settle(_value_places(vec, keys, objs))
    asked = placed.withColumns({c: F.col(c) - 1 for c in objs})
    return _without_hits(df, vec, front_rows(placed, keys, objs), asked, keys, objs)


def _without_hits(
    df: DataFrame,
    vec: DataFrame,
    sources: DataFrame,
    asked: DataFrame,
    keys: list[str],
    objs: list[str],
) -> DataFrame:
    """Rows of df whose vector, as given in `asked`, no source is no worse than."""
    sources = sources.withColumns({"_qry": F.lit(False), "_rid": -F.col("_rid") - 1})
    asked = asked.withColumn("_src", F.lit(False))
    both = settle(sources.unionByName(asked).withColumn("_w", F.lit(1.0)))
    clear = weak_hits(both, keys, objs, count=False).where("_hits > 0").select("_rid")
    kept = vec.join(clear, "_rid", "left_anti")
    return join_on(df, kept.select(*keys, *objs), [*keys, *objs], "left_semi")


def _value_places(vec: DataFrame, keys: list[str], objs: list[str]) -> DataFrame:
    """Each objective replaced by the number of distinct lower values in its group."""
    out = vec
    for c in objs:
        values = vec.select(*keys, c).distinct()
        places = numbered(values, keys, [c], "_place")
        out = join_on(out, places, [*keys, c]).withColumn(c, F.col("_place").cast("double"))
        out = out.drop("_place")
    return out


def front_constrained(
    df: DataFrame, keys: Sequence[str], objs: Sequence[str], viol: str
) -> DataFrame:
    """Feasibility first: less violation wins, then dominance among equals."""
    least = df.groupBy(*keys).agg(F.min(viol).alias("_least"))
    best = join_on(df, least, keys).where(F.col(viol) == F.col("_least")).drop("_least")
    return front_rows(best.select(*df.columns), keys, objs)


def nd_rank(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Add `rank`: 1 for the front, 2 for the front of the rest, and so on.

    A row with a NULL objective has no rank.
    """
    return join_on(df, ranked_vectors(df, keys, objs), [*keys, *objs], "left")


def crowding(
    df: DataFrame, keys: Sequence[str], objs: Sequence[str], id: Sequence[str]
) -> DataFrame:
    """Add `crowding`: gaps between neighbours over the range, infinite at the ends."""
    keys, id = list(keys), list(id)
    ends = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in objs], *[F.max(c).alias(f"_hi_{c}") for c in objs]
    )
    out = join_on(df, ends, keys).withColumn("crowding", F.lit(0.0))
    for c in objs:
        out = neighbours(out, keys, [c, *id], {"_prev": c}, {"_next": c})
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        gap = F.coalesce(ratio(F.col("_next") - F.col("_prev"), width), F.lit(0.0))
        # Ends of an objective in which all rows agree mean nothing, save for a lone row.
        alone = F.col("_prev").isNull() & F.col("_next").isNull()
        edge = alone | ((width > 0) & (F.col("_prev").isNull() | F.col("_next").isNull()))
        out = out.withColumn(
            "crowding", F.col("crowding") + F.when(edge, float("inf")).otherwise(gap)
        ).drop("_prev", "_next")
    return out.select(*df.columns, "crowding")


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "place"
) -> DataFrame:
    """The first n rows of each group in `order` (unique), numbered from 1."""
    if n <= _LIMITED_WINDOW:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return numbered(df, keys, order, name).where(F.col(name) <= n)


def select_n(df: DataFrame, keys: Sequence[str], n: int, id: Sequence[str]) -> DataFrame:
    """Best n by rank, then most crowding distance, then id; adds `place`."""
    sparse = df.withColumn("_sparse", -F.col("crowding"))
    return top_n(sparse, keys, ["rank", "_sparse", *id], n).drop("_sparse")


def ideal_nadir(df: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Least value of each objective over all rows, greatest over the front."""
    # The least of an objective is always reached on the front too.
    return front_rows(df, keys, objs).groupBy(*keys).agg(
        *[F.min(c).alias(f"ideal_{c}") for c in objs],
        *[F.max(c).alias(f"nadir_{c}") for c in objs],
    )
