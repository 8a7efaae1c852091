"""Cost of the best partner for each query point, without pairing them all.

Partners ("sites") of a group are cut into small blocks of neighbouring points.
Where a group has several, a query visits only the blocks whose bounding box
could hold a better partner than one already known. Boxes form a tree, each with at most
_FAN below it, and a query goes down it level by level, to the boxes that are left: its row
never holds more than _FAN boxes, however many the group has. Inside a block the costs are
computed as one array operation; only the least leaves the task. Crowds of
queries at one block are split over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, every, largest, total
from ..session import limit, settle
from .ordered import BLOCK, group_sizes, in_blocks, join_on
from .segments import per_group, split_groups

# cost of a query q and a site s, built from one gap per coordinate
#   l2, l1  distance
#   above   distance counting only coordinates where q is worse than s
#   below   distance counting only coordinates where s is worse than q
#   lift    how much worse s is than q in its worst coordinate
COSTS = ("l2", "l1", "above", "below", "lift")

# boxes below a box (a power of two, 4 or more), and cells of one array of costs
_FAN = 64
CELLS = 2_000_000


def pair_costs(kind: str, q: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.full((len(q), len(s)), -np.inf if kind == "lift" else 0.0)
    for a, b in zip(q.T, np.ascontiguousarray(s.T)):
        gap = b[None, :] - a[:, None]
        if kind == "lift":
            np.maximum(out, gap, out=out)
        elif kind == "l1":
            out += np.abs(gap)
        else:
            if kind == "above":
                np.minimum(gap, 0.0, out=gap)
            elif kind == "below":
                np.maximum(gap, 0.0, out=gap)
            out += gap * gap
    return out if kind in ("lift", "l1") else np.sqrt(out, out=out)


def _bound(kind: str, q: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    """Least cost any site in the box lo..hi could have; exact for a single point."""
    zero = F.lit(0.0)
    if kind == "lift":
        return largest([a - x for x, a in zip(q, lo)])
    if kind == "above":
        gap = [F.greatest(x - b, zero) for x, b in zip(q, hi)]
    elif kind == "below":
        gap = [F.greatest(a - x, zero) for x, a in zip(q, lo)]
    else:
        gap = [F.greatest(a - x, x - b, zero) for x, a, b in zip(q, lo, hi)]
    return total(gap) if kind == "l1" else F.sqrt(total([g * g for g in gap]))


def _box_levels(laid: DataFrame, keys: list[str], coords: list[str]) -> list[DataFrame]:
    """Settled tables (keys, _node, _boxes), the top first: the boxes below each node.

    A box at level k covers the blocks with the same number above the lowest k digits, to
    the base _FAN. The top has one row a group, and no node.
    """
    step = _FAN.bit_length() - 1
    one = F.min(F.struct(*coords)).alias("one")
    first = [F.min(c).alias(f"lo_{c}") for c in coords] + [F.max(c).alias(f"hi_{c}") for c in coords]
    boxes = settle(laid.groupBy(*keys, F.col(BLOCK).cast("long").alias("_box")).agg(*first, one))
    ends = boxes.groupBy(*keys).agg(F.min("_box").alias("_lo"), F.max("_box").alias("_hi"))
    most = ends.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 0
    rest = [F.min(f"lo_{c}").alias(f"lo_{c}") for c in coords] + [F.max(f"hi_{c}").alias(f"hi_{c}") for c in coords]
    cell = F.struct("_box", *[f"{e}_{c}" for c in coords for e in ("lo", "hi")], "one")
    levels = []
    while True:
        # a group of this many boxes has one more of them at most, for where it starts
        top = most < _FAN
        node = [] if top else [F.shiftright("_box", step).alias("_node")]
        levels.append(settle(boxes.groupBy(*keys, *node).agg(F.collect_list(cell).alias("_boxes"))))
        if top:
            return levels[::-1]
        up = F.shiftright("_box", step).alias("_box")
        boxes = boxes.groupBy(*keys, up).agg(*rest, F.min("one").alias("one"))
        most = (most >> step) + 1


def _worth_visiting(
    queries: DataFrame,
    laid: DataFrame,
    keys: list[str],
    coords: list[str],
    kinds: Sequence[str],
    others: bool,
) -> DataFrame:
    """Queries with each block that may hold a best partner for one of the costs."""
    q = [F.col(c) for c in coords]
    bests = [f"_best_{kind}" for kind in kinds]
    rows = queries.withColumns({b: F.lit(None).cast("double") for b in bests})
    place = keys
    for depth, table in enumerate(_box_levels(laid, keys, coords)):
        rows = join_on(settle(rows) if depth else rows, table, place)
        for kind, best in zip(kinds, bests):

            def known(b: Column) -> Column:
                p = [b["one"][c] for c in coords]
                cost = _bound(kind, q, p, p)
                return F.when(~every([x == y for x, y in zip(q, p)]), cost) if others else cost

            # one known partner per box, and a little room for rounding
            here = F.array_min(F.transform("_boxes", known))
            rows = rows.withColumn(best, F.least(best, here + F.abs(here) * 1e-12))

        def visit(b: Column) -> Column:
            lo, hi = ([b[f"{e}_{c}"] for c in coords] for e in ("lo", "hi"))
            conds = [
                F.col(best).isNull() | (_bound(kind, q, lo, hi) <= F.col(best))
                for kind, best in zip(kinds, bests)
            ]
            return any_of(conds)

        found = F.transform(F.filter("_boxes", visit), lambda b: b["_box"])
        rows = rows.withColumn("_node", F.explode(found)).drop("_boxes")
        place = [*keys, "_node"]
    return rows.select(*keys, *coords, F.col("_node").cast("int").alias(BLOCK))


def nearest(
    queries: DataFrame,
    sites: DataFrame,
    keys: Sequence[str],
    coords: Sequence[str],
    kinds: Sequence[str],
    others: bool = False,
) -> DataFrame:
    """Distinct query points with one column per kind of cost: the least over their group's sites.

    others=True leaves out sites equal to the query. A query without any site
    gets NULL.
    """
    unknown = set(kinds) - set(COSTS)
    if unknown:
        raise ValueError(f"unknown costs {sorted(unknown)}")
    spark = queries.sparkSession
    keys, coords, kinds = list(keys), list(coords), list(kinds)
    if not keys:
        one = {"_all": F.lit(0)}
        out = nearest(queries.withColumns(one), sites.withColumns(one), ["_all"], coords, kinds, others)
        return out.drop("_all")
    cols = [*keys, *coords]
    queries = settle(queries.select(*cols).distinct())
    sites = settle(sites.select(*cols).distinct())
    laid = in_blocks(sites, keys, coords, limit(spark, "site.rows"))
    if laid.split:
        visits = settle(_worth_visiting(queries, laid.df, keys, coords, kinds, others))
    else:
        visits = queries.withColumn(BLOCK, F.lit(0))

    # Split crowds: a block's sites are copied to each share of its queries.
    place = [*keys, BLOCK]
    most = limit(spark, "compare.rows")
    visit_rows, crowd = group_sizes(visits, place)
    here = laid.df
    if crowd > most:
        shares = visits.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).alias("_shares"))
        shares = settle(shares.where("_shares > 1"))  # at most visits / most rows
        share = F.coalesce(F.col("_shares"), F.lit(1))
        visits = join_on(visits, shares, place, "left")
        visits = visits.withColumn("_share", F.pmod(F.xxhash64(*coords), share)).drop("_shares")
        here = join_on(here, shares, place, "left").withColumn(
            "_share", F.explode(F.sequence(F.lit(0).cast("long"), share.cast("long") - 1))
        ).drop("_shares")
    else:
        visits, here = (d.withColumn("_share", F.lit(0).cast("long")) for d in (visits, here))

    # Both sides go through one table, told apart by a flag.
    place = [*place, "_share"]
    both = [*cols, *[c for c in place if c not in keys]]
    rows = visits.select(*both, F.lit(False).alias("_site")).unionByName(
        here.select(*both, F.lit(True).alias("_site"))
    )

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        v, site = pdf[coords].to_numpy(float), pdf["_site"].to_numpy(bool)
        cost = np.full((len(pdf), len(kinds)), np.nan)
        for at in split_groups(pdf, place):
            mine, theirs = at[~site[at]], at[site[at]]
            if not len(theirs):
                continue
            step = max(1, CELLS // len(theirs))
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                for n, kind in enumerate(kinds):
                    c = pair_costs(kind, v[part], v[theirs])
                    if others:
                        c[(v[part][:, None, :] == v[theirs][None, :, :]).all(axis=2)] = np.inf
                    low = c.min(axis=1)
                    cost[part, n] = np.where(np.isinf(low), np.nan, low)
        found = {kind: cost[~site, n] for n, kind in enumerate(kinds)}
        return pdf.loc[~site, cols].assign(**found)

    schema = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in cols)
    got = per_group(rows, place, best, schema + "".join(f", {k} double" for k in kinds), visit_rows)
    got = got.select(*cols, *[F.when(~F.isnan(k), F.col(k)).alias(k) for k in kinds])
    if laid.split:
        got = got.groupBy(*cols).agg(*[F.min(k).alias(k) for k in kinds])
    return got
