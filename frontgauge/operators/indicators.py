"""Quality of a front: volume, distance to a reference, spread, preference."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrNumber, as_col, every, largest, ratio, total
from ..plans.dominance import fields, front_vectors, weak_hits
from ..plans.nearest import CELLS, nearest, pair_costs
from ..plans.ordered import (
    BLOCK,
    fits_broadcast,
    in_blocks,
    join_blocks,
    join_on,
    match,
    neighbours,
    running,
)
from ..plans.segments import by_size, per_group, split_groups
from ..session import limit, settle

# -- hypervolume --------------------------------------------------------------


def _area_step(f1: str, f2: str, r1: str, r2: str, low: str):
    """Area a point adds left of r1, given the least f2 before it in order of f1."""
    adds = F.col(low).isNull() | (F.col(f2) < F.col(low))
    return F.when(
        adds, (F.col(r1) - F.col(f1)) * (F.coalesce(F.col(low), F.col(r2)) - F.col(f2))
    )


def hv2(
    df: DataFrame,
    keys: Sequence[str],
    objs: Sequence[str],
    ref: Sequence[ColumnOrNumber],
    name: str = "hv",
) -> DataFrame:
    """Area dominated by each group's rows up to `ref` (numbers, or columns constant per group).

    Rows need not be a front. Rows not below the reference add nothing; a group
    without any other has 0.
    """
    keys, (a, b) = list(keys), objs
    df = df.select(*keys, a, b, as_col(ref[0]).alias("_r1"), as_col(ref[1]).alias("_r2"))
    whole = [*keys, "_r1", "_r2"]
    inside = (F.col(a) < F.col("_r1")) & (F.col(b) < F.col("_r2"))
    thin = df.groupBy(*whole, a).agg(F.min(F.when(inside, F.col(b))).alias(b))
    laid = in_blocks(thin, whole, [a])
    got = running(laid, whole, [a], {"_low": ("min", F.col(b))}, inclusive=False)
    area = F.sum(_area_step(a, b, "_r1", "_r2", "_low"))
    return got.groupBy(*keys).agg(F.coalesce(area, F.lit(0.0)).alias(name))


def _swept_volume(v: np.ndarray, ref: np.ndarray) -> float:
    """Volume of one group: add points by third objective, each with the area it is first to cover."""
    xs: list[float] = []
    ys: list[float] = []
    volume = 0.0
    for x, y, z in v[np.lexsort((v[:, 1], v[:, 0], v[:, 2]))]:
        i = bisect_right(xs, x)
        height = ys[i - 1] if i else ref[1]
        if height <= y:
            continue
        start = i - 1 if i and xs[i - 1] == x else i
        left, area, j = x, 0.0, i
        while j < len(xs) and ys[j] >= y:
            area += (xs[j] - left) * (height - y)
            left, height = xs[j], ys[j]
            j += 1
        area += ((xs[j] if j < len(xs) else ref[0]) - left) * (height - y)
        xs[start:j], ys[start:j] = [x], [y]
        volume += area * (ref[2] - z)
    return volume


def hv3(
    df: DataFrame,
    keys: Sequence[str],
    objs: Sequence[str],
    ref: Sequence[ColumnOrNumber],
    name: str = "hv",
) -> DataFrame:
    """Volume dominated by each group's rows up to `ref`; as hv2 otherwise."""
    keys, objs = list(keys), list(objs)
    refs = ["_r1", "_r2", "_r3"]
    df = df.select(*keys, *objs, *[as_col(r).alias(n) for r, n in zip(ref, refs)])
    zero = df.select(*keys).distinct().withColumn(name, F.lit(0.0))
    inside = df.where(every([F.col(c) < F.col(r) for c, r in zip(objs, refs)]))
    whole = [*keys, *refs]
    points = settle(front_vectors(inside, whole, objs))
    volumes = _volumes(points, keys, objs, refs).select(*keys, F.col("_hv").alias(name))
    return zero.unionByName(volumes).groupBy(*keys).agg(F.sum(name).alias(name))


def _volumes(
    points: DataFrame, keys: list[str], objs: list[str], refs: list[str], axis: int = 0
) -> DataFrame:
    if not keys:
        points, keys = points.withColumn("_all", F.lit(0)), ["_all"]

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        v, r = pdf[objs].to_numpy(float), pdf[refs].to_numpy(float)
        groups = list(split_groups(pdf, keys))
        hv = [_swept_volume(v[at], r[at[0]]) for at in groups]
        return pdf.iloc[[at[0] for at in groups]][keys].assign(_hv=hv)

    schema = fields(points, keys) + ", _hv double"
    return by_size(
        points,
        keys,
        lambda rows, n: per_group(rows, keys, sweep, schema, n),
        lambda rows: _slab_volumes(rows, keys, objs, refs, axis),
        limit(points.sparkSession, "sweep.rows"),
    )


def _slab_volumes(
    points: DataFrame, keys: list[str], objs: list[str], refs: list[str], axis: int
) -> DataFrame:
    """Cut space into slabs along one axis and add up their volumes.

    A slab holds its own points and what earlier points cover of it, which depends on their
    other two objectives only: the front of those, settled per slab by `_earlier_fronts`.

    A slab has a quarter of the points that a sweep takes. Of the points carried into it, a
    second cut, along another axis, carries one on (they share the slab's lower face); so a
    piece then has at most two quarters and that point, and needs no third cut.
    """
    f, r, others = objs[axis], refs[axis], [o for i, o in enumerate(objs) if i != axis]
    most = limit(points.sparkSession, "sweep.rows")
    laid = in_blocks(points, keys, [f, *others], max(1, most // 4))
    starts = laid.df.groupBy(*keys, BLOCK, r).agg(F.min(f).alias("_from"))
    group = Window.partitionBy(*keys)
    nxt = F.lead("_from").over(group.orderBy(BLOCK))
    first = F.min(BLOCK).over(group)
    slabs = settle(
        starts.select(
            *keys,
            BLOCK,
            "_from",
            F.coalesce(nxt, F.col(r)).alias("_to"),
            (F.col(BLOCK) - first).alias("_node"),
            (F.max(BLOCK).over(group) - first).alias("_last"),
        )
    )
    slab, thick = f"_slab{axis}", F.col("_from") < F.col("_to")
    upto = [F.col("_to").alias(o) if o == r else o for o in refs]
    own = settle(join_blocks(laid.df, slabs, keys))
    earlier = _earlier_fronts(own, [*keys, *refs], others)
    carried = join_on(earlier.drop("_last"), slabs, [*keys, "_node"]).where(thick).select(
        *keys, F.col(BLOCK).alias(slab), *[F.col("_from").alias(o) if o == f else o for o in objs], *upto
    )
    own = own.where(thick).select(*keys, F.col(BLOCK).alias(slab), *objs, *upto)
    pieces = settle(own.unionByName(carried))
    parts = _volumes(pieces, [*keys, slab], objs, refs, (axis + 1) % 3)
    return parts.groupBy(*keys).agg(F.sum("_hv").alias("_hv"))


def _earlier_fronts(rows: DataFrame, keys: list[str], pair: list[str]) -> DataFrame:
    """(keys, _node, _last, pair): for each block `_node`, the front of all blocks before it.

    `_node` runs from 0 to `_last` in each group. The blocks are the leaves of a binary tree.
    Going up, the front of a node is thinned out of the fronts of its halves. Going down, a
    node hands what comes before it to both halves, and the right one also gets the front of
    the left; that is thinned again before it is handed on. So no point goes to more nodes
    than hold it in the front of what comes before them.
    """
    whole = [*keys, "_last", "_node"]
    levels = (rows.agg(F.max("_last")).first()[0] or 0).bit_length()
    fronts = []
    for level in range(levels):
        # groups that are one node on this level have nothing to hand on
        spread = rows.where(F.col("_last") >= (1 << level))
        fronts.append(settle(front_vectors(spread, whole, pair)))
        rows = fronts[-1].withColumn("_node", F.shiftright("_node", 1))
    before = rows.limit(0).select(*whole, *pair)
    for level in reversed(range(levels)):
        left = fronts[level].where("_node % 2 = 0").withColumn("_node", F.col("_node") + 1)
        halves = F.array(2 * F.col("_node"), 2 * F.col("_node") + 1)
        handed = left.unionByName(before.withColumn("_node", F.explode(halves)))
        there = handed.where(F.shiftleft("_node", level) <= F.col("_last"))
        before = settle(front_vectors(there, whole, pair))
    return before


def hv2_contrib(
    df: DataFrame,
    keys: Sequence[str],
    objs: Sequence[str],
    ref: Sequence[ColumnOrNumber],
    name: str = "contribution",
) -> DataFrame:
    """Area only this point covers, for each distinct front point below the reference."""
    keys, (a, b) = list(keys), objs
    df = df.select(*keys, a, b, as_col(ref[0]).alias("_r1"), as_col(ref[1]).alias("_r2"))
    whole = [*keys, "_r1", "_r2"]
    inside = df.where((F.col(a) < F.col("_r1")) & (F.col(b) < F.col("_r2")))
    points = front_vectors(inside, whole, [a, b])
    got = neighbours(points, whole, [a], {"_b": b}, {"_a": a})
    width = F.coalesce(F.col("_a"), F.col("_r1")) - F.col(a)
    height = F.coalesce(F.col("_b"), F.col("_r2")) - F.col(b)
    return got.select(*keys, a, b, (width * height).alias(name))


# -- distance to a reference front --------------------------------------------


def _spread_reference(front: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """A reference without some group columns serves every group.

    Each group asks for every reference point, so that many rows are the task
    itself; they are made in as many parts as there are pieces of the reference.
    """
    shared = [k for k in keys if k in reference.columns]
    if shared == keys:
        return reference
    spark = front.sparkSession
    groups = front.select(*keys).distinct()
    reference = settle(reference.distinct())
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(shuffles, ceil(reference.count() / limit(spark, "compare.rows")))
    piece = F.pmod(F.xxhash64(*reference.columns), F.lit(pieces)).cast("int")
    groups = groups.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return match(reference.withColumn("_piece", piece), groups, [*shared, "_piece"]).drop("_piece")


def _over_reference(
    front: DataFrame,
    reference: DataFrame,
    keys: list[str],
    objs: list[str],
    kinds: Sequence[str],
    whole: str,
) -> DataFrame:
    """Per group, the `whole` (avg or max) over the reference of its cost to the nearest point.

    A reference that all groups share, small enough for every task, is held there: groups
    that one call can hold then give one row each. Only the others, or groups with a
    reference of their own, look for the nearest point of each reference point.
    """
    def looked_up(rows: DataFrame) -> DataFrame:
        asked = _spread_reference(rows, reference, keys)
        got = nearest(asked, rows, keys, objs, kinds)
        return got.groupBy(*keys).agg(*[getattr(F, whole)(k).alias(k) for k in kinds])

    if any(k in reference.columns for k in keys):
        return looked_up(front)
    reference = settle(reference.select(*objs).distinct())
    if not fits_broadcast(reference):
        return looked_up(front)
    points = reference.toPandas().to_numpy(float)
    front = settle(front.select(*keys, *objs).distinct())

    def costs(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[objs].to_numpy(float)
        groups = list(split_groups(pdf, keys)) if keys else [np.arange(len(pdf))]
        out = {k: [] for k in kinds}
        for at in groups:
            step = max(1, CELLS // len(at))
            for k in kinds:
                low = [
                    pair_costs(k, points[i : i + step], v[at]).min(axis=1)
                    for i in range(0, len(points), step)
                ]
                held = np.concatenate(low) if low else np.zeros(0)
                out[k].append((held.mean() if whole == "avg" else held.max()) if len(held) else None)
        return pdf.iloc[[at[0] for at in groups]][keys].assign(**out)

    schema = ", ".join([fields(front, keys)] * bool(keys) + [f"{k} double" for k in kinds])
    return by_size(front, keys, lambda rows, n: per_group(rows, keys, costs, schema, n), looked_up)


def gd(
    front: DataFrame, reference: DataFrame, keys: Sequence[str], objs: Sequence[str]
) -> DataFrame:
    """GD and GD+: mean distance from distinct front points to the reference."""
    keys, objs = list(keys), list(objs)
    # Points alike in what the reference knows of them have the same distance.
    shared = [k for k in keys if k in reference.columns]
    got = nearest(front, reference, shared, objs, ["l2", "above"])
    if shared != keys:
        got = match(front.select(*keys, *objs).distinct(), got, [*shared, *objs])
    return got.groupBy(*keys).agg(F.avg("l2").alias("gd"), F.avg("above").alias("gd_plus"))


def igd(
    front: DataFrame, reference: DataFrame, keys: Sequence[str], objs: Sequence[str]
) -> DataFrame:
    """IGD and IGD+: mean distance from distinct reference points to the front."""
    got = _over_reference(front, reference, list(keys), list(objs), ["l2", "below"], "avg")
    return got.withColumnsRenamed({"l2": "igd", "below": "igd_plus"})


def eps_ind(
    front: DataFrame, reference: DataFrame, keys: Sequence[str], objs: Sequence[str]
) -> DataFrame:
    """Additive epsilon: the least shift by which the front covers the whole reference."""
    got = _over_reference(front, reference, list(keys), list(objs), ["lift"], "max")
    return got.withColumnRenamed("lift", "eps")


def spacing(front: DataFrame, keys: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Sample deviation of the L1 distance to the nearest other point.

    A copy of a point is another point at distance 0. NULL below two points.
    """
    keys, objs = list(keys), list(objs)
    copies = front.groupBy(*keys, *objs).agg(F.count(F.lit(1)).alias("_c"))
    gaps = nearest(front, front, keys, objs, ["l1"], others=True)
    rows = match(gaps, copies, [*keys, *objs])
    gap = F.when(F.col("_c") > 1, 0.0).otherwise(F.col("l1"))
    # Weighted moments: each distinct vector stands for its copies.
    n, s = F.sum("_c"), F.sum(F.col("_c") * gap)
    mean = rows.groupBy(*keys).agg(n.alias("_n"), (s / n).alias("_mean"))
    rows = join_on(rows, mean, keys)
    dev = gap - F.col("_mean")
    return rows.groupBy(*keys).agg(
        F.when(
            F.max("_n") > 1, F.sqrt(ratio(F.sum(F.col("_c") * dev * dev), F.max("_n") - 1))
        ).alias("spacing")
    )


def coverage(
    fronts: DataFrame, keys: Sequence[str], label: str, objs: Sequence[str]
) -> DataFrame:
    """C(A, B): share of B's distinct points some point of A is no worse than, for all A <> B.

    A and B are all labels that the data hold within the keys.
    """
    keys, objs = list(keys), list(objs)
    vec = settle(fronts.select(*keys, label, *objs).distinct())
    sets = vec.groupBy(*keys).agg(F.collect_set(label).alias("_labels"))
    other = F.explode(F.filter("_labels", lambda x: x != F.col(label)))
    rows = join_on(vec, sets, keys).withColumn("_other", other).drop("_labels")
    as_source = rows.select(
        *keys, F.col(label).alias("a"), F.col("_other").alias("b"), *objs, F.lit(True).alias("_src")
    )
    as_query = rows.select(
        *keys, F.col("_other").alias("a"), F.col(label).alias("b"), *objs, F.lit(False).alias("_src")
    )
    both = as_source.unionByName(as_query).withColumns(
        {"_qry": ~F.col("_src"), "_w": F.lit(1.0), "_rid": F.monotonically_increasing_id()}
    )
    both = settle(both)
    hits = weak_hits(both, [*keys, "a", "b"], objs, count=False)
    return (
        both.where("_qry")
        .join(hits, "_rid")
        .groupBy(*keys, "a", "b")
        .agg(F.avg((F.col("_hits") > 0).cast("double")).alias("coverage"))
    )


# -- preference ---------------------------------------------------------------


def scalarise(
    df: DataFrame,
    keys: Sequence[str],
    objs: Sequence[str],
    id: str,
    weights: Sequence[Sequence[float]],
    kind: str = "sum",
) -> DataFrame:
    """Per group and weight vector (numbered from 1) the row of least weighted value, ties by id.

    'sum' is the weighted sum, 'tcheby' the largest weighted distance from the
    group's ideal point. Each task reduces to one row per group and weight
    before anything is shuffled.
    """
    keys = list(keys)
    if kind == "tcheby":
        ideal = df.groupBy(*keys).agg(*[F.min(c).alias(f"_i_{c}") for c in objs])
        df = join_on(df, ideal, keys)

        def value(w):
            return largest([F.lit(float(x)) * (F.col(c) - F.col(f"_i_{c}")) for x, c in zip(w, objs)])

    elif kind == "sum":

        def value(w):
            return total([F.lit(float(x)) * F.col(c) for x, c in zip(w, objs)])

    else:
        raise ValueError("kind must be 'sum' or 'tcheby'")
    best = [F.min(F.struct(value(w).alias("value"), F.col(id).alias("id"))) for w in weights]
    rows = df.groupBy(*keys).agg(F.array(*best).alias("_best"))
    return rows.select(*keys, F.posexplode("_best").alias("_at", "_row")).select(
        *keys,
        (F.col("_at") + 1).alias("weight"),
        F.col("_row.id").alias(id),
        F.col("_row.value").alias("value"),
    )


def knee(front: DataFrame, keys: Sequence[str], f1: str, f2: str, id: str) -> DataFrame:
    """The front point farthest from the line through the two ends, ties by id.

    With fewer than two distinct points the distance is 0.
    """
    keys = list(keys)
    point = F.struct(F.col(f1).alias("x"), F.col(f2).alias("y"))
    ends = front.groupBy(*keys).agg(F.min(point).alias("_p"), F.max(point).alias("_q"))
    rows = join_on(front.select(*keys, f1, f2, id), ends, keys)
    dx, dy = F.col("_q.x") - F.col("_p.x"), F.col("_q.y") - F.col("_p.y")
    cross = F.abs(dx * (F.col(f2) - F.col("_p.y")) - dy * (F.col(f1) - F.col("_p.x")))
    far = F.coalesce(ratio(cross, F.sqrt(dx * dx + dy * dy)), F.lit(0.0))
    row = F.struct((-far).alias("d"), F.col(id).alias("id"), F.col(f1).alias("x"), F.col(f2).alias("y"))
    best = rows.groupBy(*keys).agg(F.min(row).alias("_b"))
    return best.select(
        *keys,
        F.col("_b.id").alias(id),
        F.col("_b.x").alias(f1),
        F.col("_b.y").alias(f2),
        (-F.col("_b.d")).alias("distance"),
    )


def attainment(
    df: DataFrame,
    keys: Sequence[str],
    run: str,
    f1: str,
    f2: str,
    xs: Sequence[float],
    ys: Sequence[float],
) -> DataFrame:
    """For each point of the grid xs x ys: the share of runs with a row no worse than it.

    Per run only the least f2 up to each x is needed, one aggregate per x.
    """
    keys = list(keys)
    lows = [F.min(F.when(F.col(f1) <= F.lit(float(x)), F.col(f2))) for x in xs]
    grid = F.array(*[F.struct(F.lit(float(x)).alias("x"), v.alias("low")) for x, v in zip(xs, lows)])
    runs = df.groupBy(*keys, run).agg(grid.alias("_g"))
    cells = runs.select(*keys, F.inline("_g")).withColumn(
        "y", F.explode(F.array(*[F.lit(float(y)) for y in ys]))
    )
    hit = F.coalesce(F.col("low") <= F.col("y"), F.lit(False))
    return cells.groupBy(*keys, "x", "y").agg(
        F.sum(hit.cast("long")).alias("attained"), F.avg(hit.cast("double")).alias("share")
    )
