"""Ordered work per group that survives one group holding much of the data.

A plain window sorts a whole group in one task. Where the largest group is too
big for that, rows are range-partitioned on (group, order) so that a big group
spreads over many blocks; each block is scanned on its own, and what precedes it
comes from a table with one row per block of a spread group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import limit, settle

BLOCK = "_blk"

# More partitions than this burden the driver; each may hold many blocks.
_MAX_PARTS = 20_000

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


# How two partial results of one aggregate combine; absent parts are null.
_JOIN = {"sum": _plus, "min": F.least, "max": F.greatest}


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in all and rows of the largest group; one map-side-combined pass."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    return row["rows"] or 0, row["largest"] or 0


def match(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal keys, NULL matching NULL, so that a group without a name is kept too."""
    # Own names for the right's keys: both sides may come from the same table,
    # and a column reference could then mean either.
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, r in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def join_blocks(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join a table with one row per (group, block).

    Broadcast if small; otherwise shuffled by group and block, which no block
    can clog as its size is bounded.
    """
    right = settle(right)
    small = fits_broadcast(right)
    return match(left, F.broadcast(right) if small else right, [*keys, BLOCK], how)


def fits_broadcast(settled: DataFrame) -> bool:
    """Whether a settled table is within the broadcast limits, by rows and by bytes.

    Numbers take 8 bytes. Where a column's width varies, bytes are those of the rows
    written out as text: arrays count with their length.
    """
    spark = settled.sparkSession
    rows, most = settled.count(), limit(spark, "broadcast.bytes")
    if rows > limit(spark, "broadcast.rows"):
        return False
    if all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for f in settled.schema):
        return 8 * rows * len(settled.columns) <= most
    written = F.sum(F.length(F.to_json(F.struct("*"))))
    return (settled.agg(written).first()[0] or 0) <= most


@dataclass
class Laid:
    df: DataFrame
    split: bool


def in_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int | None = None
) -> Laid:
    """Add a block number such that no (group, block) is too big for one task.

    Blocks of a group follow its ascending order. `order` must be unique within
    a group where a single value may repeat without bound.
    """
    spark = df.sparkSession
    in_window = limit(spark, "window.rows")
    max_rows = max_rows or in_window
    rows, largest = group_sizes(df, keys)
    if largest <= max_rows:
        return Laid(df.withColumn(BLOCK, F.lit(0)), False)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(shuffles, ceil(2 * rows / in_window)), _MAX_PARTS)
    # Range bounds come from a sample, so a second run could place rows
    # differently: fix the placement before it is used twice.
    placed = settle(
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_at": F.monotonically_increasing_id().bitwiseAND(2**33 - 1),
            }
        )
    )
    return Laid(number_blocks(placed, max_rows), True)


def number_blocks(placed: DataFrame, max_rows: int) -> DataFrame:
    """Number blocks of max_rows at most along `_part` and `_at`, a row's place in its part.

    Parts may hold any number of rows: each starts its blocks where the counted rows of
    the parts before it end.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / max_rows).alias("_n"))
    # one row per part, _MAX_PARTS at most
    first = blocks.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    number = (F.col("_first") + F.floor(F.col("_at") / max_rows)).cast("int")
    return (
        placed.join(F.broadcast(settle(first)), "_part")
        .withColumn(BLOCK, number)
        .drop("_part", "_at", "_first")
    )


def spread_groups(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a per-(group, block) table whose group spans several blocks.

    Blocks are contiguous, so at most two rows per block remain, whatever the
    number of groups.
    """
    w = Window.partitionBy(*keys)
    return totals.withColumn("_nb", F.count(F.lit(1)).over(w)).where("_nb > 1").drop("_nb")


def running(
    laid: Laid,
    keys: Sequence[str],
    order: Sequence[str],
    outs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    backwards: bool = False,
) -> DataFrame:
    """Running sum, min or max of each value in `order`, over the whole group."""
    end = 0 if inclusive else -1
    sort = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    w = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*sort)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    out = laid.df.withColumns({n: _AGG[a](v).over(w) for n, (a, v) in outs.items()})
    if not laid.split:
        return out
    marks = {f"_c{n}": n for n in outs}
    carried = block_carry(laid, keys, outs, backwards).withColumnsRenamed(
        {n: c for c, n in marks.items()}
    )
    joined = join_blocks(out, carried, keys, "left")
    return joined.withColumns(
        {n: _JOIN[outs[n][0]](F.col(n), F.col(c)) for c, n in marks.items()}
    ).drop(*marks)


def block_carry(
    laid: Laid,
    keys: Sequence[str],
    outs: dict[str, tuple[str, Column]],
    backwards: bool = False,
) -> DataFrame:
    """Per block of a spread group: each aggregate over the group's earlier blocks."""
    totals = laid.df.groupBy(*keys, BLOCK).agg(*[_AGG[a](v).alias(n) for n, (a, v) in outs.items()])
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col(BLOCK).desc() if backwards else F.col(BLOCK).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return spread_groups(totals, keys).select(
        *keys, BLOCK, *[_AGG[a](F.col(n)).over(before).alias(n) for n, (a, _) in outs.items()]
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    prev: dict[str, str] | None = None,
    nxt: dict[str, str] | None = None,
    laid: Laid | None = None,
) -> DataFrame:
    """Values of the row before and after in `order` (unique within a group).

    `prev` and `nxt` map an output name to the column it is taken from.
    """
    prev, nxt = prev or {}, nxt or {}
    laid = laid or in_blocks(df, keys, order)
    if not laid.split:
        w = Window.partitionBy(*keys).orderBy(*order)
        cols = {n: F.lag(c).over(w) for n, c in prev.items()}
        cols |= {n: F.lead(c).over(w) for n, c in nxt.items()}
        return laid.df.withColumns(cols).drop(BLOCK)
    # The row before is the greatest earlier row, the row after the least later one.
    out = laid
    for side, agg, back in ((prev, "max", False), (nxt, "min", True)):
        if side:
            whole = F.struct(*order, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(side.values())])
            got = running(out, keys, order, {"_row": (agg, whole)}, inclusive=False, backwards=back)
            got = got.withColumns({n: F.col(f"_row._v{i}") for i, n in enumerate(side)}).drop("_row")
            out = Laid(got, True)
    return out.df.drop(BLOCK)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1, 2, 3, ... within each group."""
    laid = in_blocks(df, keys, order)
    return running(laid, keys, order, {name: ("sum", F.lit(1).cast("long"))}).drop(BLOCK)


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, tie_break: Sequence[str], name: str
) -> DataFrame:
    """Rank of `value` within its group, ties sharing the mean of their places."""
    order = [value, *tie_break]
    laid = in_blocks(df, keys, order)
    if not laid.split:
        w = Window.partitionBy(*keys).orderBy(value)
        ties = Window.partitionBy(*keys, value)
        rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
        return laid.df.withColumn(name, rank).drop(BLOCK)
    # A run of ties may cross blocks: carry its first place forwards and its last back.
    def scan(df, outs, inclusive=True, backwards=False):
        return running(Laid(df, True), keys, order, outs, inclusive, backwards)

    v = F.col(value)
    got = scan(laid.df, {"_n": ("sum", F.lit(1).cast("long"))})
    got = scan(got, {"_p": ("max", v)}, inclusive=False)
    got = scan(got, {"_x": ("min", v)}, inclusive=False, backwards=True)
    first = F.when(F.col("_p").isNull() | (F.col("_p") < v), F.col("_n"))
    last = F.when(F.col("_x").isNull() | (F.col("_x") > v), F.col("_n"))
    got = scan(got, {"_first": ("max", first)})
    got = scan(got, {"_last": ("min", last)}, backwards=True)
    return got.withColumn(name, (F.col("_first") + F.col("_last")) / F.lit(2.0)).drop(
        "_n", "_p", "_x", "_first", "_last", BLOCK
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Distinct values are counted; where a group has too many of them for one task, places
    are found by a running count instead. Rows are spread first, so that no task counts
    more values than a partition of a shuffle holds, however few tasks read the input; rows
    of a crowded value stay apart by the task they come from.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, F.spark_partition_id().alias("_from"))
    spread = rows.repartition(*keys, value, "_from")
    tally = settle(spread.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    return tally_quantiles(tally, keys, value, ps)


def tally_quantiles(
    tally: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float]
) -> DataFrame:
    """Quantiles of a table that holds each distinct value once, with its count `_c`."""
    # percentile holds a group's values as objects, once per quantile
    laid = in_blocks(tally, keys, [value], limit(tally.sparkSession, "sweep.rows"))
    if not laid.split:
        aggs = [F.percentile(value, F.lit(p), F.col("_c")).alias(n) for n, p in ps.items()]
        return laid.df.groupBy(*keys).agg(*aggs)
    cum = running(laid, keys, [value], {"_cum": ("sum", F.col("_c"))})
    total = tally.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    cum = join_on(cum, total, keys)
    aggs = []
    for n, p in ps.items():
        place = (F.col("_total") - 1) * F.lit(float(p))

        def at(which, place=place):
            i = which(place)
            hit = (F.col("_cum") - F.col("_c") <= i) & (i < F.col("_cum"))
            return F.max(F.when(hit, F.col(value)))

        lo, hi, frac = at(F.floor), at(F.ceil), F.max(place - F.floor(place))
        aggs.append((lo + (hi - lo) * frac).alias(n))
    return cum.groupBy(*keys).agg(*aggs)


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join a table with one row per key, however the keys spread in `left`.

    A right side within the broadcast limit is broadcast. Beyond it, the few
    keys that fill more than a task in `left` still are (there are at most
    rows / limit of them) and only the others are shuffled.
    """
    keys = list(keys)
    if not keys:  # one row for the whole table
        return left if how == "left_semi" else left.join(F.broadcast(right), how=how)
    spark = left.sparkSession
    right = settle(right)
    if fits_broadcast(right):
        return match(left, F.broadcast(right), keys, how)
    crowded = F.col("count") > limit(spark, "window.rows")
    heavy = settle(left.groupBy(*keys).count().where(crowded).select(*keys))
    if heavy.isEmpty():
        return match(left, right, keys, how)
    heavy = F.broadcast(heavy)
    hot = match(
        match(left, heavy, keys, "left_semi"),
        F.broadcast(match(right, heavy, keys, "left_semi")),
        keys,
        how,
    )
    return hot.unionByName(match(match(left, heavy, keys, "left_anti"), right, keys, how))
