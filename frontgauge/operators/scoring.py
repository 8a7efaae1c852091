"""Score surrogate models in bulk, and the simple baselines they must beat."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_number
from ..plans.k_nearest import LAST, Near, means, no_partners, take_nearest
from ..plans.ordered import BLOCK, in_blocks, join_on, numbered
from ..session import discard, limit, settle

Layer = tuple[Sequence[Sequence[float]], Sequence[float]]

# Bytes that the features of the nearest-neighbour baseline's fitted rows may take in a task,
# twice: as they are sent and as numbers. More rows are taken portion by portion.
KNN_BYTES = 200_000_000
# Rows of a portion at least, and cells that rows are laid out by at most.
_KNN_LEAST = 64
_KNN_CELLS = 1_024
# Scored rows that a task starts with.
_KNN_TASK_ROWS = 16_384


def _numbers(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def score_mlp(df: DataFrame, x: str, layers: Sequence[Layer], name: str = "yhat") -> DataFrame:
    """Forward pass: dense layers with ReLU between, linear at the end; `name` is an array.

    Each layer is (weights by output unit, biases). All JVM-side; for networks
    too large to write as literals use score_with. An input that is NULL, holds a NULL
    or has not the first layer's width gives NULL.

    A layer reads the one before through a lambda variable, so each is computed once.
    """
    known = F.lit(True)
    if layers:
        width = len(layers[0][0][0])
        known = (F.size(x) == width) & F.forall(x, lambda v: v.isNotNull())
    h = F.col(x)
    for i, (weights, biases) in enumerate(layers):
        if len(weights) != len(biases):
            raise ValueError(f"layer {i}: {len(weights)} units but {len(biases)} biases")
        units = F.expr(
            "array("
            + ", ".join(
                f"named_struct('w', {_numbers(w)}, 'b', {float(b)!r}D)"
                for w, b in zip(weights, biases)
            )
            + ")"
        )
        h = _layer(h, units, i == len(layers) - 1)
    return df.withColumn(name, F.when(known, h))


def _layer(h: Column, units: Column, last: bool) -> Column:
    return F.transform(F.array(h), lambda bound: F.transform(units, _unit(bound, last)))[0]


def _unit(h: Column, linear: bool) -> Callable[[Column], Column]:
    def value(u: Column) -> Column:
        products = F.zip_with(u["w"], h, lambda a, b: a * b)
        z = F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + u["b"]
        return z if linear else F.greatest(z, F.lit(0.0))

    return value


def score_with(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str | T.StructType,
) -> DataFrame:
    """Apply any model per Arrow batch. `load` runs once per task and returns its predict function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema)


def fit_linear(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    x: str,
    train: Column | None = None,
    name: str = "yhat",
) -> DataFrame:
    """Least-squares line per group, fitted on `train` rows; NULL where x is constant."""
    a, b = (F.when(train, F.col(c)) if train is not None else F.col(c) for c in (y, x))
    both = a.isNotNull() & b.isNotNull()
    fit = df.groupBy(*keys).agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.min(F.when(both, b)).alias("_lo"),
        F.max(F.when(both, b)).alias("_hi"),
    )
    varies = F.col("_lo") < F.col("_hi")
    fit = fit.withColumns({c: F.when(varies, F.col(c)) for c in ("slope", "intercept")})
    rows = join_on(df, fit.drop("_lo", "_hi"), keys)
    return rows.withColumn(name, F.col("intercept") + F.col("slope") * F.col(x))


def fit_mean(
    df: DataFrame, keys: Sequence[str], fold: str, y: str, name: str = "yhat"
) -> DataFrame:
    """Mean of the group's other folds; NULL if there are none."""
    own = df.groupBy(*keys, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    # one row per group and fold from here
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n = F.sum("_n").over(whole) - F.col("_n")
    s = F.sum("_s").over(whole) - F.col("_s")
    means = own.select(*keys, fold, F.try_divide(s, n).alias(name))
    return join_on(df, means, [*keys, fold])


def _to_matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unknown numbers are NaN."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(col), width)


def _mean_of_nearest(
    x: np.ndarray,
    sites: np.ndarray,
    target: np.ndarray,
    k: int,
    place: np.ndarray | None = None,
    near: Near | None = None,
    apart: tuple[np.ndarray, np.ndarray] | None = None,
    block: int = 1_024,
) -> np.ndarray:
    """Mean target of the k nearest sites, ties by place; `near` has those of other sites."""
    near = no_partners(len(x), k) if near is None else near
    place = np.arange(len(sites)) if place is None else place
    take_nearest(x, sites, target, place, near, block, apart)
    return means(near)


def _fold_codes(mine: pa.Array, theirs: pa.Array) -> np.ndarray:
    """Places of folds among those of `theirs`; -1 for NULL, -2 for another fold."""
    found = pc.fill_null(pc.index_in(mine, value_set=theirs), -2)
    return pc.if_else(pc.is_null(mine), -1, found).to_numpy(zero_copy_only=False)


def _in_cells(rows: DataFrame, sites: DataFrame, wanted: int, width: int) -> DataFrame:
    """Add `_cell`, the nearest of `wanted` fitted rows: it only says which rows lie together.

    Cell -1 has the rows whose distances are not finite.
    """
    if wanted < 2:
        return rows.withColumn("_cell", F.lit(0))
    drawn = sites.orderBy(hash_number(F.lit("cell"), F.col("id")), "id").limit(wanted)
    drawn = _to_matrix(drawn.select("x").toArrow()["x"], width)
    drawn = drawn[np.isfinite((drawn * drawn).sum(axis=1))]
    shared = rows.sparkSession.sparkContext.broadcast(drawn if len(drawn) else np.zeros((1, width)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            told = np.flatnonzero(batch["x"].is_valid())
            for at in np.array_split(told, len(told) // 1_024 + 1):
                x = _to_matrix(batch["x"].take(pa.array(at)), width)
                with np.errstate(all="ignore"):
                    near = (centre * centre).sum(axis=1) - 2 * (x @ centre.T)
                fine = np.isfinite(near).all(axis=1)
                cell[at[fine]] = near[fine].argmin(axis=1)
            yield batch.append_column("_cell", pa.array(cell))

    return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType())]))


def fit_knn(
    df: DataFrame,
    id: str,
    x: str,
    y: str,
    fold: str,
    k: int,
    name: str = "yhat",
    most_sites: int | None = None,
) -> DataFrame:
    """(id, yhat): mean target of the k nearest rows of other folds, ties by id.

    The baseline is fitted on all rows with features and a target, or, if `most_sites` says
    so, on that many of the lowest hash of their id; every row is scored. Rows are laid out
    so that neighbours lie together. Fitted rows are sent to every task, a portion of bounded
    bytes at a time; the k nearest so far go from portion to portion in a settled table. A
    row without a fold is scored with the rows of all folds, and a row with NULL features,
    or no row to learn from, has NULL. All features must have one width.
    """
    spark = df.sparkSession
    single = df.schema[x].dataType.simpleString() == "array<float>"
    base = df.select(
        F.col(id).alias("id"),
        F.col(x).cast("array<float>" if single else "array<double>").alias("x"),
        F.col(y).cast("double").alias("y"),
        F.col(fold).alias("fold"),
    )
    if isinstance(base.schema["fold"].dataType, (T.FloatType, T.DoubleType)):
        base = base.withColumn("fold", F.when(~F.isnan("fold"), F.col("fold")))
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    sizes = F.min(F.size("x")), F.max(F.size("x"))
    asked, n, width, widest, last_id = (
        base.where("x is not null").agg(F.count(F.lit(1)), F.count("y"), *sizes, F.max("id")).first()
    )
    n = n if most_sites is None else min(n, most_sites)
    unknown = F.lit(None).cast("double").alias(name)
    if not n:
        return base.select(F.col("id").alias(id), unknown)
    if width != widest:
        raise ValueError(f"features of {width} to {widest} numbers")
    portion = min(KNN_BYTES // (16 * max(1, width)), limit(spark, "sweep.rows"))
    if min(n, _KNN_LEAST) * 16 * width > KNN_BYTES:
        raise ValueError(f"fewer than {_KNN_LEAST} rows of {width} numbers fit in a task")
    block = limit(spark, "site.rows")

    def fitted_on(rows: DataFrame) -> DataFrame:
        rows = rows.where(known)
        if most_sites is None:
            return rows
        return rows.orderBy(hash_number(F.lit("knn"), F.col("id")), "id").limit(most_sites)

    cells = min(_KNN_CELLS, n // (4 * block), KNN_BYTES // (64 * max(1, width)))
    rows = base.withColumn("_row", F.monotonically_increasing_id())
    rows = settle(_in_cells(rows, fitted_on(base), cells, width))
    # of equal rows of a fold none can be taken but those of the k lowest ids
    order = [F.col("id").isNull(), F.col("id"), F.col("_row")]
    copies = F.row_number().over(Window.partitionBy("x", "fold").orderBy(*order))
    sites = fitted_on(rows).withColumn("_copy", copies).where(F.col("_copy") <= k).drop("_copy")
    if isinstance(sites.schema["id"].dataType, T.IntegralType) and (last_id is None or last_id < LAST):
        sites = sites.withColumn("_place", F.coalesce(F.col("id").cast("long"), F.lit(LAST)))
    else:
        sites = numbered(
            sites.withColumn("_last", F.col("id").isNull()), [], ["_last", "id", "_row"], "_place"
        )
    sites = settle(sites.select("x", "y", "fold", "_place", "_cell", "_row"))
    laid = in_blocks(sites, [], ["_cell", "_row"], portion).df
    portions = [r[0] for r in laid.select(BLOCK).distinct().orderBy(BLOCK).collect()]

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked // _KNN_TASK_ROWS + 1)
    near = {"_dist": "array<double>", "_place": "array<long>", "_y": "array<double>"}
    scored = (
        rows.where("x is not null")
        .withColumns({c: F.lit(None).cast(t) for c, t in near.items()})
        .select("id", "x", "fold", *near, "_cell", "_row")
        .repartitionByRange(tasks, "_cell", "_row")
        .sortWithinPartitions("_cell", "_row")
        .drop("_cell", "_row")
    )

    def sent(number: int):
        part = laid.where(F.col(BLOCK) == number).orderBy("_cell", "_row").select("x", "y", "fold", "_place")
        return spark.sparkContext.broadcast(part.toArrow().combine_chunks())

    def against(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            sites, folds = _to_matrix(table["x"], width), table["fold"].combine_chunks()
            target, place = table["y"].to_numpy(), table["_place"].to_numpy()
            names = folds.unique().drop_null()
            theirs = _fold_codes(folds, names)
            for batch in batches:
                features = _to_matrix(batch["x"], width)
                so_far = no_partners(batch.num_rows, k)
                if batch["_dist"].null_count == 0:
                    told = [batch[c].flatten().to_numpy(zero_copy_only=False) for c in near]
                    so_far = tuple(v.reshape(-1, k).copy() for v in told)
                apart = _fold_codes(batch["fold"], names), theirs
                if last:
                    out = _mean_of_nearest(features, sites, target, k, place, so_far, apart, block)
                    yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out)], names=["id", name])
                    continue
                take_nearest(features, sites, target, place, so_far, block, apart)
                ends = pa.array(np.arange(0, k * batch.num_rows + 1, k, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(c.ravel())) for c in so_far]
                same = [batch[c] for c in ("id", "x", "fold")]
                yield pa.RecordBatch.from_arrays([*same, *lists], names=[*batch.schema.names])

        return run

    before = None
    for number in portions[:-1]:
        shared = sent(number)
        scored = settle(scored.mapInArrow(against(shared, False), scored.schema))
        shared.destroy()
        if before is not None:
            discard(before)
        before = scored
    out = T.StructType([base.schema["id"], T.StructField(name, T.DoubleType())])
    scored = scored.mapInArrow(against(sent(portions[-1]), True), out)
    scored = scored.select(F.col("id").alias(id), F.nanvl(name, F.lit(None).cast("double")).alias(name))
    return scored.unionByName(rows.where("x is null").select(F.col("id").alias(id), unknown))
