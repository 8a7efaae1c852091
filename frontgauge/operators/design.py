"""Evaluation design: folds, scaling fitted on training rows, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_number, ratio, uniform
from ..plans.ordered import join_on, match, numbered


def folds(
    df: DataFrame, key: Sequence[str], k: int, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Fold number from a hash of the key: the same however the rows are placed."""
    number = hash_number(F.lit(seed), *[F.col(c) for c in key])
    return df.withColumn(name, (number % k).cast("int"))


def group_folds(
    df: DataFrame, group: Sequence[str], k: int, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """All rows of a group share a fold (leave groups out)."""
    return folds(df, group, k, seed, name)


def standardise(
    df: DataFrame, cols: Sequence[str], fit_on: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """z-scores with mean and deviation of the `fit_on` rows only; zero deviation gives 0."""
    aggs = []
    for c in cols:
        used = F.when(fit_on, F.col(c))
        aggs += [F.avg(used).alias(f"_m_{c}"), F.stddev_pop(used).alias(f"_s_{c}")]
    stats = df.groupBy(*keys).agg(*aggs)
    out = join_on(df, stats, keys)
    scaled = {
        c: F.coalesce(
            ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")),
            F.when(F.col(f"_s_{c}").isNotNull() & F.col(c).isNotNull(), 0.0),
        )
        for c in cols
    }
    return out.withColumns(scaled).select(*df.columns)


def bootstrap(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], reps: int, seed: int = 0
) -> DataFrame:
    """Rows drawn with replacement: `rep` and how many `times` each row was drawn.

    Every replicate draws as many rows as the group has. Only places are
    shuffled for the draws; a row's values join in once its times are counted.
    """
    placed = numbered(df, keys, order, "_place")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draws = join_on(placed.select(*keys, "_place"), size, keys).withColumn(
        "rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))
    )
    u = uniform(F.lit(seed), *[F.col(k) for k in keys], F.col("rep"), F.col("_place"))
    times = (
        draws.withColumn("_place", F.floor(u * F.col("_n")) + 1)
        .groupBy(*keys, "rep", "_place")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return match(placed, times, [*keys, "_place"]).drop("_place")
