"""Bring candidate tables into the one form the other operators expect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, ratio
from ..plans.ordered import join_on


def orient(df: DataFrame, senses: Mapping[str, str]) -> DataFrame:
    """Make every objective a double to be minimised ('min' or 'max' per column)."""
    bad = {s for s in senses.values()} - {"min", "max"}
    if bad:
        raise ValueError(f"sense must be 'min' or 'max', not {sorted(bad)}")
    return df.withColumns(
        {
            c: F.col(c).cast("double") if s == "min" else -F.col(c).cast("double")
            for c, s in senses.items()
        }
    )


def with_reasons(df: DataFrame, key: Sequence[str], objs: Sequence[str]) -> DataFrame:
    """Add `reason`: why a row cannot be used, NULL where it can."""
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Only keys that do repeat are joined back.
    marked = join_on(df, twice, key, "left")
    inf = float("inf")
    reason = (
        F.when(any_of([F.col(k).isNull() for k in key]), "null key")
        .when(any_of([F.col(c).isNull() for c in objs]), "null objective")
        .when(any_of([F.isnan(c) for c in objs]), "nan objective")
        .when(any_of([F.abs(F.col(c)) == F.lit(inf) for c in objs]), "infinite objective")
        .when(F.col("_n").isNotNull(), "duplicate key")
    )
    return marked.withColumn("reason", reason).drop("_n").select(*df.columns, "reason")


def validate(
    df: DataFrame, key: Sequence[str], objs: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the others with the reason they were turned away."""
    marked = with_reasons(df, key, objs)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def normalise(
    df: DataFrame,
    keys: Sequence[str],
    objs: Sequence[str],
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Scale objectives to [0, 1] by group bounds `lo_<obj>`, `hi_<obj>`; zero width gives 0."""
    if bounds is None:
        bounds = df.groupBy(*keys).agg(
            *[F.min(c).alias(f"lo_{c}") for c in objs], *[F.max(c).alias(f"hi_{c}") for c in objs]
        )
    ends = [f"{e}_{c}" for c in objs for e in ("lo", "hi")]
    out = join_on(df, bounds.select(*keys, *ends), keys)
    scaled = {
        c: F.coalesce(
            ratio(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")),
            F.when(F.col(c).isNotNull(), 0.0),
        )
        for c in objs
    }
    return out.withColumns(scaled).select(*df.columns)


def pool(dfs: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """One table of several runs' rows, labelled with where each came from."""
    parts = [df.withColumn(tag, F.lit(label)) for label, df in dfs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
