"""Call a small numpy helper once per group, many groups to a task.

Only groups (or blocks of groups) of bounded size may come here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import limit, settle
from .ordered import group_sizes, join_on


def split_groups(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[np.ndarray]:
    """Row positions of each group."""
    code = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    yield from np.split(order, cuts)


def per_group(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    rows: int,
    rows_per_call: int = 50_000,
) -> DataFrame:
    """`fn` gets a frame holding whole groups (use split_groups inside it).

    A Python call costs about a millisecond, so groups are packed by key hash
    into calls of about rows_per_call rows instead of one call per group.
    """
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    calls = max(shuffles, ceil(rows / rows_per_call))
    call = F.pmod(F.xxhash64(*keys), F.lit(calls)) if keys else F.lit(0)
    return (
        df.withColumn("_call", call)
        .groupBy("_call")
        .applyInPandas(lambda pdf: fn(pdf.drop(columns="_call")), schema)
    )


def group_codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row, alike for rows of one group; whole numbers are compared as such."""
    codes = {}
    for i, k in enumerate(keys):
        col = table[k].combine_chunks()
        if not pa.types.is_floating(col.type):
            col = col.dictionary_encode(null_encoding="encode").indices
        codes[i] = col.to_pandas()
    return pd.DataFrame(codes).groupby(list(codes), sort=False, dropna=False).ngroup().to_numpy()


def per_group_whole(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pa.Table], pa.Table],
    schema: T.StructType,
    rows: int,
    rows_per_call: int = 50_000,
) -> DataFrame:
    """Like per_group, for whole rows: they pass as an Arrow table, all columns as they are."""
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    calls = max(shuffles, ceil(rows / rows_per_call))
    return (
        df.withColumn("_call", F.pmod(F.xxhash64(*keys), F.lit(calls)))
        .groupBy("_call")
        .applyInArrow(lambda table: fn(table.drop_columns("_call")), schema)
    )


def by_size(
    df: DataFrame,
    keys: Sequence[str],
    small: Callable[[DataFrame, int], DataFrame],
    big: Callable[[DataFrame], DataFrame],
    most: int | None = None,
) -> DataFrame:
    """`small(rows, how many)` for groups one Python call can hold, `big(rows)` for the others.

    Such a group has `most` rows, by default those that may be compared with each other.
    """
    most = most or limit(df.sparkSession, "compare.rows")
    rows, largest = group_sizes(df, keys)
    if largest <= most:
        return small(df, rows)
    if not keys:
        return big(df)
    large = df.groupBy(*keys).count().where(F.col("count") > most).select(*keys)
    large = settle(large)
    rest = join_on(df, large, keys, "left_anti")
    return small(rest, rows).unionByName(big(join_on(df, large, keys, "left_semi")))


def pair_counts(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    names: Sequence[str],
    count: Callable[[np.ndarray, np.ndarray], list[int]],
    rows: int,
    step: int = 512,
    whole: Callable[[np.ndarray], list[int]] | None = None,
    direct: int = 4_096,
) -> DataFrame:
    """Per group, sums of `count(some rows, all rows)`; the pairs never leave the array.

    `whole(all rows)` gives the same sums for groups of more than `direct` rows, in less time.
    """
    keys, cols = list(keys), list(cols)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[cols].to_numpy(float)
        groups = list(split_groups(pdf, keys)) if keys else [np.arange(len(pdf))]
        out = []
        for at in groups:
            g = v[at]
            if whole is not None and len(g) > direct:
                out.append(whole(g))
                continue
            out.append(np.sum([count(g[i : i + step], g) for i in range(0, len(g), step)], axis=0))
        found = pd.DataFrame(np.array(out, dtype=np.int64), columns=list(names))
        found.insert(0, "n", [len(at) for at in groups])
        for k in reversed(keys):
            found.insert(0, k, pdf[k].to_numpy()[[at[0] for at in groups]])
        return found

    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    schema += "n long" + "".join(f", {n} long" for n in names)
    return per_group(df.select(*keys, *cols), keys, fn, schema, rows)
