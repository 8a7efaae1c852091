"""Prediction error by group; all of it plain aggregates except ranks and quantiles.

A row counts where both the true and the predicted value are known, and nowhere else: `n`
says how many rows did. A group without such a row stays, with n 0 and NULL metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col, known, ratio
from ..plans.dominance import distinct_vectors, weak_hits
from ..plans.inversions import inversions
from ..plans.ordered import average_rank, quantiles
from ..session import settle


def error_columns(y: str | Column = "y", yhat: str | Column = "yhat", suffix: str = "") -> list[Column]:
    e = as_col(y) - as_col(yhat)
    return [
        F.avg(F.abs(e)).alias(f"mae{suffix}"),
        F.avg(e * e).alias(f"mse{suffix}"),
        F.sqrt(F.avg(e * e)).alias(f"rmse{suffix}"),
        F.max(F.abs(e)).alias(f"max_error{suffix}"),
        F.avg(e).alias(f"bias{suffix}"),
    ]


def errors(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """n, MAE, MSE, RMSE, largest absolute error and bias."""
    n = F.count_if(known(y, yhat)).alias("n")
    return df.groupBy(*keys).agg(n, *error_columns(y, yhat))


def r2(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Coefficient of determination and explained variance; NULL on constant y."""
    e = F.col(y) - F.col(yhat)
    t = F.when(known(y, yhat), F.col(y))
    varies = F.col("_lo") < F.col("_hi")
    out = df.groupBy(*keys).agg(
        F.avg(e * e).alias("_mse"),
        F.var_pop(e).alias("_ve"),
        F.var_pop(t).alias("_vy"),
        F.min(t).alias("_lo"),
        F.max(t).alias("_hi"),
    )
    return out.select(
        *keys,
        F.when(varies, 1 - ratio(F.col("_mse"), F.col("_vy"))).alias("r2"),
        F.when(varies, 1 - ratio(F.col("_ve"), F.col("_vy"))).alias("explained_variance"),
    )


def rel_errors(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAPE over rows with y <> 0 (the others counted), sMAPE, RMSE over the range of y."""
    p = F.col(yhat)
    t = F.when(known(y, yhat), F.col(y))
    e = t - p
    return df.groupBy(*keys).agg(
        F.avg(ratio(F.abs(e), F.abs(t))).alias("mape"),
        F.count_if(t == 0).alias("zero_y"),
        # a row with both values 0 has no error
        F.avg(F.coalesce(ratio(2 * F.abs(e), F.abs(t) + F.abs(p)), F.when(e == 0, 0.0))).alias("smape"),
        ratio(F.sqrt(F.avg(e * e)), F.max(t) - F.min(t)).alias("nrmse"),
    )


def _corr(x: str, y: str) -> Column:
    """Pearson correlation, NULL where either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def corrs(
    df: DataFrame, keys: Sequence[str], id: Sequence[str], y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks). `id` only breaks ties in the sort."""
    both = known(y, yhat)
    # Rows that do not count have neither value: they shift all ranks alike.
    whole = df.select(*keys, *id, F.when(both, F.col(y)).alias(y), F.when(both, F.col(yhat)).alias(yhat))
    ranked = average_rank(whole, keys, y, id, "_ry")
    ranked = average_rank(ranked, keys, yhat, id, "_rp")
    ranked = ranked.withColumns({r: F.when(known(y), F.col(r)) for r in ("_ry", "_rp")})
    return ranked.groupBy(*keys).agg(
        _corr(y, yhat).alias("pearson"), _corr("_ry", "_rp").alias("spearman")
    )


def pairs_no_worse(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per group `_pairs`: ordered pairs (i, j), i = j included, with i <= j in every column.

    Counted, never listed (see plans/dominance.py).
    """
    vec = distinct_vectors(df, keys, cols)
    hits = weak_hits(vec, keys, cols)
    return (
        vec.join(hits, "_rid")
        .groupBy(*keys)
        .agg(F.sum(F.col("_w") * F.col("_hits")).cast("long").alias("_pairs"))
    )


def equal_pairs(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per group `_pairs`: ordered pairs, i = j included, alike in every column."""
    same = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_c"))
    return same.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_c")).alias("_pairs"))


def sum_parts(keys: Sequence[str], parts: dict[str, DataFrame]) -> DataFrame:
    """One row per group with each part's `_pairs` under the part's name."""
    out = None
    for name, df in parts.items():
        cols = [F.col("_pairs").alias(n) if n == name else F.lit(None).cast("long").alias(n) for n in parts]
        row = df.select(*keys, *cols)
        out = row if out is None else out.unionByName(row)
    return out.groupBy(*keys).agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in parts])


def kendall(df: DataFrame, keys: Sequence[str], x: str = "y", y: str = "yhat") -> DataFrame:
    """Kendall tau-b; NULL where either side is constant.

    Knight's method: in order of (x, y) the discordant pairs are the inversions of y; ties
    come from counts of equal values. About n log n steps, a group of any size.
    """
    keys = list(keys)
    whole = df.where(known(x, y))
    tally = settle(whole.groupBy(*keys, x, y).agg(F.count(F.lit(1)).cast("double").alias("_w")))

    def tied(*cols: str) -> DataFrame:
        """Ordered pairs, a row with itself included, that are alike in these columns."""
        same = tally.groupBy(*keys, *cols).agg(F.sum("_w").cast("long").alias("_c"))
        return same.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_c")).alias("_pairs"))

    got = sum_parts(
        keys,
        {
            "n": df.groupBy(*keys).agg(F.count_if(known(x, y)).alias("_pairs")),
            "_ex": tied(x),
            "_ey": tied(y),
            "_exy": tied(x, y),
            "discordant": inversions(tally, keys, x, y).withColumnRenamed("_inversions", "_pairs"),
        },
    )
    n = F.col("n")
    pairs = (n * (n - 1) / 2).cast("long")
    tied_x, tied_y, tied_xy = (((F.col(c) - n) / 2).cast("long") for c in ("_ex", "_ey", "_exy"))
    concordant = pairs - tied_x - tied_y + tied_xy - F.col("discordant")
    scale = F.sqrt((pairs - tied_x).cast("double")) * F.sqrt((pairs - tied_y).cast("double"))
    return got.select(
        *keys,
        pairs.alias("pairs"),
        concordant.alias("concordant"),
        "discordant",
        ratio(concordant - F.col("discordant"), scale).alias("tau_b"),
    )


def err_quantiles(
    df: DataFrame, keys: Sequence[str], ps: dict[str, float], y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """Exact interpolated quantiles of the absolute error."""
    e = df.select(*keys, F.abs(F.col(y) - F.col(yhat)).alias("_e"))
    return quantiles(e, keys, "_e", ps)


# Items that a sketch keeps per level. The rank of what it gives lies within about 0.33 % of
# the rank asked for, 99 times of 100 (the published error of KLL sketches with this k).
SKETCH_K = 800
SKETCH_RANK_ERROR = 0.0033


def err_sketch(
    df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat", k: int = SKETCH_K
) -> DataFrame:
    """A KLL sketch of the absolute error per group, `sketch`, and the `n` rows it holds.

    Sketches have a bounded size whatever the group, and merge: `merged_sketch` sums up
    groups, days or files without their rows. A group without a known error stays, with n 0.
    """
    e = F.abs(F.col(y) - F.col(yhat)).cast("double")
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.kll_sketch_agg_double(e, k).alias("sketch"))


def merged_sketch(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of `err_sketch` summed up to coarser groups."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, ps: dict[str, float]) -> DataFrame:
    """Quantiles of each sketch in place of it, within SKETCH_RANK_ERROR by rank; n 0 gives NULL."""
    found = {n: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for n, p in ps.items()}
    return sketches.withColumns({n: F.when(F.col("n") > 0, q) for n, q in found.items()}).drop("sketch")


def err_hist(
    df: DataFrame,
    keys: Sequence[str],
    lo: float,
    hi: float,
    bins: int,
    y: str = "y",
    yhat: str = "yhat",
) -> DataFrame:
    """Residual counts per bin: 1..bins, 0 below `lo`, bins + 1 from `hi` on."""
    e = F.col(y) - F.col(yhat)
    bin_ = F.width_bucket(e, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    return df.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def over_folds(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of per-fold metrics."""
    aggs = [F.count(F.lit(1)).alias("folds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs)
