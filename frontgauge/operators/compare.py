"""Compare models or algorithms over many problems or runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chi2_tail, ratio, two_sided_p
from ..plans.ordered import BLOCK, in_blocks, join_on, match, running, tally_quantiles
from ..session import settle


def summary(
    metrics: DataFrame, levels: Mapping[str, Sequence[str]], value: str
) -> DataFrame:
    """n, mean, deviation, median and interquartile range at several levels.

    `levels` names the columns each level groups by; the others are NULL there. All levels
    are grouping sets of one aggregate, told apart by their grouping id, so a NULL in the
    data stays a group of its own. Undefined (NULL) values do not count; a group of nothing
    else stays, with n 0.
    """
    cols = list(dict.fromkeys(c for by in levels.values() for c in by))
    # a set's id has a bit for every column that it does not group by, the first highest
    number = {n: sum(1 << i for i, c in enumerate(reversed(cols)) if c not in by) for n, by in levels.items()}
    sets = {number[n]: [c for c in cols if c in by] for n, by in levels.items()}
    keys = ["_set", *cols]
    v = F.col(value)

    def grouped(rows: DataFrame, more: list[str], *aggs: Column) -> DataFrame:
        if not cols:
            return rows.groupBy(F.lit(0).cast("long").alias("_set"), *more).agg(*aggs)
        by = [[F.col(c) for c in [*s, *more]] for s in sets.values()]
        out = rows.groupingSets(by, *cols, *more).agg(F.grouping_id().alias("_id"), *aggs)
        # `more` is in every set, so its bits are 0
        return out.withColumn("_set", F.shiftright("_id", len(more))).drop("_id")

    base = grouped(metrics, [], F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    # Values are combined before they are copied to the levels.
    tally = metrics.where(v.isNotNull()).groupBy(*cols, value).agg(F.count(F.lit(1)).alias("_c"))
    values = settle(grouped(tally, [value], F.sum("_c").alias("_n")).withColumnRenamed("_n", "_c"))
    qs = tally_quantiles(values, keys, value, {"median": 0.5, "_q1": 0.25, "_q3": 0.75})
    names = F.create_map(*[
        x for i in sets
        for x in (F.lit(i).cast("long"), F.array(*[F.lit(n) for n in levels if number[n] == i]))
    ])
    return match(base, qs, keys, "left").select(
        F.explode(names[F.col("_set")]).alias("level"),
        *cols,
        "n",
        "mean",
        "std",
        "median",
        (F.col("_q3") - F.col("_q1")).alias("iqr"),
    )


def leaderboard(
    metrics: DataFrame, problem: Sequence[str], model: str, value: str, models: Sequence[str]
) -> DataFrame:
    """Problems as rows, one column per listed model."""
    return metrics.groupBy(*problem).pivot(model, list(models)).agg(F.avg(value))


def friedman(metrics: DataFrame, problem: str, model: str, value: str) -> DataFrame:
    """Mean rank per model over problems that have all models, the chi-square statistic and its p.

    Smaller values rank first, ties share the mean rank. A problem where a model's value
    is undefined (NULL) lacks that model.
    """
    every = metrics.groupBy(problem, model).agg(F.avg(value).alias("_v"))
    k = every.select(F.count_distinct(model).alias("models"))
    one = every.where(F.col("_v").isNotNull())
    # From here a problem holds at most one row per model.
    per_problem = Window.partitionBy(problem)
    ties = Window.partitionBy(problem, "_v")
    rank = F.rank().over(per_problem.orderBy("_v")) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    rows = one.withColumns({"_have": F.count(F.lit(1)).over(per_problem), "_rank": rank})
    rows = rows.join(F.broadcast(k)).where(F.col("_have") == F.col("models"))
    means = rows.groupBy(model, "models").agg(
        F.count(F.lit(1)).alias("problems"), F.avg("_rank").alias("mean_rank")
    )
    # one row per model: the whole table is as small as the list of models
    m = F.col("models")
    off = F.col("mean_rank") - (m + 1) / F.lit(2.0)
    chi2 = F.sum(12 * F.col("problems") * off * off / (m * (m + 1))).over(Window.partitionBy("models"))
    return means.withColumn("chi2", chi2).withColumn("p", chi2_tail(F.col("chi2"), m - 1)).drop("models")


def wtl(
    metrics: DataFrame, problem: Sequence[str], model: str, value: str, tol: float = 0.0
) -> DataFrame:
    """Wins, ties and losses of a against b over shared problems; smaller wins by more than tol.

    All models of the data are compared; pairs that share no problem have no row, and an
    undefined (NULL) value takes its model out of that problem. A problem holds one
    value per model, and its pairs are summed up before they are shuffled.
    """
    one = metrics.groupBy(*problem, model).agg(F.avg(value).alias("_v")).where(F.col("_v").isNotNull())
    held = one.groupBy(*problem).agg(F.collect_list(F.struct(F.col(model).alias("m"), "_v")).alias("_m"))
    pairs = held.select(F.explode("_m").alias("_a"), "_m").select("_a", F.explode("_m").alias("_b"))
    d = F.col("_a._v") - F.col("_b._v")
    return (
        pairs.where(F.col("_a.m") != F.col("_b.m"))
        .groupBy(F.col("_a.m").alias("a"), F.col("_b.m").alias("b"))
        .agg(
            F.count_if(d < -tol).alias("wins"),
            F.count_if(F.abs(d) <= tol).alias("ties"),
            F.count_if(d > tol).alias("losses"),
        )
    )


def _ranked_tally(tally: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add `_rank`, the average rank of each distinct value given its count `_c`."""
    laid = in_blocks(tally, keys, [value])
    got = running(laid, keys, [value], {"_cum": ("sum", F.col("_c"))}).drop(BLOCK)
    return got.withColumn("_rank", F.col("_cum") - (F.col("_c") - 1) / F.lit(2.0))


def wilcoxon(df: DataFrame, keys: Sequence[str], diff: str) -> DataFrame:
    """Signed-rank sums over non-zero differences, with the normal z and two-sided p.

    A group without any non-zero difference stays, with n 0, sums of 0 and z, p NULL.
    """
    keys = list(keys)
    d = F.col(diff)
    size = df.groupBy(*keys, F.abs(d).alias("_a"))
    tally = size.agg(
        F.count_if(d != 0).alias("_c"), F.count_if(d > 0).alias("_up"), F.count_if(d < 0).alias("_down")
    )
    got = _ranked_tally(tally, keys, "_a").groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"),
        F.sum(F.col("_down") * F.col("_rank")).alias("w_minus"),
        F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("_ties"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = ratio(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var))
    return got.withColumn("z", z).withColumn("p", two_sided_p(F.col("z"))).drop("_ties")


def a12(
    df: DataFrame, keys: Sequence[str], label: str, value: str, a: str, b: str
) -> DataFrame:
    """Mann-Whitney U of label a against b and A12 = U / (n_a n_b), with z and two-sided p.

    Undefined (NULL) values do not count. Where a side is empty a12, z and p are NULL.
    """
    keys = list(keys)
    is_a, is_b = F.col(label) == a, F.col(label) == b
    told = F.col(value).isNotNull()
    tally = df.where(is_a | is_b).groupBy(*keys, value).agg(
        F.count(value).alias("_c"), F.count_if(is_a & told).alias("_a")
    )
    got = _ranked_tally(tally, keys, value).groupBy(*keys).agg(
        F.sum("_a").alias("n_a"),
        F.sum(F.col("_c") - F.col("_a")).alias("n_b"),
        F.sum(F.col("_a") * F.col("_rank")).alias("_r"),
        F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("_ties"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("_r") - na * (na + 1) / 2
    var = na * nb / 12 * (n + 1 - ratio(F.col("_ties"), n * (n - 1)))
    return got.select(
        *keys,
        "n_a",
        "n_b",
        u.alias("u"),
        ratio(u, na * nb).alias("a12"),
        ratio(u - na * nb / 2, F.sqrt(var)).alias("z"),
    ).withColumn("p", two_sided_p(F.col("z")))


def holm(df: DataFrame, keys: Sequence[str], p: str, id: Sequence[str]) -> DataFrame:
    """Add `p_holm`: the running maximum of (m - i + 1) p(i), at most 1.

    An undefined (NULL) p counts for nothing and has p_holm NULL.
    """
    keys, order = list(keys), [p, *id]
    df, told = settle(df), F.col(p).isNotNull()
    m = df.groupBy(*keys).agg(F.count(p).alias("_m"))
    laid = in_blocks(join_on(df, m, keys), keys, order)
    got = running(laid, keys, order, {"_i": ("sum", told.cast("long"))})
    raised = F.when(told, F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p)))
    laid.df = got
    out = running(laid, keys, order, {"_h": ("max", raised)})
    return out.withColumn("p_holm", F.when(told, F.col("_h"))).drop(BLOCK, "_m", "_i", "_h")
