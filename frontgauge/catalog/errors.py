"""Prediction error."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import errors as E
from . import inputs as I
from .registry import query

_KEYS = ["model", "objective", "problem"]


@query(
    f"""WITH {I.LONG} SELECT model, objective, problem, count(*) AS n, avg(abs(y - yhat)) AS mae,
      avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
      max(abs(y - yhat)) AS max_error, avg(y - yhat) AS bias FROM long GROUP BY model, objective, problem""",
    ["mae", "mse", "rmse", "max_error", "bias"],
)
def prediction_errors(spark, folder):
    return E.errors(I.long_predictions(spark, folder), _KEYS)


@query(
    f"""WITH {I.LONG} SELECT model, objective, problem,
      1 - avg((y - yhat) * (y - yhat)) / nullif(var_pop(y), 0) AS r2,
      1 - var_pop(y - yhat) / nullif(var_pop(y), 0) AS explained_variance
      FROM long GROUP BY model, objective, problem""",
    ["r2", "explained_variance"],
)
def r_squared(spark, folder):
    return E.r2(I.long_predictions(spark, folder), _KEYS)


@query(
    f"""WITH {I.LONG}, z AS (SELECT model, objective, problem, round(y - 901) AS y, yhat - 901 AS yhat FROM long)
    SELECT model, objective, problem, avg(abs(y - yhat) / abs(y)) FILTER (y <> 0) AS mape,
      count(*) FILTER (y = 0) AS zero_y,
      avg(CASE WHEN y = yhat THEN 0 ELSE 2 * abs(y - yhat) / (abs(y) + abs(yhat)) END) AS smape,
      sqrt(avg((y - yhat) * (y - yhat))) / nullif(max(y) - min(y), 0) AS nrmse
    FROM z GROUP BY model, objective, problem""",
    ["mape", "smape", "nrmse"],
)
def relative_errors(spark, folder):
    # shifted so that some true values are 0
    df = I.long_predictions(spark, folder).withColumns(
        {"y": F.round(F.col("y") - 901), "yhat": F.col("yhat") - 901}
    )
    return E.rel_errors(df, _KEYS)


@query(
    f"""WITH {I.LONG}, r AS (SELECT *,
      rank() OVER (PARTITION BY model, objective, problem ORDER BY y)
        + (count(*) OVER (PARTITION BY model, objective, problem, y) - 1) / 2.0 AS ry,
      rank() OVER (PARTITION BY model, objective, problem ORDER BY yhat)
        + (count(*) OVER (PARTITION BY model, objective, problem, yhat) - 1) / 2.0 AS rp FROM long)
    SELECT model, objective, problem,
      CASE WHEN min(y) < max(y) AND min(yhat) < max(yhat) THEN corr(y, yhat) END AS pearson,
      CASE WHEN min(y) < max(y) AND min(yhat) < max(yhat) THEN corr(ry, rp) END AS spearman
    FROM r GROUP BY model, objective, problem""",
    ["pearson", "spearman"],
)
def correlations(spark, folder):
    return E.corrs(I.long_predictions(spark, folder), _KEYS, ["id"])


@query(
    f"""WITH {I.LONG}, p AS (SELECT a.model, a.objective, a.problem, sign(a.y - b.y) AS sx, sign(a.yhat - b.yhat) AS sy
      FROM long a JOIN long b ON a.model = b.model AND a.objective = b.objective AND a.problem = b.problem
        AND a.id < b.id)
    SELECT model, objective, problem, count(*) AS pairs, count(*) FILTER (sx * sy > 0) AS concordant,
      count(*) FILTER (sx * sy < 0) AS discordant, sum(sx * sy) / (sqrt(count(*) FILTER (sx <> 0))
        * sqrt(count(*) FILTER (sy <> 0))) AS tau_b
    FROM p GROUP BY model, objective, problem""",
    ["tau_b"],
)
def kendall_tau(spark, folder):
    return E.kendall(I.long_predictions(spark, folder), _KEYS)


@query(
    f"""WITH {I.LONG} SELECT model, objective, quantile_cont(abs(y - yhat), 0.5) AS q50,
      quantile_cont(abs(y - yhat), 0.9) AS q90, quantile_cont(abs(y - yhat), 0.99) AS q99
    FROM long GROUP BY model, objective""",
    ["q50", "q90", "q99"],
)
def error_quantiles(spark, folder):
    ps = {"q50": 0.5, "q90": 0.9, "q99": 0.99}
    return E.err_quantiles(I.long_predictions(spark, folder), ["model", "objective"], ps)


@query(
    f"""WITH {I.LONG} SELECT model, objective, count(*) AS n, true AS q50_near, true AS q90_near, true AS q99_near
    FROM long GROUP BY model, objective"""
)
def error_quantiles_by_sketch(spark, folder):
    """Quantiles from sketches per problem, merged; whether their exact ranks are as near as stated."""
    ps = {"q50": 0.5, "q90": 0.9, "q99": 0.99}
    df, keys = I.long_predictions(spark, folder), ["model", "objective"]
    found = E.sketch_quantiles(E.merged_sketch(E.err_sketch(df, [*keys, "problem"]), keys), ps)
    e = F.abs(F.col("y") - F.col("yhat"))
    held = df.join(F.broadcast(found.drop("n")), keys)  # one row per model and objective
    exact = held.groupBy(*keys).agg(
        F.count(e).alias("n"), *[F.count_if(e <= F.col(q)).alias(f"_{q}") for q in ps]
    )
    # three times what 99 of 100 sketches keep to
    near = [
        (F.abs(F.col(f"_{q}") / F.col("n") - p) <= 3 * E.SKETCH_RANK_ERROR + 1 / F.col("n")).alias(f"{q}_near")
        for q, p in ps.items()
    ]
    return exact.select(*keys, "n", *near)


@query(
    f"""WITH {I.LONG}, e AS (SELECT model, objective, y - yhat AS e FROM long)
    SELECT model, objective, CASE WHEN e < -8 THEN 0 WHEN e >= 8 THEN 17
      ELSE floor((e + 8) / 16 * 16)::BIGINT + 1 END AS bin, count(*) AS n FROM e GROUP BY ALL"""
)
def residual_histogram(spark, folder):
    return E.err_hist(I.long_predictions(spark, folder), ["model", "objective"], -8, 8, 16)


@query(
    f"""WITH {I.LONG}, f AS (SELECT model, objective, fold, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
      avg(abs(y - yhat)) AS mae FROM long GROUP BY ALL)
    SELECT model, objective, count(*) AS folds, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std,
      avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std FROM f GROUP BY model, objective""",
    ["rmse_mean", "rmse_std", "mae_mean", "mae_std"],
)
def fold_summary(spark, folder):
    per_fold = E.errors(I.long_predictions(spark, folder), ["model", "objective", "fold"])
    return E.over_folds(per_fold, ["model", "objective"], ["rmse", "mae"])


_MP = ["model", "problem"]


@query(
    f"""WITH {I.PARTIAL} SELECT model, problem, count(y) AS n, avg(abs(y - yhat)) AS mae,
      sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
      1 - avg((y - yhat) * (y - yhat)) / nullif(var_pop(y), 0) AS r2,
      avg(abs(y - yhat) / abs(y)) AS mape, count(*) FILTER (y = 0) AS zero_y,
      sqrt(avg((y - yhat) * (y - yhat))) / nullif(max(y) - min(y), 0) AS nrmse
      FROM groups LEFT JOIN whole USING (model, problem) GROUP BY model, problem""",
    ["mae", "rmse", "r2", "mape", "nrmse"],
)
def errors_of_incomplete(spark, folder):
    """Only rows with both values count, in every error alike."""
    df = I.partial_predictions(spark, folder)
    plain = E.errors(df, _MP).select(*_MP, "n", "mae", "rmse")
    share = E.r2(df, _MP).select(*_MP, "r2")
    return plain.join(share, _MP).join(E.rel_errors(df, _MP).drop("smape"), _MP)


@query(
    f"""WITH {I.PARTIAL}, r AS (SELECT *,
      rank() OVER (PARTITION BY model, problem ORDER BY y)
        + (count(*) OVER (PARTITION BY model, problem, y) - 1) / 2.0 AS ry,
      rank() OVER (PARTITION BY model, problem ORDER BY yhat)
        + (count(*) OVER (PARTITION BY model, problem, yhat) - 1) / 2.0 AS rp FROM whole)
    SELECT model, problem,
      CASE WHEN min(y) < max(y) AND min(yhat) < max(yhat) THEN corr(y, yhat) END AS pearson,
      CASE WHEN min(y) < max(y) AND min(yhat) < max(yhat) THEN corr(ry, rp) END AS spearman
    FROM groups LEFT JOIN r USING (model, problem) GROUP BY model, problem""",
    ["pearson", "spearman"],
)
def correlations_of_incomplete(spark, folder):
    return E.corrs(I.partial_predictions(spark, folder), _MP, ["id"])


@query(
    f"""WITH {I.PARTIAL}, p AS (SELECT a.model, a.problem, sign(a.y - b.y) AS sx, sign(a.yhat - b.yhat) AS sy
      FROM whole a JOIN whole b ON a.model = b.model AND a.problem = b.problem AND a.id < b.id)
    SELECT model, problem, count(sx) AS pairs, count(*) FILTER (sx * sy > 0) AS concordant,
      count(*) FILTER (sx * sy < 0) AS discordant, sum(sx * sy) / nullif(sqrt(count(*) FILTER (sx <> 0))
        * sqrt(count(*) FILTER (sy <> 0)), 0) AS tau_b
    FROM groups LEFT JOIN p USING (model, problem) GROUP BY model, problem""",
    ["tau_b"],
)
def kendall_of_incomplete(spark, folder):
    return E.kendall(I.partial_predictions(spark, folder), _MP)
