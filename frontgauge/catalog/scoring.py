"""Surrogate scores and baselines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import design, scoring
from ..sources.tables import load
from . import inputs as I
from .registry import query


def _weights(rows: int, cols: int) -> list[list[float]]:
    return [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]


# 64 inputs, 8 hidden units, 2 outputs
LAYERS = [
    (_weights(8, 64), [(i - 4) / 10 for i in range(8)]),
    (_weights(2, 8), [0.5, -0.5]),
]

_MLP = """WITH h AS (SELECT vec_id, list_transform(range(0, 8), lambda i: greatest(0, (i - 4) / 10.0
      + list_sum(list_transform(range(0, 64), lambda j:
          embedding[j + 1]::DOUBLE * ((i * 7 + j * 3) % 11 - 5) / 10.0)))) AS h FROM embeddings)
  SELECT vec_id,
    0.5 + list_sum(list_transform(range(0, 8), lambda j: h[j + 1] * ((j * 3) % 11 - 5) / 10.0)) AS y1,
    -0.5 + list_sum(list_transform(range(0, 8), lambda j: h[j + 1] * ((7 + j * 3) % 11 - 5) / 10.0)) AS y2
  FROM h"""


@query(_MLP, ["y1", "y2"])
def mlp_scores(spark, folder):
    x = F.col("embedding").cast("array<double>")
    df = load(spark, folder, "embeddings").select("vec_id", x.alias("x"))
    got = scoring.score_mlp(df, "x", LAYERS)
    return got.select("vec_id", F.col("yhat")[0].alias("y1"), F.col("yhat")[1].alias("y2"))


def _load_model():
    mats = [(np.array(w), np.array(b)) for w, b in LAYERS]

    def predict(batch):
        h = np.stack(batch["x"].to_numpy())
        for i, (w, b) in enumerate(mats):
            h = h @ w.T + b
            h = h if i == len(mats) - 1 else np.maximum(h, 0)
        return batch[["vec_id"]].assign(y1=h[:, 0], y2=h[:, 1])

    return predict


@query(_MLP, ["y1", "y2"])
def model_scores(spark, folder):
    x = F.col("embedding").cast("array<double>")
    df = load(spark, folder, "embeddings").select("vec_id", x.alias("x"))
    return scoring.score_with(df, _load_model, "vec_id long, y1 double, y2 double")


@query(
    f"""WITH {I.LINES}, t AS (SELECT *, (('0x' || substr(md5('0:' || l_orderkey), 1, 8))::BIGINT % 5) <> 0 AS train
      FROM lines), f AS (SELECT problem, regr_slope(f1, f2) FILTER (train) AS a,
        regr_intercept(f1, f2) FILTER (train) AS b FROM t GROUP BY problem)
    SELECT problem, count(*) AS n, avg(abs(f1 - (a * f2 + b))) AS mae, sqrt(avg(pow(f1 - (a * f2 + b), 2))) AS rmse
    FROM t JOIN f USING (problem) WHERE NOT train GROUP BY problem""",
    ["mae", "rmse"],
)
def linear_baseline(spark, folder):
    df = design.folds(I.lines(spark, folder), ["l_orderkey"], 5)
    fit = scoring.fit_linear(df, ["problem"], "f1", "f2", F.col("fold") != 0)
    e = F.col("f1") - F.col("yhat")
    return fit.where("fold = 0").groupBy("problem").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


@query(
    f"""WITH {I.LONG}, f AS (SELECT model, objective, fold, sum(y) AS s, count(*) AS n
      FROM long GROUP BY ALL), m AS (SELECT a.model, a.objective, a.fold, sum(b.s) / sum(b.n) AS yhat0
      FROM f a JOIN f b ON a.model = b.model AND a.objective = b.objective AND a.fold <> b.fold GROUP BY ALL)
    SELECT model, problem, id, objective, fold, yhat0 FROM long JOIN m USING (model, objective, fold)""",
    ["yhat0"],
)
def mean_baseline(spark, folder):
    df = I.long_predictions(spark, folder)
    got = scoring.fit_mean(df, ["model", "objective"], "fold", "y", "yhat0")
    return got.select("model", "problem", "id", "objective", "fold", "yhat0")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label,
        (('0x' || substr(md5('0:' || vec_id), 1, 8))::BIGINT % 5) AS fold FROM embeddings),
      r AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id
        ORDER BY list_distance(a.x, b.x), b.vec_id) AS place FROM e a JOIN e b ON a.fold <> b.fold)
    SELECT vec_id, avg(label) AS yhat FROM r WHERE place <= 5 GROUP BY vec_id""",
    ["yhat"],
)
def knn_baseline(spark, folder):
    df = design.folds(load(spark, folder, "embeddings"), ["vec_id"], 5)
    return scoring.fit_knn(df, "vec_id", "embedding", "label", "fold", 5)
