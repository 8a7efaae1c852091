"""Is the optimisation result preserved?"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as L
from ..operators import errors as E
from ..operators import fronts as M
from . import inputs as I
from .registry import query

_MP = ["model", "problem"]

_FRONTS = f"""{I.PREDICTIONS},
  tf AS (SELECT model, problem, id FROM preds a WHERE NOT EXISTS (SELECT 1 FROM preds b
    WHERE a.model = b.model AND a.problem = b.problem
      AND b.t1 <= a.t1 AND b.t2 <= a.t2 AND (b.t1 < a.t1 OR b.t2 < a.t2))),
  pf AS (SELECT model, problem, id FROM preds a WHERE NOT EXISTS (SELECT 1 FROM preds b
    WHERE a.model = b.model AND a.problem = b.problem
      AND b.p1 <= a.p1 AND b.p2 <= a.p2 AND (b.p1 < a.p1 OR b.p2 < a.p2))),
  j AS (SELECT coalesce(tf.model, pf.model) AS model, coalesce(tf.problem, pf.problem) AS problem,
      tf.id IS NOT NULL AS t, pf.id IS NOT NULL AS p
    FROM tf FULL JOIN pf ON tf.model = pf.model AND tf.problem = pf.problem AND tf.id = pf.id),
  agree AS (SELECT model, problem, count(*) FILTER (t) AS n_true, count(*) FILTER (p) AS n_pred,
      count(*) FILTER (t AND p) AS n_both, count(*) FILTER (t AND p) / nullif(count(*) FILTER (p), 0) AS precision,
      count(*) FILTER (t AND p) / nullif(count(*) FILTER (t), 0) AS recall,
      count(*) FILTER (t AND p) / count(*) AS jaccard
    FROM j GROUP BY ALL)"""


def _agreement(spark, folder):
    preds = I.predictions(spark, folder)
    # The true front does not depend on the model: find it once, then label it.
    true = M.front2(I.parts(spark, folder), ["problem"], "f1", "f2").select(
        "problem", "id", F.explode(F.array(*[F.lit(m) for m in I.MODELS])).alias("model")
    )
    pred = M.front2(preds, _MP, "p1", "p2")
    return L.front_agreement(true, pred, _MP, ["id"])


@query(f"WITH {_FRONTS} SELECT * FROM agree", ["precision", "recall", "jaccard"])
def front_agreement(spark, folder):
    return _agreement(spark, folder)


@query(
    f"""WITH {_FRONTS}, e AS (SELECT model, problem, sqrt(avg(pow(t1 - p1, 2))) AS r1, sqrt(avg(pow(t2 - p2, 2))) AS r2
      FROM preds GROUP BY ALL)
    SELECT model, count(*) AS problems, avg(precision) AS precision, avg(recall) AS recall, avg(jaccard) AS jaccard,
      avg(r1) AS rmse_f1, avg(r2) AS rmse_f2 FROM agree JOIN e USING (model, problem) GROUP BY model""",
    ["precision", "recall", "jaccard", "rmse_f1", "rmse_f2"],
)
def surrogate_report(spark, folder):
    """Per model: how well its predicted front matches the true one, and its error."""
    error = I.predictions(spark, folder).groupBy(*_MP).agg(
        *E.error_columns("t1", "p1", "_f1"), *E.error_columns("t2", "p2", "_f2")
    )
    return (
        _agreement(spark, folder)
        .join(error, _MP)
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("problems"),
            *[F.avg(c).alias(c) for c in ("precision", "recall", "jaccard", "rmse_f1", "rmse_f2")],
        )
    )


_AREA = """SELECT model, problem, sum((1000 - t1) * (coalesce(low, 0) - t2)) AS {name} FROM (
    SELECT *, min(t2) OVER (PARTITION BY model, problem ORDER BY t1
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
    FROM (SELECT model, problem, t1, min(t2) AS t2 FROM {rows} WHERE t1 < 1000 AND t2 < 0 GROUP BY ALL))
  WHERE low IS NULL OR t2 < low GROUP BY ALL"""


@query(
    f"""WITH {_FRONTS}, a AS ({_AREA.format(name="hv_true", rows="preds")}),
      b AS ({_AREA.format(name="hv_pred", rows="(preds SEMI JOIN pf USING (model, problem, id))")})
    SELECT model, problem, hv_true, hv_pred, hv_pred / hv_true AS retained FROM a JOIN b USING (model, problem)""",
    ["hv_true", "hv_pred", "retained"],
)
def hypervolume_retained(spark, folder):
    return L.hv_retained(I.predictions(spark, folder), _MP, ["t1", "t2"], ["p1", "p2"], (1000.0, 0.0))


@query(
    f"""WITH {I.LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY model, objective, problem ORDER BY y, id) AS a,
        row_number() OVER (PARTITION BY model, objective, problem ORDER BY yhat, id) AS b FROM long)
    SELECT model, objective, problem, count(*) FILTER (a <= 10) AS k,
      count(*) FILTER (a <= 10 AND b <= 10) / count(*) FILTER (a <= 10) AS topk_recall,
      max(y) FILTER (b = 1) - min(y) AS regret FROM r GROUP BY model, objective, problem""",
    ["topk_recall", "regret"],
)
def topk_recall(spark, folder):
    return L.topk(I.long_predictions(spark, folder), ["model", "objective", "problem"], ["id"], 10)


_CURVE = f"""{I.EVALS}, curve AS (SELECT algorithm, run, event_id, value,
    row_number() OVER w AS step, min(value) OVER w AS best
  FROM evals WINDOW w AS (PARTITION BY algorithm, run ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _curve(spark, folder):
    return L.anytime(I.evals(spark, folder), ["algorithm", "run"], ["ts", "event_id"]).drop("ts")


@query(f"WITH {_CURVE} SELECT * FROM curve")
def anytime_curve(spark, folder):
    return _curve(spark, folder)


@query(
    f"""WITH {_CURVE} SELECT algorithm, run, count(*) AS steps, min(step) FILTER (best <= 5) AS first_step,
      avg(best) AS mean_best FROM curve GROUP BY algorithm, run""",
    ["mean_best"],
)
def steps_to_target(spark, folder):
    return L.to_target(_curve(spark, folder), ["algorithm", "run"], 5.0)


_REL = "CASE WHEN a.{x}1 <= b.{x}1 AND a.{x}2 <= b.{x}2 AND (a.{x}1 < b.{x}1 OR a.{x}2 < b.{x}2) THEN 1 " \
    "WHEN b.{x}1 <= a.{x}1 AND b.{x}2 <= a.{x}2 AND (b.{x}1 < a.{x}1 OR b.{x}2 < a.{x}2) THEN -1 ELSE 0 END"


@query(
    f"""WITH {I.PREDICTIONS}, r AS (SELECT a.model, a.problem, {_REL.format(x="t")} AS rt, {_REL.format(x="p")} AS rp
      FROM preds a JOIN preds b ON a.model = b.model AND a.problem = b.problem AND a.id < b.id)
    SELECT model, problem, count(*) AS pairs, count(*) FILTER (rt = rp) AS unchanged, avg((rt = rp)::INTEGER) AS share
    FROM r GROUP BY model, problem""",
    ["share"],
)
def pair_order(spark, folder):
    return L.pair_order(I.predictions(spark, folder), _MP, ["t1", "t2"], ["p1", "p2"])


@query(
    f"""WITH {I.PARTIAL}, r AS (SELECT *, row_number() OVER (PARTITION BY model, problem ORDER BY y, id) AS a,
      row_number() OVER (PARTITION BY model, problem ORDER BY yhat, id) AS b FROM whole)
    SELECT model, problem, count(*) FILTER (a <= 5) AS k,
      count(*) FILTER (a <= 5 AND b <= 5) / nullif(count(*) FILTER (a <= 5), 0) AS topk_recall,
      max(y) FILTER (b = 1) - min(y) AS regret
    FROM groups LEFT JOIN r USING (model, problem) GROUP BY model, problem""",
    ["topk_recall", "regret"],
)
def topk_of_incomplete(spark, folder):
    """A row without a prediction is not predicted best."""
    return L.topk(I.partial_predictions(spark, folder), ["model", "problem"], ["id"], 5)


def _half_known(name: str):
    return F.when(F.col("id") % 5 != 2, F.col(name)).alias(name)


@query(
    f"""WITH {I.PREDICTIONS}, q AS (SELECT model, problem, id, t1, t2, p1,
        CASE WHEN id % 5 <> 2 THEN p2 END AS p2 FROM preds),
      r AS (SELECT a.model, a.problem,
        CASE WHEN a.t1 <= b.t1 AND a.t2 <= b.t2 AND (a.t1 < b.t1 OR a.t2 < b.t2) THEN 1
          WHEN b.t1 <= a.t1 AND b.t2 <= a.t2 AND (b.t1 < a.t1 OR b.t2 < a.t2) THEN -1 ELSE 0 END AS t,
        CASE WHEN a.p1 <= b.p1 AND a.p2 <= b.p2 AND (a.p1 < b.p1 OR a.p2 < b.p2) THEN 1
          WHEN b.p1 <= a.p1 AND b.p2 <= a.p2 AND (b.p1 < a.p1 OR b.p2 < a.p2) THEN -1 ELSE 0 END AS p
        FROM q a JOIN q b ON a.model = b.model AND a.problem = b.problem AND a.id < b.id
        WHERE a.p2 IS NOT NULL AND b.p2 IS NOT NULL)
    SELECT g.model, g.problem, count(t) AS pairs, count(*) FILTER (t = p) AS unchanged,
      count(*) FILTER (t = p) / nullif(count(t), 0) AS share
    FROM (SELECT DISTINCT model, problem FROM q) g LEFT JOIN r USING (model, problem) GROUP BY ALL""",
    ["share"],
)
def pair_order_of_incomplete(spark, folder):
    df = I.predictions(spark, folder).withColumn("p2", _half_known("p2"))
    return L.pair_order(df, ["model", "problem"], ["t1", "t2"], ["p1", "p2"])
