"""Inputs derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_number, uniform
from ..operators.contract import orient
from ..sources.tables import load

# Three made surrogates: the truth with noise of this relative width.
MODELS = {"m1": 0.02, "m2": 0.1, "m3": 0.4}


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of two objectives: cheap and large parts, one problem per brand."""
    df = load(spark, folder, "part").select(
        F.col("p_brand").alias("problem"),
        F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("f1"),
        F.col("p_size").alias("f2"),
    )
    return orient(df, {"f1": "min", "f2": "max"})


PARTS = """parts AS (
  SELECT p_brand AS problem, p_partkey AS id,
         p_retailprice AS f1, -p_size::DOUBLE AS f2
  FROM part)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of three objectives, one problem per supplier."""
    df = load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("problem"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_extendedprice").alias("f1"),
        F.col("l_quantity").alias("f2"),
        F.col("l_discount").alias("f3"),
    )
    return orient(df, {"f1": "min", "f2": "max", "f3": "max"})


LINES = """lines AS (
  SELECT l_suppkey AS problem, l_orderkey, l_linenumber, l_partkey,
         l_extendedprice AS f1, -l_quantity AS f2, -l_discount AS f3
  FROM lineitem)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """True (t1, t2) and predicted (p1, p2) objectives of every part by every model."""
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(s).alias("s")) for m, s in MODELS.items()]
    )
    df = parts(spark, folder).select(
        "problem", "id", F.col("f1").alias("t1"), F.col("f2").alias("t2"), F.inline(models)
    )

    def noisy(k: int):
        u = uniform(F.col("model"), F.lit(k), F.col("id"))
        return (F.col(f"t{k}") * (1 + F.col("s") * (u - 0.5))).alias(f"p{k}")

    return df.select("model", "problem", "id", "t1", "t2", noisy(1), noisy(2))


def _noisy_sql(k: int) -> str:
    u = f"(('0x' || substr(md5(model || ':{k}:' || id), 1, 8))::BIGINT / 4294967296.0)"
    return f"t{k} * (1 + s * ({u} - 0.5)) AS p{k}"


PREDICTIONS = f"""{PARTS}, preds AS (
  SELECT model, problem, id, t1, t2, {_noisy_sql(1)}, {_noisy_sql(2)}
  FROM (SELECT problem, id, f1 AS t1, f2 AS t2 FROM parts),
       (VALUES {", ".join(f"('{m}', {s}::DOUBLE)" for m, s in MODELS.items())}) v(model, s))"""


def long_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model, part and objective: y, yhat and a fold by part."""
    df = predictions(spark, folder).select(
        "model",
        "problem",
        "id",
        (hash_number(F.lit(7), F.col("id")) % 5).cast("int").alias("fold"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"f{k}").alias("objective"),
                        F.col(f"t{k}").alias("y"),
                        F.col(f"p{k}").alias("yhat"),
                    )
                    for k in (1, 2)
                ]
            )
        ),
    )
    return df


LONG = f"""{PREDICTIONS}, long AS (
  SELECT model, problem, id,
         (('0x' || substr(md5('7:' || id), 1, 8))::BIGINT % 5)::INTEGER AS fold,
         objective, y, yhat
  FROM (SELECT *, 'f1' AS objective, t1 AS y, p1 AS yhat FROM preds
        UNION ALL
        SELECT *, 'f2' AS objective, t2 AS y, p2 AS yhat FROM preds))"""


def _unknown(name: str, every: int):
    """A value that some rows lack."""
    return F.when(hash_number(F.lit(name), F.col("model"), F.col("id")) % every != 0, F.col(name)).alias(name)


def partial_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of which some lack the true value, some the predicted one, one model all."""
    df = long_predictions(spark, folder).where("objective = 'f1'").select(
        "model", "problem", "id", _unknown("y", 7), _unknown("yhat", 3)
    )
    lost = (F.col("model") == "m3") & F.col("problem").endswith("1")
    return df.withColumn("yhat", F.when(~lost, F.col("yhat")))


def _unknown_sql(name: str, every: int) -> str:
    number = f"('0x' || substr(md5('{name}:' || model || ':' || id), 1, 8))::BIGINT"
    return f"CASE WHEN {number} % {every} <> 0 THEN {name} END AS {name}"


PARTIAL = f"""{LONG}, partial AS (
  SELECT model, problem, id, y, CASE WHEN NOT (model = 'm3' AND problem LIKE '%1') THEN yhat END AS yhat
  FROM (SELECT model, problem, id, {_unknown_sql("y", 7)}, {_unknown_sql("yhat", 3)}
        FROM long WHERE objective = 'f1')),
whole AS (SELECT * FROM partial WHERE y IS NOT NULL AND yhat IS NOT NULL),
groups AS (SELECT DISTINCT model, problem FROM partial)"""


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """RMSE of each model per problem, over both objectives as one column each."""
    e = F.col("y") - F.col("yhat")
    return (
        long_predictions(spark, folder)
        .groupBy("problem", "model", "objective")
        .agg(F.sqrt(F.avg(e * e)).alias("value"))
    )


METRICS = f"""{LONG}, metrics AS (
  SELECT problem, model, objective, sqrt(avg((y - yhat) * (y - yhat))) AS value
  FROM long GROUP BY ALL)"""


def evals(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation log: a run per user and event type, in order of time."""
    return load(spark, folder, "events").select(
        F.col("event_type").alias("algorithm"),
        F.col("user_id").alias("run"),
        F.col("ts"),
        F.col("event_id"),
        F.col("value"),
    )


EVALS = """evals AS (
  SELECT event_type AS algorithm, user_id AS run, ts, event_id, value FROM events)"""

# Dominance of b over a, spelled out.
DOM2 = "b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2)"
DOM3 = (
    "b.f1 <= a.f1 AND b.f2 <= a.f2 AND b.f3 <= a.f3 "
    "AND (b.f1 < a.f1 OR b.f2 < a.f2 OR b.f3 < a.f3)"
)
FRONT2 = f"""front2 AS (
  SELECT * FROM parts a WHERE NOT EXISTS (
    SELECT 1 FROM parts b WHERE b.problem = a.problem AND {DOM2}))"""
FRONT3 = f"""front3 AS (
  SELECT * FROM lines a WHERE NOT EXISTS (
    SELECT 1 FROM lines b WHERE b.problem = a.problem AND {DOM3}))"""
# One front over all brands, as the reference front.
WHOLE_FRONT2 = f"""ref2 AS (
  SELECT DISTINCT f1, f2 FROM parts a WHERE NOT EXISTS (SELECT 1 FROM parts b WHERE {DOM2}))"""
