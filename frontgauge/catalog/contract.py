"""Reading, checking, scaling, folding and writing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import contract, design
from ..session import use_checkpoint_dir
from ..sources.tables import load, write
from . import inputs as I
from .registry import query


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def load_table(spark, folder):
    return load(spark, folder, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )


@query(f"WITH {I.LINES} SELECT * FROM lines")
def orient_objectives(spark, folder):
    return I.lines(spark, folder)


_FLAWED = """flawed AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS f1,
         CASE WHEN l_discount = 0 THEN NULL
              WHEN l_tax = 0 THEN 'nan'::DOUBLE
              WHEN l_quantity = 50 THEN 'inf'::DOUBLE
              ELSE l_extendedprice END AS f2,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
  FROM lineitem), marked AS (
  SELECT *, CASE WHEN f2 IS NULL THEN 'null objective'
                 WHEN isnan(f2) THEN 'nan objective'
                 WHEN isinf(f2) THEN 'infinite objective'
                 WHEN n > 1 THEN 'duplicate key' END AS reason
  FROM flawed)"""


def _flawed(spark, folder):
    f2 = (
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double"))
        .when(F.col("l_tax") == 0, F.lit(float("nan")))
        .when(F.col("l_quantity") == 50, F.lit(float("inf")))
        .otherwise(F.col("l_extendedprice"))
    )
    return load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("f1"), f2.alias("f2")
    )


@query(f"WITH {_FLAWED} SELECT l_orderkey, l_linenumber, f1, f2 FROM marked WHERE reason IS NULL")
def validate_usable(spark, folder):
    good, _ = contract.validate(_flawed(spark, folder), ["l_orderkey", "l_linenumber"], ["f1", "f2"])
    return good


@query(f"WITH {_FLAWED} SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY reason")
def validate_rejects(spark, folder):
    _, bad = contract.validate(_flawed(spark, folder), ["l_orderkey", "l_linenumber"], ["f1", "f2"])
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {I.LINES}, w AS (SELECT *, min(f1) OVER g AS a1, max(f1) OVER g AS b1,
      min(f2) OVER g AS a2, max(f2) OVER g AS b2, min(f3) OVER g AS a3, max(f3) OVER g AS b3
      FROM lines WINDOW g AS (PARTITION BY problem))
    SELECT problem, l_orderkey, l_linenumber, l_partkey,
      CASE WHEN b1 > a1 THEN (f1 - a1) / (b1 - a1) ELSE 0 END AS f1,
      CASE WHEN b2 > a2 THEN (f2 - a2) / (b2 - a2) ELSE 0 END AS f2,
      CASE WHEN b3 > a3 THEN (f3 - a3) / (b3 - a3) ELSE 0 END AS f3 FROM w""",
    ["f1", "f2", "f3"],
)
def normalise(spark, folder):
    return contract.normalise(I.lines(spark, folder), ["problem"], ["f1", "f2", "f3"])


@query(
    f"""WITH {I.PARTS} SELECT 'full' AS source, problem, id, f1, f2 FROM parts
    UNION ALL SELECT 'halved', problem, id, f1 / 2, f2 / 2 FROM parts""",
    ["f1", "f2"],
)
def pool_runs(spark, folder):
    df = I.parts(spark, folder)
    half = df.withColumns({c: F.col(c) / 2 for c in ("f1", "f2")})
    return contract.pool({"full": df, "halved": half}, "source")


@query(f"WITH {I.METRICS} SELECT problem, model, objective, value FROM metrics", ["value"])
def write_results(spark, folder):
    path = f"{use_checkpoint_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    write(I.metrics(spark, folder), path, ["model"])
    return spark.read.parquet(path).select("problem", "model", "objective", "value")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      (('0x' || substr(md5('3:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT % 10)::INTEGER AS fold
    FROM lineitem"""
)
def k_folds(spark, folder):
    df = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return design.folds(df, ["l_orderkey", "l_linenumber"], 10, seed=3)


@query(
    """SELECT p_brand AS problem, p_partkey AS id,
      (('0x' || substr(md5('0:' || p_brand), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM part"""
)
def group_folds(spark, folder):
    return design.group_folds(I.parts(spark, folder).select("problem", "id"), ["problem"], 5)


@query(
    f"""WITH {I.LINES}, f AS (SELECT *, (('0x' || substr(md5('0:' || l_orderkey), 1, 8))::BIGINT % 5) <> 0 AS train
      FROM lines), s AS (SELECT problem, avg(f1) FILTER (train) AS m1, stddev_pop(f1) FILTER (train) AS s1,
        avg(f2) FILTER (train) AS m2, stddev_pop(f2) FILTER (train) AS s2 FROM f GROUP BY problem)
    SELECT problem, l_orderkey, l_linenumber, l_partkey,
      CASE WHEN s1 > 0 THEN (f1 - m1) / s1 ELSE 0 END AS f1,
      CASE WHEN s2 > 0 THEN (f2 - m2) / s2 ELSE 0 END AS f2 FROM f JOIN s USING (problem)""",
    ["f1", "f2"],
)
def standardise(spark, folder):
    df = design.folds(I.lines(spark, folder), ["l_orderkey"], 5).drop("f3")
    return design.standardise(df, ["f1", "f2"], F.col("fold") != 0, ["problem"]).drop("fold")


@query(
    """WITH s AS (SELECT s_nationkey AS nation, s_acctbal AS v,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place,
        count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
      d AS (SELECT nation, rep, floor(n * (('0x' || substr(md5('1:' || nation || ':' || rep || ':' || place),
        1, 8))::BIGINT / 4294967296.0))::BIGINT + 1 AS place FROM s, range(1, 51) r(rep))
    SELECT nation, rep::INTEGER AS rep, count(*) AS drawn, avg(v) AS mean
    FROM d JOIN s USING (nation, place) GROUP BY nation, rep""",
    ["mean"],
)
def bootstrap_means(spark, folder):
    df = load(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("v")
    )
    drawn = design.bootstrap(df, ["nation"], ["s_suppkey"], 50, seed=1)
    n = F.sum("times")
    return drawn.groupBy("nation", "rep").agg(
        n.alias("drawn"), (F.sum(F.col("times") * F.col("v")) / n).alias("mean")
    )
