"""Dominance, fronts, ranks and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fronts as M
from . import inputs as I
from .registry import query

_P, _O2, _O3 = ["problem"], ["f1", "f2"], ["f1", "f2", "f3"]


@query(
    f"""WITH {I.PARTS}, p AS (SELECT a.problem, a.id AS worse, b.id AS better
      FROM parts a JOIN parts b ON a.problem = b.problem AND {I.DOM2})
    SELECT problem, id, f1, f2,
      (SELECT count(*) FROM p WHERE p.worse = parts.id) AS dominators,
      (SELECT count(*) FROM p WHERE p.better = parts.id) AS dominated FROM parts"""
)
def dominance_counts(spark, folder):
    return M.dominance(I.parts(spark, folder), _P, _O2)


@query(
    f"""WITH {I.LINES}, u AS (SELECT row_number() OVER () AS n, * FROM lines),
      p AS (SELECT a.n AS worse, b.n AS better FROM u a JOIN u b ON a.problem = b.problem AND {I.DOM3}),
      w AS (SELECT worse AS n, count(*) AS c FROM p GROUP BY 1),
      b AS (SELECT better AS n, count(*) AS c FROM p GROUP BY 1)
    SELECT problem, l_orderkey, l_linenumber, l_partkey, f1, f2, f3,
      coalesce(w.c, 0) AS dominators, coalesce(b.c, 0) AS dominated
    FROM u LEFT JOIN w USING (n) LEFT JOIN b USING (n)"""
)
def dominance_counts_3d(spark, folder):
    return M.dominance(I.lines(spark, folder), _P, _O3)


@query(
    f"""WITH {I.LINES}, u AS (SELECT row_number() OVER () AS n, l_orderkey * 100 + l_linenumber AS id, * FROM lines),
      w AS (SELECT a.n, arg_min(b.id, (b.f1, b.f2, b.f3, b.id)) AS dominator
        FROM u a JOIN u b ON a.problem = b.problem AND {I.DOM3} GROUP BY a.n)
    SELECT problem, l_partkey, id, f1, f2, f3, dominator FROM u LEFT JOIN w USING (n)"""
)
def dominating_witness(spark, folder):
    """For each dominated row one row that dominates it."""
    df = I.lines(spark, folder).withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return M.witness(df.drop("l_orderkey", "l_linenumber"), _P, _O3, "id")


@query(f"WITH {I.PARTS}, {I.FRONT2} SELECT * FROM front2")
def front_2d(spark, folder):
    return M.front2(I.parts(spark, folder), _P, "f1", "f2")


@query(f"WITH {I.LINES}, {I.FRONT3} SELECT * FROM front3")
def front_3d(spark, folder):
    return M.front(I.lines(spark, folder), _P, _O3)


@query(
    f"""WITH {I.LINES}, v AS (SELECT f2, f3, min(f1) AS f1 FROM lines GROUP BY f2, f3),
      k AS (SELECT f1, f2, f3 FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE {I.DOM3}))
    SELECT lines.* FROM lines SEMI JOIN k USING (f1, f2, f3)"""
)
def front_3d_whole(spark, folder):
    return M.front(I.lines(spark, folder), [], _O3)


@query(
    f"""WITH {I.PARTS} SELECT * FROM parts a WHERE NOT EXISTS (SELECT 1 FROM parts b
      WHERE b.problem = a.problem AND b.f1 + 2 <= a.f1 AND b.f2 + 2 <= a.f2)"""
)
def front_widened(spark, folder):
    return M.front_eps(I.parts(spark, folder), _P, _O2, 2.0)


@query(
    f"""WITH {I.LINES} SELECT * FROM lines a WHERE NOT EXISTS (SELECT 1 FROM lines b
      WHERE b.problem = a.problem AND b.f1 < a.f1 AND b.f2 < a.f2 AND b.f3 < a.f3)"""
)
def front_weak(spark, folder):
    return M.front_weak(I.lines(spark, folder), _P, _O3)


# 1 + the longest chain of dominators, found front by front
_RANKED = f"""{I.PARTS}, p AS (SELECT a.id AS worse, b.id AS better
    FROM parts a JOIN parts b ON a.problem = b.problem AND {I.DOM2}),
  chain AS (SELECT id, 1 AS rank FROM parts
    UNION SELECT p.worse, chain.rank + 1 FROM chain JOIN p ON p.better = chain.id),
  ranked AS (SELECT parts.*, (SELECT max(rank) FROM chain WHERE chain.id = parts.id)::BIGINT AS rank FROM parts)"""


@query(f"WITH RECURSIVE {_RANKED} SELECT * FROM ranked")
def nondominated_rank(spark, folder):
    return M.nd_rank(I.parts(spark, folder), _P, _O2)


@query(
    f"""WITH RECURSIVE {I.LINES}, u AS (SELECT row_number() OVER () AS n, * FROM lines),
      p AS (SELECT a.n AS worse, b.n AS better FROM u a JOIN u b ON a.problem = b.problem AND {I.DOM3}),
      chain AS (SELECT n, 1 AS rank FROM u UNION SELECT p.worse, chain.rank + 1 FROM chain JOIN p ON p.better = chain.n),
      r AS (SELECT n, max(rank)::BIGINT AS rank FROM chain GROUP BY n)
    SELECT problem, l_orderkey, l_linenumber, l_partkey, f1, f2, f3, rank FROM u JOIN r USING (n)"""
)
def nondominated_rank_3d(spark, folder):
    return M.nd_rank(I.lines(spark, folder), _P, _O3)


_CROWDED = f"""{_RANKED}, gaps AS (SELECT *,
    lead(f1) OVER o1 - lag(f1) OVER o1 AS g1, lead(f2) OVER o2 - lag(f2) OVER o2 AS g2,
    max(f1) OVER g - min(f1) OVER g AS w1, max(f2) OVER g - min(f2) OVER g AS w2, count(*) OVER g AS n
    FROM ranked WINDOW g AS (PARTITION BY problem, rank), o1 AS (PARTITION BY problem, rank ORDER BY f1, id),
      o2 AS (PARTITION BY problem, rank ORDER BY f2, id)),
  crowded AS (SELECT problem, id, f1, f2, rank,
    CASE WHEN n = 1 THEN 'inf'::DOUBLE
      ELSE CASE WHEN w1 = 0 THEN 0 ELSE coalesce(g1 / w1, 'inf'::DOUBLE) END
         + CASE WHEN w2 = 0 THEN 0 ELSE coalesce(g2 / w2, 'inf'::DOUBLE) END END AS crowding FROM gaps)"""


def _crowded(spark, folder):
    ranked = M.nd_rank(I.parts(spark, folder), _P, _O2)
    return M.crowding(ranked, ["problem", "rank"], _O2, ["id"])


@query(f"WITH RECURSIVE {_CROWDED} SELECT * FROM crowded", ["crowding"])
def crowding_distance(spark, folder):
    return _crowded(spark, folder)


@query(
    f"""WITH RECURSIVE {_CROWDED}, placed AS (SELECT *, row_number() OVER (PARTITION BY problem
        ORDER BY rank, round(crowding, 9) DESC, id)::INTEGER AS place FROM crowded)
    SELECT problem, id, rank, crowding, place FROM placed WHERE place <= 20""",
    ["crowding"],
)
def selection(spark, folder):
    # distances equal but for the last bits must not be ordered by them
    near = _crowded(spark, folder).withColumn("crowding", F.round("crowding", 9))
    return M.select_n(near, _P, 20, ["id"]).select("problem", "id", "rank", "crowding", "place")


@query(
    f"""WITH {I.LINES}, {I.FRONT3} SELECT problem, i1 AS ideal_f1, i2 AS ideal_f2, i3 AS ideal_f3,
      max(f1) AS nadir_f1, max(f2) AS nadir_f2, max(f3) AS nadir_f3
    FROM front3 JOIN (SELECT problem, min(f1) AS i1, min(f2) AS i2, min(f3) AS i3 FROM lines GROUP BY problem)
      USING (problem) GROUP BY problem, i1, i2, i3"""
)
def ideal_and_nadir(spark, folder):
    return M.ideal_nadir(I.lines(spark, folder), _P, _O3)


@query(
    f"""WITH {I.PARTS}, v AS (SELECT *, greatest(f1 - 905, 0) AS viol FROM parts)
    SELECT problem, id, f1, f2, viol FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b
      WHERE b.problem = a.problem AND (b.viol < a.viol OR (b.viol = a.viol AND {I.DOM2})))""",
    ["viol"],
)
def constrained_front(spark, folder):
    df = I.parts(spark, folder).withColumn("viol", F.greatest(F.col("f1") - 905, F.lit(0.0)))
    return M.front_constrained(df, _P, _O2, "viol")
