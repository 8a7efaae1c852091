"""Front quality."""

from __future__ import annotations

from ..operators import fronts as M
from ..operators import indicators as Q
from . import inputs as I
from .registry import query

_P, _O2, _O3 = ["problem"], ["f1", "f2"], ["f1", "f2", "f3"]


def _front2(spark, folder):
    return M.front2(I.parts(spark, folder), _P, "f1", "f2")


def _reference(spark, folder):
    return M.front2(I.parts(spark, folder), [], "f1", "f2").select("f1", "f2").distinct()


@query(
    f"""WITH {I.PARTS}, {I.FRONT2}, d AS (SELECT DISTINCT problem, f1, f2 FROM front2 WHERE f1 < 950 AND f2 < -5),
      s AS (SELECT problem, (950 - f1) * (coalesce(lag(f2) OVER (PARTITION BY problem ORDER BY f1), -5) - f2) AS a FROM d)
    SELECT problem, coalesce(sum(a), 0) AS hv FROM (SELECT DISTINCT problem FROM parts) LEFT JOIN s USING (problem)
    GROUP BY problem""",
    ["hv"],
)
def hypervolume_2d(spark, folder):
    # the reference point excludes part of the front
    return Q.hv2(I.parts(spark, folder), _P, _O2, (950.0, -5.0))


# Volume by slices of the third objective, from the definition.
_HV3 = f"""{I.LINES}, {I.FRONT3}, d AS (SELECT DISTINCT problem, f1, f2, f3 FROM front3
    WHERE f1 < 60000 AND f2 < -1 AND f3 < 0),
  z AS (SELECT DISTINCT problem, f3 AS z FROM d),
  zz AS (SELECT *, coalesce(lead(z) OVER (PARTITION BY problem ORDER BY z), 0) - z AS h FROM z),
  b AS (SELECT d.problem, zz.z, zz.h, d.f1, min(d.f2) AS f2 FROM d JOIN zz ON d.problem = zz.problem AND d.f3 <= zz.z
    GROUP BY ALL),
  st AS (SELECT *, min(f2) OVER (PARTITION BY problem, z ORDER BY f1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS low FROM b),
  a AS (SELECT problem, z, h, sum((60000 - f1) * (coalesce(low, -1) - f2)) AS area FROM st
    WHERE low IS NULL OR f2 < low GROUP BY ALL)"""


@query(
    f"""WITH {_HV3} SELECT problem, coalesce(sum(area * h), 0) AS hv
    FROM (SELECT DISTINCT problem FROM lines) LEFT JOIN a USING (problem) GROUP BY problem""",
    ["hv"],
)
def hypervolume_3d(spark, folder):
    return Q.hv3(I.lines(spark, folder), _P, _O3, (60000.0, -1.0, 0.0))


@query(
    f"""WITH {I.PARTS}, {I.FRONT2}, d AS (SELECT DISTINCT problem, f1, f2 FROM front2 WHERE f1 < 1000 AND f2 < 0)
    SELECT problem, f1, f2, (coalesce(lead(f1) OVER w, 1000) - f1) * (coalesce(lag(f2) OVER w, 0) - f2) AS contribution
    FROM d WINDOW w AS (PARTITION BY problem ORDER BY f1)""",
    ["contribution"],
)
def hypervolume_contribution(spark, folder):
    return Q.hv2_contrib(I.parts(spark, folder), _P, _O2, (1000.0, 0.0))


_NEAR = f"""{I.PARTS}, {I.FRONT2}, {I.WHOLE_FRONT2}, p AS (
    SELECT DISTINCT problem, a.f1 AS a1, a.f2 AS a2, r.f1 AS z1, r.f2 AS z2 FROM front2 a, ref2 r)"""


@query(
    f"""WITH {_NEAR}, m AS (SELECT problem, a1, a2, min(sqrt(pow(a1 - z1, 2) + pow(a2 - z2, 2))) AS d,
      min(sqrt(pow(greatest(a1 - z1, 0), 2) + pow(greatest(a2 - z2, 0), 2))) AS dp FROM p GROUP BY ALL)
    SELECT problem, avg(d) AS gd, avg(dp) AS gd_plus FROM m GROUP BY problem""",
    ["gd", "gd_plus"],
)
def generational_distance(spark, folder):
    return Q.gd(_front2(spark, folder), _reference(spark, folder), _P, _O2)


@query(
    f"""WITH {_NEAR}, m AS (SELECT problem, z1, z2, min(sqrt(pow(a1 - z1, 2) + pow(a2 - z2, 2))) AS d,
      min(sqrt(pow(greatest(a1 - z1, 0), 2) + pow(greatest(a2 - z2, 0), 2))) AS dp FROM p GROUP BY ALL)
    SELECT problem, avg(d) AS igd, avg(dp) AS igd_plus FROM m GROUP BY problem""",
    ["igd", "igd_plus"],
)
def inverted_generational_distance(spark, folder):
    return Q.igd(_front2(spark, folder), _reference(spark, folder), _P, _O2)


@query(
    f"""WITH {_NEAR}, m AS (SELECT problem, z1, z2, min(greatest(a1 - z1, a2 - z2)) AS c FROM p GROUP BY ALL)
    SELECT problem, max(c) AS eps FROM m GROUP BY problem""",
    ["eps"],
)
def epsilon_indicator(spark, folder):
    return Q.eps_ind(_front2(spark, folder), _reference(spark, folder), _P, _O2)


@query(
    f"""WITH {I.LINES}, {I.FRONT3}, u AS (SELECT row_number() OVER () AS n, * FROM front3),
      g AS (SELECT a.problem, a.n, min(abs(a.f1 - b.f1) + abs(a.f2 - b.f2) + abs(a.f3 - b.f3)) AS d
        FROM u a LEFT JOIN u b ON a.problem = b.problem AND a.n <> b.n GROUP BY a.problem, a.n)
    SELECT problem, CASE WHEN count(*) > 1 THEN stddev_samp(d) END AS spacing FROM g GROUP BY problem""",
    ["spacing"],
)
def front_spacing(spark, folder):
    return Q.spacing(M.front(I.lines(spark, folder), _P, _O3), _P, _O3)


@query(
    f"""WITH {I.PREDICTIONS}, pf AS (SELECT DISTINCT model, problem, t1 AS f1, t2 AS f2 FROM preds a WHERE NOT EXISTS (
        SELECT 1 FROM preds b WHERE a.model = b.model AND a.problem = b.problem
          AND b.p1 <= a.p1 AND b.p2 <= a.p2 AND (b.p1 < a.p1 OR b.p2 < a.p2)))
    SELECT y.problem, x.model AS a, y.model AS b, avg(CASE WHEN EXISTS (SELECT 1 FROM pf s WHERE s.problem = y.problem
      AND s.model = x.model AND s.f1 <= y.f1 AND s.f2 <= y.f2) THEN 1.0 ELSE 0.0 END) AS coverage
    FROM pf y JOIN (SELECT DISTINCT model FROM pf) x ON x.model <> y.model GROUP BY ALL""",
    ["coverage"],
)
def set_coverage(spark, folder):
    # true objectives of each model's predicted front
    picked = M.front2(I.predictions(spark, folder), ["model", "problem"], "p1", "p2")
    picked = picked.withColumnsRenamed({"t1": "f1", "t2": "f2"})
    return Q.coverage(picked, _P, "model", _O2)


WEIGHTS = [(w / 10, 1 - w / 10) for w in range(0, 11)]
_WEIGHTS_SQL = "(VALUES " + ", ".join(
    f"({i + 1}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(WEIGHTS)
) + ") w(weight, w1, w2)"


@query(
    f"""WITH {I.PARTS}, v AS (SELECT problem, weight, id, w1 * f1 + w2 * f2 AS value FROM parts, {_WEIGHTS_SQL})
    SELECT problem, weight, min(struct_pack(v := value, id := id)).id AS id, min(value) AS value
    FROM v GROUP BY problem, weight""",
    ["value"],
)
def weighted_sum_best(spark, folder):
    return Q.scalarise(I.parts(spark, folder), _P, _O2, "id", WEIGHTS, "sum")


@query(
    f"""WITH {I.PARTS}, i AS (SELECT problem, min(f1) AS i1, min(f2) AS i2 FROM parts GROUP BY problem),
      v AS (SELECT problem, weight, id, greatest(w1 * (f1 - i1), w2 * (f2 - i2)) AS value
        FROM parts JOIN i USING (problem), {_WEIGHTS_SQL})
    SELECT problem, weight, min(struct_pack(v := value, id := id)).id AS id, min(value) AS value
    FROM v GROUP BY problem, weight""",
    ["value"],
)
def tchebycheff_best(spark, folder):
    return Q.scalarise(I.parts(spark, folder), _P, _O2, "id", WEIGHTS, "tcheby")


@query(
    f"""WITH {I.PARTS}, {I.FRONT2}, e AS (SELECT problem, min(f1) AS x0, max(f2) AS y0, max(f1) AS x1, min(f2) AS y1
        FROM front2 GROUP BY problem),
      d AS (SELECT problem, id, f1, f2, CASE WHEN x0 = x1 THEN 0 ELSE abs((x1 - x0) * (f2 - y0) - (y1 - y0) * (f1 - x0))
        / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) END AS distance FROM front2 JOIN e USING (problem))
    SELECT problem, id, f1, f2, distance FROM (SELECT *, row_number() OVER (PARTITION BY problem
      ORDER BY round(distance, 9) DESC, id) AS place FROM d) WHERE place = 1""",
    ["distance"],
)
def knee_point(spark, folder):
    return Q.knee(_front2(spark, folder), _P, "f1", "f2", "id")


@query(
    f"""WITH {I.PARTS}, g AS (SELECT 900.0::DOUBLE + 10 * i AS x, -50.0::DOUBLE + 5 * j AS y FROM range(11) a(i), range(11) b(j)),
      h AS (SELECT x, y, problem, EXISTS (SELECT 1 FROM parts p WHERE p.problem = r.problem AND p.f1 <= x AND p.f2 <= y) AS hit
        FROM g, (SELECT DISTINCT problem FROM parts) r)
    SELECT x, y, count(*) FILTER (hit) AS attained, avg(hit::INTEGER) AS share FROM h GROUP BY x, y""",
    ["share"],
)
def attainment_surface(spark, folder):
    xs = [900.0 + 10 * i for i in range(11)]
    ys = [-50.0 + 5 * j for j in range(11)]
    return Q.attainment(I.parts(spark, folder), [], "problem", "f1", "f2", xs, ys)
