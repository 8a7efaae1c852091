"""Models and algorithms against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..sources.tables import load
from . import inputs as I
from .registry import query


@query(
    f"""WITH {I.METRICS} SELECT CASE (grouping(problem) * 2 + grouping(model))::INTEGER WHEN 0 THEN 'problem, model'
        WHEN 1 THEN 'problem' WHEN 2 THEN 'model' ELSE 'all' END AS level, problem, model, count(value) AS n,
      avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
    FROM metrics GROUP BY CUBE (problem, model)""",
    ["mean", "std", "median", "iqr"],
)
def summary_levels(spark, folder):
    levels = {
        "problem, model": ["problem", "model"],
        "problem": ["problem"],
        "model": ["model"],
        "all": [],
    }
    return C.summary(I.metrics(spark, folder), levels, "value")


# With k = 5 algorithms there are 4 degrees of freedom, where the tail has a closed form.
_CHI2_P = """SELECT algorithm, problems, mean_rank, chi2,
      CASE WHEN k = 5 THEN exp(-chi2 / 2) * (1 + chi2 / 2) END AS p
    FROM (SELECT *, sum(12 * problems * pow(mean_rank - (k + 1) / 2.0, 2) / (k * (k + 1))) OVER () AS chi2 FROM m)"""
_USER_MEANS = f"""{I.EVALS}, means AS (SELECT run, algorithm, avg(value) AS value FROM evals GROUP BY ALL)"""


def _user_means(spark, folder):
    return I.evals(spark, folder).groupBy("run", "algorithm").agg(F.avg("value").alias("value"))


@query(
    f"""WITH {_USER_MEANS}, k AS (SELECT count(DISTINCT algorithm) AS k FROM means),
      r AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY value)
          + (count(*) OVER (PARTITION BY run, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY run) AS have FROM means),
      m AS (SELECT algorithm, count(*) AS problems, avg(rk) AS mean_rank, any_value(k) AS k FROM r, k WHERE have = k
        GROUP BY algorithm)
    {_CHI2_P}""",
    ["mean_rank", "chi2", "p"],
)
def average_ranks(spark, folder):
    return C.friedman(_user_means(spark, folder), "run", "algorithm", "value")


@query(
    f"""WITH {_USER_MEANS} SELECT x.algorithm AS a, y.algorithm AS b, count(*) FILTER (x.value < y.value) AS wins,
      count(*) FILTER (x.value = y.value) AS ties, count(*) FILTER (x.value > y.value) AS losses
    FROM means x JOIN means y ON x.run = y.run AND x.algorithm <> y.algorithm GROUP BY ALL"""
)
def win_tie_loss(spark, folder):
    return C.wtl(_user_means(spark, folder), ["run"], "algorithm", "value")


@query(
    f"""WITH {I.METRICS} SELECT problem, objective, avg(value) FILTER (model = 'm1') AS m1,
      avg(value) FILTER (model = 'm2') AS m2, avg(value) FILTER (model = 'm3') AS m3
    FROM metrics GROUP BY problem, objective""",
    ["m1", "m2", "m3"],
)
def leaderboard(spark, folder):
    return C.leaderboard(I.metrics(spark, folder), ["problem", "objective"], "model", "value", list(I.MODELS))


_TAIL = """(0.319381530 * t - 0.356563782 * pow(t, 2) + 1.781477937 * pow(t, 3)
    - 1.821255978 * pow(t, 4) + 1.330274429 * pow(t, 5)) * exp(-z * z / 2) / sqrt(2 * pi()) * 2"""


def _p_sql(rows: str) -> str:
    """Add the two-sided normal p-value of z by the same published formula."""
    tail = f"CASE WHEN z IS NOT NULL THEN least(1, {_TAIL}) END"
    return f"SELECT * EXCLUDE (t), {tail} AS p FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM {rows})"


# m1 against m2 on the absolute error of the same part
_DIFFS = f"""{I.LONG}, diffs AS (SELECT objective, problem, a.id, abs(a.y - a.yhat) - abs(b.y - b.yhat) AS d
    FROM long a JOIN long b USING (objective, problem, id) WHERE a.model = 'm1' AND b.model = 'm2')"""


def _signed(keys: str) -> str:
    return f"""ranks AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(d))
        + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0 AS r,
        count(*) OVER (PARTITION BY {keys}, abs(d)) AS t FROM diffs WHERE d <> 0),
    sums AS (SELECT {keys}, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus,
        coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, sum(t * t - 1) AS ties FROM ranks GROUP BY {keys}),
    zs AS (SELECT {keys}, n, w_plus, w_minus, (w_plus - n * (n + 1) / 4.0)
        / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM sums)"""


def _diffs(spark, folder):
    df = I.long_predictions(spark, folder)
    e = F.abs(F.col("y") - F.col("yhat"))
    wide = df.groupBy("objective", "problem", "id").agg(
        F.max(F.when(F.col("model") == "m1", e)).alias("a"), F.max(F.when(F.col("model") == "m2", e)).alias("b")
    )
    return wide.select("objective", "problem", "id", (F.col("a") - F.col("b")).alias("d"))


@query(f"WITH {_DIFFS}, {_signed('objective')} {_p_sql('zs')}", ["w_plus", "w_minus", "z", "p"])
def wilcoxon_signed_rank(spark, folder):
    return C.wilcoxon(_diffs(spark, folder), ["objective"], "d")


@query(
    f"""WITH {_DIFFS}, {_signed('objective, problem')}, ps AS ({_p_sql('zs')}),
      o AS (SELECT objective, problem, p, count(*) OVER (PARTITION BY objective) AS m,
        row_number() OVER (PARTITION BY objective ORDER BY p, problem) AS i FROM ps)
    SELECT objective, problem, p, max(least(1, (m - i + 1) * p)) OVER (PARTITION BY objective ORDER BY p, problem
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_holm FROM o""",
    ["p", "p_holm"],
)
def holm_correction(spark, folder):
    ps = C.wilcoxon(_diffs(spark, folder), ["objective", "problem"], "d").select("objective", "problem", "p")
    return C.holm(ps, ["objective"], "p", ["problem"])


@query(
    f"""WITH two AS (SELECT event_type = 'click' AS is_a, value FROM events WHERE event_type IN ('click', 'error')),
      r AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r,
        count(*) OVER (PARTITION BY value) AS t FROM two),
      s AS (SELECT count(*) FILTER (is_a) AS n_a, count(*) FILTER (NOT is_a) AS n_b, sum(r) FILTER (is_a) AS ra,
        sum(t * t - 1) AS ties, count(*) AS n FROM r),
      u AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u FROM s),
      zs AS (SELECT n_a, n_b, u, u / (n_a * n_b) AS a12, (u - n_a * n_b / 2.0)
        / sqrt(n_a * n_b / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)
    {_p_sql('zs')}""",
    ["u", "a12", "z", "p"],
)
def mann_whitney_a12(spark, folder):
    df = load(spark, folder, "events").select("event_type", "value")
    return C.a12(df, [], "event_type", "value", "click", "error")


# A metric that is undefined in many groups: the deviation of a single value is NULL.
_SPREADS = f"""{I.EVALS}, spreads AS (
  SELECT run, algorithm, stddev_samp(value) AS value FROM evals GROUP BY ALL)"""


def _spreads(spark, folder):
    return I.evals(spark, folder).groupBy("run", "algorithm").agg(F.stddev_samp("value").alias("value"))


@query(
    f"""WITH {_SPREADS} SELECT CASE (grouping(run) * 2 + grouping(algorithm))::INTEGER WHEN 1 THEN 'run'
        WHEN 2 THEN 'algorithm' ELSE 'all' END AS level, run, algorithm, count(value) AS n,
      avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
    FROM spreads GROUP BY GROUPING SETS ((run), (algorithm), ())""",
    ["mean", "std", "median", "iqr"],
)
def summary_of_undefined(spark, folder):
    levels = {"run": ["run"], "algorithm": ["algorithm"], "all": []}
    return C.summary(_spreads(spark, folder), levels, "value")


@query(
    f"""WITH {_SPREADS}, k AS (SELECT count(DISTINCT algorithm) AS k FROM spreads),
      r AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY value)
          + (count(*) OVER (PARTITION BY run, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY run) AS have
        FROM spreads WHERE value IS NOT NULL),
      m AS (SELECT algorithm, count(*) AS problems, avg(rk) AS mean_rank, any_value(k) AS k FROM r, k WHERE have = k
        GROUP BY algorithm)
    {_CHI2_P}""",
    ["mean_rank", "chi2", "p"],
)
def average_ranks_of_undefined(spark, folder):
    return C.friedman(_spreads(spark, folder), "run", "algorithm", "value")


def _a12_sql(rows: str, keys: str) -> str:
    """Statements up to zs: A12 of is_a against the others per key, NULL values left out."""
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value)
          + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0 AS r,
        count(*) OVER (PARTITION BY {keys}, value) AS t FROM {rows} WHERE value IS NOT NULL),
      s AS (SELECT {keys}, count(*) FILTER (is_a) AS n_a, count(*) FILTER (NOT is_a) AS n_b,
        coalesce(sum(r) FILTER (is_a), 0) AS ra, sum(t * t - 1) AS ties, count(*) AS n FROM r GROUP BY {keys}),
      u AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u FROM s),
      zs AS (SELECT {keys}, n_a, n_b, u, u / nullif(n_a * n_b, 0) AS a12, (u - n_a * n_b / 2.0)
        / nullif(sqrt(n_a * n_b / 12.0 * (n + 1 - ties / nullif(n * (n - 1), 0))), 0) AS z FROM u)"""


@query(
    f"""WITH {_SPREADS}, two AS (SELECT 0 AS one, algorithm = 'click' AS is_a, value FROM spreads
        WHERE algorithm IN ('click', 'error')), {_a12_sql('two', 'one')}
    SELECT * EXCLUDE (one) FROM ({_p_sql('zs')})""",
    ["u", "a12", "z", "p"],
)
def a12_of_undefined(spark, folder):
    return C.a12(_spreads(spark, folder), [], "algorithm", "value", "click", "error")


@query(
    f"""WITH {I.EVALS}, two AS (SELECT run, algorithm = 'click' AS is_a, value FROM evals
        WHERE algorithm IN ('click', 'error')), {_a12_sql('two', 'run')}, ps AS ({_p_sql('zs')}),
      o AS (SELECT run, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, run) AS i FROM ps WHERE p IS NOT NULL)
    SELECT run, p, max(least(1, (m - i + 1) * p)) OVER (ORDER BY p, run
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_holm FROM o
    UNION ALL SELECT run, NULL, NULL FROM ps WHERE p IS NULL""",
    ["p", "p_holm"],
)
def holm_of_undefined(spark, folder):
    ps = C.a12(I.evals(spark, folder), ["run"], "algorithm", "value", "click", "error")
    return C.holm(ps.select("run", "p"), [], "p", ["run"])
