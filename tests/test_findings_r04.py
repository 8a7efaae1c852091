"""What the findings of round 4 asked for, on rows of their own."""

import math

import numpy as np
import pytest
from __spark_entry__ import oracle_sql

from frontgauge.operators import scoring
from frontgauge.plans import k_nearest


def test_knn_is_fitted_on_all_rows(spark):
    """no row is left out, however many there are; before, all beyond 20,000 were."""
    n = 20_600
    df = spark.range(n).selectExpr("id", "array(double(id)) as x", "double(id) as y", "int(id % 2) as fold")
    got = scoring.fit_knn(df, "id", "x", "y", "fold", 1).toPandas().set_index("id").yhat
    # the next rows have the other fold, and of the two the lower id is taken
    assert len(got) == n and got[0] == 1
    assert (got.sort_index().to_numpy()[1:] == np.arange(n - 1)).all()
    assert "LIMIT" not in oracle_sql()["knn_baseline"]


def _odd_rows(named):
    """Rows in clusters, many copies of one vector, and values that are unknown or have no order."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        x = [float(v) for v in rng.integers(0, 4, 3) + 50 * (i % 5)]
        if i % 4 == 0:
            x = [1.0, 2.0, 3.0]
        if i % 41 == 0:
            x[i % 3] = [math.nan, math.inf, 1e200][i % 3]
        if i % 53 == 0:
            x[0] = None
        id = None if i % 61 == 0 else f"r{i}" if named else (i * 7) % 400
        rows.append((id, None if i % 37 == 0 else x, None if i % 29 == 0 else float(i), None if i % 31 == 0 else i % 3))
    return rows


@pytest.mark.parametrize("named, k", [(False, 7), (True, 1)])
def test_knn_of_odd_rows_in_portions(spark, room, named, k):
    """the nearest so far are kept from portion to portion; NaN distances and NULL ids come last."""
    rows = _odd_rows(named)
    df = spark.createDataFrame(rows, f"id {'string' if named else 'long'}, x array<double>, y double, fold int")
    got = sorted((tuple(r) for r in scoring.fit_knn(df, "id", "x", "y", "fold", k).collect()), key=str)
    want = []
    for id, x, _, fold in rows:
        near = []
        for i, s, y, f in rows:
            if x is None or s is None or y is None or (fold is not None and fold == f):
                continue
            with np.errstate(all="ignore"):
                d = float(np.sqrt(((np.array(x, float) - np.array(s, float)) ** 2).sum()))
            near.append((math.isnan(d), 0 if math.isnan(d) else d, i is None, i or 0, y))
        near = sorted(near)[:k]
        want.append((id, sum(v[-1] for v in near) / len(near) if near else None))
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=str)]

    def by_id(pairs):
        return sorted((str(i), -1.0 if v is None else round(v, 9)) for i, v in pairs)

    assert by_id(got) == by_id(want)


def test_knn_without_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, [1.0], None, 0), (2, None, 1.0, 1)], "id long, x array<double>, y double, fold int")
    assert {tuple(r) for r in scoring.fit_knn(df, "id", "x", "y", "fold", 2).collect()} == {(1, None), (2, None)}
    assert scoring.fit_knn(df.limit(0), "id", "x", "y", "fold", 2).collect() == []
    alone = df.selectExpr("id", "x", "double(id) as y", "fold")
    assert {tuple(r) for r in scoring.fit_knn(alone, "id", "x", "y", "fold", 2).collect()} == {(1, None), (2, None)}


def test_points_pass_over_blocks_that_hold_none_nearer(monkeypatch):
    rng = np.random.default_rng(1)
    sites = rng.random((3_000, 4)) + 100 * np.repeat(np.arange(30), 100)[:, None]
    target, measured = rng.random(3_000), []
    whole = k_nearest._measured
    monkeypatch.setattr(k_nearest, "_measured", lambda *a: measured.append(len(a[1])) or whole(*a))
    near = k_nearest.no_partners(50, 3)
    k_nearest.take_nearest(sites[:50], sites, target, np.arange(3_000), near, 100)
    assert len(measured) == 1 and sum(measured) < 1_000
    d = np.sqrt(((sites[:50, None] - sites[None]) ** 2).sum(axis=2))
    assert (near[1] == np.argsort(d, axis=1, kind="stable")[:, :3]).all()
