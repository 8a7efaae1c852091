"""What the findings of round 3 asked for, on rows of their own."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from frontgauge.operators import agreement, fronts, scoring
from frontgauge.plans import halving, ordered


@pytest.mark.parametrize("columns", [1, 2, 3, 4])
def test_sums_by_halving(columns):
    rng = np.random.default_rng(columns)
    for n, m, values in ((1, 1, 3), (0, 5, 3), (5, 0, 3), (60, 90, 5), (400, 300, 1000)):
        src, qry = (rng.integers(0, values, (k, columns)).astype(float) for k in (n, m))
        src[3:4, 0] = np.nan
        weight = rng.integers(1, 4, n).astype(float)
        codes = rng.integers(0, 3, n), rng.integers(0, 3, m)
        ok = (src[:, None, :] <= qry[None, :, :]).all(axis=2)
        assert (halving.sums_below(src, weight, qry) == weight @ ok).all()
        ok &= codes[0][:, None] == codes[1][None, :]
        assert (halving.sums_below(src, weight, qry, codes) == weight @ ok).all()


def test_pair_order_of_a_group_beyond_the_compared_rows(spark, monkeypatch):
    """such a group is counted in one call, not through copies for every pair of blocks."""
    monkeypatch.setattr(agreement, "_unchanged_pairs", None)
    rng = np.random.default_rng(5)
    n = 9_000
    v = rng.integers(0, 60, (n, 4)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(v, columns=["t1", "t2", "p1", "p2"]).assign(g="a"))
    df = df.unionByName(df.limit(30).selectExpr("t1", "t2", "p1", "p2", "cast(null as string) as g"))
    got = {r.g: r for r in agreement.pair_order(df, ["g"], ["t1", "t2"], ["p1", "p2"]).collect()}
    same = sum(
        int((agreement._relation(v[i : i + 500, :2], v[:, :2]) == agreement._relation(v[i : i + 500, 2:], v[:, 2:])).sum())
        for i in range(0, n, 500)
    )
    assert got["a"].pairs == n * (n - 1) // 2 and got["a"].unchanged == (same - n) // 2
    assert got[None].pairs == 30 * 29 // 2
    v = v[:600]
    v[:40, 0], v[20:60, 3] = np.nan, np.nan  # numbers without an order
    same = (agreement._relation(v[:, :2], v[:, :2]) == agreement._relation(v[:, 2:], v[:, 2:])).sum()
    assert agreement._unchanged_in(v[:, :2], v[:, 2:]) == (same - len(v)) // 2


def _small_groups():
    """Integers as large as doubles cannot tell apart, values unknown, copies, a group without a name."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        v = [float(x) for x in rng.integers(0, 12, 3)]
        if i % 17 == 0:
            v[i % 3] = None
        group = [None, 2**53, 2**53 + 1][i % 3]
        rows.append((group, *v, 2**60 + (i * 7) % 300, None if i % 5 else [i]))
    return rows, "g long, a double, b double, c double, id long, extra array<int>"


def test_weak_front_of_small_groups_takes_one_shuffle_of_rows(spark, monkeypatch):
    """whole groups meet once; no table of places, no query."""
    monkeypatch.setattr(fronts, "weak_hits", None)
    rows, schema = _small_groups()
    got = fronts.front_weak(spark.createDataFrame(rows, schema), ["g"], ["a", "b", "c"]).collect()

    def low(x):  # an unknown value has the first place
        return -1 if x is None else x

    def beaten(r):
        return any(q[0] == r[0] and all(low(x) < low(y) for x, y in zip(q[1:4], r[1:4])) for q in rows)

    assert sorted(tuple(r)[4] for r in got) == sorted(r[4] for r in rows if not beaten(r))
    whole = {r[4]: r for r in rows}
    assert all(tuple(r) == whole[r.id] for r in got)


def test_witness_of_small_groups_takes_one_shuffle_of_rows(spark, monkeypatch):
    """the same, with the first dominator of each row."""
    monkeypatch.setattr(fronts, "weak_hits", None)
    rows, schema = _small_groups()
    got = fronts.witness(spark.createDataFrame(rows, schema), ["g"], ["a", "b", "c"], "id").collect()
    known = [r for r in rows if None not in r[1:4]]

    def first(r):
        over = [
            (q[1:4], q[4])
            for q in known
            if q[0] == r[0] and q[1:4] != r[1:4] and all(x <= y for x, y in zip(q[1:4], r[1:4]))
        ]
        return min(over)[1] if over else None

    want = {r[4]: (*r, first(r) if None not in r[1:4] else None) for r in rows}
    assert len(got) == len(rows) and all(tuple(r) == want[r.id] for r in got)


def test_nearest_rows_hold_few_distances_at_a_time():
    """20,000 fitted rows and any number of scored ones."""
    rng = np.random.default_rng(2)
    x, sites, target = rng.integers(0, 9, (500, 3)) / 1.0, rng.integers(0, 9, (20_000, 3)) / 1.0, rng.random(20_000)
    tracemalloc.start()
    got = scoring._mean_of_nearest(x, sites, target, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # 240,000,000 with 512 rows at a time
    for i in (0, 250, 499):
        d = np.sqrt(((x[i] - sites) ** 2).sum(axis=1))
        assert got[i] == target[np.argsort(d, kind="stable")[:5]].mean()


def test_quantiles_spread_rows_before_they_are_counted(spark, monkeypatch):
    """one task that reads the whole input counts no more values than others do."""
    counted = []
    settle = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df: counted.append(df) or settle(df))
    df = spark.range(0, 5_000, 1, 1).selectExpr("id % 2 as g", "if(id % 3 = 0, 7.0D, double(id)) as v")
    df = df.unionByName(spark.createDataFrame([(0, None), (5, None)], "g long, v double"))
    got = {r.g: r for r in ordered.quantiles(df, ["g"], "v", {"q": 0.25, "h": 0.9}).collect()}
    first = counted[0]._jdf.queryExecution().optimizedPlan().toString()
    assert first.index("Aggregate") < first.index("RepartitionByExpression")
    pdf = df.where("v is not null").toPandas()
    for g, q in pdf.groupby("g"):
        assert got[g].q == pytest.approx(np.quantile(q.v, 0.25)) and got[g].h == pytest.approx(np.quantile(q.v, 0.9))
    assert set(got) == {0, 1}
