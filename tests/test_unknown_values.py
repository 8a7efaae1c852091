"""Rows that lack a true or a predicted value do not count, whatever the size of the group."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frontgauge.operators import agreement, errors, fronts
from frontgauge.plans.inversions import merge_count

HAND = [("a", 1, 1.0, 1.0), ("a", 2, 2.0, 2.0), ("a", 3, 3.0, 3.0), ("a", 4, 100.0, None), ("a", 5, None, 0.5),
        ("none", 6, 4.0, None), ("none", 7, None, 4.0)]


@pytest.fixture
def hand(spark):
    return spark.createDataFrame(HAND, "g string, id long, y double, yhat double")


def by_group(df):
    return {r["g"]: r for r in df.collect()}


def test_errors(spark, room, hand):
    got = by_group(errors.errors(hand, ["g"]))
    assert (got["a"].n, got["a"].rmse, got["none"].n, got["none"].rmse) == (3, 0.0, 0, None)
    got = by_group(errors.r2(hand, ["g"]))
    assert got["a"].r2 == 1.0 and got["none"].r2 is None
    near = hand.withColumn("yhat", F.col("yhat") + 1)
    assert by_group(errors.r2(near, ["g"]))["a"].r2 == pytest.approx(1 - 1 / (2 / 3))
    got = by_group(errors.rel_errors(near, ["g"]))
    assert got["a"].nrmse == pytest.approx(0.5) and got["none"].zero_y == 0


def test_correlations(spark, room, hand):
    got = by_group(errors.corrs(hand, ["g"], ["id"]))
    assert (got["a"].pearson, got["a"].spearman) == (pytest.approx(1.0), pytest.approx(1.0))
    assert got["none"].spearman is None
    got = by_group(errors.kendall(hand, ["g"]))
    assert tuple(got["a"])[1:] == (3, 3, 0, pytest.approx(1.0))
    assert tuple(got["none"])[1:] == (0, 0, 0, None)


def test_best_and_order(spark, room, hand):
    got = by_group(agreement.topk(hand, ["g"], ["id"], 1))
    assert tuple(got["a"])[1:] == (1, 1.0, 0.0)
    assert tuple(got["none"])[1:] == (0, None, None)
    both = hand.withColumns({"t2": F.lit(1.0), "p2": F.lit(1.0)})
    got = by_group(agreement.pair_order(both, ["g"], ["y", "t2"], ["yhat", "p2"]))
    assert tuple(got["a"])[1:] == (3, 3, 1.0)
    assert tuple(got["none"])[1:] == (0, 0, None)


def test_fronts(spark, room):
    rows = [("a", 1, 1.0, 5.0, 1.0), ("a", 2, 2.0, 2.0, 1.0), ("a", 3, None, 0.0, 0.0), ("a", 4, 0.0, None, 0.0),
            ("a", 5, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, id int, f1 double, f2 double, f3 double")
    for objs in (["f1", "f2"], ["f1", "f2", "f3"]):
        assert {r.id for r in fronts.front(df, ["g"], objs).collect()} == {1, 2}
        ranks = {r.id: r["rank"] for r in fronts.nd_rank(df, ["g"], objs).collect()}
        assert ranks == {1: 1, 2: 1, 3: None, 4: None, 5: 2}


def test_kendall_by_pairs(spark, room):
    rng = np.random.default_rng(5)
    n = 260
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "y": rng.integers(0, 12, n).astype(float),
        "yhat": rng.integers(0, 9, n).astype(float),
    })
    pdf.loc[:60, ["y", "yhat"]] = [3.0, 4.0]  # one pair often
    pdf.loc[rng.choice(n, 30, replace=False), "y"] = np.nan
    pdf.loc[rng.choice(n, 30, replace=False), "yhat"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = by_group(errors.kendall(df, ["g"]))
    for g, rows in pdf.dropna().groupby("g"):
        v = rows[["y", "yhat"]].to_numpy()
        signs = [np.sign(p - q).prod() for p, q in itertools.combinations(v, 2)]
        ties = [sum(p[k] != q[k] for p, q in itertools.combinations(v, 2)) for k in (0, 1)]
        want = (len(signs), signs.count(1), signs.count(-1), pytest.approx(sum(signs) / np.sqrt(ties[0] * ties[1])))
        assert tuple(got[g])[1:] == want


def test_sketched_quantiles(spark, hand):
    got = by_group(errors.sketch_quantiles(errors.err_sketch(hand, ["g"]), {"q": 0.5}))
    assert (got["a"].n, got["a"].q, got["none"].n, got["none"].q) == (3, 0.0, 0, None)
    many = spark.range(200_000).selectExpr("id % 7 as g", "double(id * 7919 % 200000) as y", "0D as yhat")
    parts = errors.err_sketch(many, ["g"])
    ps = {f"q{p}": p / 100 for p in (1, 25, 50, 90, 99)}
    row = errors.sketch_quantiles(errors.merged_sketch(parts, []), ps).first()
    assert row.n == 200_000
    assert all(abs(row[q] / 200_000 - p) < 3 * errors.SKETCH_RANK_ERROR for q, p in ps.items())
    size = lambda df: df.agg(F.max(F.length("sketch"))).first()[0]
    assert size(errors.merged_sketch(parts, [])) < 3 * size(parts)  # bounded, not by rows


def test_witness(spark, room, cloud):
    """Each dominated row names the first row that dominates it, over all pairs."""
    objs = ["f1", "f2", "f3"]
    got = fronts.witness(spark.createDataFrame(cloud), ["g"], objs, "id").toPandas()
    assert len(got) == len(cloud)
    for g, rows in cloud.groupby("g"):
        v, ids = rows[objs].to_numpy(), rows["id"].to_numpy()
        told = got[got["g"] == g].set_index("id")["dominator"]
        for x, i in zip(v, ids):
            beats = (v <= x).all(1) & (v < x).any(1)
            want = min(zip(map(tuple, v[beats]), ids[beats]), default=(None, None))[1]
            assert told[i] == want or (want is None and pd.isna(told[i]))


@pytest.mark.parametrize("n", [0, 1, 31, 33, 200, 1000])
def test_merge_count(n):
    rng = np.random.default_rng(n)
    y, w = rng.integers(0, 50, n).astype(float), rng.integers(1, 5, n).astype(float)
    want = sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if y[i] > y[j])
    assert merge_count(y, w) == want
