"""Non-dominated ranks by dividing: on arrays, and over blocks of groups too big for a task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frontgauge.operators import fronts
from frontgauge.plans.ranking import divided_ranks


def peeled(v):
    """Front after front, from the definition."""
    rank, left, r = np.zeros(len(v), dtype=int), np.arange(len(v)), 0
    while len(left):
        r += 1
        w = v[left]
        beaten = ((w[:, None] <= w[None]).all(2) & (w[:, None] < w[None]).any(2)).any(0)
        rank[left[~beaten]] = r
        left = left[beaten]
    return rank


@pytest.mark.parametrize("d", [1, 2, 3, 4, 5, 6])
def test_arrays(d):
    rng = np.random.default_rng(d)
    for top in (2, 4, 9, 1000):
        v = np.unique(rng.integers(0, top, (600, d)).astype(float), axis=0)
        rng.shuffle(v)
        assert (divided_ranks(v) == peeled(v)).all()


def jobs_of(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
        return out, len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def ranked(spark, pdf, objs, keys=()):
    df = spark.createDataFrame(pdf)
    return fronts.nd_rank(df, list(keys), objs).toPandas().sort_values("id")["rank"].to_numpy()


def test_twenty_thousand_in_four_objectives(spark):
    """A group of any number of fronts takes no round per front."""
    rng = np.random.default_rng(4)
    objs = ["f1", "f2", "f3", "f4"]
    pdf = pd.DataFrame(rng.integers(0, 60, (20_000, 4)).astype(float), columns=objs).assign(id=range(20_000))
    v, back = np.unique(pdf[objs].to_numpy(), axis=0, return_inverse=True)
    want = divided_ranks(v)[back.reshape(-1)]
    spark.conf.set("frontgauge.compare.rows", "128")
    try:
        got, jobs = jobs_of(spark, "ranks in a task", lambda: ranked(spark, pdf, objs))
    finally:
        spark.conf.unset("frontgauge.compare.rows")
    assert (got == want).all()
    assert jobs < 80


@pytest.mark.parametrize("d, block", [(2, 90), (3, 250), (4, 250), (5, 400)])
def test_blocks(spark, d, block):
    """Groups that no task holds: blocks raise each other; ties, copies and small groups beside."""
    rng = np.random.default_rng(10 * d + block)
    objs = [f"f{i}" for i in range(d)]
    n = 700
    pdf = pd.DataFrame(rng.integers(0, 7, (n, d)).astype(float), columns=objs)
    pdf["g"], pdf["id"] = rng.choice(["a", "b", None], n, p=[0.8, 0.15, 0.05]), range(n)
    spark.conf.set("frontgauge.window.rows", str(block))
    spark.conf.set("frontgauge.sweep.rows", str(block))
    spark.conf.set("frontgauge.compare.rows", "40")
    try:
        got = ranked(spark, pdf, objs, ["g"])
    finally:
        for k in ("window", "sweep", "compare"):
            spark.conf.unset(f"frontgauge.{k}.rows")
    for g in (["a"], ["b"], [None]):
        at = np.flatnonzero(pdf["g"].isin(g) if g[0] else pdf["g"].isna())
        v, back = np.unique(pdf[objs].to_numpy()[at], axis=0, return_inverse=True)
        assert (got[at] == peeled(v)[back.reshape(-1)]).all(), g


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, f1 double, f2 double, f3 double, f4 double")
    assert fronts.nd_rank(df, ["g"], ["f1", "f2", "f3", "f4"]).count() == 0
    only = spark.createDataFrame([("a", None, 1.0)], "g string, f1 double, f2 double")
    assert [r["rank"] for r in fronts.nd_rank(only, ["g"], ["f1", "f2"]).select(F.col("rank")).collect()] == [None]
