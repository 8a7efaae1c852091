"""Each operator against brute force, in one task and with groups cut into blocks."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frontgauge.operators import agreement, compare, design, errors, fronts, indicators, scoring
from frontgauge.plans import ordered, segments
from frontgauge.plans.dominance import front_mask
from frontgauge.plans.ranking import swept_ranks
from frontgauge.plans.nearest import nearest


def dominates(b, a):
    return (b <= a).all() and (b < a).any()


def brute_front(v):
    return np.array([not any(dominates(b, a) for b in v) for a in v])


def by_group(pdf, objs, fn):
    return {g: fn(q[objs].to_numpy(), q) for g, q in pdf.groupby("g")}


@pytest.mark.parametrize("objs", [["f1"], ["f1", "f2"], ["f1", "f2", "f3"], ["f1", "f2", "f3", "f4"]])
def test_front(spark, room, cloud, objs):
    got = {r.id for r in fronts.front(spark.createDataFrame(cloud), ["g"], objs).collect()}
    want = by_group(cloud, objs, lambda v, q: set(q.id[brute_front(v)]))
    assert got == set().union(*want.values())


def test_front_without_groups(spark, room, cloud):
    for objs in (["f1", "f2"], ["f1", "f2", "f3"]):
        got = {r.id for r in fronts.front(spark.createDataFrame(cloud), [], objs).collect()}
        assert got == set(cloud.id[brute_front(cloud[objs].to_numpy())])


def test_front_where_nothing_is_dominated(spark, room, cloud):
    plane = cloud.assign(f3=100 - cloud.f1 - cloud.f2)
    objs = ["f1", "f2", "f3"]
    got = {r.id for r in fronts.front(spark.createDataFrame(plane), ["g"], objs).collect()}
    assert got == set(cloud.id)


@pytest.mark.parametrize("objs", [["f1"], ["f1", "f2"], ["f1", "f2", "f3"]])
def test_dominance_counts(spark, room, cloud, objs):
    got = fronts.dominance(spark.createDataFrame(cloud), ["g"], objs).toPandas().set_index("id")
    for _, q in cloud.groupby("g"):
        v = q[objs].to_numpy()
        for i, id_ in enumerate(q.id):
            assert got.dominators[id_] == sum(dominates(b, v[i]) for b in v)
            assert got.dominated[id_] == sum(dominates(v[i], b) for b in v)
    assert len(got) == len(cloud)


@pytest.mark.parametrize("objs", [["f1", "f2"], ["f1", "f2", "f3"]])
def test_rank(spark, room, cloud, objs):
    got = fronts.nd_rank(spark.createDataFrame(cloud), ["g"], objs).toPandas().set_index("id")["rank"]
    for _, q in cloud.groupby("g"):
        left, rank = q, 0
        while len(left):
            rank += 1
            top = brute_front(left[objs].to_numpy())
            assert (got[left.id[top]] == rank).all()
            left = left[~top]


def test_widened_and_weak_fronts(spark, room, cloud):
    df, objs = spark.createDataFrame(cloud), ["f1", "f2", "f3"]
    wide = {r.id for r in fronts.front_eps(df, ["g"], objs, 3.0).collect()}
    weak = {r.id for r in fronts.front_weak(df, ["g"], objs).collect()}
    for _, q in cloud.groupby("g"):
        v = q[objs].to_numpy()
        for a, id_ in zip(v, q.id):
            assert (id_ in wide) == (not any((b + 3 <= a).all() for b in v))
            assert (id_ in weak) == (not any((b < a).all() for b in v))
    front = {r.id for r in fronts.front(df, ["g"], objs).collect()}
    assert front <= weak and front <= wide


def test_crowding(spark, room, cloud):
    df = spark.createDataFrame(cloud)
    got = fronts.crowding(df, ["g"], ["f1", "f2"], ["id"]).toPandas().set_index("id").crowding
    want = pd.Series(0.0, index=cloud.id)
    for _, q in cloud.groupby("g"):
        for c in ("f1", "f2"):
            s = q.sort_values([c, "id"])
            gap = (s[c].shift(-1) - s[c].shift(1)) / (s[c].max() - s[c].min())
            want[s.id] += gap.fillna(np.inf).to_numpy()
    assert np.allclose(got.sort_index(), want.sort_index())


def grid_volume(v, ref):
    """Unit cells covered, for whole-number points."""
    grid = np.zeros([int(r) for r in ref], dtype=bool)
    for p in v:
        if (p < ref).all():
            grid[tuple(slice(int(x), None) for x in p)] = True
    return grid.sum()


def test_hypervolume(spark, room, cloud):
    pdf = cloud[(cloud.f1 + cloud.f2 + cloud.f3) > 25]
    df = spark.createDataFrame(pdf)
    two = indicators.hv2(df, ["g"], ["f1", "f2"], (20.0, 18.0)).toPandas().set_index("g").hv
    three = indicators.hv3(df, ["g"], ["f1", "f2", "f3"], (20.0, 18.0, 22.0)).toPandas().set_index("g").hv
    for g, q in pdf.groupby("g"):
        assert two[g] == grid_volume(q[["f1", "f2"]].to_numpy(), np.array([20, 18]))
        assert three[g] == grid_volume(q[["f1", "f2", "f3"]].to_numpy(), np.array([20, 18, 22]))


def test_hypervolume_of_a_large_front(spark, room):
    """More points on the front of one group than a task may hold."""
    pts = [(x, y, 24 - x - y) for x in range(25) for y in range(25 - x)]
    pdf = pd.DataFrame(pts, columns=["f1", "f2", "f3"]).astype(float).assign(g="a")
    got = indicators.hv3(spark.createDataFrame(pdf), ["g"], ["f1", "f2", "f3"], (26.0, 26.0, 26.0))
    want = grid_volume(pdf[["f1", "f2", "f3"]].to_numpy(), np.array([26, 26, 26]))
    assert got.first()["hv"] == want


def test_hypervolume_of_a_cut_front_copies_few_rows(spark, monkeypatch):
    """Slabs get fronts of what comes before them, not all of it: rows written stay near n log n."""
    n, cut = 2_400, 400
    v = np.abs(np.random.default_rng(5).normal(size=(n, 3)))
    pdf = pd.DataFrame(1 - v / np.linalg.norm(v, axis=1)[:, None], columns=["f1", "f2", "f3"])
    df = spark.createDataFrame(pdf.assign(g="a"))
    small = spark.createDataFrame(pdf[:30].assign(g="b"))
    written = []
    for module in (indicators, ordered, segments):
        def counted(rows, settle=module.settle):
            kept = settle(rows)
            written.append(kept.count())
            return kept

        monkeypatch.setattr(module, "settle", counted)
    spark.conf.set("frontgauge.sweep.rows", str(cut))
    try:
        got = {r.g: r.hv for r in indicators.hv3(df.union(small), ["g"], ["f1", "f2", "f3"], (1.0, 1.0, 1.0)).collect()}
    finally:
        spark.conf.unset("frontgauge.sweep.rows")
    for g, rows in (("a", pdf), ("b", pdf[:30])):
        want = indicators._swept_volume(rows.to_numpy(), np.ones(3))
        assert abs(got[g] - want) < 1e-9 * want
    assert sum(written) < 3 * n * np.log2(n)


def test_hypervolume_reference_from_columns(spark, room, cloud):
    df = spark.createDataFrame(cloud.assign(r1=cloud.g.map({"a": 9.0, "b": 25.0, "c": 30.0}), r2=20.0))
    got = indicators.hv2(df, ["g"], ["f1", "f2"], ("r1", "r2")).toPandas().set_index("g").hv
    for g, q in cloud.groupby("g"):
        ref = np.array([{"a": 9, "b": 25, "c": 30}[g], 20])
        assert got[g] == grid_volume(q[["f1", "f2"]].to_numpy(), ref)


def test_contributions(spark, room):
    x = np.arange(120.0)
    pdf = pd.DataFrame({"g": "a", "f1": x, "f2": 120 - x})
    got = indicators.hv2_contrib(spark.createDataFrame(pdf), ["g"], ["f1", "f2"], (120.0, 121.0))
    assert [r.contribution for r in got.collect()] == [1.0] * 120


COST = {
    "l2": lambda q, s: np.sqrt(((s - q) ** 2).sum(axis=1)),
    "l1": lambda q, s: np.abs(s - q).sum(axis=1),
    "above": lambda q, s: np.sqrt((np.maximum(q - s, 0) ** 2).sum(axis=1)),
    "below": lambda q, s: np.sqrt((np.maximum(s - q, 0) ** 2).sum(axis=1)),
    "lift": lambda q, s: (s - q).max(axis=1),
}


def test_nearest(spark, room, cloud):
    objs = ["f1", "f2", "f3"]
    sites = cloud[cloud.id % 2 == 0]
    got = nearest(
        spark.createDataFrame(cloud), spark.createDataFrame(sites), ["g"], objs, list(COST)
    ).toPandas()
    assert len(got) == len(cloud[["g", *objs]].drop_duplicates())
    for g, q in got.groupby("g"):
        s = sites[sites.g == g][objs].to_numpy()
        for row in q.itertuples():
            at = np.array([row.f1, row.f2, row.f3])
            for kind, fn in COST.items():
                assert getattr(row, kind) == pytest.approx(fn(at, s).min())


def test_nearest_through_a_tree_of_boxes(spark, cloud, monkeypatch, fan=4):
    """Several levels of boxes give the same partners as one, and rows of bounded size."""
    from frontgauge.plans import nearest as plan

    objs = ["f1", "f2", "f3"]
    df = spark.createDataFrame(cloud)
    levels = []
    made = plan._box_levels
    monkeypatch.setattr(plan, "_box_levels", lambda *a: levels.append(made(*a)) or levels[-1])

    def run():
        got = nearest(df, df, ["g"], objs, ["l2", "lift"], others=True).toPandas()
        return got.sort_values(["g", *objs]).reset_index(drop=True)

    want = run()
    monkeypatch.setattr(plan, "_FAN", fan)
    spark.conf.set("frontgauge.site.rows", "8")
    try:
        got = run()
    finally:
        spark.conf.unset("frontgauge.site.rows")
    pd.testing.assert_frame_equal(got, want)
    assert len(levels[-1]) >= 3
    assert all(t.agg(F.max(F.size("_boxes"))).first()[0] <= fan + 1 for t in levels[-1])


def test_nearest_other(spark, room, cloud):
    objs = ["f1", "f2"]
    df = spark.createDataFrame(cloud)
    got = nearest(df, df, ["g"], objs, ["l1"], others=True).toPandas()
    for g, q in got.groupby("g"):
        v = cloud[cloud.g == g][objs].drop_duplicates().to_numpy()
        for row in q.itertuples():
            at = np.array([row.f1, row.f2])
            rest = v[(v != at).any(axis=1)]
            assert row.l1 == COST["l1"](at, rest).min()


def test_spacing_counts_copies(spark, room, cloud):
    got = indicators.spacing(spark.createDataFrame(cloud), ["g"], ["f1", "f2"]).toPandas().set_index("g")
    for g, q in cloud.groupby("g"):
        v = q[["f1", "f2"]].to_numpy()
        d = [np.abs(np.delete(v, i, 0) - v[i]).sum(axis=1).min() for i in range(len(v))]
        assert got.spacing[g] == pytest.approx(np.std(d, ddof=1))


def test_coverage(spark, room, cloud):
    df = spark.createDataFrame(cloud.assign(p="one"))
    for objs in (["f1", "f2"], ["f1", "f2", "f3"]):
        got = indicators.coverage(df, ["p"], "g", objs).collect()
        assert len(got) == 6
        for r in got:
            a = cloud[cloud.g == r.a][objs].drop_duplicates().to_numpy()
            b = cloud[cloud.g == r.b][objs].drop_duplicates().to_numpy()
            assert r.coverage == pytest.approx(np.mean([(a <= x).all(axis=1).any() for x in b]))


def test_ranks_and_neighbours(spark, room, cloud):
    df = spark.createDataFrame(cloud)
    got = ordered.average_rank(df, ["g"], "f1", ["id"], "r").toPandas().sort_values("id")
    assert np.allclose(got.r, cloud.groupby("g").f1.rank())
    got = ordered.numbered(df, ["g"], ["f1", "id"], "n").toPandas().sort_values("id")
    assert (got.n.to_numpy() == cloud.sort_values(["f1", "id"]).groupby("g").cumcount().sort_index() + 1).all()


def test_running_keeps_keys(spark, room, cloud):
    df = spark.createDataFrame(cloud)
    laid = ordered.in_blocks(df, ["g"], ["f1", "id"])
    assert laid.split == (room == "tight")
    got = ordered.running(laid, ["g"], ["f1", "id"], {"s": ("sum", F.col("f2")), "m": ("min", F.col("f3"))})
    got = got.toPandas().sort_values("id").reset_index(drop=True)
    s = cloud.sort_values(["f1", "id"]).groupby("g")
    assert (got.g == cloud.g).all()
    assert np.allclose(got.s, s.f2.cumsum().sort_index())
    assert np.allclose(got.m, s.f3.cummin().sort_index())


def test_null_keys_are_a_group(spark, room, cloud):
    df = spark.createDataFrame(cloud).withColumn("g", F.when(F.col("g") != "a", F.col("g")))
    laid = ordered.in_blocks(df, ["g"], ["f1", "id"])
    got = ordered.running(laid, ["g"], ["f1", "id"], {"n": ("sum", F.lit(1).cast("long"))})
    top = got.groupBy("g").agg(F.max("n").alias("n")).toPandas()
    assert sorted(top.n) == sorted(cloud.groupby("g").size())


def test_quantiles(spark, room, cloud):
    got = ordered.quantiles(spark.createDataFrame(cloud), ["g"], "f1", {"a": 0.0, "b": 0.37, "c": 1.0})
    got = got.toPandas().set_index("g")
    for name, p in (("a", 0.0), ("b", 0.37), ("c", 1.0)):
        want = cloud.groupby("g").f1.quantile(p)
        assert np.allclose(got[name].sort_index(), want)


def test_kendall(spark, room, cloud):
    got = errors.kendall(spark.createDataFrame(cloud), ["g"], "f1", "f2").toPandas().set_index("g")
    for g, q in cloud.groupby("g"):
        x, y = q.f1.to_numpy(), q.f2.to_numpy()
        sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
        assert got.concordant[g] == (sx * sy > 0).sum() / 2
        assert got.discordant[g] == (sx * sy < 0).sum() / 2
        tau = (sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())
        assert got.tau_b[g] == pytest.approx(tau)


def test_pair_order(spark, room, cloud):
    df = spark.createDataFrame(cloud)
    got = agreement.pair_order(df, ["g"], ["f1", "f2"], ["f3", "f4"]).toPandas().set_index("g")

    def rel(a, b):
        return int(dominates(a, b)) - int(dominates(b, a))

    for g, q in cloud.groupby("g"):
        t, p = q[["f1", "f2"]].to_numpy(), q[["f3", "f4"]].to_numpy()
        same = sum(rel(t[i], t[j]) == rel(p[i], p[j]) for i, j in combinations(range(len(q)), 2))
        assert got.unchanged[g] == same
        assert got.pairs[g] == len(q) * (len(q) - 1) // 2


def test_rank_tests(spark, room, cloud):
    df = spark.createDataFrame(cloud.assign(d=cloud.f1 - cloud.f2))
    got = compare.wilcoxon(df, ["g"], "d").toPandas().set_index("g")
    for g, q in cloud.groupby("g"):
        d = (q.f1 - q.f2)[q.f1 != q.f2]
        r = d.abs().rank()
        assert got.w_plus[g] == r[d > 0].sum() and got.w_minus[g] == r[d < 0].sum()
        assert got.w_plus[g] + got.w_minus[g] == len(d) * (len(d) + 1) / 2
    ab = compare.a12(df, [], "g", "f1", "a", "b").first()
    ba = compare.a12(df, [], "g", "f1", "b", "a").first()
    x, y = (cloud.f1[cloud.g == k].to_numpy() for k in "ab")
    d = np.subtract.outer(x, y)
    assert ab.a12 == pytest.approx(((d > 0).sum() + (d == 0).sum() / 2) / d.size)
    assert ab.a12 + ba.a12 == pytest.approx(1)


def test_holm(spark, room, cloud):
    pdf = cloud[["g", "id"]].assign(p=(cloud.f1 + 1) / 3000)
    got = compare.holm(spark.createDataFrame(pdf), ["g"], "p", ["id"]).toPandas().set_index("id").p_holm
    for _, q in pdf.groupby("g"):
        s = q.sort_values(["p", "id"])
        want = np.minimum(1, np.maximum.accumulate(s.p.to_numpy() * np.arange(len(s), 0, -1)))
        assert np.allclose(got[s.id], want)


def test_anytime(spark, room, cloud):
    got = agreement.anytime(spark.createDataFrame(cloud), ["g"], ["id"], "f1").toPandas().set_index("id")
    assert (got.best.sort_index().to_numpy() == cloud.groupby("g").f1.cummin()).all()


def test_bootstrap_draws_whole_groups(spark, room, cloud):
    drawn = design.bootstrap(spark.createDataFrame(cloud), ["g"], ["id"], 5)
    sizes = drawn.groupBy("g", "rep").agg(F.sum("times").alias("n")).toPandas()
    want = cloud.groupby("g").size()
    assert len(sizes) == 15 and all(want[r.g] == r.n for r in sizes.itertuples())


def test_knn(spark, room):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    pdf = pd.DataFrame({"id": np.arange(300), "x": list(x), "y": rng.random(300), "fold": np.arange(300) % 4})
    got = scoring.fit_knn(spark.createDataFrame(pdf), "id", "x", "y", "fold", 7).toPandas().set_index("id").yhat
    for i in range(300):
        other = pdf[pdf.fold != pdf.fold[i]]
        d = np.sqrt(((x[other.id] - x[i]) ** 2).sum(axis=1))
        best = other.iloc[np.lexsort((other.id, d))[:7]]
        assert got[i] == pytest.approx(best.y.mean())


def test_join_on_crowded_keys(spark, room):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id % 97) as k")
    right = df.groupBy("k").agg(F.sum("id").alias("s"))
    for how in ("inner", "left", "left_semi"):
        assert ordered.join_on(df, right, ["k"], how).count() == 1000
    odd = right.where("k % 2 = 1")
    want = df.join(odd, "k", "left_anti").count()
    assert ordered.join_on(df, odd, ["k"], "left_anti").count() == want


def test_numpy_helpers_agree():
    rng = np.random.default_rng(9)
    for _ in range(50):
        v = rng.integers(0, 5, (40, 3)).astype(float)
        assert (front_mask(v) == brute_front(v)).all()
        u = np.unique(v[:, :2], axis=0)
        three = np.column_stack([u, np.zeros(len(u))])
        assert (swept_ranks(u) == swept_ranks(three)).all()
    # sums alike after rounding must not hide a dominator
    v = np.array([[1e16, 1.0], [1e16, 0.0]])
    assert (front_mask(v) == [False, True]).all()


def test_front_of_distinct_values_is_thinned_first(spark, room):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.random((500, 3)), columns=["f1", "f2", "f3"])
    pdf = pdf.assign(g=np.where(np.arange(500) % 5 == 0, "b", "a"), id=np.arange(500))
    objs = ["f1", "f2", "f3"]
    got = {r.id for r in fronts.front(spark.createDataFrame(pdf), ["g"], objs).collect()}
    want = by_group(pdf, objs, lambda v, q: set(q.id[brute_front(v)]))
    assert got == set().union(*want.values())


def test_knn_is_fitted_on_a_bounded_number_of_rows(spark, monkeypatch):
    from frontgauge.functions.columns import hash_number

    rng = np.random.default_rng(6)
    x = rng.random((120, 2))
    pdf = pd.DataFrame({"id": np.arange(120), "x": list(x), "y": rng.random(120), "fold": np.arange(120) % 3})
    pdf["fold"] = pdf["fold"].astype("Int64").where(pdf["id"] != 7)
    df = spark.createDataFrame(pdf.assign(fold=pdf["fold"].astype(object).where(pdf["fold"].notna(), None)),
                               "id long, x array<double>, y double, fold long")
    order = df.select("id", hash_number(F.lit("knn"), F.col("id")).alias("h")).toPandas().sort_values(["h", "id"])
    sites = pdf[pdf["id"].isin(order["id"].head(40))]
    got = scoring.fit_knn(df, "id", "x", "y", "fold", 3, most_sites=40).toPandas().set_index("id").yhat
    for i in range(120):
        other = sites if i == 7 else sites[sites["fold"].isna() | (sites["fold"] != pdf["fold"][i])]
        d = np.sqrt(((x[other.id] - x[i]) ** 2).sum(axis=1))
        assert got[i] == pytest.approx(other.iloc[np.lexsort((other.id, d))[:3]].y.mean())
    monkeypatch.setattr(scoring, "KNN_BYTES", 1_000)
    with pytest.raises(ValueError):
        scoring.fit_knn(df, "id", "x", "y", "fold", 3)


def test_blocks_of_a_crowded_part(spark):
    placed = spark.range(1000).select(
        "id", F.when(F.col("id") < 10, 0).when(F.col("id") < 950, 1).otherwise(2).alias("_part")
    )
    first = F.when(F.col("_part") == 0, 0).when(F.col("_part") == 1, 10).otherwise(950)
    got = ordered.number_blocks(placed.withColumn("_at", F.col("id") - first), 64).toPandas()
    assert got.groupby(ordered.BLOCK).size().max() <= 64
    assert got.sort_values("id")[ordered.BLOCK].is_monotonic_increasing
    assert sorted(got[ordered.BLOCK].unique()) == list(range(1 + 15 + 1))


def test_few_wide_rows_are_not_broadcast(spark):
    from frontgauge.session import settle

    wide = settle(spark.range(4).select("id", F.array_repeat(F.col("id") * 1.5, 50_000).alias("x")))
    spark.conf.set("frontgauge.broadcast.bytes", "100000")
    try:
        assert not ordered.fits_broadcast(wide)
        assert ordered.fits_broadcast(settle(spark.range(4)))
    finally:
        spark.conf.unset("frontgauge.broadcast.bytes")


def test_three_column_ranks():
    rng = np.random.default_rng(9)
    for top in (3, 12, 1000):
        v = np.unique(rng.integers(0, top, (400, 3)).astype(float), axis=0)
        want, left, r = np.zeros(len(v), dtype=int), np.arange(len(v)), 0
        while left.size:
            r += 1
            front = front_mask(v[left])
            want[left[front]] = r
            left = left[~front]
        assert (swept_ranks(v) == want).all()
