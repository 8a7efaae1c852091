"""Small cases worked out by hand, edges and identities."""

import math

import pytest
from pyspark.sql import functions as F

from frontgauge.operators import agreement, compare, contract, design, errors, fronts, indicators, scoring
from frontgauge.sources.tables import SchemaMismatch, load, write

INF, NAN = float("inf"), float("nan")


def points(spark, rows):
    return spark.createDataFrame([("p", i, float(a), float(b)) for i, (a, b) in enumerate(rows)],
                                 "g string, id long, f1 double, f2 double")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "rows, front",
    [
        ([(1, 1)], [0]),
        ([(1, 1), (1, 1), (1, 1)], [0, 1, 2]),
        ([(1, 1), (2, 2), (3, 3)], [0]),
        ([(1, 3), (2, 2), (3, 1)], [0, 1, 2]),
        ([(1, 2), (1, 1), (2, 1)], [1]),
        ([(1, 1), (2, 0), (2, 0), (3, 0)], [0, 1, 2]),
        ([(0.0, 1), (-0.0, 1)], [0, 1]),
    ],
)
def test_fronts(spark, rows, front):
    df = points(spark, rows)
    assert ids(fronts.front2(df, ["g"], "f1", "f2")) == front
    three = df.withColumn("f3", F.lit(0.0))
    assert ids(fronts.front(three, ["g"], ["f1", "f2", "f3"])) == front
    again = fronts.front2(fronts.front2(df, ["g"], "f1", "f2"), ["g"], "f1", "f2")
    assert ids(again) == front


def test_rank_one_is_the_front(spark):
    df = points(spark, [(1, 1), (2, 2), (3, 3), (0, 5), (1, 1), (4, 2)])
    ranked = {r.id: r["rank"] for r in fronts.nd_rank(df, ["g"], ["f1", "f2"]).collect()}
    assert ranked == {0: 1, 1: 2, 2: 3, 3: 1, 4: 1, 5: 3}


def test_crowding_edges(spark):
    df = points(spark, [(0, 4), (1, 2), (4, 0)])
    got = {r.id: r.crowding for r in fronts.crowding(df, ["g"], ["f1", "f2"], ["id"]).collect()}
    assert got == {0: INF, 1: 2.0, 2: INF}
    # an objective in which all agree adds nothing
    flat = points(spark, [(0, 7), (1, 7), (4, 7)])
    got = {r.id: r.crowding for r in fronts.crowding(flat, ["g"], ["f2", "f1"], ["id"]).collect()}
    assert got == {0: INF, 1: 1.0, 2: INF}
    lone = fronts.crowding(points(spark, [(1, 1)]), ["g"], ["f1", "f2"], ["id"])
    assert lone.first().crowding == INF


def test_selection_order(spark):
    rows = [("p", 0, 1, INF), ("p", 1, 1, 0.5), ("p", 2, 1, 0.7), ("p", 3, 2, INF), ("p", 4, 1, 0.7)]
    df = spark.createDataFrame(rows, "g string, id long, rank long, crowding double")
    got = fronts.select_n(df, ["g"], 4, ["id"]).orderBy("place").collect()
    assert [r.id for r in got] == [0, 2, 4, 1]


def test_hypervolume_reference_edges(spark):
    df = points(spark, [(1, 3), (2, 2), (3, 1), (5, 0), (0, 9)])
    hv = lambda r: indicators.hv2(df, ["g"], ["f1", "f2"], r).first().hv
    assert hv((4.0, 4.0)) == 3 + 2 + 1
    assert hv((3.0, 4.0)) == 2 * 1 + 1 * 1  # (3, 1) lies on the border
    assert hv((1.0, 1.0)) == 0.0
    # one more point never lowers it
    more = df.unionByName(points(spark, [(1.5, 1.5)]))
    assert indicators.hv2(more, ["g"], ["f1", "f2"], (4.0, 4.0)).first().hv > 6
    flat = df.withColumn("f3", F.lit(1.0))
    three = indicators.hv3(flat, ["g"], ["f1", "f2", "f3"], (4.0, 4.0, 3.0)).first().hv
    assert three == 12.0
    none = indicators.hv3(flat, ["g"], ["f1", "f2", "f3"], (4.0, 4.0, 1.0)).first().hv
    assert none == 0.0


def test_contributions_do_not_exceed_the_volume(spark):
    df = points(spark, [(1, 3), (2, 2), (3, 1), (2, 2)])
    got = indicators.hv2_contrib(df, ["g"], ["f1", "f2"], (4.0, 4.0)).collect()
    assert sorted((r.f1, r.contribution) for r in got) == [(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)]


def test_distances_to_itself_are_zero(spark):
    df = points(spark, [(1, 3), (2, 2), (3, 1)])
    assert tuple(indicators.gd(df, df, ["g"], ["f1", "f2"]).first())[1:] == (0.0, 0.0)
    assert tuple(indicators.igd(df, df, ["g"], ["f1", "f2"]).first())[1:] == (0.0, 0.0)
    assert indicators.eps_ind(df, df, ["g"], ["f1", "f2"]).first().eps == 0.0
    worse = df.withColumns({c: F.col(c) + 2 for c in ("f1", "f2")})
    assert indicators.eps_ind(worse, df, ["g"], ["f1", "f2"]).first().eps == 2.0
    assert indicators.eps_ind(df, worse, ["g"], ["f1", "f2"]).first().eps == -2.0
    shared = df.select("f1", "f2")
    # each point is 2 worse in both than the one it came from, and no other is nearer
    assert indicators.gd(worse, shared, ["g"], ["f1", "f2"]).first().gd_plus == pytest.approx(math.sqrt(8))


def test_both_distances_can_be_joined(spark):
    df = points(spark, [(1, 3), (2, 2), (3, 1)])
    a = indicators.gd(df, df, ["g"], ["f1", "f2"])
    assert a.join(indicators.igd(df, df, ["g"], ["f1", "f2"]), "g").count() == 1


def test_spacing_needs_two_points(spark):
    assert indicators.spacing(points(spark, [(1, 1)]), ["g"], ["f1", "f2"]).first().spacing is None
    even = points(spark, [(1, 3), (2, 2), (3, 1)])
    assert indicators.spacing(even, ["g"], ["f1", "f2"]).first().spacing == 0.0


def test_knee_and_scalarised_best(spark):
    df = points(spark, [(0, 10), (1, 1), (10, 0)])
    assert indicators.knee(df, ["g"], "f1", "f2", "id").first().id == 1
    assert indicators.knee(points(spark, [(1, 1)]), ["g"], "f1", "f2", "id").first().distance == 0.0
    best = indicators.scalarise(df, ["g"], ["f1", "f2"], "id", [(1, 0), (0, 1), (0.5, 0.5)])
    assert [r.id for r in best.orderBy("weight").collect()] == [0, 2, 1]


def test_feasible_first(spark):
    df = points(spark, [(1, 1), (2, 2), (3, 1), (9, 9)]).withColumn(
        "viol", F.when(F.col("id") == 0, 5.0).otherwise(0.0)
    )
    assert ids(fronts.front_constrained(df, ["g"], ["f1", "f2"], "viol")) == [1, 2]
    bad = df.withColumn("viol", F.col("id") + 1.0)
    assert ids(fronts.front_constrained(bad, ["g"], ["f1", "f2"], "viol")) == [0]


def test_coverage_includes_equal_points(spark):
    df = points(spark, [(1, 1), (2, 2)]).withColumn("m", F.lit("a")).unionByName(
        points(spark, [(2, 2), (0, 5)]).withColumn("m", F.lit("b"))
    )
    got = {(r.a, r.b): r.coverage for r in indicators.coverage(df, ["g"], "m", ["f1", "f2"]).collect()}
    assert got == {("a", "b"): 0.5, ("b", "a"): 0.5}


def test_attainment(spark):
    df = spark.createDataFrame([("r1", 1.0, 3.0), ("r1", 2.0, 2.0), ("r2", 3.0, 1.0)], "run string, f1 double, f2 double")
    got = indicators.attainment(df, [], "run", "f1", "f2", [1.0, 3.0], [1.0, 2.0, 3.0])
    assert {(r.x, r.y): r.attained for r in got.collect()} == {
        (1.0, 1.0): 0, (1.0, 2.0): 0, (1.0, 3.0): 1, (3.0, 1.0): 1, (3.0, 2.0): 2, (3.0, 3.0): 2,
    }


def preds(spark, rows):
    return spark.createDataFrame([("p", i, y, p) for i, (y, p) in enumerate(rows)], "g string, id long, y double, yhat double")


def test_constant_columns_give_null(spark):
    df = preds(spark, [(2.0, 1.0), (2.0, 3.0), (2.0, 2.0)])
    r = errors.r2(df, ["g"]).first()
    assert r.r2 is None and r.explained_variance is None
    c = errors.corrs(df, ["g"], ["id"]).first()
    assert c.pearson is None and c.spearman is None
    assert errors.kendall(df, ["g"]).first().tau_b is None
    assert errors.rel_errors(df, ["g"]).first().nrmse is None
    assert scoring.fit_linear(df, ["g"], "yhat", "y").first().yhat is None


def test_errors_by_hand(spark):
    df = preds(spark, [(0.0, 1.0), (2.0, 0.0), (4.0, 4.0)])
    e = errors.errors(df, ["g"]).first()
    assert (e.n, e.mae, e.mse, e.max_error) == (3, 1.0, 5 / 3, 2.0)
    assert e.bias == pytest.approx(1 / 3) and e.rmse == pytest.approx(math.sqrt(5 / 3))
    r = errors.rel_errors(df, ["g"]).first()
    assert r.mape == 0.5 and r.zero_y == 1
    assert r.smape == pytest.approx(4 / 3)
    both_zero = preds(spark, [(0.0, 0.0), (1.0, 1.0)])
    assert errors.rel_errors(both_zero, ["g"]).first().smape == 0.0
    # worse than the mean
    assert errors.r2(preds(spark, [(1.0, 9.0), (2.0, -9.0)]), ["g"]).first().r2 < 0


def test_histogram_edges(spark):
    df = preds(spark, [(x, 0.0) for x in (-3.0, -2.0, 0.0, 1.99, 2.0, 7.0)])
    got = {r.bin: r.n for r in errors.err_hist(df, ["g"], -2, 2, 4).collect()}
    assert got == {0: 1, 1: 1, 3: 1, 4: 1, 5: 2}


def test_topk_of_a_small_group(spark):
    got = agreement.topk(preds(spark, [(1.0, 5.0), (2.0, 1.0)]), ["g"], ["id"], 10).first()
    assert (got.k, got.topk_recall, got.regret) == (2, 1.0, 1.0)


def test_agreement_with_an_empty_side(spark):
    one, none = points(spark, [(1, 1)]), points(spark, [(1, 1)]).where("false")
    got = agreement.front_agreement(one, none, ["g"], ["id"]).first()
    assert (got.precision, got.recall, got.jaccard) == (None, 0.0, 0.0)


def test_target_never_reached(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([5.0, 3.0, 4.0])], "r string, i int, value double")
    curve = agreement.anytime(df, ["r"], ["i"])
    assert [x.best for x in curve.orderBy("i").collect()] == [5.0, 3.0, 3.0]
    assert agreement.to_target(curve, ["r"], 1.0).first().first_step is None
    assert agreement.to_target(curve, ["r"], 4.0).first().first_step == 2


def test_validate_reasons(spark):
    rows = [(1, 1.0), (2, None), (3, NAN), (4, INF), (5, 2.0), (5, 3.0), (None, 1.0), (6, -INF)]
    df = spark.createDataFrame(rows, "id long, f1 double")
    good, bad = contract.validate(df, ["id"], ["f1"])
    assert [r.id for r in good.collect()] == [1]
    got = sorted((r.reason, r.id) for r in bad.collect() if r.id is not None)
    assert got == [
        ("duplicate key", 5), ("duplicate key", 5), ("infinite objective", 4), ("infinite objective", 6),
        ("nan objective", 3), ("null objective", 2),
    ]
    assert [r.reason for r in bad.where("id is null").collect()] == ["null key"]


def test_orient_and_normalise(spark):
    df = points(spark, [(1, 5), (3, 5)])
    up = contract.orient(df, {"f1": "max"})
    assert [r.f1 for r in up.orderBy("id").collect()] == [-1.0, -3.0]
    with pytest.raises(ValueError):
        contract.orient(df, {"f1": "up"})
    got = contract.normalise(df, ["g"], ["f1", "f2"]).orderBy("id").collect()
    assert [(r.f1, r.f2) for r in got] == [(0.0, 0.0), (1.0, 0.0)]
    bounds = spark.createDataFrame([("p", 1.0, 5.0, 0.0, 10.0)], "g string, lo_f1 double, hi_f1 double, lo_f2 double, hi_f2 double")
    got = contract.normalise(df, ["g"], ["f1", "f2"], bounds).orderBy("id").collect()
    assert [(r.f1, r.f2) for r in got] == [(0.0, 0.5), (0.5, 0.5)]


def test_schema_is_checked(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    with pytest.raises(SchemaMismatch, match="p_brand"):
        load(spark, str(tmp_path), "part")
    assert load(spark, str(tmp_path), "part", "p_partkey long").count() == 3


def test_written_partitions(spark, tmp_path):
    df = points(spark, [(1, 1), (2, 2)])
    write(df, f"{tmp_path}/out", ["g"])
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == sorted(df.columns) and back.count() == 2
    with pytest.raises(Exception):
        write(df, f"{tmp_path}/out", ["g"])


def test_folds_do_not_depend_on_placement(spark):
    df = spark.range(500)
    a = {r.id: r.fold for r in design.folds(df, ["id"], 5, 1).collect()}
    b = {r.id: r.fold for r in design.folds(df.repartition(7), ["id"], 5, 1).collect()}
    assert a == b and set(a.values()) == set(range(5))
    grouped = design.group_folds(df.withColumn("g", F.col("id") % 10), ["g"], 3)
    assert grouped.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_standardise_fits_on_training_rows_only(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 100.0)], "fold int, v double")
    got = sorted(r.v for r in design.standardise(df, ["v"], F.col("fold") == 0).collect())
    assert got == [-1.0, 1.0, 98.0]
    flat = spark.createDataFrame([(0, 2.0), (1, 9.0)], "fold int, v double")
    assert [r.v for r in design.standardise(flat, ["v"], F.col("fold") == 0).collect()] == [0.0, 0.0]


def test_mean_baseline_without_other_folds(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 5.0)], "g string, fold int, y double")
    got = {(r.g, r.fold): r.yhat for r in scoring.fit_mean(df, ["g"], "fold", "y").collect()}
    assert got == {("a", 0): 3.0, ("a", 1): 1.0, ("b", 0): None}


def test_mlp_equals_the_same_net_as_a_model(spark):
    import numpy as np
    import pandas as pd

    layers = [([[1.0, -2.0], [0.5, 0.25]], [0.0, -1.0]), ([[1.0, 1.0]], [0.5])]
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0])], "id long, x array<double>")
    jvm = {r.id: r.yhat for r in scoring.score_mlp(df, "x", layers).collect()}
    assert jvm == {1: [0.5], 2: [5.75]}

    def load_net():
        def predict(b: pd.DataFrame) -> pd.DataFrame:
            h = np.stack(b["x"].to_numpy())
            h = np.maximum(h @ np.array(layers[0][0]).T + layers[0][1], 0)
            return b[["id"]].assign(yhat=(h @ np.array(layers[1][0]).T + layers[1][1])[:, 0])

        return predict

    got = {r.id: [r.yhat] for r in scoring.score_with(df, load_net, "id long, yhat double").collect()}
    assert got == jvm
    with pytest.raises(ValueError):
        scoring.score_mlp(df, "x", [([[1.0, 1.0]], [])])


def test_friedman_skips_incomplete_problems(spark):
    rows = [("p1", "a", 1.0), ("p1", "b", 2.0), ("p2", "a", 3.0), ("p2", "b", 3.0), ("p3", "a", 1.0)]
    df = spark.createDataFrame(rows, "p string, m string, v double")
    got = {r.m: (r.problems, r.mean_rank) for r in compare.friedman(df, "p", "m", "v").collect()}
    assert got == {"a": (2, 1.25), "b": (2, 1.75)}


def test_partitions_are_few_files_and_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(60_000, numPartitions=24).selectExpr(
        "id", "case when id % 10 < 7 then 'often' when id % 10 < 9 then 'some' end as g", "uuid() as filler"
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        write(df, path, ["g"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = lambda g: len(list((tmp_path / "out").glob(f"g={g}/*.parquet")))
    assert 1 < files("often") <= 24  # split, but not one file per task and value
    assert sum(map(files, ("often", "some", "__HIVE_DEFAULT_PARTITION__"))) <= 36
    write(df.limit(0), f"{tmp_path}/none", ["g"])

    new = spark.createDataFrame([(1, "some", "x")], "id long, g string, filler string")
    for _ in range(2):
        write(new, path, ["g"], mode="partitions")
        got = {r.g: r["count"] for r in spark.read.parquet(path).groupBy("g").count().collect()}
        assert got == {"often": 42_000, "some": 1, None: 6_000}
    with pytest.raises(ValueError):
        write(new, path, mode="partitions")

    def broken(batches):
        raise RuntimeError("a task fails")
        yield from batches

    with pytest.raises(Exception, match="a task fails"):
        write(new.mapInArrow(broken, new.schema), path, ["g"], mode="partitions")
    assert spark.read.parquet(path).where("g = 'some'").count() == 1


def test_chi_square_tail(spark):
    from frontgauge.functions.columns import chi2_tail

    def even(x, df):  # closed form
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))

    def odd(x, df):  # from the error function, upwards by parts
        out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for k in range(3, df + 1, 2):
            out += term
            term *= x / k
        return out

    cases = [(x, df) for x in (0.001, 0.5, 1.0, 3.0, 9.5, 30.0, 120.0) for df in (1, 2, 3, 4, 5, 9, 10, 40, 41, 101)]
    df = spark.createDataFrame([*cases, (None, 3), (1.0, 0), (0.0, 3)], "x double, df int")
    got = {(r.x, r.df): r.p for r in df.withColumn("p", chi2_tail(F.col("x"), F.col("df"))).collect()}
    for x, k in cases:
        want = odd(x, k) if k % 2 else even(x, k)
        assert got[x, k] == pytest.approx(want, rel=1e-9, abs=1e-15), (x, k)
    # published table: 5 % points
    for x, k in ((3.841458820694124, 1), (5.991464547107979, 2), (18.307038053275146, 10)):
        one = spark.range(1).select(chi2_tail(F.lit(x), F.lit(k)).alias("p")).first().p
        assert one == pytest.approx(0.05, abs=1e-9)
    assert got[None, 3] is None and got[1.0, 0] is None and got[0.0, 3] == 1.0


def test_wins_with_tolerance(spark):
    rows = [("p1", "a", 1.0), ("p1", "b", 1.05), ("p2", "a", 3.0), ("p2", "b", 1.0), ("p3", "a", 1.0)]
    df = spark.createDataFrame(rows, "p string, m string, v double")
    got = {(r.a, r.b): (r.wins, r.ties, r.losses) for r in compare.wtl(df, ["p"], "m", "v", 0.1).collect()}
    assert got == {("a", "b"): (0, 1, 1), ("b", "a"): (1, 1, 0)}


def test_undefined_metrics_do_not_count(spark):
    rows = [("p1", "a", 1.0), ("p1", "a", None), ("p1", "b", 3.0), ("p2", "a", None), ("p2", "b", 2.0),
            ("p3", "a", None)]
    df = spark.createDataFrame(rows, "p string, m string, v double")
    got = {(r.level, r.p, r.m): (r.n, r["mean"]) for r in compare.summary(df, {"p": ["p"], "m": ["m"]}, "v").collect()}
    assert got == {("p", "p1", None): (2, 2.0), ("p", "p2", None): (1, 2.0), ("p", "p3", None): (0, None),
                   ("m", None, "a"): (1, 1.0), ("m", None, "b"): (2, 2.5)}
    ranks = {r.m: (r.problems, r.mean_rank) for r in compare.friedman(df, "p", "m", "v").collect()}
    assert ranks == {"a": (1, 1.0), "b": (1, 2.0)}
    wins = {(r.a, r.b): (r.wins, r.ties, r.losses) for r in compare.wtl(df, ["p"], "m", "v").collect()}
    assert wins == {("a", "b"): (1, 0, 0), ("b", "a"): (0, 0, 1)}


def test_wilcoxon_keeps_groups_without_a_difference(spark):
    rows = [("g", 0.0), ("g", None), ("h", None), ("k", 1.0), ("k", 0.0)]
    df = spark.createDataFrame(rows, "g string, d double")
    got = {r.g: (r.n, r.w_plus, r.w_minus, r.z is None, r.p is None) for r in compare.wilcoxon(df, ["g"], "d").collect()}
    assert got == {"g": (0, 0.0, 0.0, True, True), "h": (0, 0.0, 0.0, True, True), "k": (1, 1.0, 0.0, False, False)}


def test_a12_without_values_or_spread(spark):
    rows = [("g", "a", 1.0), ("g", "a", None), ("g", "b", 2.0), ("t", "a", 1.0), ("t", "b", 1.0),
            ("e", "a", None), ("e", "b", 1.0)]
    df = spark.createDataFrame(rows, "g string, m string, v double")
    got = {r.g: (r.n_a, r.n_b, r.u, r.a12, r.p is None) for r in compare.a12(df, ["g"], "m", "v", "a", "b").collect()}
    assert got == {"g": (1, 1, 0.0, 0.0, False), "t": (1, 1, 0.5, 0.5, True), "e": (0, 1, 0.0, None, True)}


def test_holm_leaves_out_undefined(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.02)], "id long, p double")
    assert {r.id: r.p_holm for r in compare.holm(df, [], "p", ["id"]).collect()} == {1: 0.02, 2: None, 3: 0.02}


def test_mlp_without_a_usable_input(spark):
    net = [([[1.0, -1.0], [0.5, 0.5]], [0.0, 0.1]), ([[1.0, 1.0]], [0.1])]
    df = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, 2.0])], "id long, x array<double>")
    got = {r.id: r.yhat for r in scoring.score_mlp(df, "x", net).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and got[4] == pytest.approx([1.7])


def test_mlp_cost_adds_up_over_layers(spark):
    layer = ([[0.1] * 16 for _ in range(16)], [0.0] * 16)
    df = spark.createDataFrame([(1, [1.0] * 16)], "id long, x array<double>")
    sizes = [
        len(scoring.score_mlp(df, "x", [layer] * n)._jdf.queryExecution().executedPlan().toString()) for n in (3, 6)
    ]
    assert sizes[1] < 2.5 * sizes[0]


def test_coverage_of_all_labels_in_the_data(spark):
    df = spark.createDataFrame([("g", "a", 1.0, 1.0), ("g", "b", 2.0, 2.0), ("g", "c", 3.0, 3.0)],
                               "g string, m string, f1 double, f2 double")
    got = {(r.a, r.b): r.coverage for r in indicators.coverage(df, ["g"], "m", ["f1", "f2"]).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("b", "a"): 0.0, ("c", "a"): 0.0, ("c", "b"): 0.0}


def test_empty_input(spark):
    df = points(spark, [(1, 1)]).where("false")
    objs = ["f1", "f2"]
    for got in (
        fronts.front2(df, ["g"], *objs),
        fronts.front(df.withColumn("f3", F.lit(0.0)), ["g"], [*objs, "f3"]),
        fronts.nd_rank(df, ["g"], objs),
        fronts.dominance(df, ["g"], objs),
        indicators.hv2(df, ["g"], objs, (1.0, 1.0)),
        indicators.gd(df, df, ["g"], objs),
        agreement.pair_order(df, ["g"], ["f1"], ["f2"]),
        errors.kendall(df, ["g"], "f1", "f2"),
    ):
        assert got.count() == 0


def test_same_result_for_any_placement(spark):
    df = spark.range(400).selectExpr(
        "'p' as g", "id", "cast(id * 37 % 101 as double) as f1", "cast(id * 53 % 97 as double) as f2"
    )
    want = ids(fronts.front2(df, ["g"], "f1", "f2"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert ids(fronts.front2(df.repartition(5), ["g"], "f1", "f2")) == want
            assert ids(fronts.front(df.withColumn("f3", F.lit(1.0)), ["g"], ["f1", "f2", "f3"])) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
