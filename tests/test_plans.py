"""Plans: no pairing of all rows, and scans that read only what is needed."""

import contextlib
import io

import pytest
from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name",
    [
        "front_2d", "front_3d", "front_3d_whole", "front_agreement", "surrogate_report", "prediction_errors",
        "dominance_counts", "pair_order", "kendall_tau", "set_coverage", "win_tie_loss", "hypervolume_3d",
        "inverted_generational_distance", "weighted_sum_best", "knn_baseline", "nondominated_rank",
    ],
)
def test_no_pairing(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(queries()["front_2d"](spark, FOLDER))
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size:int,p_retailprice:double>" in text


def test_filter_reaches_the_scan(spark):
    text = plan(queries()["mann_whitney_a12"](spark, FOLDER))
    assert "PushedFilters: [Or(EqualTo(event_type,click),EqualTo(event_type,error))]" in text
    assert "ReadSchema: struct<event_type:string,value:double>" in text


def test_two_objective_front_sorts_once(spark):
    text = plan(queries()["front_2d"](spark, FOLDER)).split("\n\n")[0]
    assert text.count("Exchange") == 1


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(queries()["selection"](spark, FOLDER))
