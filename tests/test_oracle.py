"""Every registered query against its SQL, over whole tables."""

import oracle
import pytest
from __spark_entry__ import ENTRIES, entry, oracle_sql, queries

SF = "0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_of_the_catalog_has_sql():
    assert set(ENTRIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, name, queries()[name], oracle_sql()[name], SF) is None


def test_entry(spark):
    rows = entry(spark).orderBy("model").collect()
    assert [r["model"] for r in rows] == ["m1", "m2", "m3"]
    assert rows[0]["rmse_f1"] < rows[1]["rmse_f1"] < rows[2]["rmse_f1"]


def test_report_at_larger_scale(spark):
    """Values settled when the queries were planned."""
    got = {r["model"]: r for r in queries()["surrogate_report"](spark, "/root/testdata/sf0.01").collect()}
    want = {
        "m1": (25, 0.66943, 0.77152, 0.55578, 5.5569, 0.1649),
        "m2": (25, 0.38581, 0.47314, 0.26695, 27.7879, 0.8502),
        "m3": (25, 0.19229, 0.30233, 0.12707, 108.7479, 3.3533),
    }
    cols = ("problems", "precision", "recall", "jaccard", "rmse_f1", "rmse_f2")
    for m, values in want.items():
        for c, v in zip(cols, values):
            assert got[m][c] == pytest.approx(v, abs=6e-5)
