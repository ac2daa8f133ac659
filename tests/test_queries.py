"""Every named query against its SQL at the smallest scale, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
import check
from fieldaudit.plans import catalog


@pytest.fixture(scope="module")
def con(tiny):
    return check.connect(tiny)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees(spark, con, tiny, name):
    text, _, ok = check.compare(spark, con, name, tiny)
    assert ok, text


def test_plans_have_no_cartesian_product_and_no_python(spark, tiny):
    for name in ("hamming_radius_join", "auroc", "holm_families", "leakage_audit", "prediction_coverage", "split_assignment",
                 "rule_flag_rate", "distance_auc", "bootstrap_auroc"):
        plan = entry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan, name


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 20
