"""Physical plans: what the scans read, and what must not occur."""

import re

import pytest

from caudal.plans import core_problems, network


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, most", [("p5_totals", 2), ("norm_icd_chapter", 2), ("edges_residence", 2), ("batch_icd_filter", 2), ("link_patient_key", 5)])
def test_scans_read_only_what_is_used(spark, folder, name, most):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan((core_problems.QUERIES | network.QUERIES)[name](spark, folder)))
    assert schemas and all(s.count(":") <= most for s in schemas)


@pytest.mark.parametrize("name", [n for n in network.QUERIES if not n.startswith(("graph_wcc", "graph_scc", "graph_subgraph", "gate_"))])
def test_no_python_and_no_cross_join(spark, folder, name):
    p = plan(network.QUERIES[name](spark, folder))
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", p)


def test_filters_reach_the_scan(spark, folder):
    p = plan(network.QUERIES["geo_polygon_centroid"](spark, folder))
    assert "IsNotNull(latitude)" in p and "PushedFilters: [" in p


def test_few_candidates_leave_a_task(spark, folder):
    """The two first of equal candidates are picked before the shuffle, and no scan is read for a file list."""
    assert plan(network.QUERIES["match_events"](spark, folder)).count("WindowGroupLimit") >= 2
