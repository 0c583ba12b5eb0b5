"""Shapes of the physical plans that matter at scale."""

import pytest

from cairnframe.operators import access as ac
from cairnframe.operators import graph as gr
from cairnframe.plans.catalog import QUERIES, Inputs

from .conftest import SF_DIR


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "key",
    [k for k in sorted(QUERIES) if not k.startswith("s_")],
)
def test_no_cross_product(spark, key):
    """Scalar subqueries aside, nothing is joined without an equality."""
    plan = plan_of(QUERIES[key].run(Inputs(spark, SF_DIR)))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["v_knn_join", "v_upsert", "v_recommend", "c_put"])
def test_rank_is_limited_before_the_shuffle(inputs, key):
    plan = plan_of(QUERIES[key].run(inputs))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_single_query_is_a_top_k(inputs):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["v_knn_single"].run(inputs))


def test_hot_filter_key_reaches_the_scan(inputs):
    assert "EqualTo(label,3)" in plan_of(QUERIES["v_filter_promoted"].run(inputs))


def test_membership_stays_a_semi_join(inputs):
    asks = inputs["access_asks"].select("request_id", "user_id", "organization")
    assert "LeftSemi" in plan_of(ac.org_members(asks, inputs["grants"].select("user_id", "resource")))
    assert "LeftSemi" in plan_of(gr.with_out_edge(inputs["vertices"], inputs["edges"], gr.ROOT_EDGE))


@pytest.mark.parametrize("key", ["u_dups", "p_unique"])
def test_hot_keys_are_counted_before_the_shuffle(inputs, key):
    """No window over a whole key: partial aggregation, then a join."""
    from cairnframe.operators import state as st
    from cairnframe.operators import uploads as up

    if key == "u_dups":
        files = inputs["lineitem"].selectExpr(
            "l_orderkey AS session_id", "l_linenumber AS ordinal", "'a' AS raw_name", "'' AS subdirectory"
        )
        plan = plan_of(up.flag_duplicates(up.plan_targets(files)))
    else:
        plan = plan_of(st.uniqueness_violations(inputs["pending"]))
    assert "Window" not in plan and "partial_min" in plan


def test_identities_are_parsed_once_for_both_reconciliations(inputs):
    """Projects that carry their identity stay as they are, and owners and organisations come from one aggregation."""
    from cairnframe.operators import state as st

    named = st.with_identity(inputs["projects"])
    assert st.with_identity(named) is named
    plan = plan_of(st.reconcile_orgs(named, inputs["installs"], inputs["org_state"].limit(0), st.F.lit(None).cast("timestamp_ntz")))
    assert plan.count("BroadcastHashJoin") + plan.count("SortMergeJoin") <= 2 + plan_of(inputs["installs"]).count("Join")


def test_asked_sessions_read_their_files_once(inputs):
    plan = plan_of(QUERIES["u_session"].run(inputs))
    assert "Window" not in plan and plan.count("Scan parquet") <= 5


def test_documents_are_parsed_once(inputs):
    plan = plan_of(QUERIES["c_decode"].run(inputs))
    assert "from_json" not in plan.lower() and "jsontostructs" not in plan.lower()
