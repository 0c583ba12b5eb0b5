"""Project and organisation state."""

import pytest
from pyspark.sql import functions as F

from cairnframe.operators import mutations
from cairnframe.operators import state as st

from .conftest import rows



def now():
    return F.expr("TIMESTAMP '2025-01-01 00:00:00'")


ORG_STATE = "organization string, installed boolean, installation_id long, installation_target string, installation_target_type string, html_url string, repository_selection string"
STATE = (
    "project_id string, repo_host string, repo_owner string, repo_name string, installation_id long, installation_target string, "
    "installation_target_type string, mirror_path string, sync_state string, default_branch string, last_refreshed_at timestamp, last_error string"
)
PROJECTS = "project_id string, organization string, project string, src_repo string"


def projects(spark, *items):
    return spark.createDataFrame([(pid, *pid.split("/"), repo) for pid, repo in items], PROJECTS)


def orgs(spark, *items):
    return spark.createDataFrame(list(items), ORG_STATE)


def state(spark, *items):
    names = [c.split()[0] for c in STATE.split(", ")]
    base = dict.fromkeys(names) | {"repo_host": "github.com", "repo_owner": "o", "repo_name": "r", "mirror_path": "", "sync_state": "ready"}
    return spark.createDataFrame([tuple({**base, **i}[n] for n in names) for i in items], STATE)


def test_upsert_keeps_what_an_update_leaves_alone(spark):
    schema = "id string, status string, created_at string"
    base = spark.createDataFrame([("a", "old", "t0"), ("b", "old", "t0")], schema)
    batch = spark.createDataFrame([("b", "new", "t1"), ("c", None, "t1")], schema)
    assert rows(st.upsert_state(base, batch, "upload_session", "id")) == [("a", "old", "t0"), ("b", "new", "t0"), ("c", None, "t1")]
    assert rows(st.upsert_state(base, batch, "project_state", "id")) == [("a", "old", "t0"), ("b", "new", "t1"), ("c", None, "t1")]


def test_upsert_sets_null_and_keeps_null(spark):
    """A NULL in the new row replaces; a NULL in a kept column stays."""
    schema = "id string, installation_id long, repo_id long, source string"
    base = spark.createDataFrame([("a", None, 1, "s")], schema)
    batch = spark.createDataFrame([("a", 5, 6, None)], schema)
    assert rows(st.upsert_state(base, batch, "pending_repository", "id")) == [("a", None, 1, None)]


def test_storage_check(spark):
    p = projects(spark, ("o/a", ""), ("o/b", ""), ("o/c", ""))
    resources = spark.createDataFrame(
        [(" /programs/o/projects/a ",), ("/organization/o/project/b",), ("/programs/o/projects/c/x",), ("/programs/o",)], "resource string"
    )
    assert rows(st.storage_check(p, resources), "project_id", "storage_pass", "storage_reason") == [
        ("o/a", True, None),
        ("o/b", True, None),
        ("o/c", False, "missing_storage_scope"),
    ]
    failed = st.storage_check(p, resources, "listing failed")
    assert set(rows(failed, "storage_pass", "storage_details")) == {(False, "listing failed")}


@pytest.mark.parametrize(
    "app, done, total, expected",
    [
        (False, 3, 3, "not_connected"),
        (True, 0, 0, "connected"),
        (True, 0, 2, "installed_unconfigured"),
        (True, 1, 2, "partially_configured"),
        (True, 2, 2, "connected"),
    ],
)
def test_configuration_state(spark, app, done, total, expected):
    one = spark.range(1)
    assert one.select(st.configuration_state(F.lit(app), F.lit(done), F.lit(total))).first()[0] == expected


def test_checks_and_rollups(spark):
    p = projects(spark, ("all/a", "github.com/x/a"), ("all/b", ""), ("sel/a", "github.com/y/a"), ("sel/b", "github.com/y/b"), ("none/a", ""))
    o = orgs(
        spark,
        ("all", True, 1, "all", "Organization", "u1", "all"),
        ("sel", True, 2, "sel", "Organization", "u2", "selected"),
        ("empty", True, 3, "empty", "Organization", "u3", "all"),
    )
    s = state(spark, {"project_id": "sel/a", "installation_target": "y"}, {"project_id": "all/a", "installation_id": 99})
    resources = spark.createDataFrame([("/programs/all/projects/a",), ("/programs/sel/projects/b",)], "resource string")
    checks = st.project_checks(p, o, s, resources)
    assert rows(checks, "project_id", "installed", "installation_id", "installation_target", "configured", "github_reason") == [
        ("all/a", True, 1, "x", True, None),
        ("all/b", True, 1, None, False, "missing_repository_link"),
        ("none/a", False, None, None, False, "missing_repository_link"),
        ("sel/a", True, None, "y", False, None),
        ("sel/b", False, None, None, False, "missing_github_connection"),
    ]
    by_org = st.org_rollup(checks, o)
    assert rows(by_org, "organization", "total_projects", "connected_projects", "configured_projects", "configuration_state") == [
        ("all", 2, 2, 1, "partially_configured"),
        ("none", 1, 0, 0, "not_connected"),
        ("sel", 2, 1, 0, "installed_unconfigured"),
    ]
    total = st.all_rollup(by_org).first()
    assert (total.total_organizations, total.installed_organizations, total.total_projects, total.configuration_state) == (3, 2, 5, "partially_configured")
    assert rows(st.organizations(p)) == [("all",), ("none",), ("sel",)]


def test_status_defaults(spark):
    p = projects(spark, ("o/a", "github.com/x/a"), ("o/b", "github.com/x/b"), ("o/c", "bad"))
    s = state(spark, {"project_id": "o/a", "sync_state": "", "installation_id": 4})
    assert rows(st.project_status(p, s, orgs(spark)), "project_id", "installation_state", "sync_state", "organization_app_installed") == [
        ("o/a", "connected", "never_synced", False),
        ("o/b", "not_connected", "never_synced", False),
    ]


INSTALLS = "organization string, owner string, status_code int, installed boolean, installation_id long, installation_target string, installation_target_type string, html_url string, repository_selection string"


def test_reconcile_organisations(spark):
    p = projects(
        spark,
        ("first/a", "github.com/aa/r"),
        ("first/b", "github.com/bb/r"),
        ("first/c", "github.com/cc/r"),
        ("fail/a", "github.com/ff/r"),
        ("kept/a", "bad"),
        ("lost/a", "github.com/ll/r"),
        ("none/a", ""),
    )
    installs = spark.createDataFrame(
        [
            ("first", "aa", 404, False, None, None, None, None, None),
            ("first", "bb", 200, True, 2, "bb", "Organization", "u", "all"),
            ("first", "cc", 200, True, 3, "cc", "Organization", "u", "all"),
            ("fail", "ff", 500, False, None, None, None, None, None),
            ("lost", "ll", 200, False, None, None, None, None, None),
        ],
        INSTALLS,
    )
    old = orgs(spark, ("kept", True, 9, "k", "Organization", "u9", "selected"), ("lost", True, 8, "l", "Organization", "u8", "all"))
    new = st.reconcile_orgs(p, installs, old, now())
    assert rows(new, "organization", "installed", "installation_id", "error") == [
        ("fail", False, None, "integration_error"),
        ("first", True, 2, None),
        ("kept", True, 9, None),
        ("lost", False, None, None),
        ("none", False, None, None),
    ]
    assert new.filter("installed = (configured_at IS NULL)").count() == 0

    probes = spark.createDataFrame([("lost/a", 403, None), ("first/a", 403, None)], "project_id string, token_status int, metadata_ok boolean")
    s = state(spark, {"project_id": "lost/a", "installation_id": 8, "installation_target": "l", "sync_state": "ready"})
    done = st.reconcile_projects(p, new, s, probes)
    assert rows(done, "project_id", "outcome", "installation_id", "installation_target", "sync_state") == [
        ("first/a", "applied", 2, "aa", "never_synced"),
        ("first/b", "applied", 2, "bb", "never_synced"),
        ("first/c", "applied", 2, "cc", "never_synced"),
        ("lost/a", "cleared", None, None, "ready"),
    ]


@pytest.mark.parametrize(
    "token, metadata, outcome, kept",
    [(200, True, "applied", None), (200, False, "cleared", None), (404, True, "cleared", None), (502, True, "error", 5), (None, None, "error", 5)],
)
def test_reconcile_project_by_probe(spark, token, metadata, outcome, kept):
    p = projects(spark, ("o/a", "github.com/x/a"))
    org_rows = orgs(spark, ("o", True, None, "x", "Organization", None, "selected")).withColumn("error", F.lit(None).cast("string"))
    probes = spark.createDataFrame([("o/a", token, metadata)], "project_id string, token_status int, metadata_ok boolean")
    done = st.reconcile_projects(p, org_rows, state(spark, {"project_id": "o/a", "installation_id": 5}), probes).first()
    assert (done.outcome, done.installation_id) == (outcome, kept)


PENDING = "id string, installation_id long, user_id string, setup_session_id string, repo_id long, repo_full_name string, added_at int, resolved_at timestamp, removed_at timestamp"


def pending(spark):
    data = [
        ("a", 1, None, None, 10, "o/z", 2, None, None),
        ("b", 1, None, None, 10, "o/a", 2, None, None),
        ("c", 1, "u", "s", 10, "o/b", 1, None, None),
        ("d", 1, "u", "t", 10, "o/b", 3, None, None),
        ("e", 2, "u", "s", 10, "o/b", 3, None, None),
    ]
    return spark.createDataFrame(data, PENDING)


def test_pending_lists_and_times(spark):
    p = pending(spark)
    assert [r.id for r in st.open_pending(p, installation_id=1).collect()] == ["c", "b", "a", "d"]
    assert [r.id for r in st.open_pending(p, user_id="u", setup_session_id="s").collect()] == ["c", "e"]
    keys = spark.createDataFrame([(1, 10)], "installation_id long, repo_id long")
    removed = st.close_pending(p, keys, ["installation_id", "repo_id"], "removed_at", now())
    assert rows(st.open_pending(removed), "id") == [("e",)]
    again = st.close_pending(removed, keys, ["installation_id", "repo_id"], "resolved_at", now())
    assert again.filter("resolved_at IS NOT NULL").count() == 0  # removed rows are not open
    by_id = st.close_pending(removed, spark.createDataFrame([("a",)], "id string"), ["id"], "resolved_at", now(), only_open=False)
    assert rows(by_id.filter("resolved_at IS NOT NULL"), "id") == [("a",)]


def test_uniqueness_depends_on_the_user(spark):
    assert rows(st.uniqueness_violations(pending(spark)), "id", "first_id", "copies") == [("b", "a", 2), ("d", "c", 2)]


def test_repo_ids(spark):
    df = spark.createDataFrame([([1, 2, 2], "[2,2,3]"), ([], "oops"), (None, None)], "ids array<bigint>, raw string")
    got = df.select(st.encode_repo_ids(F.col("ids")), st.decode_repo_ids(F.col("raw")), st.new_repo_ids(F.col("ids"), F.col("raw"))).collect()
    assert [tuple(r) for r in got] == [("[1,2,2]", [2, 3], [1]), ("[]", [], []), ("[]", [], None)]


def test_cascade(spark):
    tables = {
        "files": spark.createDataFrame([("s1",), ("s2",), ("s3",)], "session_id string"),
        "sessions": spark.createDataFrame([("s1", "o/a"), ("s2", "o/b"), ("s3", "p/a")], "id string, project_id string"),
        "states": spark.createDataFrame([("o/a",), ("o/b",), ("p/a",)], "project_id string"),
    }
    left = st.cascade_delete(tables, spark.createDataFrame([("o/a",)], "project_id string"))
    assert rows(left["files"]) == [("s2",), ("s3",)]
    p = projects(spark, ("o/a", ""), ("o/b", ""), ("p/a", ""))
    left = st.cascade_delete_orgs(tables, p, spark.createDataFrame([("o",)], "organization string"))
    assert {k: rows(v, v.columns[0]) for k, v in left.items()} == {"files": [("s3",)], "sessions": [("s3",)], "states": [("p/a",)]}


def test_identity_drift(spark):
    p = projects(spark, ("o/a", "github.com/x/a"), ("o/b", "github.com/x/new"), ("o/c", "bad"), ("o/d", "github.com/x/d"))
    s = state(
        spark,
        {"project_id": "o/a", "repo_owner": "x", "repo_name": "a", "mirror_path": "/d/github.com/x/a.git"},
        {"project_id": "o/b", "repo_owner": "x", "repo_name": "b", "installation_id": 3},
        {"project_id": "o/c"},
    )
    aligned = st.align_identity(s, p, "/d/")
    assert rows(aligned, "project_id", "repo_name", "mirror_path", "changed", "installation_id") == [
        ("o/a", "a", "/d/github.com/x/a.git", False, None),
        ("o/b", "new", "/d/github.com/x/new.git", True, 3),
        ("o/c", "r", "", False, None),
    ]
    put = st.put_project_state(s, p, "/d")
    assert rows(put, "project_id", "repo_name", "sync_state", "installation_id") == [
        ("o/a", "a", "ready", None),
        ("o/b", "new", "never_synced", None),
        ("o/c", "r", "ready", None),
        ("o/d", "d", "never_synced", None),
    ]


def test_bind(spark):
    p = projects(spark, ("o/a", ""), ("off/a", ""))
    o = orgs(spark, ("o", True, 7, "o", "Organization", "u", "all"), ("off", False, 8, None, None, None, None))
    repos = spark.createDataFrame(
        [(7, "Lab/Tools", " ", ""), (7, "Lab/Clone", "https://github.com/Lab/Clone.git", "x"), (7, "Lab/Bad", "bad", ""), (8, "Lab/Tools", "", "")],
        "installation_id long, full_name string, clone_url string, html_url string",
    )
    asked = [("o/a", " lab/tools "), ("o/a", "LAB/clone"), ("o/a", "lab/other"), ("o/a", "Lab/Bad"), ("o/a", ""), ("off/a", "Lab/Tools"), ("o/x", "Lab/Tools")]
    got = st.bind_repositories(spark.createDataFrame(asked, "project_id string, repository_full_name string"), p, o, repos)
    assert rows(got, "project_id", "repository_full_name", "error_type", "src_repo") == sorted(
        [
            ("o/a", " lab/tools ", None, "https://github.com/Lab/Tools"),
            ("o/a", "LAB/clone", None, "https://github.com/Lab/Clone"),
            ("o/a", "lab/other", "conflict", None),
            ("o/a", "Lab/Bad", "integration_error", None),
            ("o/a", "", "invalid_request", None),
            ("off/a", "Lab/Tools", "conflict", None),
            ("o/x", "Lab/Tools", "not_found", None),
        ],
        key=repr,
    )


@pytest.mark.parametrize(
    "path, prefix, org, project, provider, expected",
    [
        (" s3://x ", "p", "o", "p", "gs", "s3://x"),
        ("", "/p/q/", "o", "p", "GCS", "gs://b/p/q"),
        ("", "", "/o/", "p", "azure", "azblob://b/o/p"),
        (None, None, None, "p", "file", "file://b/p"),
        ("", "", "", "", "file", ""),
        ("", "", "a", "../b", None, "s3://b/b"),
        ("", "", "a", "..", "", "s3://b/."),
        ("", "", "..", "a", "", "s3://b/../a"),
    ],
)
def test_scope_path(spark, path, prefix, org, project, provider, expected):
    df = spark.createDataFrame([(path, prefix, org, project, provider, " b ")], "a string, b string, c string, d string, e string, f string")
    assert df.select(st.scope_path(*[F.col(c) for c in "abcdef"])).first()[0] == expected


def test_refresh(spark):
    s = state(spark, {"project_id": "a", "last_error": "x"}, {"project_id": "b", "default_branch": "m"}, {"project_id": "c", "last_error": "y"})
    started = st.start_refresh(s, spark.createDataFrame([("a",), ("b",)], "project_id string"))
    assert rows(started, "project_id", "sync_state", "last_error") == [("a", "updating", None), ("b", "updating", None), ("c", "ready", "y")]
    results = spark.createDataFrame([("a", True, "main", None), ("b", False, None, "boom")], "project_id string, ok boolean, branch string, message string")
    done = st.finish_refresh(started, results, now())
    assert rows(done, "project_id", "sync_state", "default_branch", "last_error") == [("a", "ready", "main", None), ("b", "error", "m", "boom"), ("c", "ready", None, "y")]


def test_setup_plan(spark):
    grants = spark.createDataFrame(
        [(1, "/programs/o/projects/p", "read", "x"), (2, "/programs/o/projects", "create-descendant", "arborist"), (3, "/programs/o", "manage-owners", "other")],
        "user_id long, resource string, method string, service string",
    )
    asks = spark.createDataFrame([(u, "o", "p") for u in (1, 2, 3)], "user_id long, organization string, project string")
    assert rows(st.setup_plan(asks, grants), "user_id", "to_create") == [
        (1, []),
        (2, ["/programs/o/projects/p"]),
        (3, ["/programs/o", "/programs/o/projects/p"]),
    ]


def test_replace_and_lookup(spark):
    base = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "s string, x int")
    batch = spark.createDataFrame([("s1", 9), ("s3", 8)], "s string, x int")
    assert rows(mutations.replace_groups(base, batch, ["s"])) == [("s1", 9), ("s2", 3), ("s3", 8)]
    assert rows(mutations.delete_flags(base, batch, ["s"])) == [("s1", True), ("s3", False)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """A third of all changes on one id: the result is whole and one row wide."""
    changes = spark.range(30_000).selectExpr("id AS seq", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS key")
    latest = mutations.latest_per_key(changes, ["key"], "seq")
    assert latest.count() == 20_001 and latest.filter("key = 0").first()["seq"] == 29_997
