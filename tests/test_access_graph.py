"""Access grants and the directory graph."""

import json
import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from cairnframe.functions.text import ancestors, normalize_resource_path, path_escape, valid_path
from cairnframe.operators import access as ac
from cairnframe.operators import graph as gr

from .conftest import rows

GRANTS = "user_id long, resource string, method string, service string"


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("", ""),
        ("  ", ""),
        ("/", ""),
        ("/programs/a/projects/b", "/programs/a/projects/b"),
        (" /programs/a/ ", "/programs/a"),
        ("programs/a", "/programs/a"),
        ("https://x.org/programs/a/projects/b/", "/programs/a/projects/b"),
        ("https://x.org", "/https://x.org"),
        ("//x.org/programs/a", "/programs/a"),
        ("/programs/a?x=1#y", "/programs/a"),
        ("/programs/a%20b+c", "/programs/a b+c"),
        ("/programs/a%zz", "/programs/a%zz"),
        ("mailto:someone", "/mailto:someone"),
        ("/a:b/c", "/a:b/c"),
        ("*", "/*"),
    ],
)
def test_normalize_resource_path(spark, raw, expected):
    assert texts(spark, [raw]).select(normalize_resource_path(F.col("x"))).first()[0] == expected


SNAPSHOTS = [
    (1, {"authz": {"/programs/org-a": [{"method": "manage-owners", "service": "arborist"}], "/programs/org-a/projects/proj-a": [{"method": "read", "service": "*"}, {"method": "update", "service": "*"}]}}),
    (2, {"authz": {}, "project_access": {"/programs/b": [{"method": "read", "service": "s"}, 5, {"method": 1}], "/odd": "x"}}),
    (3, {}),
    (4, {"authz": {"/all": [{"method": "*", "service": "*"}]}}),
    (5, {"authz": [1], "project_access": {}}),
]


def snapshots(spark):
    return spark.createDataFrame([(u, json.dumps(s)) for u, s in SNAPSHOTS] + [(6, "{bad")], "user_id long, snapshot string")


def test_explode_grants(spark):
    got = rows(ac.explode_grants(snapshots(spark)))
    assert got == sorted(
        [
            (1, "/programs/org-a", "manage-owners", "arborist"),
            (1, "/programs/org-a/projects/proj-a", "read", "*"),
            (1, "/programs/org-a/projects/proj-a", "update", "*"),
            (2, "/programs/b", "", ""),
            (2, "/programs/b", "read", "s"),
            (4, "/all", "*", "*"),
        ],
        key=repr,
    )
    assert [r[0] for r in rows(ac.snapshot_errors(snapshots(spark)), "user_id")] == [3, 6]


def test_allowed_resources(spark):
    grants = ac.explode_grants(snapshots(spark))
    assert rows(ac.allowed_resources(grants, "update", "*").filter("user_id = 1"), "resource") == [("/programs/org-a/projects/proj-a",)]
    assert rows(ac.allowed_resources(grants, "delete", "anything"), "user_id") == [(4,)]
    assert rows(ac.allowed_resources(grants, "read", "other").filter("user_id = 2")) == []


def test_projects_and_organisations(spark):
    allowed = spark.createDataFrame(
        [
            (1, "https://x.org/programs/Alpha/projects/P1/"),
            (1, "/organization/Alpha/project/P2"),
            (1, "/programs/Other"),
            (2, "/programs/Alpha"),
        ],
        "user_id long, resource string",
    )
    projects = spark.createDataFrame([("Alpha/P1",), ("Alpha/P2",), ("Alpha/P1/x",), ("Alpha/",), ("plain",)], "project_id string")
    assert rows(ac.filter_projects(projects, allowed), "user_id", "project_id") == [(1, "Alpha/P1")]
    assert rows(ac.allowed_orgs(allowed)) == [(1, "Alpha"), (1, "Other"), (2, "Alpha")]


@pytest.mark.parametrize("resource", ["*", "/", "/programs", "/programs/o", "/programs/o/projects", "/programs/o/projects/p"])
def test_admin_allows(spark, resource):
    asks = spark.createDataFrame([(1, "o", "p"), (1, "o", "q"), (2, "o", "p")], "user_id long, organization string, project string")
    allowed = spark.createDataFrame([(1, resource), (2, "/programs/o/")], "user_id long, resource string")
    assert (1, "o", "p") in rows(ac.admin_allows(asks, allowed))
    assert all(r[0] == 1 for r in rows(ac.admin_allows(asks, allowed)))


def test_route_policy(spark):
    grants = spark.createDataFrame([(1, "/programs/a/projects/b", "read", "s"), (2, "/programs/a/projects/b", "create", "*")], GRANTS)
    asked = [
        (1, 1, "GET", "explorer", "a-b", True, "allowed"),
        (2, 1, "PUT", "explorer", "a-b", True, "forbidden"),
        (3, 2, "DELETE", "", "a-b", True, "allowed"),
        (4, 2, "PATCH", "explorer", "a-b", True, "method_not_allowed"),
        (5, 1, "GET", "explorer", "a-b", False, "missing_authorization"),
        (6, 1, "GET", "explorer", "a-b-c", True, "invalid_project_id"),
        (7, 1, "GET", "explorer", "", True, "invalid_project_id"),
        (8, 3, "GET", "nav", "x", False, "allowed"),
        (9, 3, "PUT", "projects", "x", True, "forbidden"),
        (10, 3, "POST", "nav", "x", True, "method_not_allowed"),
    ]
    schema = "request_id long, user_id long, method string, config_type string, config_id string, has_token boolean, want string"
    got = ac.route_policy(spark.createDataFrame(asked, schema), grants)
    assert got.filter("outcome <> want").count() == 0 and got.count() == len(asked)
    messages = dict(rows(got, "request_id", "message"))
    assert messages[2] == "User is not allowed to create on any resource path"


def test_path_escape(spark):
    assert texts(spark, ["a b/c+d&e=f:g@h$~*é"]).select(path_escape(F.col("x"))).first()[0] == "a%20b%2Fc+d&e=f:g@h$~%2A%C3%A9"


# ---------------------------------------------------------------- graph

SEGMENT = st_.sampled_from(["", ".", "..", "a", "b.c", "..x", "..."])


def expected_valid(path):
    cleaned = posixpath.normpath("/" + path.lstrip("/")) if path else ""
    return path.startswith("/") and "\\" not in path and not cleaned.startswith("/..")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st_.lists(st_.lists(SEGMENT, max_size=5).map("/".join), min_size=10, max_size=40))
def test_valid_path_against_path_cleaning(spark, paths):
    paths += ["/" + p for p in paths] + ["/a\\b", "/", "", "/../a", "/a/../..x", "/a\x00"]
    got = texts(spark, paths).select("x", valid_path(F.col("x"))).collect()
    for path, valid in got:
        assert valid == (expected_valid(path) and "\x00" not in path), path


def test_ancestors(spark):
    df = texts(spark, ["a/b/c", "a", ""])
    assert [r[0] for r in df.select(ancestors(F.col("x"), False)).collect()] == [["a", "a/b"], [], []]
    assert [r[0] for r in df.select(ancestors(F.col("x"), True)).collect()] == [["a", "a/b", "a/b/c"], ["a"], [""]]


P1, P2 = "/programs/PROG/projects/PROJ1", "/programs/PROG/projects/PROJ2"
VERTICES = [
    ("s1", "ResearchStudy", "one", P1),
    ("s2", "ResearchStudy", "two", P2),
    ("r1", "Directory", "/", P1),
    ("data", "Directory", "data", P1),
    ("alien", "Directory", "alien", P2),
    ("foo", "Directory", "foo", P1),
    ("leaf", "DocumentReference", "leaf.txt", P1),
    ("hidden", "DocumentReference", "hidden.txt", P2),
]
EDGES = [
    ("s1", "r1", "rootDir_Directory"),
    ("r1", "data", "c"),
    ("r1", "alien", "c"),
    ("data", "foo", "c"),
    ("data", "hidden", "c"),
    ("foo", "leaf", "c"),
    ("s2", "data", "other"),
]


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame(VERTICES, "id string, label string, name string, auth_resource_path string")
    return v, spark.createDataFrame(EDGES, "src string, dst string, label string")


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/", ["data"]),  # the root filters its children by project
        ("/data", ["foo", "hidden"]),  # deeper listings do not filter the last hop
        ("/data/", ["foo", "hidden"]),
        ("/data/foo", ["leaf"]),
        ("/data/foo/leaf.txt", [None]),  # a leaf gives one null vertex
        ("/data/hidden.txt", []),  # every named level must belong to the project
        ("/alien", []),
        ("/missing", []),
        ("//", []),
        ("/data//foo", []),
    ],
)
def test_list_directory(graph, path, expected):
    assert sorted((r[0] for r in rows(gr.list_directory(*graph, P1, path), "id")), key=repr) == sorted(expected, key=repr)


def test_resolve_paths_keeps_every_request(spark, graph):
    asked = [(1, P1, "/data"), (2, P1, "/data"), (3, P1, "bad"), (4, P1, "/missing"), (5, P2, "/"), (6, P1, None)]
    requests = spark.createDataFrame(asked, "request_id long, project string, path string")
    got = rows(gr.resolve_paths(*graph, requests), "request_id", "error_type", "matched", "id")
    assert got == sorted(
        [(i, None, True, x) for i in (1, 2) for x in ("foo", "hidden")]
        + [(3, "invalid_directory", False, None), (4, None, False, None), (5, None, False, None), (6, "invalid_directory", False, None)],
        key=repr,
    )


def _most_joined(plan) -> int:
    """The most rows that a join of an executed plan made."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return _most_joined(plan.executedPlan())
    if "QueryStage" in kind:
        return _most_joined(plan.plan())
    below = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0
    return max([own, *[_most_joined(below.apply(i)) for i in range(below.size())]])


def test_resolve_paths_steps_make_a_row_for_a_match(spark, monkeypatch):
    n = 60
    names = [f"n{i}" for i in range(n)]
    v = spark.createDataFrame([("s1", "ResearchStudy", "one", P1), ("r1", "Directory", "/", P1), ("data", "Directory", "data", P1), *[(k, "Directory", k, P1) for k in names]], "id string, label string, name string, auth_resource_path string")
    e = spark.createDataFrame([("s1", "r1", "rootDir_Directory"), ("r1", "data", "c"), *[("data", k, "c") for k in names]], "src string, dst string, label string")
    requests = spark.createDataFrame([(i, P1, f"/data/{k}") for i, k in enumerate(names)], "request_id long, project string, path string")
    most, write = [], gr.stored

    def seen(df):
        df.collect()
        most.append(_most_joined(df._jdf.queryExecution().executedPlan()))
        return write(df)

    monkeypatch.setattr(gr, "stored", seen)
    assert rows(gr.resolve_paths(v, e, requests), "request_id", "matched", "id") == sorted(((i, True, None) for i in range(n)), key=repr)
    assert max(most) <= 2 * n  # not every path with every entry of the directory that it passes


def test_resolve_paths_in_blocks(spark, graph, monkeypatch):
    """Repeated and null requests, two paths of one directory, a repeated edge and an empty directory, in blocks of two rows."""
    monkeypatch.setattr(gr, "BLOCK_ROWS", 2)
    v, e = graph
    e = e.union(e.filter("dst = 'foo'"))
    asked = [(1, P1, "/data"), (1, P1, "/data"), (None, P1, "/data/"), (2, P1, "/data/foo/leaf.txt"), (3, P1, "/"), (4, None, "/"), (5, P1, "/data/foo")]
    requests = spark.createDataFrame(asked, "request_id long, project string, path string")
    got = rows(gr.resolve_paths(v, e, requests), "request_id", "matched", "id")
    listed = ["foo", "foo", "hidden"]
    expected = [(i, True, x) for i in (1, 1, None) for x in listed] + [(2, True, None)] * 2 + [(3, True, "data"), (4, False, None)] + [(5, True, "leaf")] * 2
    assert got == sorted(expected, key=repr)


def test_list_projects_needs_a_root_edge(spark, graph):
    grants = spark.createDataFrame([(1, P1), (1, P2), (2, P2)], "user_id long, resource string")
    assert rows(gr.list_projects(*graph, grants)) == [(1, P1)]


def test_traversal_steps(spark, graph):
    v, e = graph
    assert gr.has_label(v, "Directory").count() == 4
    assert rows(gr.has_value(v, "name", "foo"), "id") == [("foo",)]
    wanted = spark.createDataFrame([("foo",), ("data",), ("zzz",)], "n string")
    assert rows(gr.within(v, "name", wanted, "n"), "id") == [("data",), ("foo",)]
    kids = gr.children(v, e)
    assert rows(gr.out_or_null(v.filter("id IN ('leaf', 'foo')").select("id"), kids), "id", "child_id") == [("foo", "leaf"), ("leaf", None)]


def test_project_ids(spark):
    df = spark.createDataFrame([("PROG-PROJ",), ("a-b-c",), ("x",)], "p string")
    assert rows(gr.parse_project_ids(df, "p"), "resource_path", "error_type") == [
        ("/programs/PROG/projects/PROJ", None),
        (None, "invalid_project_id"),
        (None, "invalid_project_id"),
    ]


def test_a_directory_is_listed_by_one_query(spark, graph):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    found = gr.list_directory(*graph, P1, "/a/b/c")
    assert not tracker.getJobIdsForGroup("listing")
    spark.sparkContext.setJobGroup("", "")
    assert found.columns == ["id", "label", "name", "auth_resource_path"]
