"""Configuration documents and repository addresses."""

import json

import pytest
from pyspark.sql import functions as F

from cairnframe.functions.repos import normalize_repo_url
from cairnframe.operators import documents as dc
from cairnframe.operators import explorer as ex
from cairnframe.schemas import DOCUMENT_SCHEMAS, PROJECT

from .conftest import rows

DOCS = "config_type string, name string, content string"


def docs(spark, *items):
    return spark.createDataFrame([(t, n, c if c is None or isinstance(c, str) else json.dumps(c)) for t, n, c in items], DOCS)


EXPLORER = {
    "sharedFilters": {"defined": {"proj": [{"index": "file", "field": "project_id"}]}},
    "explorerConfig": [
        {
            "tabTitle": "Files",
            "guppyConfig": {"dataType": "file", "nodeCountTitle": "Files", "manifestMapping": {}},
            "charts": {"a": {"chartType": "bar", "title": "A"}},
            "filters": {"tabs": [{"title": "t", "fields": ["x", "y"], "fieldsConfig": {"x": {"label": "X", "type": "enum"}}}]},
            "table": {"enabled": True, "fields": ["x"], "columns": {"x": {"field": "x", "title": "X", "visable": True}}, "detailsConfig": {}},
            "dropdowns": {"any": [1, {"b": None}]},
            "preFilters": {"project": ["p", "q"], "single": "s"},
        }
    ],
    "fileActions": {"extensions": {"tiff": ["view"], "tif": ["view"], "default": ["download"]}, "actions": {"view": "open"}},
}
FILE_SUMMARY = {
    "config": {"a": {"field": "a", "title": "A"}},
    "barChartColor": "c",
    "defaultProject": "p",
    "binslicePoints": [0, 1048576, 524288000, 1073741824, 107374182400, 9007199254740991],
    "idField": "i",
    "index": "x",
}
NAV = {
    "headerProps": {
        "topBar": {"items": [{"classNames": {"button": "b", "label": "l", "root": "r"}, "href": "/", "name": "n"}]},
        "navigation": {"items": [], "classNames": None, "logo": {"src": "s", "href": "/", "width": 1.5}},
        "leftnav": [{"title": "t", "description": "d", "icon": "i", "href": "/", "perms": None}],
    },
    "footerProps": {"rightSection": {"columns": [{"rows": [{"Icon": {"logo": "l", "width": 3}}, {"Links": {"links": []}}]}]}},
    "headerMetadata": {"title": "t", "content": "c", "key": "k"},
}


@pytest.mark.parametrize("config_type, doc", [("explorer", EXPLORER), ("file_summary", FILE_SUMMARY), ("nav", NAV)])
def test_documents_survive_a_round_trip(spark, config_type, doc):
    decoded = dc.decode(docs(spark, (config_type, "d", doc)), config_type)
    text = decoded.select(dc.encode("doc", DOCUMENT_SCHEMAS[config_type])).first()[0]
    back = json.loads(text)
    again = dc.decode(docs(spark, (config_type, "d", text)), config_type).select(dc.encode("doc", DOCUMENT_SCHEMAS[config_type])).first()[0]
    assert again == text

    def contains(big, small):
        if isinstance(small, dict):
            return all(k in big and contains(big[k], v) for k, v in small.items() if v is not None)
        if isinstance(small, list):
            return len(big) == len(small) and all(contains(b, s) for b, s in zip(big, small))
        return big == small

    assert contains(back, doc)


def test_empty_members_are_left_out(spark):
    doc = {"config": {"a": {"field": "f", "title": "t", "type": "", "width": ""}}}
    decoded = dc.decode(docs(spark, ("file_summary", "d", doc)), "file_summary")
    text = json.loads(decoded.select(dc.encode("doc", DOCUMENT_SCHEMAS["file_summary"])).first()[0])
    assert text["config"]["a"] == {"field": "f", "title": "t"}
    assert text["barChartColor"] == ""


@pytest.mark.parametrize(
    "config_type, content, expected",
    [
        ("projects", {"title": "t"}, (None, None, None)),
        ("projects", {"title": None}, (None, None, None)),
        ("projects", None, ("empty_request_body", None, None)),
        ("projects", "", ("invalid_json", None, None)),
        ("projects", "{bad", ("invalid_json", None, None)),
        ("projects", "[]", ("invalid_request_body", "", "wrong_type")),
        ("projects", {"title": 7}, ("invalid_request_body", "title", "wrong_type")),
        ("projects", {"title": "t", "surprise": 1}, ("invalid_request_body", "surprise", "unknown_field")),
        ("projects", {"Title": "t"}, ("invalid_request_body", "Title", "unknown_field")),
        ("file_summary", {"binslicePoints": [1, "x"]}, ("invalid_request_body", "binslicePoints", "wrong_type")),
        ("file_summary", {"binslicePoints": [1.5]}, ("invalid_request_body", "binslicePoints", "wrong_type")),
        ("file_summary", {"config": {"a": {"sortable": "yes"}}}, ("invalid_request_body", "config.sortable", "wrong_type")),
        ("file_summary", {"config": {"a": {"params": {"free": [1, "x"]}}}}, (None, None, None)),
        ("explorer", {"explorerConfig": [{"table": {"detailsConfig": {"odd": 1}}}]}, ("invalid_request_body", "explorerConfig.table.detailsConfig.odd", "unknown_field")),
        ("explorer", {"explorerConfig": [{"dropdowns": 5}]}, ("invalid_request_body", "explorerConfig.dropdowns", "wrong_type")),
        ("nav", {"headerProps": {"leftnav": [{"perms": {"anything": 1}}]}}, (None, None, None)),
        ("nav", {"footerProps": {"leftSection": {"columns": [{"rows": [{"Text": {"text": "a"}, "Icon": {}}]}]}}}, ("invalid_request_body", "footerProps.leftSection.columns.rows", "bad_row")),
        ("nav", {"footerProps": {"leftSection": {"columns": [{"rows": [{"Icon": {"width": "w"}}]}]}}}, ("invalid_request_body", "footerProps.leftSection.columns.rows.Icon.width", "wrong_type")),
    ],
)
def test_strict_parse(spark, config_type, content, expected):
    checked = dc.strict_parse_all(docs(spark, (config_type, "d", content)))
    assert rows(checked, "error_type", "error_field", "error_problem") == [expected]


def test_split_accepted(spark):
    d = docs(spark, ("projects", "a", {"title": "t"}), ("projects", "b", {"title": 7}))
    accepted, rejected = dc.split_accepted(dc.strict_parse(d, PROJECT))
    assert rows(accepted) == [("projects", "a", '{"title": "t"}')]
    assert rows(rejected, "name", "error_field") == [("b", "title")]


def test_decode_is_lenient_about_keys_only(spark):
    d = docs(spark, ("projects", "a", {"title": "t", "x": 1}), ("projects", "b", {"title": 7}), ("projects", "c", "{"), ("nav", "d", {}))
    assert rows(dc.decode(d, "projects").select("name", "doc.title")) == [("a", "t"), ("b", None), ("c", None)]


def test_list_get_put_delete(spark):
    base = docs(spark, ("explorer", "default", "{}"), ("nav", "x", "{}"))
    assert rows(dc.list_names(base)) == [("default",)]
    with pytest.raises(ValueError):
        dc.list_names(base, "weird")
    asked = spark.createDataFrame([("", ""), ("nav", "y"), ("odd", "z")], "config_type string, name string")
    assert rows(dc.get_documents(base, asked), "config_type", "name", "found", "error_type") == [
        ("explorer", "default", True, None),
        ("nav", "y", False, "config_not_found"),
        ("odd", "z", False, "invalid_config_type"),
    ]
    put = dc.put_documents(base, docs(spark, ("nav", "x", "[1]"), ("nav", "y", "[2]")))
    assert rows(put) == [("explorer", "default", "{}"), ("nav", "x", "[1]"), ("nav", "y", "[2]")]
    left, flags = dc.delete_documents(put, asked)
    assert rows(left, "name") == [("default",), ("x",)]
    assert rows(flags, "name", "deleted") == [("", False), ("y", True), ("z", False)]


GOOD = {
    "title": " Title ",
    "contact_email": "person@example.org",
    "src_repo": "https://GitHub.com/Org/Repo.git",
    "org_title": "o",
    "description": "d",
    "project_title": "p",
}


def projects(spark, *changes):
    fields = [f.name for f in PROJECT.fields]
    return spark.createDataFrame([tuple({**GOOD, **c}[f] for f in fields) for c in changes], ", ".join(f"{f} string" for f in fields))


@pytest.mark.parametrize(
    "change, require, error",
    [
        ({}, True, None),
        ({"contact_email": "Ann Example <ann@example.org>"}, True, None),
        ({"contact_email": "not-an-email"}, True, "contact_email must be a valid email address"),
        ({"contact_email": "a@b@c"}, True, "contact_email must be a valid email address"),
        ({"contact_email": "a..b@c"}, True, "contact_email must be a valid email address"),
        ({f: " " for f in GOOD}, True, "title is required"),
        ({"title": None}, True, "title is required"),
        ({"description": "", "project_title": ""}, True, "description is required"),
        ({"src_repo": ""}, True, "src_repo is required"),
        ({"src_repo": ""}, False, None),
        ({"src_repo": "nope"}, False, "invalid src_repo URL: nope"),
        ({"src_repo": "https://github.com/only"}, True, "src_repo must point to a GitHub-style owner/repo path"),
    ],
)
def test_validate_projects(spark, change, require, error):
    got = dc.validate_projects(projects(spark, change), require).first()
    assert got["error"] == error
    if not change:
        assert (got["title"], got["src_repo"]) == ("Title", "github.com/Org/Repo")


@pytest.mark.parametrize(
    "raw, url, error",
    [
        ("https://github.com/o/r", "github.com/o/r", None),
        ("https://user:pw@GitHub.com:8443/o/r.git/", "github.com/o/r", None),
        ("http://[2001:db8::1]:80/o/r", "2001:db8::1/o/r", None),
        ("https://github.com/o/r?tab=x#y", "github.com/o/r", None),
        ("git@github.com:o/r.git", "github.com/o/r", None),
        ("ssh://git@ssh.github.com:443/o/r.git", "github.com/o/r", None),
        ("git@altssh.github.com:443/o/r", "github.com/o/r", None),
        ("git@other.org:443/o/r", None, "src_repo must point to a GitHub-style owner/repo path"),
        ("github.com/o/r/", "github.com/o/r", None),
        ("github.com/o/r/extra", None, "src_repo must point to a GitHub-style owner/repo path"),
        ("o/r", None, "invalid src_repo URL: o/r"),
        ("https:///o/r", None, "src_repo host is required"),
        ("", None, "src_repo is required"),
        (None, None, "src_repo is required"),
        ("https://github.com//r", None, "src_repo must point to a GitHub-style owner/repo path"),
        ("https://github.com/o/r.git.git", "github.com/o/r.git", None),
    ],
)
def test_normalize_repo_url(spark, raw, url, error):
    got = spark.createDataFrame([(raw,)], "x string").select(normalize_repo_url(F.col("x")).alias("n")).first()["n"]
    assert (got["url"], got["error"]) == (url, error)


def test_requested_identities(spark):
    df = spark.createDataFrame([("o/r",), (" git@h.org:a/b.git ",), ("bad",)], "x string")
    got = rows(dc.requested_identities(df, "x"), "x", "repo_url")
    assert got == [(" git@h.org:a/b.git ", "https://h.org/a/b"), ("bad", None), ("o/r", "https://github.com/o/r")]


def test_summary_falls_back_on_titles(spark):
    d = docs(
        spark,
        ("projects", "O/b", {"title": " ", "project_title": " Zeta "}),
        ("projects", "O/a c", {"contact_email": " x@y "}),
        ("projects", "plain", {"title": "t"}),
    )
    thumbs = spark.createDataFrame([("O", "a c")], "organization string, project string")
    summary = dc.ordered_summary(dc.project_summary(d, thumbs))
    assert [tuple(r) for r in summary.select("project", "title", "contact_email", "thumbnail_url").collect()] == [
        ("a c", "a c", "x@y", "/git/projects/O/a%20c/thumbnail"),
        ("b", "Zeta", "", None),
    ]


def test_union_rows(spark):
    nav = {
        "footerProps": {
            "rightSection": {
                "columns": [
                    {
                        "rows": [
                            {"Text": {"text": "a"}},
                            {"Icon": {}, "Text": {}},
                            {"Odd": 1},
                            {"Section": {"columns": [{"rows": [{"Link": {}}, {"Section": {"columns": [{"rows": [{}]}]}}]}]}},
                        ]
                    }
                ]
            }
        }
    }
    got = rows(dc.footer_rows(docs(spark, ("nav", "n", nav))), "path", "kind", "error")
    assert got == [
        ("/0.0", "Text", None),
        ("/0.1", None, "FooterRow must have exactly one key, got 2"),
        ("/0.2", None, "unknown FooterRow key: Odd"),
        ("/0.3", "Section", None),
        ("/0.3/0.0", "Link", None),
        ("/0.3/0.1", "Section", None),
        ("/0.3/0.1/0.0", None, "FooterRow must have exactly one key, got 0"),
    ]


def test_many_sections_side_by_side_are_two_levels(spark):
    section = {"Section": {"columns": [{"rows": [{"Text": {"text": '"Section" "Section"'}}]}]}}
    nav = {"footerProps": {"leftSection": {"columns": [{"rows": [section] * 1000}]}}}
    got = dc.footer_rows(docs(spark, ("nav", "n", nav)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 0 and plan.count("Relation ") <= 3
    counts = {(r["side"], r["kind"]): r["count"] for r in got.groupBy("side", "kind").count().collect()}
    assert counts == {("leftSection", "Section"): 1000, ("leftSection", "Text"): 1000}


# ---------------------------------------------------------------- settings


def explorer(spark):
    return dc.decode(docs(spark, ("explorer", "d", EXPLORER)), "explorer")


def test_flatten_and_settings(spark):
    e = explorer(spark)
    assert rows(dc.flatten_filters(e), "field", "label", "configured") == [("x", "X", True), ("y", None, False)]
    assert rows(dc.flatten_columns(e), "key", "title", "listed") == [("x", "X", True)]
    assert rows(ex.pre_filter_values(e), "field", "value") == [("project", "p"), ("project", "q"), ("single", "s")]
    assert rows(ex.shared_filters(e), "filter", "index", "field") == [("proj", "file", "project_id")]


def test_prefilters_and_actions(spark):
    e = explorer(spark)
    table = spark.createDataFrame([("p", "s"), ("q", "t"), ("r", "s")], "project string, single string")
    assert rows(ex.pre_filter(table, ex.pre_filter_values(e), ["project", "single"])) == [("p", "s")]
    files = spark.createDataFrame([("d", "a.b.TIFF"), ("d", "x.csv"), ("d", "noext"), ("other", "x.tif")], "name string, file_name string")
    assert rows(ex.file_actions(files, ex.extension_actions(e)), "file_name", "actions") == [
        ("a.b.TIFF", ["view"]),
        ("noext", ["download"]),
        ("x.csv", ["download"]),
        ("x.tif", None),
    ]


def test_histogram_keeps_empty_bins_and_long_edges(spark):
    sizes = spark.createDataFrame([(-1,), (0,), (10,), (2**53,), (2**53 - 2,)], "s long")
    got = ex.size_histogram(sizes, "s", [0, 10, 100, 9007199254740991])
    assert [tuple(r) for r in got.orderBy("bin").collect()] == [
        (0, 0, 10, 1),
        (1, 10, 100, 1),
        (2, 100, 9007199254740991, 1),
        (3, 9007199254740991, None, 1),
    ]


def test_table_view_casts(spark):
    df = spark.createDataFrame([("1.5", "true", "2024-01-02", '["a"]', ("in",), '{"k":3}')], "n string, b string, d string, l string, s struct<x:string>, j string")
    columns = [
        {"field": "n", "type": "number", "title": "N"},
        {"field": "b", "type": "boolean"},
        {"field": "d", "type": "date"},
        {"field": "l", "type": "array"},
        {"field": "x", "accessorPath": "s.x", "type": ""},
        {"field": "k", "accessorPath": "j.k", "type": "paragraphs"},
    ]
    view = ex.table_view(df, columns)
    assert view.columns == ["N", "b", "d", "l", "x", "k"]
    row = view.first()
    assert (row.N, row.b, row.d.day, row.l, row.x, row.k) == (1.5, True, 2, ["a"], "in", "3")
    with pytest.raises(ValueError):
        ex.table_view(df, [{"field": "n", "type": "odd"}])


def test_pre_filters_of_all_documents(spark):
    values = spark.createDataFrame(
        [("a", 0, "x", "1"), ("a", 0, "x", "2"), ("a", 0, "y", "q"), ("b", 0, "x", "1"), ("c", 1, "x", "1"), ("d", 0, "gone", "1"), ("e", 0, "y", "q"), ("e", 0, "x", "2"), ("e", 0, "x", "1")],
        "name string, tab_pos long, field string, value string",
    )
    table = spark.createDataFrame([(1, "q", 5), (2, "q", 6), (1, "r", 7), (3, "q", 8), (None, "q", 9), (1, "q", 5)], "x int, y string, filter_no int")
    classes = {(r["name"], r["tab_pos"]): r["filter_class"] for r in ex.filter_classes(values).collect()}
    assert classes["a", 0] == classes["e", 0] and classes["b", 0] == classes["c", 1] and len(set(classes.values())) == 3
    got = ex.pre_filter_classes(table, values)
    own = got.filter(F.col("filter_class") == classes["a", 0]).drop("filter_class")
    assert rows(own) == rows(table.filter("x IN (1, 2) AND y = 'q'")) and got.columns == [*table.columns, "filter_class"]
    assert rows(got.filter(F.col("filter_class") == classes["b", 0]).drop("filter_class")) == rows(table.filter("x = 1"))
    assert got.filter(F.col("filter_class") == classes["d", 0]).count() == 0
    assert ex.pre_filter_classes(table, values.filter("false")).count() == 0


def test_histograms_of_all_documents(spark):
    sizes = [(v,) for v in (-5, 0, 1, 9, 10, 10, 11, 99, 100, 2**53 - 1, 2**60, None)]
    edges = [("a", 0), ("a", 10), ("a", 100), ("b", 10), ("b", 9), ("b", 9), ("c", 2**53 - 1), ("d", None), ("e", -(2**60)), ("e", 2**61)]
    got = ex.document_histograms(spark.createDataFrame(sizes, "s long"), "s", spark.createDataFrame(edges, "name string, edge long"))
    expected = []
    for name in "abce":
        own = sorted({e for n, e in edges if n == name})
        for i, (low, high) in enumerate(zip(own, [*own[1:], None])):
            expected.append((name, i, low, high, sum(1 for (v,) in sizes if v is not None and v >= low and (high is None or v < high))))
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    nothing = ex.document_histograms(spark.createDataFrame([], "s long"), "s", spark.createDataFrame(edges, "name string, edge long"))
    assert sorted(map(tuple, nothing.collect())) == sorted((*e[:4], 0) for e in expected)
    assert ex.document_histograms(spark.createDataFrame(sizes, "s long"), "s", spark.createDataFrame([], "name string, edge long")).count() == 0
