"""One key holds a third of all rows: results stay whole and equal to a plain count."""

import numpy as np
from pyspark.sql import functions as F

from cairnframe.operators import access as ac
from cairnframe.operators import graph as gr
from cairnframe.operators import knn as nn
from cairnframe.operators import state as st
from cairnframe.operators import trees as tr
from cairnframe.operators import uploads as up

N = 9_000
HOT = "CASE WHEN id % 3 = 0 THEN 0 ELSE id END"


def test_duplicates_in_a_hot_session(spark):
    files = spark.range(N).selectExpr(
        f"{HOT} AS session_id", "id AS ordinal", "concat('f', id % 30) AS raw_name", "'' AS subdirectory", "1L AS size"
    )
    flagged = up.flag_duplicates(up.plan_targets(files))
    assert flagged.count() == N
    # The hot session has N/3 files with 10 distinct names; every other session has one file.
    assert flagged.filter("duplicate").count() == N // 3 - 10


def test_view_of_a_hot_session(spark):
    files = spark.range(N).selectExpr(
        f"{HOT} AS session_id", "id AS ordinal", "'f' AS file_name", "concat('t', id) AS target_path", "1L AS size",
        "'c' AS checksum", "'d' AS drs_object_id", "CASE WHEN id = 3 THEN 'collision' ELSE 'uploaded' END AS status", "'' AS error",
    )
    sessions = files.select("session_id").distinct().withColumn("project_id", F.lit("o/p"))
    view = up.session_view(sessions, sessions, files)
    assert view.count() == N
    assert view.filter("has_conflicts").count() == N // 3
    assert up.session_status(sessions, files).filter("status = 'pending_upload'").count() == 1
    assert up.finalize_check(sessions, files).filter("error IS NOT NULL").count() == 1


def test_view_moves_only_what_it_shows(spark):
    files = spark.range(40).selectExpr(
        "id % 6 AS session_id", "id AS ordinal", "concat('f', id) AS file_name", "concat('t', id) AS target_path", "1L AS size",
        "CAST(NULL AS string) AS checksum", "CAST(NULL AS string) AS drs_object_id", "CASE WHEN id = 3 THEN 'collision' ELSE 'pending_upload' END AS status", "'' AS error",
    )
    given = files.filter("ordinal % 2 = 0").selectExpr("session_id", "target_path", "2L AS size", "'c' AS checksum", "'d' AS drs_object_id", "1L AS ordinal")
    attached = up.attach(files, given, "ordinal")
    sessions = files.select("session_id").distinct().withColumn("project_id", F.lit("o/p"))
    shown = ("session_id", "project_id", "ordinal", "target_path", "status", "collision", "has_conflicts", "error_type")
    narrow = up.session_view(sessions, sessions, attached, ("ordinal", "target_path", "status"))
    assert sorted(narrow.select(*shown).collect()) == sorted(up.session_view(sessions, sessions, attached).select(*shown).collect())
    assert narrow.filter("status = 'uploaded'").count() == 20
    assert not {"size", "checksum", "drs_object_id", "file_name", "error"} & set(narrow.columns)
    plan = attached.select("session_id", "ordinal", "target_path", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "drs_object_id" not in plan.split("Join")[0] and "_given" not in plan


def test_hot_pending_key(spark):
    pending = spark.range(N).selectExpr("id", f"{HOT} AS installation_id", "1L AS repo_id", "CAST(NULL AS string) AS user_id")
    bad = st.uniqueness_violations(pending)
    assert bad.count() == N // 3 - 1
    assert bad.select("copies", "first_id").distinct().collect() == [(N // 3, 0)]


def test_hot_resource_and_hot_user(spark):
    grants = spark.range(N).selectExpr(
        "id AS user_id", "CASE WHEN id % 3 = 0 THEN '/programs/o/projects/hot' ELSE concat('/programs/o/projects/p', id) END AS resource"
    )
    projects = grants.selectExpr("substring(resource, 11) AS x").distinct().selectExpr("replace(x, '/projects/', '/') AS project_id")
    assert ac.filter_projects(projects, grants).count() == N
    asks = spark.range(N).selectExpr(f"{HOT} AS user_id", "'o' AS organization", "concat('p', id) AS project")
    wide = spark.createDataFrame([(0, "/programs")], "user_id long, resource string")
    assert ac.admin_allows(asks, wide).count() == N // 3


def test_hot_directory_and_hot_request(spark):
    auth = "'/p' AS auth_resource_path"
    vertices = (
        spark.sql(f"SELECT 's' AS id, 'ResearchStudy' AS label, 's' AS name, {auth} UNION ALL SELECT 'r', 'Directory', '/', '/p' UNION ALL SELECT 'hot', 'Directory', 'hot', '/p'")
        .unionByName(spark.range(N).selectExpr("concat('f', id) AS id", "'Directory' AS label", "concat('f', id) AS name", auth))
    )
    edges = spark.sql("SELECT 's' AS src, 'r' AS dst, 'rootDir_Directory' AS label UNION ALL SELECT 'r', 'hot', 'c'").unionByName(
        spark.range(N).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'r' END AS src", "concat('f', id) AS dst", "'c' AS label")
    )
    requests = spark.range(60).selectExpr("id AS request_id", "'/p' AS project", "CASE WHEN id < 20 THEN '/hot' ELSE concat('/hot/f', id) END AS path")
    found = gr.resolve_paths(vertices, edges, requests)
    assert found.filter("request_id < 20").count() == 20 * N // 3
    # Below /hot only every third name exists, as a leaf with one null vertex.
    assert found.filter("request_id >= 20 AND matched").count() == len([i for i in range(20, 60) if i % 3 == 0])
    assert found.select("request_id").distinct().count() == 60


def test_hot_request_and_hot_input(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(30, 18))
    points = spark.createDataFrame([(f"p{i:02d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, vector array<double>")
    inputs = spark.range(3_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS request_id", "'pos' AS sign", "CASE WHEN id % 2 = 0 THEN 'p00' ELSE concat('p', lpad(id % 30, 2, '0')) END AS id"
    )
    targets = nn.recommend_targets(points, inputs, "Dot")
    assert targets.count() == 2_001
    chosen = ["p00" if i % 2 == 0 else f"p{i % 30:02d}" for i in range(0, 3_000, 3)]
    mean = np.mean([vectors[int(c[1:])] for c in chosen], axis=0)
    assert np.allclose(targets.filter("query_id = 0").first()["vector"], mean)
    assert nn.recommend(points, inputs, 2, "Dot").count() == 2 * 2_001


def test_hot_directory_in_a_listing(spark):
    tree = spark.range(N).selectExpr("'r' AS repo", "concat(CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('d', id % 50) END, '/f', id) AS path", "id AS hash", "1L AS size")
    listing = tr.list_tree(tree)
    assert listing.filter("type = 'blob'").count() == N
    assert listing.filter("type = 'tree'").count() == 51
    commits = tree.selectExpr("repo", "path", "hash AS committed_at")
    assert tr.last_modified(commits).filter("path = 'hot'").first()["last_modified_at"] == N - 3
