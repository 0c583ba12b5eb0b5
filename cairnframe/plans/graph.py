"""Directory graph queries."""

from pyspark.sql import functions as F

from ..operators import graph as gr
from .registry import query

_VALID = """
path LIKE '/%' AND NOT contains(path, chr(92)) AND NOT starts_with(coalesce(
  array_to_string(list_reduce(list_transform(string_split(path, '/'), lambda s: [s]),
    lambda acc, s: CASE WHEN s[1] IN ('', '.') THEN acc WHEN s[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, s) END,
    CAST([] AS VARCHAR[])), '/'), ''), '..')
"""


@query(
    "g_valid_path",
    f"SELECT request_id, path, {_VALID} AS valid, CASE WHEN NOT ({_VALID}) THEN 'invalid_directory' END AS error_type FROM path_requests",
)
def g_valid_path(t):
    return gr.check_paths(t["path_requests"]).select("request_id", "path", "valid", "error_type")


@query(
    "g_list_projects",
    """
SELECT DISTINCT g.user_id, g.resource AS project FROM web_grants g JOIN vertices v ON v.auth_resource_path = g.resource
WHERE v.label = 'ResearchStudy' AND EXISTS (SELECT 1 FROM edges e WHERE e.src = v.id AND e.label = 'rootDir_Directory')
""",
)
def g_list_projects(t):
    return gr.list_projects(t["vertices"], t["edges"], t["web_grants"])


# Project of the largest repository, in either engine.
_BUSIEST = "WITH busy AS MATERIALIZED (SELECT repo FROM tree GROUP BY repo ORDER BY count(*) DESC, repo LIMIT 1) SELECT repo FROM busy"


def _busiest(t):
    counts = t["tree"].groupBy("repo").count()
    return "/programs/web/projects/" + counts.orderBy(F.desc("count"), "repo").first()["repo"]


@query(
    "g_list_dir_root",
    f"""
SELECT c.id, c.label, c.name, c.auth_resource_path FROM ({_BUSIEST}) b JOIN vertices s ON s.label = 'ResearchStudy' AND s.auth_resource_path = '/programs/web/projects/' || b.repo
JOIN edges e1 ON e1.src = s.id AND e1.label = 'rootDir_Directory' JOIN edges e2 ON e2.src = e1.dst
JOIN vertices c ON c.id = e2.dst AND c.auth_resource_path = s.auth_resource_path
""",
)
def g_list_dir_root(t):
    return gr.list_directory(t["vertices"], t["edges"], _busiest(t), "/")


@query(
    "g_list_dir",
    f"""
SELECT c.id, c.label, c.name, c.auth_resource_path FROM ({_BUSIEST}) b JOIN vertices s ON s.label = 'ResearchStudy' AND s.auth_resource_path = '/programs/web/projects/' || b.repo
JOIN edges e1 ON e1.src = s.id AND e1.label = 'rootDir_Directory' JOIN edges e2 ON e2.src = e1.dst
JOIN vertices d ON d.id = e2.dst AND d.auth_resource_path = s.auth_resource_path AND d.name = 'en'
LEFT JOIN edges e3 ON e3.src = d.id LEFT JOIN vertices c ON c.id = e3.dst
""",
)
def g_list_dir(t):
    return gr.list_directory(t["vertices"], t["edges"], _busiest(t), "/en/")


@query(
    "g_resolve",
    f"""
WITH checked AS (SELECT *, {_VALID} AS valid FROM path_requests),
kids AS (SELECT e.src, v.id, v.label, v.name, v.auth_resource_path FROM edges e JOIN vertices v ON v.id = e.dst),
start AS (SELECT r.request_id, r.project, CASE WHEN path = '/' THEN CAST([] AS VARCHAR[]) ELSE string_split(trim(path, '/'), '/') END AS parts, e.dst AS node
  FROM checked r JOIN vertices s ON s.label = 'ResearchStudy' AND s.auth_resource_path = r.project
  JOIN edges e ON e.src = s.id AND e.label = 'rootDir_Directory' WHERE valid),
walk AS (SELECT request_id, project, parts, node, CAST(0 AS BIGINT) AS depth FROM start
  UNION ALL SELECT w.request_id, w.project, w.parts, k.id, w.depth + 1 FROM walk w JOIN kids k
    ON k.src = w.node AND k.name = w.parts[w.depth + 1] AND k.auth_resource_path = w.project WHERE w.depth < len(w.parts)),
entries AS (
  SELECT w.request_id, k.id, k.label, k.name, k.auth_resource_path FROM walk w JOIN kids k ON k.src = w.node AND k.auth_resource_path = w.project WHERE len(parts) = 0
  UNION ALL SELECT w.request_id, k.id, k.label, k.name, k.auth_resource_path FROM walk w LEFT JOIN kids k ON k.src = w.node WHERE len(parts) > 0 AND depth = len(parts))
SELECT c.request_id, c.project, c.path, CASE WHEN NOT valid THEN 'invalid_directory' END AS error_type, e.request_id IS NOT NULL AS matched,
       e.id, e.label, e.name, e.auth_resource_path
FROM checked c LEFT JOIN entries e ON e.request_id = c.request_id
""",
)
def g_resolve(t):
    return gr.resolve_paths(t["vertices"], t["edges"], t["path_requests"])


@query(
    "g_project_id",
    """
SELECT request_id, config_id,
       CASE WHEN len(string_split(config_id, '-')) = 2 THEN '/programs/' || split_part(config_id, '-', 1) || '/projects/' || split_part(config_id, '-', 2) END AS resource_path,
       CASE WHEN len(string_split(config_id, '-')) <> 2 THEN 'invalid_project_id' END AS error_type
FROM route_requests
""",
)
def g_project_id(t):
    return gr.parse_project_ids(t["route_requests"].select("request_id", "config_id"), "config_id")
