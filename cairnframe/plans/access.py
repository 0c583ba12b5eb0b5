"""Access-grant queries."""

from pyspark.sql import functions as F

from ..operators import access as ac
from .registry import query, view

# One JSON document per user, packed from the grants; some users have only the older block, or none.
view(
    "snapshots",
    """
WITH entries AS (
  SELECT user_id, resource, concat('[', array_join(array_sort(collect_list(concat('{"method":"', method, '","service":"', service, '"}'))), ','), ',7,{"method":1}]') AS list
  FROM grants GROUP BY user_id, resource)
SELECT user_id, CASE WHEN user_id % 7 = 0 THEN '{"other":1}'
  WHEN user_id % 3 = 0 THEN concat('{"authz":{},"project_access":{', array_join(array_sort(collect_list(concat('"', resource, '":', list))), ','), '}}')
  ELSE concat('{"authz":{"skipped":5,', array_join(array_sort(collect_list(concat('"', resource, '":', list))), ','), '}}') END AS snapshot
FROM entries GROUP BY user_id
""",
    """
WITH entries AS (
  SELECT user_id, resource, concat('[', array_to_string(list_sort(list(concat('{"method":"', method, '","service":"', service, '"}'))), ','), ',7,{"method":1}]') AS list
  FROM grants GROUP BY user_id, resource)
SELECT user_id, CASE WHEN user_id % 7 = 0 THEN '{"other":1}'
  WHEN user_id % 3 = 0 THEN concat('{"authz":{},"project_access":{', array_to_string(list_sort(list(concat('"', resource, '":', list))), ','), '}}')
  ELSE concat('{"authz":{"skipped":5,', array_to_string(list_sort(list(concat('"', resource, '":', list))), ','), '}}') END AS snapshot
FROM entries GROUP BY user_id
""",
)

READ = "method IN ('read', '*')"  # the service asked for is '*', which every grant meets
# Trimmed path of a plain or URL resource, one leading slash.
PATH = "concat('/', trim(regexp_replace(trim(resource), '^[a-z]+://[^/]*', ''), '/'))"


@query(
    "a_explode",
    """
SELECT user_id, resource, method, service FROM grants WHERE user_id % 7 <> 0
UNION ALL SELECT DISTINCT user_id, resource, '', '' FROM grants WHERE user_id % 7 <> 0
""",
)
def a_explode(t):
    return ac.explode_grants(t["snapshots"])


@query(
    "a_snapshot_errors",
    "SELECT DISTINCT user_id, 'authorization snapshot response did not include authz/project_access' AS error FROM grants WHERE user_id % 7 = 0",
)
def a_snapshot_errors(t):
    return ac.snapshot_errors(t["snapshots"])


@query(
    "a_allows",
    """
SELECT user_id, resource, method, service, (method = 'update' OR method = '*') AND (service = '*' OR service = 'arborist') AS allowed,
       method IN ('read', '*') AS readable FROM grants
""",
)
def a_allows(t):
    m, s = F.col("method"), F.col("service")
    return t["grants"].select(
        "user_id",
        "resource",
        "method",
        "service",
        ac.allows(m, s, "update", "arborist").alias("allowed"),
        ac.allows(m, s, "read", "*").alias("readable"),
    )


@query("a_allowed", f"SELECT DISTINCT user_id, resource FROM grants WHERE {READ}")
def a_allowed(t):
    return ac.allowed_resources(t["grants"], "read", "*")


@query("a_normalize", f"SELECT resource, {PATH} AS path, count(*) AS n FROM grants GROUP BY ALL")
def a_normalize(t):
    grouped = t["grants"].groupBy("resource").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("resource", ac.normalize_resource_path(F.col("resource")).alias("path"), "n")


@query(
    "a_filter_projects",
    f"""
WITH allowed AS (SELECT DISTINCT user_id, {PATH} AS path FROM grants WHERE {READ})
SELECT a.user_id, p.project_id, p.organization FROM allowed a JOIN projects p ON a.path = p.resource_path
""",
)
def a_filter_projects(t):
    allowed = ac.allowed_resources(t["grants"], "read", "*")
    return ac.filter_projects(t["projects"].select("project_id", "organization"), allowed)


_ORGS = f"SELECT DISTINCT user_id, split_part({PATH}, '/', 3) AS organization FROM grants WHERE {READ} AND {PATH} LIKE '/programs/_%'"


@query("a_orgs", _ORGS)
def a_orgs(t):
    return ac.allowed_orgs(ac.allowed_resources(t["grants"], "read", "*"))


@query(
    "a_org_members",
    f"""
WITH allowed AS ({_ORGS})
SELECT request_id, user_id, organization FROM access_asks JOIN allowed USING (user_id, organization)
""",
)
def a_org_members(t):
    asks = t["access_asks"].select("request_id", "user_id", "organization")
    return ac.org_members(asks, ac.allowed_resources(t["grants"], "read", "*"))


@query(
    "a_admin",
    """
WITH allowed AS (SELECT DISTINCT user_id, resource FROM grants WHERE method IN ('delete', '*'))
SELECT request_id, user_id, organization, project FROM access_asks a
WHERE EXISTS (SELECT 1 FROM allowed g WHERE g.user_id = a.user_id AND g.resource IN
  ('*', '/', '/programs', '/programs/' || a.organization, '/programs/' || a.organization || '/projects', a.resource_path))
""",
)
def a_admin(t):
    asks = t["access_asks"].select("request_id", "user_id", "organization", "project")
    return ac.admin_allows(asks, ac.allowed_resources(t["grants"], "delete", "*"))


@query(
    "a_request",
    f"""
WITH allowed AS (SELECT DISTINCT user_id, {PATH} AS path FROM grants WHERE {READ})
SELECT request_id, a.user_id, resource_path, g.path IS NOT NULL AS accessible, g.path IS NULL AS request_access
FROM access_asks a LEFT JOIN allowed g ON g.user_id = a.user_id AND g.path = a.resource_path
""",
)
def a_request(t):
    asks = t["access_asks"].select("request_id", "user_id", "organization", "project")
    flagged = ac.request_access(asks, ac.allowed_resources(t["grants"], "read", "*"))
    return flagged.select("request_id", "user_id", "resource_path", "accessible", "request_access")


_HAS = "EXISTS (SELECT 1 FROM grants g WHERE g.user_id = a.user_id AND g.resource = {r} AND g.method IN ('{m}', '*'){s})"
_ARBORIST = " AND g.service IN ('arborist', '*')"
_ORG, _ORG_PROJECTS = "'/programs/' || a.organization", "'/programs/' || a.organization || '/projects'"


@query(
    "a_caps",
    f"""
WITH a AS (SELECT DISTINCT user_id, organization FROM access_asks),
flags AS (SELECT *, {_HAS.format(r=_ORG_PROJECTS, m="create-descendant", s=_ARBORIST)} AS can_create_projects,
          {_HAS.format(r=_ORG, m="manage-owners", s=_ARBORIST)} AS can_manage_people, {_HAS.format(r=_ORG, m="delete", s="")} AS del FROM a)
SELECT user_id, organization, can_create_projects, can_manage_people, can_manage_people OR del AS can_delete_org, TRUE AS can_access_settings FROM flags
""",
)
def a_caps(t):
    asks = t["access_asks"].select("user_id", "organization").distinct()
    return ac.org_capabilities(asks, t["grants"])


@query(
    "a_project_caps",
    f"SELECT request_id, user_id, resource_path, {_HAS.format(r='a.resource_path', m='update', s='')} AS can_manage_settings FROM access_asks a",
)
def a_project_caps(t):
    asks = t["access_asks"].select("request_id", "user_id", "resource_path")
    return ac.project_capabilities(asks, t["grants"])


@query(
    "a_policy",
    """
WITH r AS (SELECT request_id, user_id, method, has_token,
             CASE WHEN config_type = '' THEN 'explorer' ELSE config_type END AS kind,
             CASE WHEN config_id = '' THEN 'default' ELSE config_id END AS cid,
             CASE WHEN method = 'GET' THEN 'read' WHEN method IN ('PUT', 'DELETE') THEN 'create' END AS perm FROM route_requests),
p AS (SELECT *, CASE WHEN len(string_split(cid, '-')) = 2 THEN '/programs/' || split_part(cid, '-', 1) || '/projects/' || split_part(cid, '-', 2) END AS res FROM r),
f AS (SELECT *, EXISTS (SELECT 1 FROM grants g WHERE g.user_id = p.user_id AND g.method IN (p.perm, '*')) AS has_any,
        EXISTS (SELECT 1 FROM grants g WHERE g.user_id = p.user_id AND g.method IN (p.perm, '*') AND g.resource = p.res) AS has_exact FROM p),
o AS (SELECT *, CASE WHEN perm IS NULL THEN 'method_not_allowed' WHEN kind <> 'explorer' AND method = 'GET' THEN 'allowed'
        WHEN kind <> 'explorer' THEN 'forbidden' WHEN NOT has_token THEN 'missing_authorization' WHEN res IS NULL THEN 'invalid_project_id'
        WHEN has_exact THEN 'allowed' ELSE 'forbidden' END AS outcome FROM f)
SELECT request_id, outcome, CASE outcome WHEN 'allowed' THEN NULL WHEN 'method_not_allowed' THEN 'Unsupported HTTP method ' || method
    WHEN 'missing_authorization' THEN 'Authorization token not provided' WHEN 'invalid_project_id' THEN 'incorrect path'
    ELSE CASE WHEN kind <> 'explorer' THEN 'must use route-specific authorization; refusing global /programs fallback'
              WHEN has_any THEN 'User is not allowed to ' || perm || ' on resource path: ' || res
              ELSE 'User is not allowed to ' || perm || ' on any resource path' END END AS message
FROM o
""",
)
def a_policy(t):
    return ac.route_policy(t["route_requests"], t["grants"]).select("request_id", "outcome", "message")
