"""Project and organisation state queries."""

from pyspark.sql import functions as F

from ..operators import state as st
from ..sources.tables import stored
from .documents import _OWNER, _VALID_REPO
from .registry import query

NOW = "TIMESTAMP '2025-01-01 00:00:00'"
_OWNER_P = _OWNER.replace("project_key", "p.project_key").replace("segment", "p.segment").replace("organization", "p.organization")
_LINKED = f"CASE WHEN {_VALID_REPO} THEN {_OWNER} END"


def _now():
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query(
    "p_upsert",
    f"""
WITH batch AS (SELECT id, project_id, 'main' AS base_branch, 'finalized' AS status, {NOW} AS created_at, {NOW} AS updated_at FROM upload_sessions WHERE status = 'ready_for_pr'
               UNION ALL SELECT -1 - user_id, 'X/y', 'dev', 'pending_upload', max(ts), max(ts) FROM events GROUP BY user_id)
SELECT coalesce(b.id, s.id) AS id, coalesce(b.project_id, s.project_id) AS project_id, coalesce(b.base_branch, s.base_branch) AS base_branch,
       coalesce(b.status, s.status) AS status, coalesce(s.created_at, b.created_at) AS created_at, coalesce(b.updated_at, s.updated_at) AS updated_at
FROM upload_sessions s FULL JOIN batch b ON b.id = s.id
""",
)
def p_upsert(t):
    base = t["upload_sessions"]
    again = base.filter("status = 'ready_for_pr'").withColumns(
        {"status": F.lit("finalized"), "created_at": _now(), "updated_at": _now()}
    )
    fresh = t["events"].groupBy("user_id").agg(F.max("ts").alias("ts")).select(
        (-1 - F.col("user_id")).alias("id"),
        F.lit("X/y").alias("project_id"),
        F.lit("dev").alias("base_branch"),
        F.lit("pending_upload").alias("status"),
        F.col("ts").cast(base.schema["created_at"].dataType).alias("created_at"),
        F.col("ts").cast(base.schema["updated_at"].dataType).alias("updated_at"),
    )
    again = again.withColumns({c: F.col(c).cast(base.schema[c].dataType) for c in ("created_at", "updated_at")})
    return st.upsert_state(base, again.unionByName(fresh), "upload_session", "id")


_SCOPED = """EXISTS (SELECT 1 FROM bucket_resources b WHERE trim(b.resource) IN (p.resource_path, '/organization/' || p.organization || '/project/' || p.project))"""


@query(
    "p_storage",
    f"""
SELECT project_id, {_SCOPED} AS storage_pass, CASE WHEN NOT {_SCOPED} THEN 'missing_storage_scope' END AS storage_reason,
       CASE WHEN NOT {_SCOPED} THEN 'No bucket scope matched this project' END AS storage_details FROM projects p
""",
)
def p_storage(t):
    checked = st.storage_check(t["projects"], t["bucket_resources"])
    return checked.select("project_id", "storage_pass", "storage_reason", "storage_details")


_CHECKS = f"""
SELECT p.project_id, p.organization, p.project, p.src_repo, p.resource_path, o.installed AS app_installed,
       o.installed AND o.repository_selection = 'all' AS wide, s.installation_id IS NOT NULL OR s.installation_target IS NOT NULL AS own,
       wide OR coalesce(own, FALSE) AS installed,
       CASE WHEN wide THEN o.installation_id WHEN own THEN s.installation_id END AS installation_id,
       CASE WHEN wide THEN CASE WHEN {_VALID_REPO.replace('project_key', 'p.project_key')} THEN {_OWNER_P} END WHEN own THEN s.installation_target END AS installation_target,
       CASE WHEN wide THEN 'Organization' WHEN own THEN s.installation_target_type END AS installation_target_type,
       CASE WHEN wide OR own THEN o.html_url END AS html_url, CASE WHEN wide OR own THEN o.repository_selection END AS repository_selection,
       {_SCOPED} AS storage_pass
FROM projects p LEFT JOIN orgs o ON o.organization = p.organization LEFT JOIN project_state s ON s.project_id = p.project_id
"""
_INSTALL_COLUMNS = "installation_id, installation_target, installation_target_type, html_url, repository_selection"


@query("p_install", f"WITH checks AS ({_CHECKS}) SELECT project_id, app_installed, installed, {_INSTALL_COLUMNS} FROM checks")
def p_install(t):
    found = st.installation(st.with_identity(t["projects"]), t["org_state"], t["project_state"])
    return found.select("project_id", "app_installed", "installed", *_INSTALL_COLUMNS.split(", "))


def _project_checks(t):
    return st.project_checks(t["projects"], t["org_state"], t["project_state"], t["bucket_resources"])


@query(
    "p_checks",
    f"""
WITH checks AS ({_CHECKS})
SELECT project_id, organization, resource_path, installed, storage_pass, installed AND storage_pass AS configured,
  CASE WHEN trim(src_repo) = '' THEN 'missing_repository_link' WHEN NOT installed THEN 'missing_github_connection' END AS github_reason,
  CASE WHEN trim(src_repo) = '' AND app_installed THEN 'GitHub App is installed for this organization, but this project is not linked to a repository yet'
       WHEN trim(src_repo) = '' THEN 'No GitHub repository is linked to this project'
       WHEN NOT installed THEN 'GitHub App is not connected to this repository' END AS github_details
FROM checks
""",
)
def p_checks(t):
    return _project_checks(t).select(
        "project_id", "organization", "resource_path", "installed", "storage_pass", "configured", "github_reason", "github_details"
    )


@query(
    "p_status",
    f"""
SELECT p.project_id, p.resource_path, {_OWNER_P} AS repo_owner, 'r' || p.project_key AS repo_name,
  CASE WHEN s.installation_id IS NOT NULL OR s.installation_target IS NOT NULL THEN 'connected' ELSE 'not_connected' END AS installation_state,
  CASE WHEN coalesce(s.sync_state, '') = '' THEN 'never_synced' ELSE s.sync_state END AS sync_state, s.default_branch, s.last_error,
  o.installed AS organization_app_installed, o.html_url AS organization_html_url, o.repository_selection AS organization_repository_selection
FROM projects p LEFT JOIN orgs o ON o.organization = p.organization LEFT JOIN project_state s ON s.project_id = p.project_id
WHERE {_VALID_REPO.replace('project_key', 'p.project_key')}
""",
)
def p_status(t):
    return st.project_status(t["projects"], t["project_state"], t["org_state"]).select(
        "project_id", "resource_path", "repo_owner", "repo_name", "installation_state", "sync_state", "default_branch", "last_error",
        "organization_app_installed", "organization_html_url", "organization_repository_selection",
    )


_STATE_OF = """CASE WHEN NOT {app} THEN 'not_connected' WHEN {total} = 0 THEN 'connected' WHEN {done} <= 0 THEN 'installed_unconfigured'
  WHEN {done} < {total} THEN 'partially_configured' ELSE 'connected' END"""
_BY_ORG = f"""
SELECT c.organization, count(*) AS total_projects, count(*) FILTER (c.installed) AS connected_projects,
       count(*) FILTER (c.installed AND c.storage_pass) AS configured_projects, any_value(o.installed) AS app_installed,
       any_value(o.installation_id) AS installation_id, any_value(o.repository_selection) AS repository_selection
FROM checks c JOIN orgs o ON o.organization = c.organization GROUP BY c.organization
"""


@query(
    "p_org_rollup",
    f"""
WITH checks AS ({_CHECKS}), by_org AS ({_BY_ORG})
SELECT *, {_STATE_OF.format(app='app_installed', total='total_projects', done='configured_projects')} AS configuration_state FROM by_org
""",
)
def p_org_rollup(t):
    return st.org_rollup(_project_checks(t), t["org_state"]).drop("html_url")


@query(
    "p_all_rollup",
    f"""
WITH checks AS ({_CHECKS}), by_org AS ({_BY_ORG}),
totals AS (SELECT count(*) AS total_organizations, count(*) FILTER (app_installed) AS installed_organizations, CAST(sum(total_projects) AS BIGINT) AS total_projects,
  CAST(sum(connected_projects) AS BIGINT) AS connected_projects, CAST(sum(configured_projects) AS BIGINT) AS configured_projects FROM by_org)
SELECT *, installed_organizations AS connected_organizations, installed_organizations > 0 AS app_installed,
  {_STATE_OF.format(app='(installed_organizations > 0)', total='total_projects', done='configured_projects')} AS configuration_state FROM totals
""",
)
def p_all_rollup(t):
    return st.all_rollup(st.org_rollup(_project_checks(t), t["org_state"]))


@query(
    "p_conf_state",
    f"""
WITH s AS (SELECT event_id, event_type <> 'error' AS app, user_id % 7 AS total, event_id % 8 - 1 AS done FROM events)
SELECT event_id, {_STATE_OF.format(app='app', total='total', done='done')} AS configuration_state FROM s
""",
)
def p_conf_state(t):
    app, total, done = F.col("event_type") != "error", F.col("user_id") % 7, F.col("event_id") % 8 - 1
    return t["events"].select("event_id", st.configuration_state(app, done, total).alias("configuration_state"))


@query("p_orgs", "SELECT DISTINCT split_part(project_id, '/', 1) AS organization FROM projects")
def p_orgs(t):
    return st.organizations(t["projects"])


_COLS = ("installation_id", "installation_target", "installation_target_type", "html_url", "repository_selection")
_REC_ORG = f"""
owners AS (SELECT DISTINCT organization, {_OWNER} AS owner FROM projects WHERE {_VALID_REPO}),
decisive AS (SELECT i.* FROM installs i JOIN owners USING (organization, owner) WHERE status_code NOT IN (200, 404) OR status_code = 200 AND installed),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organization ORDER BY owner) AS rn FROM decisive) WHERE rn = 1),
listed AS (SELECT DISTINCT organization FROM projects),
with_owner AS (SELECT DISTINCT organization, TRUE AS has_owner FROM owners),
picked AS (SELECT l.organization, coalesce(w.has_owner, FALSE) AS has_owner, f.status_code, f.installed AS new_installed, o.installed AS old_installed,
  {", ".join(f"CASE WHEN w.has_owner THEN f.{c} ELSE o.{c} END AS {c}" for c in _COLS)}
  FROM listed l LEFT JOIN with_owner w ON w.organization = l.organization LEFT JOIN firsts f ON f.organization = l.organization LEFT JOIN org_state o ON o.organization = l.organization),
org_rows AS (SELECT organization, CASE WHEN has_owner AND status_code NOT IN (200, 404) THEN 'integration_error' END AS error,
  error IS NULL AND coalesce(CASE WHEN has_owner THEN new_installed ELSE old_installed END, FALSE) AS installed,
  {", ".join(f"CASE WHEN error IS NULL AND coalesce(CASE WHEN has_owner THEN new_installed ELSE old_installed END, FALSE) THEN {c} END AS {c}" for c in _COLS)} FROM picked)
"""


@query(
    "p_rec_org",
    f"WITH {_REC_ORG} SELECT *, CASE WHEN installed THEN {NOW} END AS configured_at, {NOW} AS last_seen_at, {NOW} AS updated_at FROM org_rows",
)
def p_rec_org(t):
    return st.reconcile_orgs(t["projects"], t["installs"], t["org_state"], _now())


@query(
    "p_rec_project",
    f"""
WITH {_REC_ORG},
tracked AS (SELECT p.project_id, 'github.com' AS h, {_OWNER_P} AS o, 'r' || p.project_key AS n, r.installed, r.installation_id AS org_id, r.repository_selection, b.token_status, b.metadata_ok,
  CASE WHEN r.installed AND r.repository_selection = 'all' THEN 'applied' WHEN b.token_status IN (403, 404) THEN 'cleared' WHEN b.token_status <> 200 THEN 'error'
       WHEN NOT b.metadata_ok THEN 'cleared' ELSE 'applied' END AS outcome
  FROM projects p JOIN org_rows r ON r.organization = p.organization AND r.error IS NULL LEFT JOIN probes b ON b.project_id = p.project_id WHERE {_VALID_REPO.replace('project_key', 'p.project_key')})
SELECT t.project_id, coalesce(s.repo_host, h) AS repo_host, coalesce(s.repo_owner, o) AS repo_owner, coalesce(s.repo_name, n) AS repo_name,
  CASE outcome WHEN 'applied' THEN org_id WHEN 'error' THEN s.installation_id END AS installation_id,
  CASE outcome WHEN 'applied' THEN o WHEN 'error' THEN s.installation_target END AS installation_target,
  CASE outcome WHEN 'applied' THEN 'Organization' WHEN 'error' THEN s.installation_target_type END AS installation_target_type,
  coalesce(s.sync_state, 'never_synced') AS sync_state, outcome
FROM tracked t LEFT JOIN project_state s ON s.project_id = t.project_id
""",
)
def p_rec_project(t):
    projects = stored(st.with_identity(t["projects"]))
    org_rows = st.reconcile_orgs(projects, t["installs"], t["org_state"], _now())
    return st.reconcile_projects(projects, org_rows, t["project_state"], t["probes"])


@query("p_pending", "SELECT id, installation_id, repo_full_name, added_at FROM pending WHERE resolved_at IS NULL AND removed_at IS NULL")
def p_pending(t):
    return st.open_pending(t["pending"]).select("id", "installation_id", "repo_full_name", "added_at")


@query(
    "p_pending_user",
    "SELECT id, installation_id, setup_session_id FROM pending WHERE resolved_at IS NULL AND removed_at IS NULL AND user_id = 3 AND installation_id = 13 AND setup_session_id = 's1'",
)
def p_pending_user(t):
    return st.open_pending(t["pending"], 13, 3, "s1").select("id", "installation_id", "setup_session_id")


@query(
    "p_resolve",
    f"""
WITH keys AS (SELECT DISTINCT 'github.com' AS repo_host, 'o' AS repo_owner, 'r' || o_custkey AS repo_path FROM orders),
hits AS (SELECT p.*, k.repo_path IS NOT NULL AND resolved_at IS NULL AND removed_at IS NULL AS hit FROM pending p LEFT JOIN keys k ON k.repo_path = p.repo_path)
SELECT id, CASE WHEN hit THEN {NOW} ELSE resolved_at END AS resolved_at, CASE WHEN hit THEN {NOW} END AS updated_at, removed_at FROM hits
""",
)
def p_resolve(t):
    keys = t["orders"].select(
        F.lit("github.com").alias("repo_host"),
        F.lit("o").alias("repo_owner"),
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo_path"),
    )
    closed = st.close_pending(t["pending"], keys, ["repo_host", "repo_owner", "repo_path"], "resolved_at", _now())
    return closed.select("id", "resolved_at", "updated_at", "removed_at")


@query(
    "p_remove",
    f"""
WITH keys AS (SELECT DISTINCT user_id % 30 AS installation_id, event_id % 400 AS repo_id FROM events WHERE event_type = 'click'),
hits AS (SELECT p.*, k.repo_id IS NOT NULL AND removed_at IS NULL AS hit FROM pending p LEFT JOIN keys k ON k.repo_id = p.repo_id AND k.installation_id = p.installation_id)
SELECT id, resolved_at, CASE WHEN hit THEN {NOW} ELSE removed_at END AS removed_at FROM hits
""",
)
def p_remove(t):
    keys = t["events"].filter("event_type = 'click'").select(
        (F.col("user_id") % 30).alias("installation_id"), (F.col("event_id") % 400).alias("repo_id")
    )
    closed = st.close_pending(t["pending"], keys, ["installation_id", "repo_id"], "removed_at", _now())
    return closed.select("id", "resolved_at", "removed_at")


@query(
    "p_resolve_by_id",
    f"SELECT id, CASE WHEN id IN (SELECT event_id FROM events WHERE event_type = 'view') THEN {NOW} ELSE resolved_at END AS resolved_at FROM pending",
)
def p_resolve_by_id(t):
    ids = t["events"].filter("event_type = 'view'").select(F.col("event_id").alias("id"))
    return st.close_pending(t["pending"], ids, ["id"], "resolved_at", _now(), only_open=False).select("id", "resolved_at")


@query(
    "p_unique",
    """
SELECT id, first_id, copies FROM (SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS copies FROM pending WINDOW w AS (PARTITION BY installation_id, repo_id, user_id)) WHERE id <> first_id
""",
)
def p_unique(t):
    return st.uniqueness_violations(t["pending"]).select("id", "first_id", "copies")


@query(
    "p_cascade",
    """
WITH gone AS (SELECT project_id FROM projects WHERE segment = 'MACHINERY')
SELECT 'files' AS part, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS checksum FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM upload_sessions WHERE project_id IN (SELECT * FROM gone))
UNION ALL SELECT 'sessions', count(*), CAST(sum(id) AS BIGINT) FROM upload_sessions WHERE project_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'states', count(*), CAST(sum(length(project_id)) AS BIGINT) FROM project_state WHERE project_id NOT IN (SELECT * FROM gone)
""",
)
def p_cascade(t):
    tables = {
        "files": t["lineitem"].select(F.col("l_orderkey").alias("session_id")),
        "sessions": t["upload_sessions"],
        "states": t["project_state"],
    }
    left = st.cascade_delete(tables, t["projects"].filter("segment = 'MACHINERY'"))
    return _left_counts(left)


def _left_counts(left):
    value = {"files": F.col("session_id"), "sessions": F.col("id"), "states": F.length("project_id")}
    parts = [
        left[k].agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("checksum")).select(F.lit(k).alias("part"), "n", "checksum")
        for k, v in value.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "p_cascade_org",
    """
WITH gone AS (SELECT organization FROM orgs WHERE NOT installed)
SELECT 'files' AS part, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS checksum FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM upload_sessions WHERE split_part(project_id, '/', 1) IN (SELECT * FROM gone))
UNION ALL SELECT 'sessions', count(*), CAST(sum(id) AS BIGINT) FROM upload_sessions WHERE split_part(project_id, '/', 1) NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'states', count(*), CAST(sum(length(project_id)) AS BIGINT) FROM project_state WHERE split_part(project_id, '/', 1) NOT IN (SELECT * FROM gone)
""",
)
def p_cascade_org(t):
    tables = {
        "files": t["lineitem"].select(F.col("l_orderkey").alias("session_id")),
        "sessions": t["upload_sessions"],
        "states": t["project_state"],
    }
    return _left_counts(st.cascade_delete_orgs(tables, t["projects"], t["orgs"].filter("NOT installed")))


@query(
    "p_drift",
    f"""
WITH want AS (SELECT project_id, 'github.com' AS h, {_OWNER} AS o, 'r' || project_key AS n, '/data/github.com/' || {_OWNER} || '/r' || project_key || '.git' AS m FROM projects WHERE {_VALID_REPO})
SELECT s.project_id, coalesce(o, repo_owner) AS repo_owner, coalesce(n, repo_name) AS repo_name, coalesce(m, mirror_path) AS mirror_path,
       m IS NOT NULL AND (o <> repo_owner OR n <> repo_name OR m <> mirror_path) AS changed, s.sync_state
FROM project_state s LEFT JOIN want w ON w.project_id = s.project_id
""",
)
def p_drift(t):
    aligned = st.align_identity(t["project_state"], t["projects"], "/data")
    return aligned.select("project_id", "repo_owner", "repo_name", "mirror_path", "changed", "sync_state")


@query(
    "p_put_state",
    f"""
WITH want AS (SELECT project_id, {_OWNER} AS o, 'r' || project_key AS n, '/data/github.com/' || {_OWNER} || '/r' || project_key || '.git' AS m FROM projects WHERE {_VALID_REPO}),
changed AS (SELECT w.* FROM want w LEFT JOIN project_state s ON s.project_id = w.project_id AND s.repo_owner = w.o AND s.repo_name = w.n WHERE s.project_id IS NULL)
SELECT project_id, repo_owner, repo_name, mirror_path, sync_state, installation_id FROM project_state WHERE project_id NOT IN (SELECT project_id FROM changed)
UNION ALL SELECT project_id, o, n, m, 'never_synced', NULL FROM changed
""",
)
def p_put_state(t):
    stored = st.put_project_state(t["project_state"], t["projects"], "/data")
    return stored.select("project_id", "repo_owner", "repo_name", "mirror_path", "sync_state", "installation_id")


_BIND = """
j AS (SELECT r.project_id, r.project_key, trim(r.repository_full_name) AS wanted, p.project_id IS NOT NULL AS known, o.installation_id AS inst, i.full_name,
  CASE WHEN trim(i.clone_url) <> '' THEN trim(i.clone_url) WHEN trim(i.html_url) <> '' THEN trim(i.html_url) ELSE 'https://github.com/' || i.full_name END AS url
  FROM bind_requests r LEFT JOIN projects p ON p.project_id = r.project_id
  LEFT JOIN orgs o ON o.organization = split_part(r.project_id, '/', 1) AND o.installed
  LEFT JOIN installation_repos i ON i.installation_id = o.installation_id AND lower(i.full_name) = lower(trim(r.repository_full_name))),
e AS (SELECT *, CASE WHEN wanted = '' THEN 'invalid_request' WHEN NOT known THEN 'not_found' WHEN inst IS NULL OR full_name IS NULL THEN 'conflict' WHEN url = 'nonsense' THEN 'integration_error' END AS error_type FROM j)
"""


@query(
    "p_bind",
    f"""
WITH {_BIND}
SELECT project_id, project_key, error_type, CASE WHEN error_type IS NULL THEN inst END AS installation_id, CASE WHEN error_type IS NULL THEN 'never_synced' END AS sync_state,
       CASE WHEN error_type IS NULL THEN regexp_replace(url, '[.]git$', '') END AS src_repo FROM e
""",
)
def p_bind(t):
    bound = st.bind_repositories(t["bind_requests"], t["projects"], t["org_state"], t["installation_repos"])
    return bound.select("project_id", "project_key", "error_type", "installation_id", "sync_state", "src_repo")


@query(
    "p_bind_states",
    f"""
WITH {_BIND},
good AS (SELECT e.project_id, inst, string_split(regexp_replace(url, '[.]git$', ''), '/') AS u, o.installation_target FROM e JOIN org_state o ON o.organization = split_part(e.project_id, '/', 1) WHERE error_type IS NULL)
SELECT project_id, repo_owner, repo_name, installation_id, installation_target, mirror_path, sync_state, default_branch, last_error FROM project_state WHERE project_id NOT IN (SELECT project_id FROM good)
UNION ALL SELECT project_id, u[4], u[5], inst, installation_target, '/data/github.com/' || u[4] || '/' || u[5] || '.git', 'never_synced', NULL, NULL FROM good
""",
)
def p_bind_states(t):
    bound = st.bind_repositories(t["bind_requests"], t["projects"], t["org_state"], t["installation_repos"])
    return st.apply_bindings(t["project_state"], bound, t["org_state"], "/data").select(
        "project_id", "repo_owner", "repo_name", "installation_id", "installation_target", "mirror_path", "sync_state", "default_branch", "last_error"
    )


@query(
    "p_repo_ids",
    """
WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'oops' ELSE '[' || user_id || ',' || event_id % 5 || ',' || user_id || ']' END AS before_text, [user_id, event_id % 7, user_id + 1] AS ids FROM events),
d AS (SELECT *, CASE WHEN before_text = 'oops' THEN CAST([] AS BIGINT[]) ELSE list_distinct(CAST(before_text::JSON AS BIGINT[])) END AS before FROM s)
SELECT event_id, '[' || ids[1] || ',' || ids[2] || ',' || ids[3] || ']' AS encoded, len(before) AS n_before,
       CAST(list_sum(list_distinct(list_filter(ids, lambda x: NOT list_contains(before, x)))) AS BIGINT) AS new_sum FROM d
""",
)
def p_repo_ids(t):
    e = t["events"].select(
        "event_id",
        F.when(F.col("event_type") == "error", "oops")
        .otherwise(F.format_string("[%d,%d,%d]", "user_id", F.col("event_id") % 5, "user_id"))
        .alias("before_text"),
        F.array("user_id", F.col("event_id") % 7, F.col("user_id") + 1).alias("ids"),
    )
    new = st.new_repo_ids(F.col("ids"), F.col("before_text"))
    return e.select(
        "event_id",
        st.encode_repo_ids(F.col("ids")).alias("encoded"),
        F.size(st.decode_repo_ids(F.col("before_text"))).cast("bigint").alias("n_before"),
        F.when(F.size(new) > 0, F.aggregate(new, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("new_sum"),
    )


@query(
    "p_paths",
    """
WITH s AS (SELECT c_custkey, c_mktsegment, c_name, CASE c_custkey % 5 WHEN 0 THEN ' s3://own/path ' ELSE ' ' END AS path, CASE c_custkey % 5 WHEN 1 THEN ' /pre/fix/ ' ELSE '/' END AS prefix,
  CASE WHEN c_custkey % 5 IN (2, 3) THEN '/org/./x/' ELSE '' END AS org_sub, CASE WHEN c_custkey % 5 = 3 THEN ' ../proj ' ELSE '' END AS project_sub,
  CASE c_custkey % 6 WHEN 0 THEN 'GCS' WHEN 1 THEN 'azure' WHEN 2 THEN ' az ' WHEN 3 THEN 'file' WHEN 4 THEN 'aws' ELSE '' END AS provider FROM customer),
r AS (SELECT *, CASE c_custkey % 6 WHEN 0 THEN 'gs' WHEN 1 THEN 'azblob' WHEN 2 THEN 'azblob' WHEN 3 THEN 'file' ELSE 's3' END || '://' || c_mktsegment AS root FROM s)
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 's3://own/path' WHEN 1 THEN root || '/pre/fix' WHEN 2 THEN root || '/org/x' WHEN 3 THEN root || '/org/proj' ELSE '' END AS scope,
  '/data/a_b/' || c_mktsegment || '/' || replace(c_name, ' ', '_') || '.git' AS mirror FROM r
""",
)
def p_paths(t):
    k = F.col("c_custkey")
    provider = F.element_at(F.array(*[F.lit(x) for x in ("GCS", "azure", " az ", "file", "aws", "")]), (k % 6 + 1).cast("int"))
    scope = st.scope_path(
        F.when(k % 5 == 0, " s3://own/path ").otherwise(" "),
        F.when(k % 5 == 1, " /pre/fix/ ").otherwise("/"),
        F.when((k % 5).isin(2, 3), "/org/./x/").otherwise(""),
        F.when(k % 5 == 3, " ../proj ").otherwise(""),
        provider,
        F.col("c_mktsegment"),
    )
    mirror = st.mirror_path(F.lit("a:b"), F.col("c_mktsegment"), F.col("c_name"), "/data/")
    return t["customer"].select("c_custkey", scope.alias("scope"), mirror.alias("mirror"))


@query(
    "p_refresh",
    f"""
WITH results AS (SELECT project_id, project_key % 3 = 0 AS ok, CASE WHEN project_key % 6 = 0 THEN '' ELSE 'trunk' END AS branch, 'failed ' || project_key AS message FROM projects WHERE segment <> 'FURNITURE')
SELECT s.project_id, CASE WHEN r.ok THEN 'ready' WHEN NOT r.ok THEN 'error' ELSE 'updating' END AS sync_state,
  CASE WHEN r.ok THEN nullif(r.branch, '') ELSE s.default_branch END AS default_branch, CASE WHEN r.ok THEN {NOW} ELSE s.last_refreshed_at END AS last_refreshed_at,
  CASE WHEN NOT r.ok THEN r.message END AS last_error
FROM project_state s LEFT JOIN results r ON r.project_id = s.project_id
""",
)
def p_refresh(t):
    started = st.start_refresh(t["project_state"], t["projects"])
    results = t["projects"].filter("segment <> 'FURNITURE'").select(
        "project_id",
        (F.col("project_key") % 3 == 0).alias("ok"),
        F.when(F.col("project_key") % 6 == 0, "").otherwise("trunk").alias("branch"),
        F.concat(F.lit("failed "), F.col("project_key").cast("string")).alias("message"),
    )
    done = st.finish_refresh(started, results, _now())
    return done.select("project_id", "sync_state", "default_branch", "last_refreshed_at", "last_error")


@query(
    "p_setup_plan",
    """
WITH a AS (SELECT DISTINCT user_id, organization, project, resource_path FROM access_asks),
f AS (SELECT *, EXISTS (SELECT 1 FROM grants g WHERE g.user_id = a.user_id AND g.resource = a.resource_path AND g.method IN ('read', '*')) AS readable,
  EXISTS (SELECT 1 FROM grants g WHERE g.user_id = a.user_id AND g.service IN ('arborist', '*') AND
    (g.resource = '/programs/' || a.organization || '/projects' AND g.method IN ('create-descendant', '*') OR g.resource = '/programs/' || a.organization AND g.method IN ('manage-owners', '*'))) AS owner FROM a)
SELECT user_id, organization, project, resource_path, CASE WHEN readable THEN '' WHEN owner THEN resource_path ELSE '/programs/' || organization || ' ' || resource_path END AS to_create FROM f
""",
)
def p_setup_plan(t):
    asks = t["access_asks"].select("user_id", "organization", "project").distinct()
    return st.setup_plan(asks, t["grants"]).withColumn("to_create", F.array_join("to_create", " "))
