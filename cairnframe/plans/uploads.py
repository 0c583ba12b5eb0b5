"""Upload session queries."""

from pyspark.sql import functions as F

from ..operators import uploads as up
from .registry import query, view

_NAMED = """
SELECT *, CASE WHEN trim(raw_name) = '' THEN 'file name is required' WHEN contains(raw_name, '/') THEN 'file name must not include path separators' END AS name_error,
  CASE WHEN name_error IS NULL THEN trim(raw_name) END AS file_name,
  CASE WHEN name_error IS NULL THEN CASE WHEN trim(subdirectory) = '' THEN '' ELSE 'data/' END || trim(raw_name) END AS target_path FROM upload_files
"""


@query("u_plan", f"SELECT session_id, ordinal, name_error, file_name, target_path FROM ({_NAMED})")
def u_plan(t):
    return up.plan_targets(t["upload_files"]).select("session_id", "ordinal", "name_error", "file_name", "target_path")


_DUPS = f"SELECT *, target_path IS NOT NULL AND row_number() OVER (PARTITION BY session_id, target_path ORDER BY ordinal) > 1 AS duplicate FROM ({_NAMED})"


@query("u_dups", f"SELECT session_id, ordinal, duplicate FROM ({_DUPS})")
def u_dups(t):
    return up.flag_duplicates(up.plan_targets(t["upload_files"])).select("session_id", "ordinal", "duplicate")


_PATHS = "SELECT repo, path FROM base_tree UNION SELECT repo, 'data' FROM base_tree WHERE path LIKE 'data/%' UNION SELECT repo, regexp_replace(path, '/inner$', '') FROM base_tree"
_PLANNED = f"""
SELECT d.*, CASE WHEN name_error IS NULL THEN CASE WHEN duplicate THEN 'duplicate target path in upload batch' WHEN b.path IS NOT NULL THEN 'target path already exists on base branch' END END AS error,
  CASE WHEN name_error IS NULL THEN CASE WHEN duplicate OR b.path IS NOT NULL THEN 'collision' ELSE 'pending_upload' END END AS status
FROM ({_DUPS}) d LEFT JOIN ({_PATHS}) b ON b.repo = d.repo AND b.path = d.target_path
"""


def _planned(t):
    return up.plan_uploads(t["upload_files"], t["base_tree"])


@query("u_exists", f"SELECT session_id, ordinal, target_path, status, error FROM ({_PLANNED})")
def u_exists(t):
    return _planned(t).select("session_id", "ordinal", "target_path", "status", "error")


# Every target is attached with the data of its first file; half of the sessions also name a file they do not hold.
# Files with a faulty name never enter a session; a repeated target does, as a collision.
_OF_FIRST = "OVER (PARTITION BY session_id, target_path ORDER BY ordinal)"
_ATTACHED = f"""
SELECT session_id, ordinal, target_path, file_name, first_value(size) {_OF_FIRST} AS size,
  first_value(lower(nullif(trim(checksum), ''))) {_OF_FIRST} AS checksum, first_value(nullif(trim(drs_object_id), '')) {_OF_FIRST} AS drs_object_id,
  CASE WHEN status = 'pending_upload' THEN 'uploaded' ELSE status END AS status, CASE WHEN status <> 'pending_upload' THEN error END AS error
FROM ({_PLANNED}) WHERE name_error IS NULL
"""


def _attachments(t):
    own = up.plan_targets(t["upload_files"]).filter("target_path IS NOT NULL")
    own = own.select(
        "session_id", F.concat(F.lit(" /"), "target_path").alias("target_path"), "size", "checksum", "drs_object_id", (-F.col("ordinal")).alias("ordinal")
    )
    extra = t["orders"].filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("session_id"), F.lit("not/there").alias("target_path"), F.lit(1).cast("bigint").alias("size"),
        F.lit("x").alias("checksum"), F.lit("y").alias("drs_object_id"), F.lit(0).cast("bigint").alias("ordinal"),
    )
    return own.unionByName(extra)


def _attached(t):
    """Files of good names, each with the data of the target's first row (the largest negated ordinal)."""
    files = _planned(t).filter("name_error IS NULL")
    return up.attach(files, _attachments(t), order="ordinal")


@query("u_attach", f"SELECT session_id, ordinal, target_path, size, checksum, drs_object_id, status, error FROM ({_ATTACHED})")
def u_attach(t):
    return _attached(t).select("session_id", "ordinal", "target_path", "size", "checksum", "drs_object_id", "status", "error")


@query(
    "u_attach_errors",
    "SELECT o_orderkey AS session_id, 'not/there' AS target_path, 'upload session does not contain target path not/there' AS error FROM orders WHERE o_orderstatus = 'F'",
)
def u_attach_errors(t):
    return up.attach_errors(up.plan_targets(t["upload_files"]), _attachments(t))


@query(
    "u_status",
    f"""
SELECT o_orderkey AS session_id, CASE WHEN EXISTS (SELECT 1 FROM ({_ATTACHED}) f WHERE f.session_id = o_orderkey AND (status = 'collision' OR checksum IS NULL OR drs_object_id IS NULL))
  THEN 'pending_upload' ELSE 'ready_for_pr' END AS status FROM orders
""",
)
def u_status(t):
    return up.session_status(t["orders"].select(F.col("o_orderkey").alias("session_id")), _attached(t))


@query(
    "u_finalize",
    f"""
WITH files AS ({_ATTACHED}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY target_path, ordinal) AS rn FROM files WHERE status = 'collision' OR checksum IS NULL OR drs_object_id IS NULL) WHERE rn = 1)
SELECT o_orderkey AS session_id, CASE WHEN f.status = 'collision' THEN 'upload session contains target path conflicts'
  WHEN f.status IS NOT NULL THEN 'upload session file ' || f.target_path || ' is not fully attached' END AS error
FROM orders LEFT JOIN firsts f ON f.session_id = o_orderkey
""",
)
def u_finalize(t):
    return up.finalize_check(t["orders"].select(F.col("o_orderkey").alias("session_id")), _attached(t))


@query(
    "u_pointer",
    """
SELECT session_id, ordinal, 'version https://git-lfs.github.com/spec/v1' || chr(10) || 'oid sha256:' || lower(trim(checksum)) || chr(10) || 'size ' || size || chr(10) AS pointer
FROM upload_files
""",
)
def u_pointer(t):
    """A file without checksum has no pointer."""
    return t["upload_files"].select("session_id", "ordinal", up.pointer_text(F.col("checksum"), F.col("size")).alias("pointer"))


@query(
    "u_session",
    f"""
WITH files AS ({_ATTACHED}),
asked AS (SELECT DISTINCT id AS session_id, CASE WHEN status = 'finalized' THEN 'Other/project' ELSE project_id END AS project_id, status = 'finalized' AS wrong FROM upload_sessions),
conflicts AS (SELECT session_id, bool_or(status = 'collision') AS has_conflicts FROM files GROUP BY session_id)
SELECT a.session_id, a.project_id, f.ordinal, f.target_path, f.status, f.status = 'collision' AS collision,
  CASE WHEN NOT wrong THEN coalesce(c.has_conflicts, FALSE) END AS has_conflicts, CASE WHEN wrong THEN 'not_found' END AS error_type
FROM asked a LEFT JOIN files f ON f.session_id = a.session_id AND NOT wrong LEFT JOIN conflicts c ON c.session_id = a.session_id
""",
)
def u_session(t):
    sessions = t["upload_sessions"].select(F.col("id").alias("session_id"), "project_id", "status")
    project = F.when(F.col("status") == "finalized", "Other/project").otherwise(F.col("project_id"))
    asked = sessions.select("session_id", project.alias("project_id"))
    shown = up.session_view(asked, sessions, _attached(t), ("ordinal", "target_path", "status"))
    return shown.select("session_id", "project_id", "ordinal", "target_path", "status", "collision", "has_conflicts", "error_type")


view(
    "session_requests",
    """
SELECT id AS session_id, split_part(project_id, '/', 2) AS project, CASE status WHEN 'finalized' THEN ' dev ' ELSE ' ' END AS requested_branch,
       CASE status WHEN 'pending_upload' THEN '' ELSE 'main' END AS default_branch, CASE WHEN id % 2 = 0 THEN ' /data/ ' ELSE '' END AS subdirectory,
       lpad(CAST(id % 99991 AS STRING), 8, '0') AS suffix FROM upload_sessions
""",
)


@query(
    "u_defaults",
    """
WITH n AS (SELECT session_id, count(*) AS n FROM upload_files GROUP BY session_id),
s AS (SELECT r.*, coalesce(n.n, 0) AS n_files, coalesce(nullif(trim(requested_branch), ''), nullif(trim(default_branch), '')) AS base_branch,
  CASE WHEN trim(subdirectory) <> '' THEN 'data' END AS target_subdirectory FROM session_requests r LEFT JOIN n ON n.session_id = r.session_id)
SELECT session_id, n_files, base_branch, target_subdirectory, CASE WHEN n_files = 1 THEN 'Add 1 LFS file to ' ELSE 'Add ' || n_files || ' LFS files to ' END || project AS title,
  'Upload Git LFS-backed files into `' || base_branch || '`' || CASE WHEN target_subdirectory IS NULL THEN '.' ELSE ' under `' || target_subdirectory || '`.' END AS body,
  'upload-' || replace(lower(project), '_', '-') || '-20250101-000000-' || suffix AS branch_name,
  CASE WHEN base_branch IS NULL THEN 'conflict' WHEN n_files = 0 THEN 'invalid_request' END AS error_type FROM s
""",
)
def u_defaults(t):
    counts = t["upload_files"].groupBy("session_id").agg(F.count(F.lit(1)).alias("n_files"))
    filled = up.session_defaults(t["session_requests"], counts, "20250101-000000")
    return filled.select(
        "session_id", "n_files", "base_branch", "target_subdirectory", "title", "body", "branch_name", "error_type"
    )


@query(
    "u_final_texts",
    """
SELECT id AS session_id, CASE WHEN status = 'finalized' THEN 'Release ' || id ELSE project_id END AS title, base_branch AS body FROM upload_sessions
""",
)
def u_final_texts(t):
    s = t["upload_sessions"]
    sessions = s.select(F.col("id").alias("session_id"), F.col("project_id").alias("title"), F.col("base_branch").alias("body"))
    wanted = F.when(F.col("status") == "finalized", F.concat(F.lit(" Release "), F.col("id").cast("string"))).otherwise("  ")
    asked = s.select(F.col("id").alias("session_id"), wanted.alias("title"), F.lit(None).cast("string").alias("body"))
    return up.final_texts(sessions, asked)


@query(
    "u_replace",
    """
WITH fresh AS (SELECT o_orderkey AS session_id, CAST(1 AS BIGINT) AS ordinal, 'only.tsv' AS raw_name FROM orders WHERE o_orderstatus = 'P')
SELECT session_id, ordinal, raw_name FROM upload_files WHERE session_id NOT IN (SELECT session_id FROM fresh) UNION ALL SELECT * FROM fresh
""",
)
def u_replace(t):
    fresh = t["orders"].filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("session_id"), F.lit(1).cast("bigint").alias("ordinal"), F.lit("only.tsv").alias("raw_name")
    )
    return up.replace_files(t["upload_files"].select("session_id", "ordinal", "raw_name"), fresh)
