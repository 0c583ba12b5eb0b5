"""Configuration document queries."""

from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import documents as dc
from ..schemas import DOCUMENT_SCHEMAS, PROJECT
from .registry import query

_TYPES = "('explorer', 'nav', 'file_summary', 'project', 'projects')"


@query("c_list", "SELECT config_type, name FROM docs WHERE config_type = 'explorer'")
def c_list(t):
    return dc.list_names(t["docs"]).withColumn("config_type", F.lit("explorer"))


@query(
    "c_get",
    f"""
WITH asked AS (SELECT DISTINCT CASE WHEN config_type = '' THEN 'explorer' ELSE config_type END AS config_type,
                      CASE WHEN name = '' THEN 'default' ELSE name END AS name FROM doc_asks)
SELECT a.config_type, a.name, d.content, d.name IS NOT NULL AS found,
       CASE WHEN a.config_type NOT IN {_TYPES} THEN 'invalid_config_type' WHEN d.name IS NULL THEN 'config_not_found' END AS error_type
FROM asked a LEFT JOIN docs d ON d.config_type = a.config_type AND d.name = a.name
""",
)
def c_get(t):
    return dc.get_documents(t["docs"], t["doc_asks"])


@query(
    "c_put",
    """
WITH latest AS (SELECT 'nav' AS config_type, concat('Customer_', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS name,
                       concat('{"order":', CAST(max(o_orderkey) AS VARCHAR), '}') AS content FROM orders GROUP BY o_custkey)
SELECT config_type, name, content FROM docs WHERE (config_type, name) NOT IN (SELECT config_type, name FROM latest)
UNION ALL SELECT config_type, name, content FROM latest
""",
)
def c_put(t):
    batch = t["orders"].select(
        F.lit("nav").alias("config_type"),
        F.concat(F.lit("Customer_"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"),
        F.concat(F.lit('{"order":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("content"),
        "o_orderkey",
    )
    return dc.put_documents(t["docs"].select("config_type", "name", "content"), batch, "o_orderkey")


@query("c_delete", "SELECT config_type, name FROM docs d WHERE NOT EXISTS (SELECT 1 FROM doc_asks a WHERE a.config_type = d.config_type AND a.name = d.name AND a.config_type = 'nav')")
def c_delete(t):
    remaining, _ = dc.delete_documents(t["docs"].select("config_type", "name"), t["doc_asks"].filter("config_type = 'nav'"))
    return remaining


@query(
    "c_delete_flags",
    "SELECT DISTINCT a.config_type, a.name, d.name IS NOT NULL AS deleted FROM doc_asks a LEFT JOIN docs d ON d.config_type = a.config_type AND d.name = a.name",
)
def c_delete_flags(t):
    _, flags = dc.delete_documents(t["docs"], t["doc_asks"])
    return flags


# Problems planted in the documents, found again by looking at the JSON.
_STRICT = """
SELECT config_type, name, doc_key,
  CASE WHEN content IS NULL THEN 'empty_request_body' WHEN NOT json_valid(content) THEN 'invalid_json' WHEN field IS NOT NULL THEN 'invalid_request_body' END AS error_type,
  field AS error_field, problem AS error_problem
FROM (SELECT *, CASE config_type
    WHEN 'projects' THEN CASE WHEN list_contains(json_keys(ok), 'surprise') THEN 'surprise' WHEN json_type(ok, '$.title') <> 'VARCHAR' THEN 'title' END
    WHEN 'file_summary' THEN CASE WHEN json_type(ok, '$.binslicePoints[5]') = 'VARCHAR' THEN 'binslicePoints' WHEN list_contains(json_keys(ok), 'extra') THEN 'extra' END
    WHEN 'explorer' THEN CASE WHEN list_contains(json_keys(ok, '$.explorerConfig[0].filters.tabs[0].fieldsConfig.segment'), 'surprise') THEN 'explorerConfig.filters.tabs.fieldsConfig.surprise'
                              WHEN json_type(ok, '$.explorerConfig[0].tabTitle') <> 'VARCHAR' THEN 'explorerConfig.tabTitle' END
    WHEN 'nav' THEN CASE WHEN json_type(ok, '$.footerProps.basePage') <> 'BOOLEAN' THEN 'footerProps.basePage'
                         WHEN len(json_keys(ok, '$.footerProps.rightSection.columns[0].rows[1]')) <> 1
                           OR json_keys(ok, '$.footerProps.rightSection.columns[0].rows[1]')[1] = 'Odd' THEN 'footerProps.rightSection.columns.rows' END
    END AS field,
  CASE WHEN field LIKE '%surprise' OR field = 'extra' THEN 'unknown_field' WHEN field LIKE '%rows' THEN 'bad_row' WHEN field IS NOT NULL THEN 'wrong_type' END AS problem
  FROM (SELECT *, CASE WHEN json_valid(content) THEN content END AS ok FROM docs))
"""


@query("c_strict", _STRICT)
def c_strict(t):
    checked = dc.strict_parse_all(t["docs"])
    return checked.select("config_type", "name", "doc_key", "error_type", "error_field", "error_problem")


@query(
    "c_decode",
    """
SELECT config_type, name,
  CASE config_type WHEN 'projects' THEN content->>'title' WHEN 'file_summary' THEN content->>'$.binslicePoints[5]'
       WHEN 'explorer' THEN content->>'$.explorerConfig[0].table.columns.name.title' ELSE content->>'$.headerProps.navigation.title' END AS probe
FROM docs WHERE json_valid(content) AND doc_key % 13 <> 0 AND NOT (config_type = 'nav' AND doc_key % 5 <> 0 AND (doc_key % 7 = 0 OR doc_key % 11 = 0))
""",
)
def c_decode(t):
    def probe(config_type, expr):
        rows = dc.decode(t["docs"], config_type).filter("doc IS NOT NULL")
        return rows.select(F.lit(config_type).alias("config_type"), "name", F.expr(expr).cast("string").alias("probe"))

    return (
        probe("projects", "doc.title")
        .unionByName(probe("file_summary", "doc.binslicePoints[5]"))
        .unionByName(probe("explorer", "doc.explorerConfig[0].table.columns['name'].title"))
        .unionByName(probe("nav", "doc.headerProps.navigation.title"))
    )


_EXPLORER = "SELECT name, content, unnest(range(CAST(json_array_length(content, '$.explorerConfig') AS BIGINT))) AS tab_pos FROM docs WHERE config_type = 'explorer' AND json_valid(content) AND doc_key % 13 <> 0"


@query(
    "c_flatten",
    f"""
WITH tabs AS ({_EXPLORER}),
parts AS (SELECT name, tab_pos, json_extract(content, '$.explorerConfig[' || tab_pos || ']') AS tab FROM tabs),
filters AS (SELECT name, tab_pos, tab, unnest(range(CAST(json_array_length(tab, '$.filters.tabs') AS BIGINT))) AS filter_pos FROM parts),
one AS (SELECT name, tab_pos, tab->>'tabTitle' AS tab_title, filter_pos, json_extract(tab, '$.filters.tabs[' || filter_pos || ']') AS f FROM filters),
fields AS (SELECT *, unnest(range(CAST(json_array_length(f, '$.fields') AS BIGINT))) AS field_pos FROM one),
named AS (SELECT *, json_extract_string(f, '$.fields[' || field_pos || ']') AS field FROM fields)
SELECT name, tab_pos, tab_title, filter_pos, f->>'title' AS filter_title, field_pos, field,
       CASE WHEN field = 'segment' THEN f->>'$.fieldsConfig.segment.label' END AS label,
       CASE WHEN field = 'segment' THEN f->>'$.fieldsConfig.segment.type' END AS type,
       field = 'segment' AND json_exists(f, '$.fieldsConfig.segment') AS configured FROM named
""",
)
def c_flatten(t):
    return dc.flatten_filters(dc.decode(t["docs"], "explorer"))


@query(
    "c_flatten_columns",
    f"""
WITH tabs AS ({_EXPLORER}),
cols AS (SELECT name, tab_pos, json_extract(content, '$.explorerConfig[' || tab_pos || '].table') AS tbl FROM tabs),
keyed AS (SELECT name, tab_pos, tbl, unnest(json_keys(tbl, '$.columns')) AS key FROM cols)
SELECT name, tab_pos, key, json_extract_string(tbl, '$.columns.' || key || '.field') AS field, json_extract_string(tbl, '$.columns.' || key || '.title') AS title,
       json_extract_string(tbl, '$.columns.' || key || '.type') AS type, json_extract_string(tbl, '$.columns.' || key || '.accessorPath') AS accessorPath,
       list_contains(CAST(tbl->'fields' AS VARCHAR[]), key) AS listed FROM keyed
""",
)
def c_flatten_columns(t):
    return dc.flatten_columns(dc.decode(t["docs"], "explorer"))


@query(
    "c_union",
    """
WITH nav AS (SELECT name, content FROM docs WHERE config_type = 'nav' AND json_valid(content) AND json_exists(content, '$.footerProps.rightSection')),
outer_rows AS (SELECT name, r, json_extract(content, '$.footerProps.rightSection.columns[0].rows[' || r || ']') AS row FROM nav, range(3) x(r)),
rows AS (SELECT name, '/0.' || r AS path, row FROM outer_rows
         UNION ALL SELECT name, '/0.' || r || '/0.' || i, json_extract(row, '$.Section.columns[0].rows[' || i || ']') FROM outer_rows, range(2) y(i) WHERE json_exists(row, '$.Section')),
keyed AS (SELECT *, json_keys(row) AS keys FROM rows)
SELECT name, 'rightSection' AS side, path,
       CASE WHEN len(keys) = 1 AND keys[1] IN ('Icon', 'Text', 'Link', 'Links', 'Section') THEN keys[1] END AS kind,
       CASE WHEN len(keys) <> 1 THEN 'FooterRow must have exactly one key, got ' || len(keys)
            WHEN keys[1] NOT IN ('Icon', 'Text', 'Link', 'Links', 'Section') THEN 'unknown FooterRow key: ' || keys[1] END AS error,
       CASE WHEN len(keys) = 1 AND keys[1] = 'Text' THEN row->>'$.Text.text' END AS text
FROM keyed
""",
)
def c_union(t):
    rows = dc.footer_rows(t["docs"])
    text = F.when(F.col("kind") == "Text", F.try_variant_get("body", "$.text", "string"))
    return rows.select("name", "side", "path", "kind", "error", text.alias("text"))


@query(
    "c_encode",
    """
SELECT name, TRUE AS same, key, CASE WHEN key = 'balance' THEN FALSE ELSE TRUE END AS has_type
FROM docs, (VALUES ('name'), ('balance')) k(key) WHERE config_type = 'explorer' AND json_valid(content) AND doc_key % 13 <> 0
""",
)
def c_encode(t):
    """Encoded documents read back equal; an empty column type is left out."""
    schema = DOCUMENT_SCHEMAS["explorer"]
    rows = dc.decode(t["docs"], "explorer").filter("doc IS NOT NULL")
    text = rows.withColumn("text", dc.encode("doc", schema)).withColumn("again", F.from_json("text", schema))
    columns = F.try_variant_get(F.try_parse_json("text"), "$.explorerConfig[0].table.columns", "map<string,variant>")
    checked = text.select("name", (dc.encode("again", schema) == F.col("text")).alias("same"), F.explode(columns).alias("key", "column"))
    return checked.select("name", "same", "key", F.try_variant_get("column", "$.type", "string").isNotNull().alias("has_type"))


# Project fields as stored, blanks and all.
_PROJECT_ROWS = """SELECT name AS project_id, trim(coalesce(content->>'title', '')) AS title, trim(coalesce(content->>'contact_email', '')) AS contact_email,
  trim(coalesce(content->>'src_repo', '')) AS src_repo, trim(coalesce(content->>'org_title', '')) AS org_title,
  trim(coalesce(content->>'description', '')) AS description, trim(coalesce(content->>'project_title', '')) AS project_title
  FROM docs WHERE config_type = 'projects' AND json_valid(content) AND doc_key % 13 <> 0"""
_REPO = r"^https://github\.com/([^/]+)/([^/]+)\.git$"


def _projects(t):
    rows = dc.decode(t["docs"], "projects").filter("doc IS NOT NULL")
    return rows.select(F.col("name").alias("project_id"), *[F.col(f"doc.{f.name}").alias(f.name) for f in PROJECT.fields])


def _validated(require_repo: bool) -> str:
    repo_check = "WHEN src_repo = '' THEN 'src_repo is required'" if require_repo else ""
    return rf"""
WITH p AS ({_PROJECT_ROWS})
SELECT project_id, title, contact_email, description, project_title,
  CASE WHEN title = '' THEN 'title is required' WHEN description = '' THEN 'description is required' {repo_check}
       WHEN NOT regexp_matches(contact_email, '^[a-z.]+@[a-z.]+$|^[A-Za-z ]+<[a-z.]+@[a-z.]+>$') THEN 'contact_email must be a valid email address'
       WHEN src_repo <> '' AND NOT regexp_matches(src_repo, '{_REPO}') THEN 'invalid src_repo URL: ' || src_repo END AS error,
  CASE WHEN error IS NULL THEN regexp_replace(src_repo, '{_REPO}', 'github.com/\1/\2') ELSE src_repo END AS src_repo
FROM p
"""


_VALIDATED = ("project_id", "title", "contact_email", "description", "project_title", "error", "src_repo")


@query("c_validate", _validated(True))
def c_validate(t):
    return dc.validate_projects(_projects(t)).select(*_VALIDATED)


@query("c_validate_init", _validated(False))
def c_validate_init(t):
    return dc.validate_projects(_projects(t), require_repo=False).select(*_VALIDATED)


_OWNER = "CASE WHEN project_key % 7 = 2 THEN segment ELSE organization END"
_VALID_REPO = "project_key % 7 NOT IN (0, 6)"
_REPO_URL = f"'github.com/' || {_OWNER} || '/r' || project_key"


@query(
    "c_repo_url",
    f"""
SELECT project_id, CASE WHEN {_VALID_REPO} THEN {_REPO_URL} END AS url,
       CASE project_key % 7 WHEN 0 THEN 'src_repo is required' WHEN 6 THEN 'invalid src_repo URL: ' || trim(src_repo) END AS error FROM projects
""",
)
def c_repo_url(t):
    repo = dc.normalize_repo_url(F.col("src_repo"))
    return t["projects"].select("project_id", repo["url"].alias("url"), repo["error"].alias("error"))


@query(
    "c_identity",
    f"""
SELECT project_id, CASE WHEN {_VALID_REPO} THEN 'github.com' END AS repo_host, CASE WHEN {_VALID_REPO} THEN {_OWNER} END AS repo_owner,
       CASE WHEN {_VALID_REPO} THEN 'r' || project_key END AS repo_name, CASE WHEN {_VALID_REPO} THEN 'https://' || {_REPO_URL} END AS repo_url FROM projects
""",
)
def c_identity(t):
    found = dc.repository_identities(t["projects"].select("project_id", "src_repo"))
    return found.select("project_id", "repo_host", "repo_owner", "repo_name", "repo_url")


@query(
    "c_requested_identity",
    "SELECT id, 'github.com' AS repo_host, 'o' AS repo_owner, repo_path AS repo_name, 'https://github.com/' || repo_full_name AS repo_url FROM pending",
)
def c_requested_identity(t):
    found = dc.requested_identities(t["pending"].select("id", "repo_full_name"), "repo_full_name")
    return found.select("id", "repo_host", "repo_owner", "repo_name", "repo_url")


@query(
    "c_summary",
    rf"""
WITH p AS ({_PROJECT_ROWS} AND contains(name, '/')),
thumbs AS (SELECT DISTINCT organization, project FROM access_asks)
SELECT split_part(project_id, '/', 1) AS organization, split_part(project_id, '/', 2) AS project,
       CASE WHEN title <> '' THEN title WHEN project_title <> '' THEN project_title ELSE split_part(project_id, '/', 2) END AS title,
       contact_email, description, '/programs/' || split_part(project_id, '/', 1) || '/projects/' || split_part(project_id, '/', 2) AS resource_path,
       CASE WHEN h.project IS NOT NULL THEN '/git/projects/' || replace(split_part(project_id, '/', 1), ' ', '%20') || '/' || h.project || '/thumbnail' END AS thumbnail_url
FROM p LEFT JOIN thumbs h ON h.organization = split_part(project_id, '/', 1) AND h.project = split_part(project_id, '/', 2)
""",
)
def c_summary(t):
    return dc.ordered_summary(dc.project_summary(t["docs"], t["access_asks"]))


@query(
    "c_is_zero",
    """
SELECT config_type, name, CASE config_type WHEN 'explorer' THEN json_array_length(content, '$.explorerConfig') = 0
    WHEN 'file_summary' THEN len(json_keys(content, '$.config')) = 0
    WHEN 'nav' THEN json_array_length(content, '$.headerProps.leftnav') = 0 AND NOT json_exists(content, '$.footerProps.rightSection')
    ELSE FALSE END AS is_zero
FROM docs WHERE json_valid(content) AND doc_key % 13 <> 0 AND NOT (config_type = 'nav' AND doc_key % 5 <> 0 AND (doc_key % 7 = 0 OR doc_key % 11 = 0))
""",
)
def c_is_zero(t):
    parts = []
    for kind in ("explorer", "nav", "file_summary", "projects"):
        rows = dc.decode(t["docs"], kind).filter("doc IS NOT NULL")
        parts.append(rows.select(F.lit(kind).alias("config_type"), "name", dc.is_empty(F.col("doc"), kind).alias("is_zero")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "c_defaults",
    f"""
WITH p AS ({_PROJECT_ROWS.replace("trim(coalesce(content->>'title', ''))", "content->>'title'").replace("trim(coalesce(content->>'project_title', ''))", "content->>'project_title'")})
SELECT project_id, split_part(project_id, '/', 1) AS org_title,
       CASE WHEN trim(title) = '' THEN CASE WHEN contains(project_id, '/') THEN split_part(project_id, '/', 2) ELSE project_id END ELSE title END AS title,
       project_title FROM p
""",
)
def c_defaults(t):
    return dc.init_defaults(_projects(t)).select("project_id", "org_title", "title", "project_title")
