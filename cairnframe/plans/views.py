"""Derived inputs, each one statement over the given tables.

Every statement reads its base tables whole. Where the two SQL dialects differ
the second text is the same statement in the other dialect.
"""

from .registry import view

# ---------------------------------------------------------------- vectors

view(
    "points",
    """
SELECT concat('00000000-0000-4000-8000-', lpad(CAST(vec_id AS STRING), 12, '0')) AS id, vec_id, 'emb' AS vector_name,
       embedding AS vector, CAST(label AS BIGINT) AS label,
       concat('{"color":"color_', CAST(vec_id % 3 AS STRING), '","label":', CAST(label AS STRING), ',"even":',
              CASE WHEN vec_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"code":', CASE WHEN label < 5 THEN '"7"' ELSE '7' END,
              ',"note":null,"n":{"k":', CAST(vec_id % 5 AS STRING), '},"tags":["t', CAST(label AS STRING), '","all"]}') AS payload
FROM embeddings
""",
)
view("knn_queries", "SELECT vec_id AS query_id, id, vector FROM points")
view(
    "request_inputs",
    """
SELECT vec_id AS request_id, 'pos' AS sign, id FROM points
UNION ALL SELECT a.vec_id, 'pos', b.id FROM points a JOIN points b ON b.vec_id = a.vec_id + 1
UNION ALL SELECT a.vec_id, 'neg', b.id FROM points a JOIN points b ON b.vec_id = a.vec_id + 2 AND a.label < 5
""",
)
view(
    "raw_requests",
    """
SELECT event_id AS request_id, event_type <> 'view' AS has_vector, CAST(event_id % 3 AS BIGINT) AS n_pos,
       CAST(user_id % 5 AS BIGINT) AS n_neg FROM events
""",
)
# Requests of every form: a vector, a lookup id, both, positives and negatives, negatives alone, nothing; some name an unknown id.
view(
    "whole_requests",
    """
SELECT p.vec_id AS query_id, 'emb' AS vector_name, CASE WHEN p.vec_id % 8 IN (0, 2, 6) THEN p.vector END AS vector,
       CASE WHEN p.vec_id % 8 IN (1, 4, 6) THEN p.id END AS lookup_id,
       CASE WHEN p.vec_id % 40 = 3 THEN 'no-such-id' WHEN p.vec_id % 8 = 3 THEN p.id WHEN p.vec_id % 8 = 4 THEN n.id END AS positive,
       CASE WHEN p.vec_id % 8 IN (3, 5) THEN n.id END AS negative,
       CASE WHEN p.label < 9 THEN p.label + 2 END AS lim, CASE WHEN p.label < 4 THEN p.label END AS off, CASE WHEN p.label % 2 = 0 THEN 0.2 END AS threshold,
       CASE WHEN p.vec_id % 3 = 1 THEN 'color_2' END AS color, CASE WHEN p.vec_id % 5 = 1 THEN 7 END AS code, CASE WHEN p.vec_id % 7 = 1 THEN true END AS even,
       CASE WHEN p.vec_id % 9 = 1 THEN concat('t', CAST(p.label AS STRING)) END AS tag,
       p.vec_id % 2 = 0 AS with_payload, p.vec_id % 4 = 3 AS with_vector
FROM points p JOIN points n ON n.vec_id = CASE WHEN p.vec_id % 2 = 0 THEN p.vec_id + 1 ELSE p.vec_id - 1 END
""",
)
view(
    "raw_points",
    """
SELECT CASE WHEN vec_id % 17 = 0 THEN CAST(vec_id AS STRING) ELSE id END AS id, vec_id,
       CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 11 = 0 THEN 'other' ELSE 'emb' END AS vector_name,
       CASE WHEN vec_id % 13 = 0 THEN 32 ELSE 64 END AS dim, vector FROM points
""",
)
view(
    "point_feed",
    """
SELECT event_id AS seq, ts, concat('00000000-0000-4000-8000-', lpad(CAST(user_id AS STRING), 12, '0')) AS id,
       CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
       CASE WHEN event_type = 'signup' THEN NULL ELSE props END AS payload FROM events
""",
)

# ---------------------------------------------------------------- catalogue

view(
    "orgs",
    """
SELECT n_nationkey AS org_key, n_name AS organization, n_regionkey <> 3 AS installed,
       CASE WHEN n_regionkey <> 3 THEN CAST(1000 + n_nationkey AS BIGINT) END AS installation_id,
       CASE WHEN n_regionkey <> 3 THEN concat('https://github.com/apps/', CAST(n_nationkey AS STRING)) END AS html_url,
       CASE WHEN n_nationkey % 2 = 0 THEN 'all' ELSE 'selected' END AS repository_selection FROM nation
""",
)
view(
    "projects",
    """
SELECT c_custkey AS project_key, concat(n_name, '/', replace(c_name, '#', '_')) AS project_id, n_name AS organization,
       replace(c_name, '#', '_') AS project, concat('/programs/', n_name, '/projects/', replace(c_name, '#', '_')) AS resource_path,
       c_mktsegment AS segment,
       CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN concat('https://GitHub.com/', n_name, '/r', CAST(c_custkey AS STRING), '.git')
            WHEN 2 THEN concat('git@github.com:', c_mktsegment, '/r', CAST(c_custkey AS STRING), '.git')
            WHEN 3 THEN concat('ssh://git@ssh.github.com:443/', n_name, '/r', CAST(c_custkey AS STRING))
            WHEN 4 THEN concat(' github.com/', n_name, '/r', CAST(c_custkey AS STRING), '/ ')
            WHEN 5 THEN concat('git@altssh.github.com:443/', n_name, '/r', CAST(c_custkey AS STRING))
            ELSE 'not a repo' END AS src_repo
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
)
_PROJECT_STATE = """
SELECT project_id, 'github.com' AS repo_host, organization AS repo_owner,
       concat(CASE WHEN project_key % 11 = 0 THEN 'old' ELSE 'r' END, CAST(project_key AS STRING)) AS repo_name,
       CASE WHEN project_key % 5 = 0 THEN CAST(project_key AS BIGINT) END AS installation_id,
       CASE WHEN project_key % 10 < 5 THEN organization END AS installation_target,
       CASE WHEN project_key % 10 < 5 THEN 'Organization' END AS installation_target_type,
       concat('/data/github.com/', organization, '/r', CAST(project_key AS STRING), '.git') AS mirror_path,
       CASE WHEN project_key % 4 = 1 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' END AS last_refreshed_at,
       CASE project_key % 4 WHEN 0 THEN 'never_synced' WHEN 1 THEN 'ready' WHEN 2 THEN '' ELSE 'error' END AS sync_state,
       CASE WHEN project_key % 4 = 1 THEN 'main' END AS default_branch,
       CASE WHEN project_key % 4 = 3 THEN 'fetch failed' END AS last_error
FROM projects WHERE segment <> 'BUILDING'
"""
view("project_state", _PROJECT_STATE, _PROJECT_STATE.replace("TIMESTAMP_NTZ", "TIMESTAMP"))
view(
    "bucket_resources",
    """
SELECT segment AS bucket,
       CASE project_key % 3 WHEN 0 THEN concat(' ', resource_path, ' ')
            WHEN 1 THEN concat('/organization/', organization, '/project/', project) ELSE concat(resource_path, '/x') END AS resource
FROM projects
""",
)
view(
    "grants",
    """
SELECT CAST(floor(o_orderkey / 300) AS BIGINT) AS user_id, CASE WHEN o_orderkey % 97 = 0 THEN concat('/programs/', n_name)
            WHEN o_orderkey % 89 = 0 THEN concat('/programs/', n_name, '/projects')
            WHEN o_orderkey % 1009 = 0 THEN '/programs'
            WHEN o_orderkey % 83 = 0 THEN concat('/organization/', n_name, '/project/', replace(c_name, '#', '_'))
            WHEN o_orderkey % 7 = 0 THEN concat('https://x.org/programs/', n_name, '/projects/', replace(c_name, '#', '_'), '/')
            ELSE concat('/programs/', n_name, '/projects/', replace(c_name, '#', '_')) END AS resource,
       CASE WHEN o_orderkey % 97 = 0 AND o_orderstatus = 'F' THEN 'manage-owners'
            WHEN o_orderkey % 97 = 0 AND o_orderstatus = 'O' THEN 'delete'
            WHEN o_orderkey % 89 = 0 AND o_orderstatus = 'F' THEN 'create-descendant'
            ELSE CASE o_orderstatus WHEN 'O' THEN 'read' WHEN 'F' THEN 'update' ELSE '*' END END AS method,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '*' ELSE 'arborist' END AS service
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""",
)
view(
    "access_asks",
    """
SELECT event_id AS request_id, CAST(floor(user_id / 3) AS BIGINT) AS user_id, project_id, organization, project, resource_path
FROM events JOIN projects ON project_key = user_id
""",
)
view(
    "route_requests",
    """
SELECT event_id AS request_id, CAST(floor(user_id / 3) AS BIGINT) AS user_id,
       CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' WHEN 'signup' THEN 'PUT' WHEN 'purchase' THEN 'DELETE' ELSE 'PATCH' END AS method,
       CASE event_id % 4 WHEN 0 THEN 'explorer' WHEN 1 THEN 'nav' WHEN 2 THEN '' ELSE 'project' END AS config_type,
       CASE WHEN event_id % 8 = 0 THEN 'bad' WHEN event_id % 15 = 0 THEN '' ELSE concat(organization, '-', project) END AS config_id,
       value >= 1 AS has_token
FROM events JOIN projects ON project_key = user_id
""",
)
view(
    "pending",
    """
SELECT o_orderkey AS id, o_custkey % 30 AS installation_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 20 END AS user_id,
       concat('s', CAST(o_custkey % 6 AS STRING)) AS setup_session_id, o_orderkey % 400 AS repo_id,
       concat('o/r', CAST(o_orderkey % 400 AS STRING)) AS repo_full_name, 'github.com' AS repo_host, 'o' AS repo_owner,
       concat('r', CAST(o_orderkey % 400 AS STRING)) AS repo_path, o_orderdate AS added_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS resolved_at,
       CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS removed_at
FROM orders
""",
)

# ---------------------------------------------------------------- repositories and graph

view(
    "tree",
    r"""
SELECT regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 1) AS repo,
       trim(regexp_replace(regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 2), '/$', '')) AS path,
       CAST(min(page_id) AS BIGINT) AS hash, CAST(max(length(html)) AS BIGINT) AS size
FROM pages GROUP BY 1, 2
""",
)
view(
    "commits",
    r"""
SELECT regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 1) AS repo, event_id, ts AS committed_at,
       trim(regexp_replace(regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 2), '/$', '')) AS path
FROM events JOIN pages ON page_id = user_id
""",
)
view(
    "refs",
    r"""
SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS repo, page_id AS hash,
       concat(CASE page_id % 5 WHEN 0 THEN 'refs/heads/' WHEN 1 THEN 'refs/remotes/origin/' WHEN 2 THEN 'refs/tags/' WHEN 3 THEN 'refs/notes/' ELSE 'refs/heads/rel/' END,
              CASE WHEN page_id % 9 = 0 THEN 'HEAD' ELSE concat(CASE WHEN page_id % 2 = 0 THEN 'B' ELSE 'b' END, CAST(page_id % 7 AS STRING)) END) AS full_name
FROM pages
UNION ALL SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)/', 1), CAST(-1 AS BIGINT), 'HEAD' FROM pages WHERE url LIKE 'https%'
""",
)
view(
    "vertices",
    """
SELECT concat('s:', repo) AS id, 'ResearchStudy' AS label, repo AS name, concat('/programs/web/projects/', repo) AS auth_resource_path FROM tree GROUP BY repo
UNION ALL SELECT concat('r:', repo), 'Directory', '/', concat('/programs/web/projects/', repo) FROM tree GROUP BY repo
UNION ALL SELECT concat('d:', repo, ':', split_part(path, '/', 1)), 'Directory', split_part(path, '/', 1),
       CASE WHEN max(size) < 2500 THEN '/programs/web/projects/other' ELSE concat('/programs/web/projects/', repo) END FROM tree GROUP BY repo, split_part(path, '/', 1)
UNION ALL SELECT concat('f:', repo, ':', path), 'Directory', split_part(path, '/', 2),
       CASE WHEN hash % 6 = 0 THEN '/programs/web/projects/other' ELSE concat('/programs/web/projects/', repo) END FROM tree WHERE split_part(path, '/', 2) <> ''
UNION ALL SELECT concat('v:', repo, ':', path), 'DocumentReference', CAST(hash AS STRING), concat('/programs/web/projects/', repo)
       FROM tree WHERE split_part(path, '/', 2) <> '' AND path NOT LIKE '%.html'
""",
)
view(
    "edges",
    """
SELECT concat('s:', repo) AS src, concat('r:', repo) AS dst, 'rootDir_Directory' AS label FROM tree WHERE repo NOT LIKE 'spam%' GROUP BY repo
UNION ALL SELECT concat('r:', repo), concat('d:', repo, ':', split_part(path, '/', 1)), 'child' FROM tree GROUP BY repo, split_part(path, '/', 1)
UNION ALL SELECT concat('d:', repo, ':', split_part(path, '/', 1)), concat('f:', repo, ':', path), 'child' FROM tree WHERE split_part(path, '/', 2) <> ''
UNION ALL SELECT concat('f:', repo, ':', path), concat('v:', repo, ':', path), 'version' FROM tree WHERE split_part(path, '/', 2) <> '' AND path NOT LIKE '%.html'
""",
)
view(
    "web_grants",
    """
SELECT CAST(length(name) AS BIGINT) AS user_id, auth_resource_path AS resource FROM vertices
""",
)
view(
    "path_requests",
    """
SELECT hash AS request_id, concat('/programs/web/projects/', repo) AS project,
       CASE hash % 11 WHEN 0 THEN '/' WHEN 1 THEN concat('/', split_part(path, '/', 1)) WHEN 2 THEN concat('/', path)
            WHEN 3 THEN '/missing' WHEN 4 THEN 'relative/path' WHEN 5 THEN concat('/a', chr(92), 'b') WHEN 6 THEN ''
            WHEN 7 THEN concat('/', path, '/', CAST(hash AS STRING)) WHEN 8 THEN '/a/./../..x' WHEN 9 THEN concat('/../', path)
            ELSE concat('/', split_part(path, '/', 1), '/') END AS path
FROM tree
""",
)
view(
    "pointers",
    """
SELECT p_partkey AS file_id, concat(CASE WHEN p_partkey % 9 = 0 THEN 'version 2' ELSE 'version https://git-lfs.github.com/spec/v1' END, chr(10),
       'oid sha256:', lpad(CAST(p_partkey AS STRING), CASE WHEN p_partkey % 7 = 0 THEN 63 ELSE 64 END, 'A'), CASE WHEN p_size < 10 THEN concat(' ', chr(13)) ELSE '' END, chr(10),
       CASE WHEN p_partkey % 5 = 0 THEN 'size many' ELSE concat('size ', CAST(p_size AS STRING)) END, chr(10)) AS content
FROM part
""",
)

# ---------------------------------------------------------------- configuration documents

view(
    "docs",
    """
SELECT CASE c_custkey % 4 WHEN 0 THEN 'explorer' WHEN 1 THEN 'nav' WHEN 2 THEN 'file_summary' ELSE 'projects' END AS config_type,
       CASE WHEN c_custkey % 4 = 3 AND c_custkey % 29 <> 0 THEN concat(n_name, '/', replace(c_name, '#', '_')) ELSE replace(c_name, '#', '_') END AS name,
       c_custkey AS doc_key, c_mktsegment AS segment,
       CASE WHEN c_custkey % 17 = 0 THEN '{broken' WHEN c_custkey % 37 = 0 THEN '' WHEN c_custkey % 41 = 0 THEN NULL ELSE
       CASE c_custkey % 4
       WHEN 0 THEN concat('{"sharedFilters":{"defined":{"seg":[{"index":"part","field":"p_brand"},{"index":"file","field":"', lower(c_mktsegment), '"}]}},"explorerConfig":[',
         '{"tabTitle":', CASE WHEN c_custkey % 13 = 0 THEN '5' ELSE concat('"Tab ', c_mktsegment, '"') END,
         ',"guppyConfig":{"dataType":"file","nodeCountTitle":"Files","manifestMapping":{"resourceIdField":"id"}},"filters":{"tabs":[{"title":"Main","fields":["segment","', n_name, '"],',
         '"fieldsConfig":{"segment":{"label":"Segment","type":"enum"', CASE WHEN c_custkey % 11 = 0 THEN ',"surprise":1' ELSE '' END, '}}},{"fields":["nation"]}]},',
         '"table":{"enabled":true,"fields":["name","balance"],"columns":{"name":{"field":"name","title":"Name of ', replace(c_name, '#', '_'), '","type":"string"},',
         '"balance":{"field":"balance","title":"Balance","type":"","sortable":', CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END, '}},"detailsConfig":{}},',
         '"preFilters":{"segment":["', c_mktsegment, '"]}}',
         CASE WHEN c_custkey % 5 = 0 THEN ',{"tabTitle":"Second","filters":{"tabs":[]},"table":{"enabled":false,"fields":null}}' ELSE '' END,
         '],"fileActions":{"extensions":{"tiff":["view","', lower(c_mktsegment), '"],"default":["download"]},"actions":{"view":"open"}}}')
       WHEN 1 THEN concat('{"headerProps":{"topBar":{"items":[]},"navigation":{"items":[],"title":"', n_name, '","classNames":null},"leftnav":[',
         CASE WHEN c_custkey % 3 = 0 THEN '{"title":"Home","description":"","icon":"i","href":"/","perms":null}' ELSE '' END, ']},"footerProps":{',
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('"rightSection":{"columns":[{"heading":"h","rows":[{"Text":{"text":"', c_mktsegment, '"}},',
           CASE WHEN c_custkey % 7 = 0 THEN '{"Icon":{"logo":"l"},"Text":{}}' WHEN c_custkey % 11 = 0 THEN '{"Odd":1}' ELSE '{"Link":{"text":"t","href":"/x"}}' END,
           ',{"Section":{"columns":[{"rows":[{"Text":{"text":"inner"}},{"Links":{"links":[]}}]}]}}]}]},') END,
         '"basePage":', CASE WHEN c_custkey % 13 = 0 THEN '"yes"' ELSE 'true' END, '},"headerMetadata":{"title":"t","content":"c","key":"k"}}')
       WHEN 2 THEN concat('{"config":{', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('"', lower(c_mktsegment), '":{"field":"size","title":"Size"}') END,
         '},"barChartColor":"blue","defaultProject":"', n_name, '","binslicePoints":[0,1048576,524288000,1073741824,107374182400,',
         CASE WHEN c_custkey % 13 = 0 THEN '"many"' ELSE '9007199254740991' END, '],"idField":"id","index":"file"', CASE WHEN c_custkey % 11 = 0 THEN ',"extra":[]' ELSE '' END, '}')
       ELSE concat('{"title":', CASE WHEN c_custkey % 13 = 0 THEN '7' WHEN c_custkey % 19 = 0 THEN '"  "' ELSE concat('" T', CAST(c_custkey AS STRING), ' "') END,
         ',"contact_email":"', CASE c_custkey % 5 WHEN 0 THEN 'nobody' WHEN 1 THEN 'Ann B <ann@b.org>' ELSE 'a.b@c.org' END, '","src_repo":"',
         CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('https://github.com/', n_name, '/r', CAST(c_custkey AS STRING), '.git') ELSE 'bad' END,
         '","org_title":"', c_mktsegment, '",', CASE WHEN c_custkey % 23 = 0 THEN '' ELSE '"description":" d ",' END, '"project_title":" ', c_mktsegment, ' "',
         CASE WHEN c_custkey % 11 = 0 THEN ',"surprise":1' ELSE '' END, '}')
       END END AS content
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
)
# Names asked for: every document, and as many that do not exist or have an odd type.
view(
    "doc_asks",
    """
SELECT config_type, name FROM docs
UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderstatus = 'P' THEN 'weird' ELSE 'nav' END,
                 CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE concat('Customer_', lpad(CAST(o_custkey AS STRING), 9, '0')) END FROM orders
""",
)

# ---------------------------------------------------------------- reconciliation inputs

view(
    "org_state",
    "SELECT organization, installed, installation_id, organization AS installation_target, 'Organization' AS installation_target_type, html_url, repository_selection FROM orgs",
)
view(
    "installs",
    """
SELECT DISTINCT organization, segment AS owner,
       CASE WHEN segment = 'BUILDING' THEN 404 WHEN segment = 'AUTOMOBILE' AND organization LIKE '%7' THEN 500 ELSE 200 END AS status_code,
       organization LIKE '%1%' AND segment = 'HOUSEHOLD' AS installed, CAST(7 AS BIGINT) AS installation_id, segment AS installation_target,
       'Organization' AS installation_target_type, 'https://github.com/apps/x' AS html_url, 'selected' AS repository_selection FROM projects
UNION ALL SELECT organization, organization, 200, installed, installation_id, installation_target, installation_target_type, html_url, repository_selection FROM org_state
""",
)
view(
    "probes",
    """
SELECT project_id, CASE project_key % 6 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 502 ELSE 200 END AS token_status, project_key % 4 <> 1 AS metadata_ok FROM projects
""",
)
view(
    "upload_sessions",
    """
SELECT o_orderkey AS id, concat(n_name, '/', replace(c_name, '#', '_')) AS project_id, 'main' AS base_branch,
       CASE o_orderstatus WHEN 'F' THEN 'finalized' WHEN 'O' THEN 'ready_for_pr' ELSE 'pending_upload' END AS status,
       o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""",
)
view(
    "installation_repos",
    """
SELECT o.installation_id, concat(p.organization, '/R', CAST(p.project_key AS STRING)) AS full_name,
       CASE WHEN p.segment = 'BUILDING' THEN ' ' WHEN p.segment = 'MACHINERY' THEN 'nonsense' ELSE concat('https://github.com/', p.organization, '/r', CAST(p.project_key AS STRING), '.git') END AS clone_url,
       CASE WHEN p.project_key % 2 = 0 THEN '' ELSE concat('https://github.com/', p.organization, '/page', CAST(p.project_key AS STRING)) END AS html_url
FROM projects p JOIN orgs o ON o.organization = p.organization AND o.installed
""",
)
view(
    "bind_requests",
    """
SELECT CASE WHEN project_key % 31 = 0 THEN concat(project_id, '-gone') ELSE project_id END AS project_id, project_key,
       CASE project_key % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'none/here' ELSE concat(' ', lower(organization), '/r', CAST(project_key AS STRING)) END AS repository_full_name
FROM projects
""",
)

# ---------------------------------------------------------------- uploads

view(
    "upload_files",
    """
SELECT l_orderkey AS session_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ordinal,
       concat('r', CAST(l_orderkey % 3 AS STRING)) AS repo,
       CASE WHEN l_partkey % 43 = 0 THEN '  ' ELSE concat(' part-', CAST(l_partkey % 20 AS STRING), CASE WHEN l_partkey % 41 = 0 THEN '/x' ELSE '.tsv' END) END AS raw_name,
       CASE WHEN l_orderkey % 2 = 0 THEN ' /data/ ' ELSE '' END AS subdirectory, CAST(l_quantity AS BIGINT) AS size,
       CASE WHEN l_returnflag <> 'R' THEN upper(concat(' abc', CAST(l_partkey AS STRING))) END AS checksum,
       CASE WHEN l_linestatus = 'O' THEN concat('drs-', CAST(l_partkey AS STRING)) ELSE ' ' END AS drs_object_id
FROM lineitem
""",
)
view(
    "base_tree",
    """
SELECT DISTINCT concat('r', CAST(p_size % 5 AS STRING)) AS repo,
       concat(CASE WHEN p_brand <> 'Brand#2' THEN 'other/' WHEN p_type = 'ECONOMY' THEN 'data/' ELSE '' END, 'part-', CAST(p_partkey % 20 AS STRING), '.tsv', CASE WHEN p_size > 40 THEN '/inner' ELSE '' END) AS path
FROM part
""",
)
