"""Repository listing queries."""

from pyspark.sql import functions as F

from ..operators import trees as tr
from .registry import query, view

_ANCESTORS = "unnest(list_transform(range(1, len(string_split(path, '/')) + {last}), lambda n: array_to_string(string_split(path, '/')[1:n], '/')))"


@query(
    "t_list",
    f"""
WITH dirs AS (SELECT DISTINCT repo, {_ANCESTORS.format(last=0)} AS path FROM tree),
entries AS (SELECT repo, path, 'blob' AS type, hash, size FROM tree UNION ALL SELECT repo, path, 'tree', NULL, NULL FROM dirs)
SELECT repo, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, string_split(path, '/')[-1] AS name, path, type, hash, size FROM entries
""",
)
def t_list(t):
    return tr.ordered_listing(tr.list_tree(t["tree"]))


@query(
    "t_modified",
    f"""
WITH touched AS (SELECT repo, committed_at, {_ANCESTORS.format(last=1)} AS path FROM commits)
SELECT repo, path, max(committed_at) AS last_modified_at FROM touched GROUP BY repo, path
""",
)
def t_modified(t):
    return tr.last_modified(t["commits"])


@query(
    "t_list_modified",
    f"""
WITH touched AS (SELECT repo, committed_at, {_ANCESTORS.format(last=1)} AS path FROM commits), times AS (SELECT repo, path, max(committed_at) AS at FROM touched GROUP BY repo, path),
dirs AS (SELECT DISTINCT repo, {_ANCESTORS.format(last=0)} AS path FROM tree), entries AS (SELECT repo, path FROM tree UNION ALL SELECT repo, path FROM dirs)
SELECT e.repo, e.path, t.at AS last_modified_at FROM entries e LEFT JOIN times t ON t.repo = e.repo AND t.path = e.path
""",
)
def t_list_modified(t):
    return tr.with_last_modified(tr.list_tree(t["tree"]), t["commits"]).select("repo", "path", "last_modified_at")


# Every event changes its page's file, deletes it or writes a pointer; a ref stands at the last change of its own page.
view(
    "file_versions",
    """
SELECT repo, path, committed_at, event_id AS commit_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id END AS hash, event_id % 1000 AS size,
  CASE WHEN event_id % 3 = 0 THEN concat('version https://git-lfs.github.com/spec/v1', chr(10), 'oid sha256:', lpad(CAST(event_id AS STRING), 64, 'A'), chr(10), 'size ', CAST(event_id AS STRING), chr(10))
       ELSE 'plain text' END AS content
FROM commits WHERE path <> ''
""",
)
view("ref_times", "SELECT user_id AS hash, max(ts) AS as_of FROM events GROUP BY user_id")
view(
    "listing_requests",
    """
SELECT r.hash AS request_id, r.repo, t.as_of, CASE r.hash % 5 WHEN 0 THEN '' WHEN 1 THEN ' /en/ ' WHEN 2 THEN 'missing' WHEN 3 THEN 'fr' ELSE '/en' END AS dir
FROM refs r LEFT JOIN ref_times t ON t.hash = r.hash
""",
)


@query(
    "t_listing",
    """
WITH q AS (SELECT request_id, repo, as_of, trim(trim(dir), '/') AS dir FROM listing_requests), p AS (SELECT DISTINCT repo, dir, as_of FROM q WHERE as_of IS NOT NULL),
v AS (SELECT p.repo, p.dir, p.as_of, v.path, v.hash, v.size, v.committed_at, CASE WHEN p.dir = '' THEN v.path ELSE substr(v.path, length(p.dir) + 2) END AS rest,
  row_number() OVER (PARTITION BY p.repo, p.dir, p.as_of, v.path ORDER BY v.committed_at DESC, v.commit_id DESC) AS rn
  FROM p JOIN file_versions v ON v.repo = p.repo AND v.committed_at <= p.as_of AND (p.dir = '' OR starts_with(v.path, p.dir || '/'))),
f AS (SELECT *, split_part(rest, '/', 1) AS name FROM v WHERE rn = 1),
times AS (SELECT repo, dir, as_of, name, max(committed_at) AS last_modified_at FROM f GROUP BY ALL),
e AS (SELECT repo, dir, as_of, name, 'blob' AS type, hash, size FROM f WHERE hash IS NOT NULL AND rest = name
  UNION ALL SELECT DISTINCT repo, dir, as_of, name, 'tree', NULL, NULL FROM f WHERE hash IS NOT NULL AND rest <> name)
SELECT q.request_id, q.repo, q.dir, e.name, CASE WHEN q.dir = '' THEN e.name ELSE q.dir || '/' || e.name END AS path, e.type, e.hash, e.size,
  CASE WHEN e.hash % 3 = 0 THEN lower(lpad(CAST(e.hash AS VARCHAR), 64, 'a')) END AS pointer_oid, CASE WHEN e.hash % 3 = 0 THEN e.hash END AS pointer_size, t.last_modified_at,
  CASE WHEN e.name IS NULL AND (q.as_of IS NULL OR q.dir <> '') THEN 'not_found' END AS error_type
FROM q LEFT JOIN e ON e.repo = q.repo AND e.dir = q.dir AND e.as_of = q.as_of LEFT JOIN times t ON t.repo = e.repo AND t.dir = e.dir AND t.as_of = e.as_of AND t.name = e.name
""",
)
def t_listing(t):
    found = tr.listing_at(t["listing_requests"], t["file_versions"], ordered=True)
    return found.select(
        "request_id", "repo", "dir", "name", "path", "type", "hash", "size", F.col("pointer.oid").alias("pointer_oid"), F.col("pointer.size").alias("pointer_size"),
        "last_modified_at", "error_type",
    )


@query(
    "t_pointer",
    """
WITH lines AS (SELECT file_id, string_split(trim(content, ' ' || chr(10) || chr(13)), chr(10)) AS l FROM pointers),
parts AS (SELECT file_id, trim(l[1]) AS v, lower(regexp_extract(trim(l[2], ' ' || chr(13)), '^oid sha256:([a-fA-F0-9]{64})$', 1)) AS oid, try_cast(regexp_extract(trim(l[3]), '^size ([0-9]+)$', 1) AS BIGINT) AS size FROM lines),
checked AS (SELECT *, v = 'version https://git-lfs.github.com/spec/v1' AND oid <> '' AND size IS NOT NULL AS good FROM parts)
SELECT file_id, good AS is_pointer, CASE WHEN good THEN oid END AS oid, CASE WHEN good THEN size END AS size FROM checked
""",
)
def t_pointer(t):
    parsed = t["pointers"].withColumn("p", tr.parse_pointer(F.col("content")))
    return parsed.select("file_id", F.col("p").isNotNull().alias("is_pointer"), "p.oid", "p.size")


view("defaults", "SELECT DISTINCT repo, CASE WHEN repo LIKE '%.com' THEN 'b1' ELSE 'rel/B2' END AS default_branch FROM refs")


@query(
    "t_refs",
    """
WITH kinds AS (SELECT *, CASE WHEN full_name LIKE 'refs/heads/%' OR full_name LIKE 'refs/remotes/origin/%' AND full_name <> 'refs/remotes/origin/HEAD' THEN 'branch' WHEN full_name LIKE 'refs/tags/%' THEN 'tag' END AS type,
  regexp_replace(full_name, '^refs/(heads|remotes/origin|tags)/', '') AS name FROM refs),
firsts AS (SELECT *, row_number() OVER (PARTITION BY repo, type, name ORDER BY full_name, hash) AS rn FROM kinds WHERE type IS NOT NULL)
SELECT f.repo, f.name, f.type, f.hash, f.type = 'branch' AND f.name = d.default_branch AS "default" FROM firsts f JOIN defaults d ON d.repo = f.repo WHERE rn = 1
""",
)
def t_refs(t):
    return tr.ordered_refs(tr.list_refs(t["refs"], t["defaults"]))


view(
    "ref_requests",
    """
SELECT page_id AS request_id, r.repo, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'b1' WHEN 2 THEN 'refs/heads/rel/B2' ELSE concat('B', CAST(page_id % 10 AS STRING)) END AS requested, d.default_branch
FROM pages JOIN refs r ON r.hash = page_id JOIN defaults d ON d.repo = r.repo
""",
)


@query(
    "t_resolve",
    """
WITH w AS (SELECT *, CASE WHEN requested <> '' THEN requested ELSE default_branch END AS wanted FROM ref_requests),
c AS (SELECT request_id, repo, n, rank FROM w, (VALUES (0, ''), (1, 'refs/'), (2, 'refs/tags/'), (3, 'refs/heads/'), (4, 'refs/remotes/'), (6, 'refs/remotes/origin/')) v(rank, pre), LATERAL (SELECT pre || wanted AS n)
  UNION ALL SELECT request_id, repo, 'refs/remotes/' || wanted || '/HEAD', 5 FROM w
  UNION ALL SELECT request_id, repo, pre || 'HEAD', rank FROM w, (VALUES (10, ''), (11, 'refs/'), (12, 'refs/tags/'), (13, 'refs/heads/'), (14, 'refs/remotes/'), (15, 'refs/remotes/HEAD/')) v(rank, pre)),
hits AS (SELECT c.request_id, c.rank, min(r.hash) AS hash FROM c JOIN refs r ON r.repo = c.repo AND r.full_name = c.n GROUP BY c.request_id, c.rank),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS rn FROM hits) WHERE rn = 1)
SELECT w.request_id, CASE WHEN b.rank >= 10 THEN 'HEAD' WHEN b.rank IS NOT NULL THEN regexp_replace(wanted, '^refs/(heads|remotes/origin|tags)/', '') END AS resolved, b.hash, coalesce(b.rank >= 10, FALSE) AS fell_back
FROM w LEFT JOIN best b ON b.request_id = w.request_id
""",
)
def t_resolve(t):
    return tr.resolve_refs(t["ref_requests"], t["refs"])


@query(
    "t_empty",
    "SELECT DISTINCT repo FROM refs WHERE repo NOT IN (SELECT repo FROM refs WHERE full_name LIKE 'refs/heads/%' OR full_name LIKE 'refs/remotes/%' OR full_name LIKE 'refs/tags/%')",
)
def t_empty(t):
    return tr.empty_repositories(t["refs"].select("repo"), t["refs"])


view(
    "exist_requests",
    """
SELECT hash AS request_id, repo, CASE hash % 5 WHEN 0 THEN concat(' /', path, '/ ') WHEN 1 THEN split_part(path, '/', 1) WHEN 2 THEN concat(path, 'x') WHEN 3 THEN '' ELSE path END AS path FROM tree
""",
)


@query(
    "t_exists",
    f"""
WITH known AS (SELECT DISTINCT repo, {_ANCESTORS.format(last=1)} AS path FROM tree)
SELECT r.request_id, r.repo, r.path, k.path IS NOT NULL AS exists FROM exist_requests r LEFT JOIN known k ON k.repo = r.repo AND k.path <> '' AND k.path = trim(trim(r.path), '/')
""",
)
def t_exists(t):
    return tr.paths_exist(t["exist_requests"], t["tree"])


view(
    "remote_metadata",
    """
SELECT repo, path, CASE WHEN hash % 3 = 0 THEN '' ELSE concat('remote-', CAST(hash AS STRING)) END AS meta_name, CAST(hash AS STRING) AS meta_hash,
       CASE WHEN hash % 4 = 0 THEN CAST(0 AS BIGINT) ELSE size * 2 END AS meta_size, concat('https://', repo, '/', path) AS html_url, '' AS download_url
FROM tree WHERE size > 1500
""",
)


@query(
    "t_file",
    """
SELECT t.repo, t.path, CASE WHEN m.meta_name <> '' THEN m.meta_name ELSE string_split(t.path, '/')[-1] END AS name, coalesce(m.meta_hash, '') AS hash,
  CASE WHEN m.meta_size > 0 THEN m.meta_size ELSE t.size END AS size, coalesce(m.html_url, '') AS html_url, coalesce(m.download_url, '') AS download_url
FROM tree t LEFT JOIN remote_metadata m ON m.repo = t.repo AND m.path = t.path
""",
)
def t_file(t):
    return tr.file_records(t["tree"], t["remote_metadata"])
