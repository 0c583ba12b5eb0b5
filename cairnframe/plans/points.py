"""Vector point queries."""

from pyspark.sql import functions as F

from ..functions.vectors import score
from ..operators import knn as nn
from ..operators import mutations
from ..operators import points as pt
from ..operators.requests import query_points
from .registry import query

SPEC = {"emb": (64, "Cosine")}
UUID = "'^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$'"
COSINE = "list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(p.vector AS DOUBLE[]))"


def _rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c == "score" else F.col(c) for c in cols])


def _neighbours(extra: str = "", score_sql: str = COSINE, order: str = "DESC") -> str:
    """All pairs of distinct vectors with their score, ranked per query."""
    return f"""
SELECT q.query_id, p.id, {score_sql} AS s,
       row_number() OVER (PARTITION BY q.query_id ORDER BY {score_sql} {order}, p.id) AS rank
FROM knn_queries q JOIN points p ON p.id <> q.id {extra}"""


def _self(t):
    return t["knn_queries"].select("query_id", "id")


@query(
    "v_validate",
    f"""
SELECT id, vec_id, vector_name,
       CASE WHEN vector_name = '' OR NOT regexp_matches(id, {UUID}) THEN 'invalid_point_data'
            WHEN vector_name <> 'emb' OR dim <> 64 THEN 'vector_operation_failed' END AS error_type,
       CASE WHEN vector_name = '' THEN concat('vector_name is required for point ID ', id)
            WHEN NOT regexp_matches(id, {UUID}) THEN 'id is not a UUID'
            WHEN vector_name <> 'emb' THEN concat('unknown vector name ', vector_name)
            WHEN dim <> 64 THEN 'expected dimension 64' END AS error
FROM raw_points
""",
)
def v_validate(t):
    return pt.validate_points(t["raw_points"], SPEC).select("id", "vec_id", "vector_name", "error_type", "error")


_LATEST = """
SELECT id, payload FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM point_feed WHERE op = 'upsert') WHERE rn = 1
"""


@query(
    "v_upsert",
    f"""
WITH latest AS ({_LATEST})
SELECT id, payload FROM points WHERE id NOT IN (SELECT id FROM latest)
UNION ALL SELECT id, payload FROM latest
""",
)
def v_upsert(t):
    batch = t["point_feed"].filter("op = 'upsert'").select("seq", "id", "payload")
    return pt.upsert_points(t["points"].select("id", "payload"), batch, "seq")


@query("v_delete", "SELECT id, vec_id FROM points WHERE id NOT IN (SELECT id FROM point_feed WHERE op = 'delete')")
def v_delete(t):
    return pt.delete_points(t["points"].select("id", "vec_id"), t["point_feed"].filter("op = 'delete'"))


@query(
    "v_get",
    f"""
WITH asked AS (SELECT id FROM point_feed UNION SELECT id FROM raw_points)
SELECT a.id, p.id IS NOT NULL AS found, p.payload, round(CAST(p.vector[1] AS DOUBLE), 6) AS first_value,
       CASE WHEN NOT regexp_matches(a.id, {UUID}) THEN 'invalid_uuid' WHEN p.id IS NULL THEN 'point_not_found' END AS error_type
FROM asked a LEFT JOIN points p ON p.id = a.id
""",
)
def v_get(t):
    ids = t["point_feed"].select("id").union(t["raw_points"].select("id"))
    got = pt.get_points(t["points"], ids)
    first = F.round(F.try_element_at(F.col("vectors"), F.lit("emb"))[0].cast("double"), 6)
    return got.select("id", "found", "payload", first.alias("first_value"), "error_type")


@query(
    "v_knn_single",
    f"""
SELECT p.id, p.label, round({COSINE}, 6) AS score FROM points p, (SELECT vector FROM points ORDER BY vec_id LIMIT 1) q
ORDER BY {COSINE} DESC, p.id LIMIT 10
""",
)
def v_knn_single(t):
    origin = t["points"].orderBy("vec_id").select("vector").first()[0]
    return _rounded(nn.knn(t["points"], origin, 10, vector_name="emb"), "id", "label", "score")


@query(
    "v_knn_join",
    f"SELECT query_id, id, round(s, 6) AS score, rank FROM ({_neighbours()}) WHERE rank <= 10",
)
def v_knn_join(t):
    ranked = nn.knn_join(t["points"], t["knn_queries"], 10, exclude=_self(t))
    return _rounded(ranked, "query_id", "id", "score", "rank")


@query(
    "v_knn_filtered",
    f"""
SELECT query_id, id, round(s, 6) AS score, rank
FROM ({_neighbours("AND (p.payload->>'color') = 'color_1' AND (p.payload->>'even') = 'true'")}) WHERE rank <= 5
""",
)
def v_knn_filtered(t):
    kept = pt.payload_filter(t["points"], {"color": "color_1", "even": True})
    return _rounded(nn.knn_join(kept, t["knn_queries"], 5, exclude=_self(t)), "query_id", "id", "score", "rank")


@query(
    "v_threshold",
    f"SELECT query_id, id, round(s, 6) AS score, rank FROM ({_neighbours()}) WHERE rank <= 10 AND s >= 0.3",
)
def v_threshold(t):
    ranked = nn.knn_join(t["points"], t["knn_queries"], 10, threshold=0.3, exclude=_self(t))
    return _rounded(ranked, "query_id", "id", "score", "rank")


@query(
    "v_page",
    f"SELECT query_id, id, round(s, 6) AS score, rank FROM ({_neighbours()}) WHERE rank > 5 AND rank <= 12",
)
def v_page(t):
    ranked = nn.knn_join(t["points"], t["knn_queries"], 7, offset=5, exclude=_self(t))
    return _rounded(ranked, "query_id", "id", "score", "rank")


@query(
    "v_search",
    f"""
WITH r AS (SELECT vec_id, CASE WHEN label > 7 THEN NULL ELSE label END AS lim, CASE WHEN label < 2 THEN NULL ELSE label % 4 END AS off,
                  CASE WHEN label < 5 THEN 0.3 END AS threshold FROM points)
SELECT query_id, n.id, round(s, 6) AS score, rank FROM ({_neighbours()}) n JOIN r ON r.vec_id = n.query_id
WHERE rank > coalesce(off, 0) AND rank <= coalesce(off, 0) + coalesce(lim, 0) AND (threshold IS NULL OR s >= threshold)
""",
)
def v_search(t):
    """Every request brings its own limit, offset and threshold."""
    label = F.col("label")
    requests = t["points"].select(
        F.col("vec_id").alias("query_id"),
        "vector",
        F.when(label <= 7, label).alias("limit"),
        F.when(label >= 2, label % 4).alias("offset"),
        F.when(label < 5, 0.3).alias("score_threshold"),
    )
    return _rounded(nn.search(t["points"], requests, exclude=_self(t)), "query_id", "id", "score", "rank")


@query(
    "v_knn_euclid",
    "SELECT query_id, id, round(s, 6) AS score, rank FROM ("
    + _neighbours(score_sql="list_distance(CAST(q.vector AS DOUBLE[]), CAST(p.vector AS DOUBLE[]))", order="ASC")
    + ") WHERE rank <= 10",
)
def v_knn_euclid(t):
    ranked = nn.knn_join(t["points"], t["knn_queries"], 10, metric="Euclid", exclude=_self(t))
    return _rounded(ranked, "query_id", "id", "score", "rank")


@query(
    "v_scores",
    """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 6) AS cosine,
       round(list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 6) AS dot,
       round(list_distance(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 6) AS euclid,
       round(list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: abs(CAST(a.vector[i] AS DOUBLE) - CAST(b.vector[i] AS DOUBLE)))), 6) AS manhattan
FROM points a JOIN points b ON b.vec_id = a.vec_id + 1
""",
)
def v_scores(t):
    a = t["points"].select("vec_id", "vector")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    scores = [
        F.round(score(F.col("vector"), F.col("other"), metric), 6).alias(metric.lower())
        for metric in ("Cosine", "Dot", "Euclid", "Manhattan")
    ]
    return a.join(b, "vec_id").select("vec_id", *scores)


_UNIT = "list_transform(CAST(vector AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))))"


def _recommended(inputs: str, k: int) -> str:
    return f"""
WITH unit AS (SELECT id, {_UNIT} AS u FROM points),
inputs AS ({inputs}),
cut AS (SELECT request_id, sign, i, u[i] AS x FROM inputs JOIN unit USING (id), range(1, 65) r(i)),
means AS (SELECT request_id, i, avg(x) FILTER (sign = 'pos') AS pos, avg(x) FILTER (sign = 'neg') AS neg FROM cut GROUP BY ALL),
targets AS (SELECT request_id, list(pos + coalesce(pos - neg, 0) ORDER BY i) AS vector FROM means GROUP BY request_id),
scored AS (SELECT q.request_id AS query_id, p.id, {COSINE} AS s FROM targets q, points p
           WHERE NOT EXISTS (SELECT 1 FROM inputs x WHERE x.request_id = q.request_id AND x.id = p.id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored)
SELECT query_id, id, round(s, 6) AS score, rank FROM ranked WHERE rank <= {k}
"""


@query(
    "v_query_points",
    f"""
WITH checked AS (SELECT *, CASE
    WHEN vector IS NOT NULL AND (lookup_id IS NOT NULL OR positive IS NOT NULL OR negative IS NOT NULL) THEN 'cannot use both ''query'' vector and recommend inputs (positives/negatives/lookup_id) simultaneously'
    WHEN negative IS NOT NULL AND lookup_id IS NULL AND positive IS NULL THEN 'must provide at least one positive for recommend query'
    WHEN vector IS NULL AND lookup_id IS NULL AND positive IS NULL AND negative IS NULL THEN 'must specify either ''query'' vector or recommend inputs (positives/negatives/lookup_id)' END AS error FROM whole_requests),
inputs AS (SELECT query_id AS request_id, 'pos' AS sign, lookup_id AS id FROM checked WHERE error IS NULL AND lookup_id IS NOT NULL
           UNION ALL SELECT query_id, 'pos', positive FROM checked WHERE error IS NULL AND positive IS NOT NULL
           UNION ALL SELECT query_id, 'neg', negative FROM checked WHERE error IS NULL AND negative IS NOT NULL),
lost AS (SELECT DISTINCT request_id FROM inputs WHERE id NOT IN (SELECT id FROM points)),
unit AS (SELECT id, {_UNIT} AS u FROM points),
cut AS (SELECT request_id, sign, i, u[i] AS x FROM inputs JOIN unit USING (id), range(1, 65) r(i)),
means AS (SELECT request_id, i, avg(x) FILTER (sign = 'pos') AS pos, avg(x) FILTER (sign = 'neg') AS neg FROM cut GROUP BY ALL),
targets AS (SELECT request_id, list(pos + coalesce(pos - neg, 0) ORDER BY i) AS vector FROM means GROUP BY request_id),
q AS (SELECT query_id, CAST(vector AS DOUBLE[]) AS vector FROM checked WHERE error IS NULL AND vector IS NOT NULL
      UNION ALL SELECT request_id, vector FROM targets WHERE request_id NOT IN (SELECT request_id FROM lost)),
fields AS (SELECT id, vector, payload, payload->>'color' AS color, CASE WHEN json_type(payload, '$.code') = 'UBIGINT' THEN CAST(payload->>'code' AS BIGINT) END AS code,
                  (payload->>'even') = 'true' AS even, CAST(payload->'tags' AS VARCHAR[]) AS tags FROM points),
scored AS (SELECT q.query_id, p.id, p.payload, p.vector, {COSINE} AS s FROM q JOIN checked r USING (query_id)
           JOIN fields p ON coalesce(p.color = r.color, r.color IS NULL) AND (r.code IS NULL OR coalesce(p.code = r.code, false))
                         AND (r.even IS NULL OR p.even = r.even) AND (r.tag IS NULL OR list_contains(p.tags, r.tag))
           WHERE NOT EXISTS (SELECT 1 FROM inputs x WHERE x.request_id = q.query_id AND x.id = p.id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored)
SELECT query_id, id, round(s, 6) AS score, rank, CASE WHEN with_payload THEN n.payload END AS payload, CASE WHEN with_vector THEN len(n.vector) END AS n_dims, NULL AS error
FROM ranked n JOIN checked r USING (query_id)
WHERE rank > coalesce(off, 0) AND rank <= coalesce(off, 0) + coalesce(lim, 0) AND (threshold IS NULL OR s >= threshold)
UNION ALL SELECT query_id, NULL, NULL, NULL, NULL, NULL, error FROM checked WHERE error IS NOT NULL
UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, 'point not found' FROM lost
""",
)
def v_query_points(t):
    """Every request brings its own form, ids, filter, page, threshold and flags."""

    def one(column):
        return F.when(F.col(column).isNotNull(), F.array(column))

    texts = {"color": F.concat(F.lit('"'), F.col("color"), F.lit('"')), "tags": F.concat(F.lit('"'), F.col("tag"), F.lit('"')), "code": F.col("code").cast("string"), "even": F.col("even").cast("string")}
    must = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in texts.items()]), lambda c: c["value"].isNotNull())
    requests = t["whole_requests"].select(
        "query_id", "vector_name", "vector", "lookup_id", one("positive").alias("positives"), one("negative").alias("negatives"),
        F.col("lim").alias("limit"), F.col("off").alias("offset"), F.col("threshold").alias("score_threshold"), must.alias("must"), "with_payload", "with_vector",
    )
    found = query_points(t["points"], requests)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank", "payload", F.size("vector").cast("bigint").alias("n_dims"), "error")


@query("v_recommend", _recommended("SELECT request_id, sign, id FROM request_inputs", 7))
def v_recommend(t):
    return _rounded(nn.recommend(t["points"], t["request_inputs"], 7), "query_id", "id", "score", "rank")


@query("v_lookup", _recommended("SELECT vec_id AS request_id, 'pos' AS sign, id FROM points", 3))
def v_lookup(t):
    own = t["points"].select(F.col("vec_id").alias("request_id"), F.lit("pos").alias("sign"), "id")
    return _rounded(nn.recommend(t["points"], own, 3), "query_id", "id", "score", "rank")


@query(
    "v_recommend_errors",
    """
WITH inputs AS (SELECT CAST(floor(seq / 10) AS BIGINT) AS request_id, CASE WHEN op = 'delete' THEN 'neg' ELSE 'pos' END AS sign, id FROM point_feed
                UNION ALL SELECT vec_id, 'neg', id FROM raw_points),
state AS (SELECT request_id, count(*) FILTER (sign = 'pos') AS n_pos, count(*) FILTER (p.id IS NULL) AS n_missing
          FROM inputs i LEFT JOIN (SELECT DISTINCT id FROM points) p ON p.id = i.id GROUP BY request_id)
SELECT request_id, CASE WHEN n_pos = 0 THEN 'invalid_vector_request' ELSE 'point_not_found' END AS error_type
FROM state WHERE n_pos = 0 OR n_missing > 0
""",
)
def v_recommend_errors(t):
    sign = F.when(F.col("op") == "delete", "neg").otherwise("pos").alias("sign")
    inputs = t["point_feed"].select(F.floor(F.col("seq") / 10).alias("request_id"), sign, "id")
    inputs = inputs.union(t["raw_points"].select("vec_id", F.lit("neg"), "id"))
    return nn.recommend_errors(t["points"], inputs)


@query(
    "v_filter",
    """
SELECT id, vec_id FROM points
WHERE (payload->>'color') = 'color_2' AND json_type(payload, '$.code') = 'UBIGINT' AND (payload->>'code') = '7'
  AND (payload->>'$.n.k') = '1' AND list_contains(CAST(payload->'tags' AS VARCHAR[]), 't7')
""",
)
def v_filter(t):
    must = {"color": "color_2", "code": 7, "n.k": 1, "tags": "t7"}
    return pt.payload_filter(t["points"], must).select("id", "vec_id")


@query("v_filter_promoted", "SELECT id, vec_id FROM points WHERE label = 3 AND (payload->>'even') = 'false'")
def v_filter_promoted(t):
    return pt.payload_filter(t["points"], {"label": 3, "even": False}, promoted={"label": "label"}).select("id", "vec_id")


@query("v_project", "SELECT id, payload FROM points")
def v_project(t):
    narrow = t["points"].select("id", "payload", "vector")
    return pt.project_points(narrow, with_payload=True)


@query(
    "v_attach",
    f"""
SELECT n.query_id, n.id, n.rank, p.payload FROM ({_neighbours()}) n JOIN points p ON p.id = n.id WHERE n.rank <= 2
""",
)
def v_attach(t):
    ranked = nn.knn_join(t["points"], t["knn_queries"], 2, exclude=_self(t))
    return nn.attach_points(ranked, t["points"], with_payload=True).select("query_id", "id", "rank", "payload")


@query(
    "v_vectors_map",
    """
WITH named AS (SELECT id, CASE WHEN label < 5 THEN '' ELSE vector_name END AS name, vector FROM points
               UNION ALL SELECT id, 'half', vector[1:32] FROM points WHERE label > 2)
SELECT id, count(*) AS n_vectors, string_agg(CASE WHEN name = '' THEN 'default' ELSE name END, ',' ORDER BY CASE WHEN name = '' THEN 'default' ELSE name END) AS names,
       CAST(sum(len(vector)) AS BIGINT) AS total_dim FROM named GROUP BY id
""",
)
def v_vectors_map(t):
    p = t["points"]
    name = F.when(F.col("label") < 5, "").otherwise(F.col("vector_name")).alias("vector_name")
    half = p.filter("label > 2").select("id", F.lit("half").alias("vector_name"), F.slice("vector", 1, 32).alias("vector"))
    mapped = pt.vectors_map(p.select("id", name, "vector").unionByName(half))
    dims = F.aggregate(F.map_values("vectors"), F.lit(0), lambda acc, v: acc + F.size(v))
    return mapped.select(
        "id",
        F.size("vectors").cast("bigint").alias("n_vectors"),
        F.array_join(F.map_keys("vectors"), ",").alias("names"),
        dims.cast("bigint").alias("total_dim"),
    )


@query(
    "v_payload",
    """
WITH entries AS (SELECT id, unnest(json_keys(payload)) AS key, payload FROM points)
SELECT id, key,
       CASE json_type(payload, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean'
            WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'null' END AS kind,
       CASE WHEN json_type(payload, '$.' || key) <> 'NULL' THEN CAST(json_extract(payload, '$.' || key) AS VARCHAR) END AS value
FROM entries
""",
)
def v_payload(t):
    return pt.decode_payload(t["points"])


@query(
    "v_profile",
    """
WITH sized AS (SELECT vector_name, payload, len(vector) AS d,
               sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))) AS n FROM points)
SELECT vector_name, count(*) AS points, min(d) AS min_dim, max(d) AS max_dim, count(*) FILTER (payload IS NULL) AS null_payloads,
       round(min(n), 6) AS min_norm, round(avg(n), 6) AS avg_norm, round(max(n), 6) AS max_norm FROM sized GROUP BY vector_name
""",
)
def v_profile(t):
    profile = pt.collection_profile(t["points"])
    norms = [F.round(c, 6).alias(c) for c in ("min_norm", "avg_norm", "max_norm")]
    return profile.select("vector_name", "points", "min_dim", "max_dim", "null_payloads", *norms)


@query(
    "v_requests",
    """
SELECT request_id, CASE
  WHEN has_vector AND n_pos + n_neg > 0 THEN 'cannot use both ''query'' vector and recommend inputs (positives/negatives/lookup_id) simultaneously'
  WHEN n_pos = 0 AND n_neg > 0 THEN 'must provide at least one positive for recommend query'
  WHEN NOT has_vector AND n_pos + n_neg = 0 THEN 'must specify either ''query'' vector or recommend inputs (positives/negatives/lookup_id)' END AS error
FROM raw_requests
""",
)
def v_requests(t):
    return pt.validate_requests(t["raw_requests"]).select("request_id", "error")


# The signatures of the approximate search, from the same planes written out. The given vectors hardly
# cluster, so a recall of 0.9 needs wide cells: these find about 0.95 of the exact ten and score about 0.7 of all pairs.
_BANDS, _BITS = 20, 4
_PLANES = ", ".join(f"({i}, {row.tolist()}::DOUBLE[])" for i, row in enumerate(nn.hyperplanes(_BANDS * _BITS, 64, 7)))


_ANN = f"""
planes(n, plane) AS (VALUES {_PLANES}),
cells AS (SELECT id, n // {_BITS} AS band, sum(CASE WHEN list_dot_product(CAST(vector AS DOUBLE[]), plane) > 0 THEN 1 << (n % {_BITS}) ELSE 0 END) AS cell
          FROM points, planes GROUP BY id, band),
near AS (SELECT DISTINCT q.query_id, c.id FROM knn_queries q JOIN cells d ON d.id = q.id JOIN cells c ON c.band = d.band AND c.cell = d.cell),
scored AS (SELECT n.query_id, n.id, {COSINE} AS s FROM near n JOIN knn_queries q ON q.query_id = n.query_id JOIN points p ON p.id = n.id),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored) WHERE rank <= 10)"""


@query("v_ann", f"WITH {_ANN}\nSELECT query_id, id, round(s, 6) AS score, rank FROM found")
def v_ann(t):
    ranked = nn.ann_join(t["points"], t["knn_queries"], 10, bands=_BANDS, bits=_BITS)
    return _rounded(ranked, "query_id", "id", "score", "rank")


@query(
    "v_ann_recall",
    f"""
WITH {_ANN},
pairs AS (SELECT q.query_id, p.id, {COSINE} AS s FROM knn_queries q, points p),
exact AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM pairs) WHERE rank <= 10)
SELECT count(*) AS wanted, count(f.id) AS found, round(count(f.id) / count(*), 6) AS recall FROM exact e LEFT JOIN found f ON f.query_id = e.query_id AND f.id = e.id
""",
)
def v_ann_recall(t):
    """How many of the exact ten the approximate search finds, over all queries."""
    approximate = nn.ann_join(t["points"], t["knn_queries"], 10, bands=_BANDS, bits=_BITS).select("query_id", "id", F.lit(True).alias("hit"))
    exact = nn.knn_join(t["points"], t["knn_queries"], 10).select("query_id", "id")
    joined = exact.join(approximate, ["query_id", "id"], "left")
    counts = joined.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return counts.select("wanted", "found", F.round(F.col("found") / F.col("wanted"), 6).alias("recall"))
