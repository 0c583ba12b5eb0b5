"""Queries driven by explorer settings."""

from pyspark.sql import functions as F

from ..operators import documents as dc
from ..operators import explorer as ex
from ..sources.tables import stored
from .registry import query, view

_DOCS = "SELECT name, segment, content FROM docs WHERE config_type = 'explorer' AND json_valid(content) AND doc_key % 13 <> 0"


def _explorer(t):
    return dc.decode(t["docs"], "explorer").filter("doc IS NOT NULL")


@query(
    "d_prefilter",
    f"""
WITH wanted AS (SELECT content->>'$.explorerConfig[0].preFilters.segment[0]' AS value, count(*) AS n_documents FROM ({_DOCS}) GROUP BY 1)
SELECT project_id, segment, n_documents FROM projects JOIN wanted ON value = segment
""",
)
def d_prefilter(t):
    """All projects that some document keeps, and how many documents do."""
    values = stored(ex.pre_filter_values(_explorer(t)))  # parsed once
    kept = ex.pre_filter_classes(t["projects"].select("project_id", "segment"), values)
    documents = ex.filter_classes(values).groupBy("filter_class").agg(F.count("*").alias("n"))
    return kept.join(documents, "filter_class").groupBy("project_id", "segment").agg(F.sum("n").alias("n_documents"))


@query(
    "d_prefilter_values",
    f"""
SELECT name, CAST(0 AS BIGINT) AS tab_pos, 'segment' AS field, content->>'$.explorerConfig[0].preFilters.segment[0]' AS value FROM ({_DOCS})
""",
)
def d_prefilter_values(t):
    return ex.pre_filter_values(_explorer(t))


@query(
    "d_facets",
    """
SELECT 'l_returnflag' AS field, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2
""",
)
def d_facets(t):
    return ex.facet_counts(t["lineitem"], ["l_returnflag", "l_linestatus", "l_linenumber"])


EDGES = (0, 1048576, 524288000, 1073741824, 107374182400, 9007199254740991)
_EDGES = ", ".join(f"({i}, CAST({e} AS BIGINT))" for i, e in enumerate(EDGES))


@query(
    "d_bins",
    f"""
WITH bins AS (SELECT i, low, lead(low) OVER (ORDER BY i) AS high FROM (VALUES {_EDGES}) v(i, low)),
sizes AS (SELECT CAST(floor(l_extendedprice) AS BIGINT) * l_partkey * 100 - 1000 AS size FROM lineitem)
SELECT CAST(i AS BIGINT) AS bin, low, high, count(size) AS n FROM bins LEFT JOIN sizes ON size >= low AND (high IS NULL OR size < high) GROUP BY ALL
""",
)
def d_bins(t):
    sizes = t["lineitem"].select((F.floor("l_extendedprice") * F.col("l_partkey") * 100 - 1000).alias("size"))
    return ex.size_histogram(sizes, "size", EDGES)


@query(
    "d_document_bins",
    """
WITH lows AS (SELECT name, CAST(content->>('$.binslicePoints[' || i || ']') AS BIGINT) + CASE WHEN i IN (1, 2) THEN length(name) * (ascii(right(name, 1)) % 7) * 1000 ELSE 0 END AS low
               FROM docs, range(6) r(i) WHERE config_type = 'file_summary' AND json_valid(content) AND doc_key % 13 <> 0),
bins AS (SELECT name, low, lead(low) OVER (PARTITION BY name ORDER BY low) AS high, row_number() OVER (PARTITION BY name ORDER BY low) - 1 AS bin FROM lows),
sizes AS (SELECT CAST(floor(l_extendedprice) AS BIGINT) * l_partkey * 100 - 1000 AS size FROM lineitem),
counts AS (SELECT low, high, count(size) AS n FROM (SELECT DISTINCT low, high FROM bins) LEFT JOIN sizes ON size >= low AND (high IS NULL OR size < high) GROUP BY ALL)
SELECT name, bin, b.low, b.high, n FROM bins b JOIN counts c ON c.low = b.low AND c.high IS NOT DISTINCT FROM b.high
""",
)
def d_document_bins(t):
    """The histogram of every document; two edges are moved by the document's name, so that documents differ."""
    moved = F.when(F.col("position").isin(1, 2), F.length("name") * (F.ascii(F.right("name", F.lit(1))) % 7) * 1000).otherwise(0)
    edges = stored(ex.bin_edges(dc.decode(t["docs"], "file_summary").filter("doc IS NOT NULL")).select("name", (F.col("edge") + moved).alias("edge")))
    sizes = t["lineitem"].select((F.floor("l_extendedprice") * F.col("l_partkey") * 100 - 1000).alias("size"))
    return ex.document_histograms(sizes, "size", edges)


@query(
    "d_bin_edges",
    """
SELECT name, i AS position, CAST(content->>('$.binslicePoints[' || i || ']') AS BIGINT) AS edge
FROM docs, range(6) r(i) WHERE config_type = 'file_summary' AND json_valid(content) AND doc_key % 13 <> 0
""",
)
def d_bin_edges(t):
    return ex.bin_edges(dc.decode(t["docs"], "file_summary").filter("doc IS NOT NULL"))


@query(
    "d_table",
    """
SELECT event_id AS "Event", CAST(CAST(props->>'k' AS BIGINT) AS DOUBLE) AS "Key", event_type AS "Kind", value >= 1 AS "Large", value AS value FROM events
""",
)
def d_table(t):
    rows = t["events"].withColumn("large", F.when(F.col("value") >= 1, "true").otherwise("false"))
    columns = [
        {"field": "event_id", "title": "_event"},
        {"field": "k", "title": "Key", "accessorPath": "props.k", "type": "number"},
        {"field": "event_type", "title": "Kind", "type": "string"},
        {"field": "large", "title": "Large", "type": "boolean"},
        {"field": "value", "type": "number"},
    ]
    shown = ex.table_view(rows, columns)
    return shown.withColumn("_event", F.col("_event").cast("bigint")).withColumnRenamed("_event", "Event")


@query(
    "d_manifest",
    "SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey",
)
def d_manifest(t):
    mapping = {"referenceIdFieldInDataIndex": "l_partkey", "referenceIdFieldInResourceIndex": "p_partkey"}
    data = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")
    return ex.manifest(data, t["part"].select("p_partkey", "p_name", "p_brand"), mapping)


@query(
    "d_shared_list",
    f"""
SELECT name, 'seg' AS filter, i AS position, content->>('$.sharedFilters.defined.seg[' || i || '].index') AS "index", content->>('$.sharedFilters.defined.seg[' || i || '].field') AS field
FROM ({_DOCS}), range(2) r(i)
""",
)
def d_shared_list(t):
    return ex.shared_filters(_explorer(t))


@query(
    "d_shared",
    """
WITH v AS (SELECT DISTINCT p_brand AS value FROM part WHERE p_size > 45)
SELECT 'part' AS "index", p_partkey AS key FROM part WHERE p_brand IN (SELECT value FROM v)
UNION ALL SELECT 'file', l_orderkey * 10 + l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN (SELECT value FROM v)
""",
)
def d_shared(t):
    brands = t["part"].filter("p_size > 45").select(F.col("p_brand").alias("value")).distinct()
    files = t["lineitem"].join(t["part"].select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    tables = {"part": t["part"], "file": files}
    out = ex.apply_shared_filter(tables, [("part", "p_brand"), ("file", "brand")], brands)
    parts = out["part"].select(F.lit("part").alias("index"), F.col("p_partkey").alias("key"))
    return parts.unionByName(out["file"].select(F.lit("file").alias("index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")))


view(
    "config_files",
    """
SELECT p_partkey AS file_id, concat('Customer_', lpad(CAST(p_partkey % 1500 AS STRING), 9, '0')) AS name,
       concat(replace(p_name, ' ', '_'), CASE p_size % 3 WHEN 0 THEN '.TIFF' WHEN 1 THEN '.csv' ELSE '' END) AS file_name FROM part
""",
)


@query(
    "d_actions",
    f"""
SELECT f.file_id, f.name, f.file_name, CASE WHEN d.name IS NULL THEN NULL WHEN f.file_name LIKE '%.TIFF' THEN 'view,' || lower(d.segment) ELSE 'download' END AS actions
FROM config_files f LEFT JOIN ({_DOCS}) d ON d.name = f.name
""",
)
def d_actions(t):
    found = ex.file_actions(t["config_files"], ex.extension_actions(_explorer(t)))
    return found.withColumn("actions", F.array_join("actions", ","))
