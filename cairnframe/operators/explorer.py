"""What an explorer document's settings mean for a table: filters, counts, views and joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants
from ..functions.text import let
from ..schemas import COLUMN_TYPES


def pre_filter_values(decoded: DataFrame) -> DataFrame:
    """``name, tab_pos, field, value`` rows of the documents' ``preFilters`` (lists, or single values)."""
    tabs = decoded.select("name", F.posexplode("doc.explorerConfig").alias("tab_pos", "tab"))
    fields = tabs.select("name", "tab_pos", F.explode("tab.preFilters").alias("field", "node"))
    values = F.coalesce(variants.as_array(F.col("node")), F.array("node"))
    rows = fields.select("name", F.col("tab_pos").cast("bigint").alias("tab_pos"), "field", F.explode(values).alias("v"))
    return rows.select("name", "tab_pos", "field", F.try_variant_get("v", "$", "string").alias("value"))


def pre_filter(table: DataFrame, values: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows whose every listed field has one of its values.

    ``values``: ``field, value`` of any length; each field is one semi join.
    """
    for field in fields:
        wanted = values.filter(F.col("field") == field).select(F.col("value").alias("_value")).distinct()
        table = table.join(wanted, F.col(field).cast("string") == F.col("_value"), "left_semi")
    return table


def filter_classes(values: DataFrame) -> DataFrame:
    """``name, tab_pos, filter_class``: tabs whose pre-filters are equal, in any order, have one class.

    ``values`` as from :func:`pre_filter_values`. Tabs without pre-filters keep every row and are not listed.
    """
    listed = F.sort_array(F.collect_set(F.struct("field", "value")))
    return values.groupBy("name", "tab_pos").agg(listed.alias("filters")).select("name", "tab_pos", F.md5(F.to_json("filters")).alias("filter_class"))


def pre_filter_classes(table: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of ``table`` with ``filter_class``: once for every class of pre-filters (:func:`filter_classes`) that keeps them.

    The table is read once for any number of documents. Each (field, value) has the list of the classes that
    allow it; a row looks up its values, field by field, and a class keeps it that
    is found as often as it has fields. A filter on a field that the table lacks keeps no row.

    The driver reads the distinct fields, which are like column names.
    """
    classes = filter_classes(values)
    conditions = values.join(classes, ["name", "tab_pos"]).select("filter_class", "field", "value").distinct()
    needs = conditions.groupBy("filter_class").agg(F.count_distinct("field").alias("need"))
    entry = F.struct("filter_class", "need")
    allowed = conditions.join(needs, "filter_class").groupBy("field", "value").agg(F.collect_list(entry).alias("classes"))
    fields = sorted({r[0] for r in values.select("field").distinct().collect()} & set(table.columns))
    none = F.array().cast("array<struct<filter_class:string,need:bigint>>")
    own = F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("_row")
    rows = table.select(own)
    for n, field in enumerate(fields):
        lookup = allowed.filter(F.col("field") == field).select(F.col("value").alias(f"_value{n}"), F.col("classes").alias(f"_classes{n}"))
        rows = rows.join(lookup, F.col("_row")[field].cast("string") == F.col(f"_value{n}"), "left")
    found = F.concat(none, *[F.coalesce(f"_classes{n}", none) for n in range(len(fields))])

    def kept(every: Column) -> Column:
        return F.filter(F.array_distinct(every), lambda c: F.size(F.filter(every, lambda x: x["filter_class"] == c["filter_class"])) == c["need"])

    return rows.select("_row", F.explode(let(found, kept)).alias("_kept")).select("_row.*", "_kept.filter_class")


def facet_counts(table: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, value, n`` for all listed fields in one pass over the table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    counted = table.select(pairs.alias("p")).groupBy("p.field", "p.value")
    return counted.agg(F.count(F.lit(1)).alias("n"))


def size_bin(size: Column, edges: Sequence[int]) -> Column:
    """Number of the bin whose lower edge is the last one not above the size; NULL below the first edge."""
    position = sum((size >= F.lit(int(e))).cast("bigint") for e in edges)
    return F.nullif(position, F.lit(0)) - 1


def size_histogram(table: DataFrame, column: str, edges: Sequence[int]) -> DataFrame:
    """``bin, low, high, n`` for every bin between the edges, empty ones included; the last bin is open."""
    edges = sorted(int(e) for e in edges)
    counts = table.select(size_bin(F.col(column), edges).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = table.sparkSession.createDataFrame(
        [(i, low, high) for i, (low, high) in enumerate(zip(edges, [*edges[1:], None]))], "bin long, low long, high long"
    )
    return bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _edges_upto(edges: Sequence[int], value: Column) -> Column:
    """How many of the sorted edges are not above the value: a binary search; NULL for NULL."""
    listed = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(edges).bit_length())))])

    def step(at: Column, by: Column) -> Column:
        return F.when(F.coalesce(F.try_element_at(listed, at + by) <= value, F.lit(False)), at + by).otherwise(at)

    return F.when(value.isNotNull(), F.aggregate(steps, F.lit(0), step))


def document_histograms(sizes: DataFrame, column: str, edges: DataFrame) -> DataFrame:
    """``name, bin, low, high, n`` of every document's own bins, empty ones included; the last bin is open.

    ``edges``: ``name, edge`` in any order, as from :func:`bin_edges`. Sizes below the first edge are in no bin.

    One read of the sizes serves all documents: sizes are counted between the distinct edges of all documents
    (a binary search and a partial count each), and sums of these counts give how many sizes lie below an
    edge. A bin holds the difference at its two edges, so documents meet edges by equality, never sizes.

    The driver reads the distinct edges, which are settings, few.
    """
    bounds = sorted(r[0] for r in edges.filter("edge IS NOT NULL").select("edge").distinct().collect())
    counts = sizes.select(_edges_upto(bounds, F.col(column)).alias("upto")).filter("upto IS NOT NULL").groupBy("upto").agg(F.count(F.lit(1)).alias("n"))
    listed = sizes.sparkSession.createDataFrame([(i, e) for i, e in enumerate(bounds)], "place int, low long")
    # Sizes that reach exactly ``place`` edges lie below the edge at ``place``.
    inside = listed.join(counts.withColumn("place", F.col("upto")).drop("upto"), "place", "full")
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    below = inside.withColumn("below", F.sum(F.coalesce("n", F.lit(0))).over(upto)).filter("low IS NOT NULL").select("low", "below")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    of_name = Window.partitionBy("name").orderBy("low")
    bins = edges.filter("edge IS NOT NULL").select("name", F.col("edge").cast("long").alias("low")).distinct()
    bins = bins.withColumn("bin", (F.row_number().over(of_name) - 1).cast("long")).withColumn("high", F.lead("low").over(of_name))
    at_high = below.select(F.col("low").alias("high"), F.col("below").alias("below_high")).unionByName(total.select(F.lit(None).cast("long").alias("high"), F.col("total").alias("below_high")))
    joined = bins.join(below, "low").join(at_high, bins["high"].eqNullSafe(at_high["high"])).drop(at_high["high"])
    return joined.select("name", "bin", "low", "high", (F.col("below_high") - F.col("below")).cast("long").alias("n"))


def bin_edges(decoded: DataFrame) -> DataFrame:
    """``name, position, edge`` of the documents' size bins (LONG, exact beyond 2^53)."""
    points = decoded.select("name", F.posexplode("doc.binslicePoints").alias("position", "edge"))
    return points.select("name", F.col("position").cast("bigint").alias("position"), "edge")


# Column type of a table view and what a value is cast to.
_CASTS = {"string": "string", "number": "double", "date": "timestamp", "link": "string", "boolean": "boolean", "paragraphs": "string"}


def _view_cell(table: DataFrame, column: Mapping[str, str]) -> Column:
    path = column.get("accessorPath") or column["field"]
    root, _, inner = path.partition(".")
    if inner and dict(table.dtypes).get(root) == "string":
        value = F.get_json_object(root, f"$.{inner}")
    else:
        value = F.col(path)
    kind = column.get("type") or "string"
    if kind not in COLUMN_TYPES:
        raise ValueError(f"unknown column type: {kind}")
    if kind == "array":
        is_array = dict(table.dtypes).get(path, "").startswith("array")
        return value if is_array else F.from_json(value, "array<string>")
    return value.try_cast(_CASTS[kind])


def table_view(table: DataFrame, columns: Sequence[Mapping[str, str]]) -> DataFrame:
    """The listed columns in order, cast by type and renamed to their title.

    Each column has ``field``, and may have ``title``, ``type`` and
    ``accessorPath`` (into a struct, or into JSON text). Only what is listed is read.
    """
    return table.select(*[_view_cell(table, c).alias(c.get("title") or c["field"]) for c in columns])


def manifest(data: DataFrame, resources: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Resource rows of the data rows, joined on the mapping's reference fields.

    The resource's reference field takes the name of the data index's; other
    columns of both sides are kept.
    """
    data_key = mapping["referenceIdFieldInDataIndex"]
    resource_key = mapping["referenceIdFieldInResourceIndex"]
    return data.join(resources.withColumnRenamed(resource_key, data_key), data_key)


def shared_filters(decoded: DataFrame) -> DataFrame:
    """``name, filter, position, index, field`` of the documents' shared filters."""
    entries = decoded.select("name", F.explode("doc.sharedFilters.defined").alias("filter", "pairs"))
    pairs = entries.select("name", "filter", F.posexplode("pairs").alias("position", "pair"))
    return pairs.select("name", "filter", F.col("position").cast("bigint").alias("position"), "pair.index", "pair.field")


def apply_shared_filter(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str]], values: DataFrame) -> dict[str, DataFrame]:
    """Apply one filter (``values``: ``value``) to every (index, field) pair of a shared filter."""
    out = dict(tables)
    for index, field in pairs:
        listed = values.select(F.lit(field).alias("field"), F.col("value").cast("string").alias("value"))
        out[index] = pre_filter(out[index], listed, [field])
    return out


def extension_actions(decoded: DataFrame) -> DataFrame:
    """``name, extension, actions`` of the documents' file actions."""
    return decoded.select("name", F.explode("doc.fileActions.extensions").alias("extension", "actions"))


def file_actions(files: DataFrame, actions: DataFrame) -> DataFrame:
    """Add ``actions`` to ``name, file_name`` rows: those of the file's extension, else the document's ``default``.

    ``name`` is the document whose settings apply to the file.
    """
    extension = let(F.split("file_name", r"\."), lambda p: F.when(F.size(p) > 1, F.lower(F.element_at(p, -1))))
    own = actions.select("name", F.col("extension").alias("_extension"), F.col("actions").alias("_own"))
    fallback = actions.filter("extension = 'default'").select("name", F.col("actions").alias("_default"))
    joined = files.withColumn("_extension", extension).join(own, ["name", "_extension"], "left").join(fallback, "name", "left")
    return joined.withColumn("actions", F.coalesce("_own", "_default")).drop("_extension", "_own", "_default")
