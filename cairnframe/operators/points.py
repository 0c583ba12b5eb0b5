"""Vector points: validation, mutation, lookup, payload filters and profiles.

Points are in long form, one row per ``(id, vector_name)``, with columns
``id, vector_name, vector, payload`` and payload as JSON text. Rules marked
"store rule" belong to the vector store that a point service calls; they are
specified here.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variants
from ..functions.text import is_uuid, let
from ..functions.vectors import check_metric, norm
from . import mutations

VectorSpec = Mapping[str, tuple[int, str]]  # vector name -> (dimension, metric)


def validate_points(points: DataFrame, spec: VectorSpec) -> DataFrame:
    """Flag each row with ``error_type`` and ``error`` (both NULL when the point is good).

    Checked in order: vector name given, id is a UUID, name known, dimension
    right. The last two are store rules. Column ``dim`` is used as the claimed
    dimension when present, else the length of ``vector``.
    """
    for _, metric in spec.values():
        check_metric(metric)
    dim = F.col("dim") if "dim" in points.columns else F.size("vector")
    known = F.create_map(*[F.lit(x) for name, (size, _) in spec.items() for x in (name, size)])
    expected = F.try_element_at(known, F.col("vector_name"))
    missing = F.coalesce(F.col("vector_name"), F.lit("")) == ""
    bad_id = ~F.coalesce(is_uuid(F.col("id")), F.lit(False))
    error = (
        F.when(missing, F.concat(F.lit("vector_name is required for point ID "), F.coalesce("id", F.lit(""))))
        .when(bad_id, F.lit("id is not a UUID"))
        .when(expected.isNull(), F.concat(F.lit("unknown vector name "), F.col("vector_name")))
        .when(
            ~F.coalesce(dim == expected, F.lit(False)),
            F.concat(F.lit("expected dimension "), expected.cast("string")),
        )
    )
    kind = (
        F.when(missing | bad_id, F.lit("invalid_point_data"))
        .when(error.isNotNull(), F.lit("vector_operation_failed"))
    )
    return points.withColumn("error_type", kind).withColumn("error", error)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the error columns, and rejected rows with them."""
    accepted = validated.filter(F.col("error_type").isNull()).drop("error_type", "error")
    return accepted, validated.filter(F.col("error_type").isNotNull())


def upsert_points(base: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Insert or replace whole points by id (a NULL payload clears the stored one)."""
    return mutations.upsert(base, batch, ["id"], order)


def delete_points(base: DataFrame, ids: DataFrame, filter=None) -> DataFrame:
    """Delete by id. A filter would silently not apply, so passing one is an error."""
    if filter is not None:
        raise ValueError("delete by filter is not supported; delete by id")
    return mutations.delete(base, ids, ["id"])


def get_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, vectors, payload, found, error_type`` for every distinct asked id.

    ``error_type`` is invalid_uuid for a malformed id and point_not_found for an
    absent one.
    """
    got = mutations.lookup(vectors_map(points), ids, ["id"])
    error = F.when(~is_uuid(F.col("id")), "invalid_uuid").when(~F.col("found"), "point_not_found")
    return got.withColumn("error_type", error)


def vectors_map(points: DataFrame) -> DataFrame:
    """One row per id: ``vectors`` (name → vector, ``default`` when unnamed) and ``payload``.

    A group holds one entry per vector name of the collection, so it stays small.
    """
    name = F.coalesce(F.nullif(F.col("vector_name"), F.lit("")), F.lit("default"))
    entries = F.sort_array(F.collect_list(F.struct(name.alias("name"), F.col("vector"))))
    payload = [F.any_value("payload", F.lit(True)).alias("payload")] if "payload" in points.columns else []
    return points.groupBy("id").agg(F.map_from_entries(entries).alias("vectors"), *payload)


def project_points(points: DataFrame, with_payload: bool | None = None, with_vector: bool | None = None) -> DataFrame:
    """Drop payload and vector unless asked for; the scan then does not read them."""
    dropped = [c for c, keep in (("payload", with_payload), ("vector", with_vector)) if not keep]
    return points.drop(*dropped)


def _condition(payload: Column, key: str, value) -> Column:
    node = variants.member(payload, f"$.{key}")
    if isinstance(value, bool):
        shape, sql_type = "BOOLEAN", "boolean"
    elif isinstance(value, int):
        shape, sql_type = "BIGINT", "bigint"
    elif isinstance(value, str):
        shape, sql_type = "STRING", "string"
    else:
        raise TypeError(f"match value for {key!r} must be a string, an integer or a boolean")
    candidates = F.coalesce(variants.as_array(node), F.array(node))
    return F.exists(
        candidates,
        lambda v: (F.schema_of_variant(v) == shape) & (F.try_variant_get(v, "$", sql_type) == F.lit(value)),
    )


def _column_condition(points: DataFrame, column: str, value) -> Column:
    kind = points.schema[column].dataType
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(value, bool):
        alike = isinstance(element, T.BooleanType)
    elif isinstance(value, int):
        alike = isinstance(element, T.IntegralType)
    elif isinstance(value, str):
        alike = isinstance(element, T.StringType)
    else:
        raise TypeError(f"match value for {column!r} must be a string, an integer or a boolean")
    if not alike:
        return F.lit(False)
    return F.array_contains(column, value) if isinstance(kind, T.ArrayType) else F.col(column) == F.lit(value)


def payload_filter(points: DataFrame, must: Mapping[str, object] | None, promoted: Mapping[str, str] | None = None) -> DataFrame:
    """Rows whose payload equals every ``key: value``; no conditions keep all rows.

    Values match with their type (``2`` is not ``"2"``); an array matches when
    any element does (store rule). A predicate on JSON cannot reach the file
    scan, so ``promoted`` names keys that are also plain columns: those
    conditions become column comparisons, which are pushed down. A value of
    another type than the column's matches no row, as in the JSON form.
    """
    promoted = promoted or {}
    must = must or {}
    json_keys = [k for k in must if k not in promoted]
    for key in must:
        if key in promoted:
            points = points.filter(_column_condition(points, promoted[key], must[key]))
    if not json_keys:
        return points

    def all_match(payload: Column) -> Column:
        return reduce(and_, [_condition(payload, key, must[key]) for key in json_keys])

    return points.filter(let(F.try_parse_json("payload"), all_match))


def condition_token(key: Column, value: Column) -> Column:
    """A text for a key with a string, integer or boolean VARIANT, equal for equal values of one type; NULL for others."""
    shape = F.schema_of_variant(value)
    tags = (("STRING", "s", "string"), ("BIGINT", "i", "bigint"), ("BOOLEAN", "b", "boolean"))
    texts = [F.when(shape == kind, F.concat(key, F.lit(f"={tag}:"), F.try_variant_get(value, "$", sql_type).cast("string"))) for kind, tag, sql_type in tags]
    return F.coalesce(*texts)


def payload_tokens(payload: Column, keys: list[str]) -> Column:
    """:func:`condition_token` of all values that a JSON payload has at the ``keys``; an array gives one for each element."""

    def tokens(parsed: Column) -> Column:
        found = []
        for key in keys:
            node = variants.member(parsed, f"$.{key}")
            elements = F.coalesce(variants.as_array(node), F.array(node))
            found.append(F.transform(elements, _tokens_of(key)))
        return F.array_compact(F.concat(*found))

    none = F.array().cast("array<string>")
    return F.coalesce(let(F.try_parse_json(payload), tokens), none) if keys else none


def _tokens_of(key: str):
    return lambda value: condition_token(F.lit(key), value)


def decode_payload(points: DataFrame) -> DataFrame:
    """Top-level payload entries as rows ``id, key, kind, value`` (value as JSON text, NULL for null)."""
    entries = F.explode(variants.as_map(F.try_parse_json("payload"))).alias("key", "node")
    rows = points.select("id", entries)
    return rows.select("id", "key", variants.kind(F.col("node")).alias("kind"), "node").select(
        "id", "key", "kind", F.when(F.col("kind") != "null", F.to_json("node")).alias("value")
    )


def collection_profile(points: DataFrame) -> DataFrame:
    """Per vector name: points, dimension range, NULL payloads and norm statistics."""
    n = norm(F.col("vector"))
    return points.groupBy("vector_name").agg(
        F.count(F.lit(1)).alias("points"),
        F.min(F.size("vector")).cast("bigint").alias("min_dim"),
        F.max(F.size("vector")).cast("bigint").alias("max_dim"),
        F.count_if(F.col("payload").isNull()).alias("null_payloads"),
        F.min(n).alias("min_norm"),
        F.avg(n).alias("avg_norm"),
        F.max(n).alias("max_norm"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``error`` to query requests with ``has_vector, n_pos, n_neg``; NULL when good.

    ``n_pos`` counts positives and a lookup id. Order of checks: both forms,
    negatives without positives, neither form.
    """
    has_inputs = (F.col("n_pos") > 0) | (F.col("n_neg") > 0)
    # The messages.
    error = (
        F.when(
            F.col("has_vector") & has_inputs,
            "cannot use both 'query' vector and recommend inputs (positives/negatives/lookup_id) simultaneously",
        )
        .when(has_inputs & (F.col("n_pos") == 0), "must provide at least one positive for recommend query")
        .when(
            ~F.col("has_vector") & ~has_inputs,
            "must specify either 'query' vector or recommend inputs (positives/negatives/lookup_id)",
        )
    )
    return requests.withColumn("error", error)
