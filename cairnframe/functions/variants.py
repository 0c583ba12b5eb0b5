"""Typed access to JSON values held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(value: Column) -> Column:
    """JSON kind of a VARIANT: object, array, string, boolean, integer, number, null; NULL when absent."""
    shape = F.schema_of_variant(value)
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "BIGINT", "integer")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "number")
        .when(shape == "VOID", "null")
    )


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def member(value: Column, path: str) -> Column:
    """Nested VARIANT at a JSON path such as ``$.a.b``; NULL when absent."""
    return F.try_variant_get(value, path, "variant")


def as_array(value: Column) -> Column:
    """ARRAY<VARIANT> of a JSON array, else NULL."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_map(value: Column) -> Column:
    """MAP<STRING, VARIANT> of a JSON object, else NULL."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def text_or(value: Column, path: str, default: str) -> Column:
    """Text at the path when it really is a JSON string, else the default."""
    is_text = F.schema_of_variant(member(value, path)) == "STRING"
    return F.when(is_text, F.try_variant_get(value, path, "string")).otherwise(F.lit(default))
