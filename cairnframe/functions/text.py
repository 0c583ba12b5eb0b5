"""Text, path and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that trimming removes at both ends.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    The optimiser writes out an expression at every place that uses it; a
    lambda variable keeps long ones (parsed JSON, split addresses) single.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for an expensive value that later filters must not compute again.

    A filter on a plain column moves below it and takes the whole expression
    along; it does not move below a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes blanks only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def strip_slashes(col: Column) -> Column:
    return F.btrim(col, F.lit("/"))


def strip_path(col: Column) -> Column:
    """White space first, then slashes, at both ends."""
    return strip_slashes(strip(col))


def blank_to_null(col: Column) -> Column:
    """Trimmed value, NULL where nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def segments(path: Column) -> Column:
    """Segments of a path without its outer slashes."""
    return F.split(strip_slashes(path), "/")


def ancestors(path: Column, include_self: bool) -> Column:
    """Every proper prefix of a slash-separated path, optionally with the path itself.

    ``a/b/c`` gives ``a``, ``a/b`` (and ``a/b/c``); the work per row is bounded
    by the depth of the path.
    """
    parts = F.split(path, "/")
    last = F.size(parts) if include_self else F.size(parts) - 1
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def parent_dir(path: Column) -> Column:
    """Directory holding the path; empty text for the top level."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_uuid(col: Column) -> Column:
    """Canonical text form of a UUID."""
    return col.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def valid_path(path: Column) -> Column:
    """Absolute POSIX path without NUL or backslash that does not clean to ``/..…``.

    Only a path with a segment starting with two dots can clean to something
    rejected, so the segment fold runs for those rows alone. In the fold an
    empty segment or ``.`` is skipped and ``..`` drops the last kept segment.
    """
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    escapes = F.when(path.contains("/.."), F.coalesce(F.get(kept, F.lit(0)).startswith(".."), F.lit(False))).otherwise(
        F.lit(False)
    )
    plain = path.startswith("/") & ~path.contains("\x00") & ~path.contains("\\")
    return F.coalesce(plain & ~escapes, F.lit(False))


def normalize_resource_path(resource: Column) -> Column:
    """Trim; keep only the path of a URL; one leading slash, none trailing; empty stays empty.

    A value whose URL form has no path (``https://host``, ``a:b``) or cannot be
    decoded keeps its whole text. Plain paths, nearly all values, skip the URL
    rules.
    """

    def absolute(path: Column) -> Column:
        inner = strip_slashes(path)
        return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit("/"), inner))

    text = strip(resource)
    plain = text.rlike("^/([^/?#%:][^?#%:]*)?$")
    return F.when(plain, absolute(text)).otherwise(let(text, lambda t: absolute(_url_path(t))))


def _url_path(text: Column) -> Column:
    """Decoded path of a URL or relative reference, or the text itself when it has none."""

    def inside(bare: Column) -> Column:
        # A scheme without a slash after it, or a colon in the first segment: no path at all.
        opaque = bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!/)") | bare.rlike(r"^(?![A-Za-z][A-Za-z0-9+.\-]*:)[^/]*:")
        path = F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/]*)?", "")
        return F.when(opaque, text).otherwise(let(path, decoded))

    def decoded(path: Column) -> Column:
        plus_kept = F.replace(path, F.lit("+"), F.lit("%2B"))
        plain = F.when(path.contains("%"), F.try_url_decode(plus_kept)).otherwise(path)
        return F.coalesce(F.nullif(plain, F.lit("")), text)

    return let(F.regexp_replace(text, r"[?#].*$", ""), inside)


def path_escape(col: Column) -> Column:
    """Percent-encode one path segment; the characters ``$&+:=@`` stay readable."""
    encoded = F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))
    # Form encoding differs from path-segment encoding in these codes.
    for code, char in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def safe_path_part(col: Column) -> Column:
    """Characters that cannot stand in one path part become ``_``."""
    return F.translate(col, "/\\: ", "____")
