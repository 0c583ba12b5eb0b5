"""Configuration documents: ``config_type, name, content`` with content as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variants
from ..functions.grants import project_path
from ..functions.repos import normalize_repo_url, repo_identity, requested_repo_url
from ..functions.text import barrier, blank_to_null, first_non_blank, let, path_escape, strip
from ..schemas import (
    CONFIG_TYPES,
    DEFAULT_ID,
    DEFAULT_TYPE,
    DOCUMENT_SCHEMAS,
    FOOTER_ROW_KINDS,
    FOOTER_ROW_SCHEMAS,
    PROJECT,
)
from ..sources.tables import stored
from . import mutations

KEY = ["config_type", "name"]

# ---------------------------------------------------------------- stored documents


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill an empty type and id, and add ``error_type`` for an unknown type."""
    kind = F.coalesce(F.nullif("config_type", F.lit("")), F.lit(DEFAULT_TYPE))
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit(DEFAULT_ID))
    filled = requests.withColumn("config_type", kind).withColumn("name", name)
    return filled.withColumn("error_type", F.when(~F.col("config_type").isin(*CONFIG_TYPES), "invalid_config_type"))


def list_names(documents: DataFrame, config_type: str | None = None) -> DataFrame:
    """Names of one type's documents; the default type when none is given."""
    config_type = config_type or DEFAULT_TYPE
    if config_type not in CONFIG_TYPES:
        raise ValueError(f"Unknown config type: {config_type}")
    return documents.filter(F.col("config_type") == config_type).select("name")


def get_documents(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per distinct asked ``(config_type, name)`` with ``content``, ``found``, ``error_type``."""
    asked = with_defaults(requests)
    got = mutations.lookup(documents.select(*KEY, "content"), asked, KEY)
    unknown = ~F.col("config_type").isin(*CONFIG_TYPES)
    return got.withColumn(
        "error_type", F.when(unknown, "invalid_config_type").when(~F.col("found"), "config_not_found")
    )


def put_documents(base: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Insert documents or replace their whole content."""
    return mutations.upsert(base, batch, KEY, order)


def delete_documents(base: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining documents, and the asked keys with a ``deleted`` flag."""
    return mutations.delete(base, ids, KEY), mutations.delete_flags(base, ids, KEY)


# ---------------------------------------------------------------- strict parsing

# Checks are generated as SQL text: one expression per schema, parsed in one call.
_NONE = "CAST(array() AS array<struct<field:string,problem:string>>)"
# How the kinds of a scalar VARIANT are spelled.
_SCALARS = {
    T.StringType: "{0} IN ('STRING', 'VOID')",
    T.BooleanType: "{0} IN ('BOOLEAN', 'VOID')",
    T.LongType: "{0} IN ('BIGINT', 'VOID')",
    T.DoubleType: "({0} IN ('BIGINT', 'DOUBLE', 'FLOAT', 'VOID') OR startswith({0}, 'DECIMAL'))",
}


def _found(field: str, problem: str) -> str:
    return f"named_struct('field', '{field}', 'problem', '{problem}')"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once and called ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _scalar_problem(value: str, kind: T.DataType, field: str) -> str:
    """SQL giving the problem of a scalar member, NULL when it is absent, null or right."""
    right = _SCALARS[type(kind)].format(f"schema_of_variant({value})")
    return f"CASE WHEN NOT {right} THEN {_found(field, 'wrong_type')} END"


def _problems(value: str, kind: T.DataType, field: str, level: int = 0) -> str:
    """SQL listing everything in a JSON value that its type does not allow (JSON null is always allowed).

    An object or array is taken apart once, and its members are looked at in
    place; a failed cast tells that the value is something else.
    """
    if isinstance(kind, T.VariantType):
        return _NONE
    if type(kind) in _SCALARS:
        return f"array_compact(array({_scalar_problem(value, kind, field)}))"
    v, parts, x = f"v{level}", f"m{level}", f"x{level}"
    if isinstance(kind, T.StructType):
        cast, prefix = "map<string,variant>", field + "." if field else ""
        known = ", ".join(f"'{f.name}'" for f in kind.fields)
        unknown = f"transform(array_except(map_keys({parts}), array({known})), {x} -> named_struct('field', concat('{prefix}', {x}), 'problem', 'unknown_field'))"
        scalars, nested = [], []
        for f in kind.fields:
            member, name = f"try_element_at({parts}, '{f.name}')", prefix + f.name
            if type(f.dataType) in _SCALARS:
                scalars.append(_scalar_problem(member, f.dataType, name))
            else:
                check = _union_problems if f.metadata.get("union") else _problems
                nested.append(check(member, f.dataType, name, level + 1))
        lists = [unknown, *[n for n in nested if n != _NONE]]
        if scalars:
            lists.append(f"array_compact(array({', '.join(scalars)}))")
        inside = f"concat({', '.join(lists)})"
    else:
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        cast = "array<variant>" if isinstance(kind, T.ArrayType) else "map<string,variant>"
        items = parts if isinstance(kind, T.ArrayType) else f"map_values({parts})"
        each = _problems(x, element, field, level + 1)
        inside = _NONE if each == _NONE else f"flatten(transform({items}, {x} -> {each}))"
    check = (
        f"CASE WHEN {v} IS NULL THEN {_NONE} WHEN {parts} IS NOT NULL THEN {inside} "
        f"WHEN schema_of_variant({v}) = 'VOID' THEN {_NONE} ELSE array({_found(field, 'wrong_type')}) END"
    )
    return _let(value, v, _let(f"try_variant_get({v}, '$', '{cast}')", parts, check))


def _union_problems(value: str, kind: T.DataType, field: str, level: int) -> str:
    """Problems of a list of tagged-union rows; unknown keys inside a row are let pass."""
    row, entries, body = f"row{level}", f"entries{level}", f"body{level}"
    kinds = ", ".join(f"'{k}'" for k in FOOTER_ROW_KINDS)
    wrong = " ".join(
        f"WHEN map_keys({entries})[0] = '{name}' THEN filter("
        + _problems(f"map_values({entries})[0]", schema, f"{field}.{name}", level + 1)
        + f", {body} -> {body}.problem = 'wrong_type')"
        for name, schema in FOOTER_ROW_SCHEMAS.items()
    )
    check = (
        f"CASE WHEN {entries} IS NULL OR size({entries}) <> 1 OR map_keys({entries})[0] NOT IN ({kinds}) "
        f"THEN array({_found(field, 'bad_row')}) {wrong} ELSE {_NONE} END"
    )
    each = _let(f"try_variant_get({row}, '$', 'map<string,variant>')", entries, check)
    rows = f"flatten(transform(try_variant_get({value}, '$', 'array<variant>'), {row} -> {each}))"
    return f"concat({_problems(value, kind, field, level + 1)}, coalesce({rows}, {_NONE}))"


def strict_parse(documents: DataFrame, schema: T.StructType, column: str = "content") -> DataFrame:
    """Add ``problems``, ``error_type``, ``error_field``, ``error_problem`` (NULL when accepted).

    ``error_type`` is empty_request_body for a missing body, invalid_json for
    text that is not JSON (an empty text included), and invalid_request_body
    for a wrong type or an unknown key, at any depth. ``problems`` lists all of
    them sorted by field; the other columns show the first. Keys are compared
    with exact case.
    """
    return _checked(documents, _problems("doc", schema, ""), column)


def _checked(documents: DataFrame, problems: str, column: str = "content") -> DataFrame:
    found = f"CASE WHEN doc IS NOT NULL THEN array_sort(array_distinct({problems})) END"
    checked = barrier(documents, "problems", F.expr(_let(f"try_parse_json(`{column}`)", "doc", found)))
    first = F.get("problems", F.lit(0))
    error = (
        F.when(F.col(column).isNull(), "empty_request_body")
        .when(F.col("problems").isNull(), "invalid_json")
        .when(F.size("problems") > 0, "invalid_request_body")
    )
    return (
        checked.withColumn("error_type", error)
        .withColumn("error_field", first["field"])
        .withColumn("error_problem", first["problem"])
    )


def strict_parse_all(documents: DataFrame) -> DataFrame:
    """``strict_parse`` with each document's own schema, in one scan; documents of unknown types are left out."""
    known = documents.filter(F.col("config_type").isin(*DOCUMENT_SCHEMAS))
    cases = " ".join(f"WHEN '{config_type}' THEN {_problems('doc', schema, '')}" for config_type, schema in DOCUMENT_SCHEMAS.items())
    return _checked(known, f"CASE config_type {cases} END")


def split_accepted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted documents without the error columns, and the rejected ones with them."""
    accepted = checked.filter(F.col("error_type").isNull()).drop("problems", "error_type", "error_field", "error_problem")
    return accepted, checked.filter(F.col("error_type").isNotNull())


def decode(documents: DataFrame, config_type: str) -> DataFrame:
    """``name, doc`` with the typed content of one type's documents.

    Reading is lenient about unknown keys; ``doc`` is NULL for text that is not
    JSON or holds a value of a wrong type.
    """
    schema = DOCUMENT_SCHEMAS[config_type]
    wrong = f"exists({_problems('parsed', schema, '')}, p -> p.problem <> 'unknown_field')"
    typed = f"try_variant_get(parsed, '$', '{schema.simpleString()}')"
    doc = F.expr(_let("try_parse_json(content)", "parsed", f"CASE WHEN parsed IS NOT NULL AND NOT {wrong} THEN {typed} END"))
    rows = documents.filter(F.col("config_type") == config_type).select("name", "content")
    return barrier(rows, "doc", doc).select("name", "doc")


# ---------------------------------------------------------------- encoding

# Zero of each scalar type, as SQL.
_ZERO = {T.StringType: "''", T.BooleanType: "false", T.LongType: "0L", T.DoubleType: "0.0D"}


def _encoded(value: str, kind: T.DataType, omit: bool, optional: bool, level: int = 0) -> str:
    """SQL giving the value as it is written: empty ``omit`` members NULL, other scalars never NULL."""
    x = f"x{level}"
    if isinstance(kind, T.StructType):
        members = []
        for f in kind.fields:
            inner = _encoded(
                f"{value}.`{f.name}`", f.dataType, f.metadata.get("omit", False), f.metadata.get("optional", False), level
            )
            members.append(f"'{f.name}', {inner}")
        record = f"named_struct({', '.join(members)})"
        return f"CASE WHEN {value} IS NOT NULL THEN {record} END" if optional else record
    if isinstance(kind, T.ArrayType):
        out = f"transform({value}, {x} -> {_encoded(x, kind.elementType, False, False, level + 1)})"
        return f"CASE WHEN size({value}) > 0 THEN {out} END" if omit else out
    if isinstance(kind, T.MapType):
        out = f"transform_values({value}, (k{level}, {x}) -> {_encoded(x, kind.valueType, False, False, level + 1)})"
        return f"CASE WHEN size({value}) > 0 THEN {out} END" if omit else out
    zero = _ZERO.get(type(kind))
    if zero is None or optional:
        return value
    return f"nullif({value}, {zero})" if omit else f"coalesce({value}, {zero})"


def encode(column: str, schema: T.StructType) -> Column:
    """JSON text of the typed document in a column.

    Empty members marked ``omit`` are left out, other scalars appear with their
    zero value, and a nested object always appears unless it is optional.
    """
    return F.to_json(F.expr(_encoded(f"`{column}`", schema, False, True)), {"ignoreNullFields": "true"})


# ---------------------------------------------------------------- explorer and footer structure


def flatten_filters(decoded: DataFrame) -> DataFrame:
    """Document → tab → filter tab → field, with the field's settings (NULL when it has none)."""
    tabs = decoded.select("name", F.posexplode("doc.explorerConfig").alias("tab_pos", "tab"))
    groups = tabs.select("name", "tab_pos", "tab.tabTitle", F.posexplode("tab.filters.tabs").alias("filter_pos", "filter"))
    fields = groups.select(
        "name", "tab_pos", "tabTitle", "filter_pos", "filter", F.posexplode("filter.fields").alias("field_pos", "field")
    )
    setting = F.try_element_at(F.col("filter.fieldsConfig"), F.col("field"))
    return fields.select(
        "name",
        F.col("tab_pos").cast("bigint").alias("tab_pos"),
        F.col("tabTitle").alias("tab_title"),
        F.col("filter_pos").cast("bigint").alias("filter_pos"),
        F.col("filter.title").alias("filter_title"),
        F.col("field_pos").cast("bigint").alias("field_pos"),
        "field",
        setting["label"].alias("label"),
        setting["type"].alias("type"),
        setting.isNotNull().alias("configured"),
    )


def flatten_columns(decoded: DataFrame) -> DataFrame:
    """Document → tab → table column."""
    tabs = decoded.select("name", F.posexplode("doc.explorerConfig").alias("tab_pos", "tab"))
    columns = tabs.select("name", "tab_pos", "tab.table.fields", F.explode("tab.table.columns").alias("key", "column"))
    return columns.select(
        "name",
        F.col("tab_pos").cast("bigint").alias("tab_pos"),
        "key",
        "column.field",
        "column.title",
        "column.type",
        "column.accessorPath",
        F.array_contains("fields", F.col("key")).alias("listed"),
    )


def union_row(row: Column) -> Column:
    """STRUCT(kind, body, error) of a tagged-union VARIANT: exactly one known key."""

    def read(v: Column) -> Column:
        entries = variants.as_map(v)
        key = F.get(F.map_keys(entries), F.lit(0))
        error = (
            F.when(entries.isNull(), "row is not an object")
            .when(
                F.size(entries) != 1,
                F.concat(F.lit("FooterRow must have exactly one key, got "), F.size(entries).cast("string")),
            )
            .when(~key.isin(*FOOTER_ROW_KINDS), F.concat(F.lit("unknown FooterRow key: "), key))
        )
        good = error.isNull()
        return F.struct(
            F.when(good, key).alias("kind"),
            F.when(good, F.get(F.map_values(entries), F.lit(0))).alias("body"),
            error.alias("error"),
        )

    return let(row, read)


def footer_rows(documents: DataFrame) -> DataFrame:
    """Rows of all footer columns, those inside nested sections included.

    ``name, side, path, kind, error, body``: ``path`` counts column and row at
    each nesting level. Levels are unrolled one after the other until none holds a
    section, each written to the shared folder, so that it is parsed once and the
    plan grows with the nesting alone.
    """
    text = documents.filter(F.col("config_type") == "nav")
    parsed = text.select("name", F.try_parse_json("content").alias("v"))
    sides = [
        F.struct(
            F.lit(side).alias("side"),
            F.try_variant_get("v", f"$.footerProps.{side}.columns", "array<variant>").alias("columns"),
        )
        for side in ("rightSection", "leftSection")
    ]
    level = parsed.select("name", F.explode(F.array(*sides)).alias("s")).select(
        "name", "s.side", F.lit("").alias("path"), "s.columns"
    )
    out = None
    while out is None or not level.isEmpty():
        columns = level.select("name", "side", "path", F.posexplode("columns").alias("c", "column"))
        rows = columns.select(
            "name", "side", "path", "c", F.posexplode(F.try_variant_get("column", "$.rows", "array<variant>")).alias("r", "row")
        )
        path = F.concat("path", F.lit("/"), F.col("c").cast("string"), F.lit("."), F.col("r").cast("string"))
        rows = rows.select("name", "side", path.alias("path"), union_row(F.col("row")).alias("u"))
        rows = stored(rows.select("name", "side", "path", "u.kind", "u.error", "u.body"))
        out = rows if out is None else out.unionByName(rows)
        level = rows.filter(F.col("kind") == "Section").select(
            "name", "side", "path", F.try_variant_get("body", "$.columns", "array<variant>").alias("columns")
        )
    return out


# ---------------------------------------------------------------- project documents

# One address, alone or in angle brackets after a display name.
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-\x{80}-\x{10FFFF}]+"
_ADDRESS = rf"(?:{_ATOM}(?:\.{_ATOM})*|\"[^\"\\]*\")@{_ATOM}(?:\.{_ATOM})*"
EMAIL = rf"^(?:{_ADDRESS}|(?:\"[^\"]*\"|[^\"<>@,;:\\\[\]()]*)\s*<{_ADDRESS}>)$"
EMAIL_ERROR = "contact_email must be a valid email address"
REQUIRED = ("title", "contact_email", "org_title", "description", "project_title")


def validate_projects(projects: DataFrame, require_repo: bool = True) -> DataFrame:
    """Trim the six fields, normalise ``src_repo`` and add ``error`` (first problem, else NULL).

    Missing fields come first, in the listed order and the repository last,
    then the e-mail address, then the repository address.
    """
    fields = [f.name for f in PROJECT.fields]
    trimmed = projects.withColumns({c: F.coalesce(strip(F.col(c)), F.lit("")) for c in fields})
    required = REQUIRED + (("src_repo",) if require_repo else ())
    missing = F.coalesce(*[F.when(F.col(c) == "", f"{c} is required") for c in required])
    repo = normalize_repo_url(F.col("src_repo"))
    error = F.coalesce(
        missing,
        F.when(~F.col("contact_email").rlike(EMAIL), EMAIL_ERROR),
        F.when(F.col("src_repo") != "", repo["error"]),
    )
    return trimmed.withColumn("error", error).withColumn(
        "src_repo", F.when(F.col("error").isNull(), F.coalesce(repo["url"], F.col("src_repo"))).otherwise(F.col("src_repo"))
    )


def repository_identities(rows: DataFrame, column: str = "src_repo") -> DataFrame:
    """Add ``repo_host, repo_owner, repo_name, repo_url`` (NULL for invalid addresses)."""
    identity = repo_identity(F.col(column))
    return rows.withColumns(
        {
            "repo_host": identity["host"],
            "repo_owner": identity["owner"],
            "repo_name": identity["repo"],
            "repo_url": identity["url"],
        }
    )


def requested_identities(rows: DataFrame, column: str) -> DataFrame:
    """``repository_identities`` for requests that may name just ``owner/name``."""
    out = rows.withColumn("_url", requested_repo_url(F.col(column)))
    return repository_identities(out, "_url").drop("_url")


def init_defaults(projects: DataFrame) -> DataFrame:
    """Organisation title from the id; empty project title and title become the project name."""
    org = F.substring_index("project_id", "/", 1)
    project = F.regexp_replace("project_id", "^[^/]*/", "")
    return projects.withColumns(
        {
            "org_title": strip(org),
            "project_title": F.when(blank_to_null(F.col("project_title")).isNull(), project).otherwise(F.col("project_title")),
            "title": F.when(blank_to_null(F.col("title")).isNull(), project).otherwise(F.col("title")),
        }
    )


def project_summary(documents: DataFrame, thumbnails: DataFrame | None = None, url_prefix: str = "/git/projects") -> DataFrame:
    """Listing rows of the readable project documents whose id holds a slash.

    ``thumbnails`` holds ``organization, project`` of projects that have one;
    ``ordered_summary`` sorts the listing.
    """
    parsed = decode(documents, "projects").filter(F.col("doc").isNotNull() & F.col("name").contains("/"))
    project = strip(F.regexp_replace("name", "^[^/]*/", ""))
    rows = parsed.select(
        strip(F.substring_index("name", "/", 1)).alias("organization"),
        project.alias("project"),
        first_non_blank(F.col("doc.title"), F.col("doc.project_title"), project).alias("title"),
        F.coalesce(strip(F.col("doc.contact_email")), F.lit("")).alias("contact_email"),
        F.coalesce(strip(F.col("doc.description")), F.lit("")).alias("description"),
    )
    rows = rows.withColumn("title", F.coalesce("title", F.lit("")))
    rows = rows.withColumn("resource_path", project_path(F.col("organization"), F.col("project")))
    if thumbnails is None:
        return rows.withColumn("thumbnail_url", F.lit(None).cast("string"))
    url = F.concat_ws(
        "/", F.lit(url_prefix), path_escape(F.col("organization")), path_escape(F.col("project")), F.lit("thumbnail")
    )
    has = thumbnails.select("organization", "project").distinct().withColumn("_has", F.lit(True))
    joined = rows.join(has, ["organization", "project"], "left")
    return joined.withColumn("thumbnail_url", F.when(F.col("_has"), url)).drop("_has")


def ordered_summary(summary: DataFrame) -> DataFrame:
    """Title, organisation, project, each without regard to case."""
    return summary.orderBy(*[F.lower(strip(F.col(c))) for c in ("title", "organization", "project")])


def is_empty(doc: Column, config_type: str) -> Column:
    """Whether a typed document counts as empty."""

    def none(path: Column) -> Column:
        return F.coalesce(F.size(path), F.lit(0)) <= 0

    if config_type == "explorer":
        return none(doc["explorerConfig"])
    if config_type == "file_summary":
        return none(doc["config"])
    if config_type == "nav":
        footer = doc["footerProps"]
        return (
            none(doc["headerProps"]["leftnav"])
            & footer["rightSection"].isNull()
            & none(footer["bottomLinks"])
            & none(footer["columnLinks"])
        )
    empty = F.lit(True)
    for field in PROJECT.fields:
        empty = empty & (F.coalesce(doc[field.name], F.lit("")) == "")
    return empty
