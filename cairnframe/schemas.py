"""Schemas of the configuration documents and of the state tables.

Fixed values: every name below is a key of the stored JSON or a stored column.
``omit`` marks keys left out of encoded JSON when empty, ``optional`` marks
nested objects that may be absent. A VARIANT member takes any JSON value, a map
of VARIANT any object.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    VariantType,
)

TEXT, FLAG, NUMBER, LONG, ANY = StringType(), BooleanType(), DoubleType(), LongType(), VariantType()
TEXTS = ArrayType(TEXT)
ANY_OBJECT = MapType(TEXT, ANY)


def _record(*fields) -> StructType:
    """Fields as ``"name"`` (text) or ``("name", type)``.

    After the name ``?`` marks omit, ``*`` optional and omit, ``!`` a list of tagged-union rows.
    """
    out = []
    for field in fields:
        name, kind = field if isinstance(field, tuple) else (field, TEXT)
        bare = name.rstrip("?*!")
        flags = {"omit": name[-1] in "?*", "optional": name[-1] == "*", "union": name[-1] == "!"}
        out.append(StructField(bare, kind, True, {k: v for k, v in flags.items() if v}))
    return StructType(out)


CONFIG_TYPES = ("explorer", "nav", "file_summary", "project", "projects")
DEFAULT_TYPE, DEFAULT_ID = "explorer", "default"
COLUMN_TYPES = ("string", "number", "date", "array", "link", "boolean", "paragraphs")

PROJECT = _record("title", "contact_email", "src_repo", "org_title", "description", "project_title")

COLUMN = _record(
    "field", "title", "accessorPath?", "type?", "cellRenderFunction?", ("params?", ANY_OBJECT), "width?",
    ("sortable?", FLAG), ("visable?", FLAG),
)
FILE_SUMMARY = _record(
    ("config", MapType(TEXT, COLUMN)), "barChartColor", "defaultProject", ("binslicePoints", ArrayType(LONG)), "idField", "index"
)

FIELD_CONFIG = _record("field?", "dataField?", "index?", "label", "type?")
FILTER_TAB = _record("title?", ("fields", TEXTS), ("fieldsConfig?", MapType(TEXT, FIELD_CONFIG)))
DETAILS = _record("panel?", "mode?", "idField?", "filterField?", "title?", "nodeType?", ("nodeFields?", MapType(TEXT, TEXT)))
TABLE = _record(("enabled", FLAG), ("fields", TEXTS), ("columns?", MapType(TEXT, COLUMN)), ("detailsConfig", DETAILS))
MANIFEST = _record(
    "resourceIndexType?", "resourceIdField?", "referenceIdFieldInResourceIndex?", "referenceIdFieldInDataIndex?"
)
DATA_SOURCE = _record(
    "dataType",
    "nodeCountTitle",
    ("fieldMapping?", ArrayType(_record("field?", "name?"))),
    ("accessibleFieldCheckList?", TEXTS),
    "accessibleValidationField?",
    ("manifestMapping", MANIFEST),
)
BUTTON_ARGS = _record(
    "resourceIndexType?",
    "resourceIdField?",
    "referenceIdFieldInDataIndex?",
    "referenceIdFieldInResourceIndex?",
    ("fileFields?", TEXTS),
)
BUTTON = _record(
    ("enabled?", FLAG), "type?", "action?", "title?", "leftIcon?", "rightIcon?", "fileName?", ("actionArgs", BUTTON_ARGS)
)
EXPLORER_TAB = _record(
    "tabTitle",
    ("guppyConfig", DATA_SOURCE),
    ("charts?", MapType(TEXT, _record("chartType", "title"))),
    ("filters", _record(("tabs", ArrayType(FILTER_TAB)))),
    ("table", TABLE),
    ("dropdowns?", ANY_OBJECT),
    ("buttons?", ArrayType(BUTTON)),
    ("loginForDownload?", FLAG),
    ("preFilters?", ANY_OBJECT),
)
EXPLORER = _record(
    ("sharedFilters", _record(("defined", MapType(TEXT, ArrayType(_record("index", "field")))))),
    ("explorerConfig", ArrayType(EXPLORER_TAB)),
    ("fileActions", _record(("extensions?", MapType(TEXT, TEXTS)), ("actions?", MapType(TEXT, TEXT)))),
)

STYLE = _record("root", "layout?", "mergeMode?", "navigationPanel?", "button?", "label?", "item?")
# Rows of a footer column are tagged unions: an object with exactly one of these keys.
FOOTER_ROW_KINDS = ("Icon", "Text", "Link", "Links", "Section")
FOOTER_COLUMN = _record("heading?", ("rows!", ArrayType(ANY)), ("classNames*", STYLE), ("basePage?", FLAG))
FOOTER_SECTION = _record(("columns", ArrayType(FOOTER_COLUMN)), "className?", ("basePage?", FLAG))
FOOTER_LOGO = _record(
    "logolight", "logo", "description", ("width", LONG), ("height", LONG), "className?", "href?"
)
FOOTER_TEXT = _record("text", "className?")
FOOTER_LINK = _record("text", "className?", "href", "linkType?")
FOOTER_ROW_SCHEMAS = {
    "Icon": FOOTER_LOGO,
    "Text": FOOTER_TEXT,
    "Link": FOOTER_LINK,
    "Links": _record(("links", ArrayType(FOOTER_LINK)), "className?"),
}
COLUMN_LINKS = _record("heading", ("items", ArrayType(_record("text", "href?", "linkType?"))))
FOOTER = _record(
    ("bottomLinks?", ArrayType(_record("text", "href"))),
    ("columnLinks?", ArrayType(COLUMN_LINKS)),
    ("footerLogos?", ArrayType(FOOTER_LOGO)),
    ("footerRightLogos?", ArrayType(FOOTER_LOGO)),
    ("rightSection*", FOOTER_SECTION),
    ("leftSection*", FOOTER_SECTION),
    ("classNames*", STYLE),
    ("customFooter?", ANY),
    ("basePage?", FLAG),
)
NAV_BUTTON = _record(
    "icon", "tooltip", "href", ("noBasePath*", FLAG), "name", "iconHeight?", "title?", ("classNames*", STYLE)
)
NAV_LOGO = _record(
    "src", "title?", "description?", ("width?", NUMBER), ("height?", NUMBER), ("noBasePath*", FLAG), ("divider*", FLAG),
    "basePath?", "href", ("onToggle?", ANY), ("basepage*", FLAG), ("classNames*", STYLE),
)
NAVIGATION = _record(
    ("logo*", NAV_LOGO), ("items", ArrayType(NAV_BUTTON)), "title?", ("loginIcon?", ANY), ("classNames*", STYLE)
)
TOP_ITEM = _record(("classNames", _record("button", "label", "root")), "href?", "name?")
HEADER = _record(
    ("topBar", _record(("items?", ArrayType(TOP_ITEM)), "loginButtonVisibility?")),
    ("navigation", NAVIGATION),
    ("leftnav", ArrayType(_record("title", "description", "icon", "href", ("perms", ANY)))),
    ("basePage?", FLAG),
)
NAV = _record(("headerProps", HEADER), ("footerProps", FOOTER), ("headerMetadata", _record("title", "content", "key")))

DOCUMENT_SCHEMAS = {"explorer": EXPLORER, "nav": NAV, "file_summary": FILE_SUMMARY, "project": PROJECT, "projects": PROJECT}
