"""Directory graph: studies, their root directories and everything below.

``vertices`` has ``id, label, name, auth_resource_path``; ``edges`` has
``src, dst, label``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grants import project_id_parts, project_id_path
from ..functions.text import segments, valid_path
from ..sources.tables import stored

# Labels of the graph.
STUDY_LABEL = "ResearchStudy"
ROOT_EDGE = "rootDir_Directory"
# Requests of one directory, and its entries, that one task brings together.
BLOCK_ROWS = 4_000


def has_label(vertices: DataFrame, label: str) -> DataFrame:
    return vertices.filter(F.col("label") == label)


def has_value(vertices: DataFrame, field: str, value) -> DataFrame:
    return vertices.filter(F.col(field) == F.lit(value))


def within(vertices: DataFrame, field: str, values: DataFrame, column: str) -> DataFrame:
    """Vertices whose field is listed in a table (of any length)."""
    listed = values.select(F.col(column).alias(field)).distinct()
    return vertices.join(listed, field, "left_semi")


def with_out_edge(vertices: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Vertices that have at least one out-edge with the label."""
    sources = edges.filter(F.col("label") == label).select(F.col("src").alias("id"))
    return vertices.join(sources, "id", "left_semi")


def children(vertices: DataFrame, edges: DataFrame, edge_label: str | None = None) -> DataFrame:
    """``src`` with its out-neighbour as ``child_id, child_label, child_name, child_auth``."""
    if edge_label is not None:
        edges = edges.filter(F.col("label") == edge_label)
    target = vertices.select(
        F.col("id").alias("dst"),
        F.col("label").alias("child_label"),
        F.col("name").alias("child_name"),
        F.col("auth_resource_path").alias("child_auth"),
    )
    return edges.select("src", "dst").join(target, "dst").withColumnRenamed("dst", "child_id")


def out_or_null(frontier: DataFrame, kids: DataFrame, key: str = "id") -> DataFrame:
    """One row per out-neighbour of ``key``, and one with a null child where there is none.

    Written as an inner join and an anti join: a directory with very many
    children is on the right, where a left join could not be split.
    """
    linked = frontier.join(kids, frontier[key] == kids["src"]).drop("src")
    alone = frontier.join(linked.select(key).distinct(), key, "left_anti")
    return linked.unionByName(alone, allowMissingColumns=True)


def list_projects(vertices: DataFrame, edges: DataFrame, grants: DataFrame) -> DataFrame:
    """Distinct ``user_id, project`` paths of granted studies that have a root directory.

    ``grants`` holds ``user_id, resource``.
    """
    studies = with_out_edge(has_label(vertices, STUDY_LABEL), edges, ROOT_EDGE)
    paths = studies.select(F.col("auth_resource_path").alias("resource")).distinct()
    granted = grants.select("user_id", "resource").distinct()
    return granted.join(paths, "resource").select("user_id", F.col("resource").alias("project"))


def roots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``project, id``: the root directories of every study."""
    studies = has_label(vertices, STUDY_LABEL).select(F.col("id").alias("src"), F.col("auth_resource_path").alias("project"))
    root_edges = edges.filter(F.col("label") == ROOT_EDGE).select("src", F.col("dst").alias("id"))
    return studies.join(root_edges, "src").select("project", "id")


def _below(frontier: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``frontier`` rows with each child of their ``id``."""
    reached = frontier.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("child_id")), "id")
    target = vertices.select(
        F.col("id").alias("child_id"),
        F.col("label").alias("child_label"),
        F.col("name").alias("child_name"),
        F.col("auth_resource_path").alias("child_auth"),
    )
    return reached.join(target, "child_id")


_CHILD = ("child_id", "child_label", "child_name", "child_auth")


def list_directory(vertices: DataFrame, edges: DataFrame, project: str, path: str) -> DataFrame:
    """``id, label, name, auth_resource_path`` of the entries below one directory of one project.

    ``/`` lists the root's children that belong to the project. Deeper, each
    segment must match a child's name within the project, and the last hop is
    not filtered: a directory without children gives one all-NULL row.

    The path is known here, so all its steps are one query that runs when its rows are asked
    for: a join with the edges and one with the vertices for a step, each on what the step
    before reached. Vertices of other projects and names are filtered in the scan.
    """
    own = vertices.filter(F.col("auth_resource_path") == F.lit(project).cast("string"))
    studies = has_label(own, STUDY_LABEL).select(F.col("id").alias("src"))
    at = edges.filter(F.col("label") == ROOT_EDGE).join(studies, "src").select(F.col("dst").alias("id"))
    if path == "/":
        entries = _below(at, own, edges).select(*_CHILD)
    else:
        for segment in (path or "").strip("/").split("/"):
            reached = at.join(edges.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id"))
            at = reached.join(has_value(own, "name", segment).select("id"), "id")
        below = _below(at, vertices, edges).select("id", *_CHILD)
        empty = at.join(below.select("id").distinct(), "id", "left_anti")
        entries = below.unionByName(empty, allowMissingColumns=True).select(*_CHILD)
    valid = F.coalesce(valid_path(F.lit(path).cast("string")), F.lit(False))
    return entries.filter(valid).select(
        F.col("child_id").alias("id"), F.col("child_label").alias("label"), F.col("child_name").alias("name"), F.col("child_auth").alias("auth_resource_path")
    )


def resolve_paths(vertices: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``list_directory`` for a table of ``request_id, project, path``.

    One row per listed entry with ``matched`` true (its vertex is all NULL for an
    empty directory); one row with ``matched`` false for a directory that does
    not exist, and with ``error_type`` for a path that is not valid. Equal
    (project, path) pairs are resolved once, and a directory is listed once however many paths lead to it.

    The edges that a path can take, those to a vertex of an asked project and name, are worked out
    first. The paths that are still on their way meet them by source, project and name at once, so a step
    makes a row for a match, not for every entry of the directories on the way.

    The walk runs here, level by level, until no path goes deeper. Each level is
    written to the shared folder: it is computed once, its size is known to the
    planner, and a lost executor repeats one level at most.
    """
    checked = requests.withColumn(
        "error_type", F.when(~F.coalesce(valid_path(F.col("path")), F.lit(False)), "invalid_directory")
    )
    pairs = checked.filter("error_type IS NULL").select("project", "path").distinct()
    pairs = pairs.withColumn("_parts", F.when(F.col("path") == "/", F.array()).otherwise(segments(F.col("path"))))
    at_root = stored(pairs.join(roots(vertices, edges), "project"))
    steps = stored(_steps(vertices, edges, at_root))

    ended = [at_root.filter(F.size("_parts") == 0).select("project", "path", "id", F.lit(True).alias("_root"))]
    frontier = at_root.filter(F.size("_parts") > 0).select("project", "path", "_parts", "id")
    depth = 0
    while not frontier.isEmpty():
        asking = frontier.withColumn("_name", F.get("_parts", F.lit(depth)))
        reached = asking.join(steps, ["id", "project", "_name"])
        reached = stored(reached.select("project", "path", "_parts", F.col("child_id").alias("id")))
        depth += 1
        ended.append(reached.filter(F.size("_parts") == depth).select("project", "path", "id", F.lit(False).alias("_root")))
        frontier = reached.filter(F.size("_parts") > depth)

    reached = reduce(DataFrame.unionByName, ended)
    entries = stored(_below(reached.select("id").distinct(), vertices, edges).select("id", *_CHILD))
    own = entries.select("id", F.col("child_auth").alias("project")).distinct()
    found = stored(reached.filter("NOT _root").unionByName(reached.filter("_root").join(own, ["id", "project"], "left_semi")))
    asked = checked.join(found, ["project", "path"])
    listed = _listed(asked, entries).filter(~F.col("_root") | (F.col("child_auth") == F.col("project")))
    empty = asked.join(entries.select("id").distinct(), "id", "left_anti")
    matched = listed.unionByName(empty, allowMissingColumns=True).withColumn("matched", F.lit(True))
    other = checked.join(found.select("project", "path").distinct(), ["project", "path"], "left_anti").withColumn("matched", F.lit(False))
    return matched.unionByName(other, allowMissingColumns=True).select(
        "request_id",
        "project",
        "path",
        "error_type",
        "matched",
        F.col("child_id").alias("id"),
        F.col("child_label").alias("label"),
        F.col("child_name").alias("name"),
        F.col("child_auth").alias("auth_resource_path"),
    )


def _steps(vertices: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, project, _name, child_id``: the edges to vertices of a project and name that a row of ``asked`` has among its ``_parts``."""
    wanted = asked.select("project", F.explode("_parts").alias("_name")).distinct()
    named = vertices.select(F.col("id").alias("child_id"), F.col("auth_resource_path").alias("project"), F.col("name").alias("_name"))
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("child_id")).join(named.join(wanted, ["project", "_name"], "left_semi"), "child_id")


def _listed(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``asked`` rows with each of the ``entries`` of their ``id``.

    The rows of a directory are as many as its requests times its entries, so both are cut
    into blocks and every pair of blocks has a key of its own: no directory is one task's work, and what is
    shuffled besides the two tables is a row for thousands of the answer.
    """

    def blocks(table: DataFrame, out: str) -> DataFrame:
        return table.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(out))

    sizes = stored(blocks(asked, "_n_asked").join(blocks(entries, "_n_entries"), "id"))

    def dealt(table: DataFrame, key: str, own: str, other: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.col(f"_n_{other}") - 1)).alias(f"_{other}")
        block = F.pmod(F.xxhash64(key), F.col(f"_n_{own}")).alias(f"_{own}")
        cut = table.join(sizes, "id").select(*table.columns, block, each)
        # A number given here stays: planned by their bytes, blocks would be put together again.
        return cut.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    keys = ["id", "_asked", "_entries"]
    return dealt(asked, "request_id", "asked", "entries").join(dealt(entries, "child_id", "entries", "asked"), keys).drop("_asked", "_entries")


def parse_project_ids(ids: DataFrame, column: str) -> DataFrame:
    """Add ``resource_path`` of ``prog-proj`` ids, or ``error_type`` when there are not two parts."""
    bad = project_id_parts(F.col(column)).isNull()
    return ids.withColumn("resource_path", project_id_path(F.col(column))).withColumn(
        "error_type", F.when(bad, "invalid_project_id")
    )


def check_paths(requests: DataFrame, column: str = "path") -> DataFrame:
    """Add ``valid`` and ``error_type`` for directory paths (missing paths are invalid)."""
    ok: Column = F.coalesce(valid_path(F.col(column)), F.lit(False))
    return requests.withColumn("valid", ok).withColumn("error_type", F.when(~ok, "invalid_directory"))
