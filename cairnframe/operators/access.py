"""Access grants: who may do what on which resource path.

``grants`` has ``user_id, resource, method, service``; ``allowed`` has
``user_id, resource``. Checks take a table of asked (user, project) pairs, so
the output never outgrows what was asked: a resource held by very many users,
or a user holding everything, does not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants
from ..functions.grants import (
    admin_paths,
    allows,
    is_project_id,
    org_of_id,
    org_path,
    org_projects_path,
    project_id_parts,
    project_of_id,
    project_path,
    resource_org,
)
from ..functions.text import barrier, let, normalize_resource_path


def _snapshot_blocks(snapshots: DataFrame) -> DataFrame:
    """``user_id`` with ``access``: resource → entries of the block that counts, NULL when there is none."""
    body = F.from_json("snapshot", "authz variant, project_access variant")

    def blocks(b: Column) -> Column:
        return F.struct(variants.as_map(b["authz"]).alias("authz"), variants.as_map(b["project_access"]).alias("older"))

    def chosen(m: Column) -> Column:
        return F.when(F.size(m["authz"]) > 0, m["authz"]).otherwise(m["older"])

    return barrier(snapshots, "access", let(body, lambda b: let(blocks(b), chosen))).select("user_id", "access")


def explode_grants(snapshots: DataFrame) -> DataFrame:
    """``user_id, resource, method, service`` from JSON snapshots.

    Uses ``authz`` when it is a non-empty object, else ``project_access``.
    Values that are not lists and entries that are not objects are skipped; a
    missing or non-text method or service is empty.
    """
    per_resource = _snapshot_blocks(snapshots).select("user_id", F.explode_outer("access").alias("resource", "entries"))
    entries = per_resource.select("user_id", "resource", F.explode(variants.as_array(F.col("entries"))).alias("entry"))
    return entries.filter(variants.is_object(F.col("entry"))).select(
        "user_id",
        "resource",
        variants.text_or(F.col("entry"), "$.method", "").alias("method"),
        variants.text_or(F.col("entry"), "$.service", "").alias("service"),
    )


def snapshot_errors(snapshots: DataFrame) -> DataFrame:
    """``user_id, error`` for snapshots with neither block."""
    # Fixed value: the message.
    message = "authorization snapshot response did not include authz/project_access"
    return _snapshot_blocks(snapshots).filter(F.col("access").isNull()).select("user_id", F.lit(message).alias("error"))


def allowed_resources(grants: DataFrame, method: str, service: str) -> DataFrame:
    """Distinct ``user_id, resource`` on which the method and service are allowed."""
    kept = grants.filter(allows(F.col("method"), F.col("service"), method, service))
    return kept.select("user_id", "resource").distinct()


def _allowed_paths(allowed: DataFrame) -> DataFrame:
    """Distinct ``user_id, path`` with the normalised path of every allowed resource."""
    normalized = barrier(allowed.select("user_id", "resource"), "path", normalize_resource_path(F.col("resource")))
    return normalized.select("user_id", "path").distinct()


def filter_projects(projects: DataFrame, allowed: DataFrame) -> DataFrame:
    """``user_id`` plus project columns for every project a user may see.

    The id must be ``org/project``; the normalised allowed path must equal
    ``/programs/org/projects/project``. A user without grants sees nothing.
    There is one output row per matching grant, never more.
    """
    p = projects.filter(is_project_id(F.col("project_id"))).withColumn(
        "path", project_path(org_of_id(F.col("project_id")), project_of_id(F.col("project_id")))
    )
    return _allowed_paths(allowed).join(p, "path").drop("path")


def allowed_orgs(allowed: DataFrame) -> DataFrame:
    """Distinct ``user_id, organization`` named by the user's ``/programs/…`` resources."""
    orgs = _allowed_paths(allowed).select("user_id", resource_org(F.col("path")).alias("organization"))
    return orgs.filter("organization IS NOT NULL").distinct()


def org_members(asks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Asked ``(user_id, organization)`` rows that are allowed."""
    return asks.join(allowed_orgs(allowed), ["user_id", "organization"], "left_semi")


def admin_allows(asks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Asked ``(user_id, organization, project)`` rows with an administering grant.

    Each ask becomes its six possible resources, matched by equality on the
    text as granted (no normalisation).
    """
    asked = asks.select("user_id", "organization", "project").distinct()
    candidates = asked.withColumn("resource", F.explode(admin_paths(F.col("organization"), F.col("project"))))
    allowed = allowed.select("user_id", "resource").distinct()
    hits = candidates.join(allowed, ["user_id", "resource"], "left_semi")
    return asks.join(hits.select("user_id", "organization", "project").distinct(), ["user_id", "organization", "project"], "left_semi")


def request_access(asks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Asks with ``resource_path``, ``accessible`` and ``request_access`` (= not readable)."""
    path = project_path(F.col("organization"), F.col("project"))
    readable = _allowed_paths(allowed).select("user_id", F.col("path").alias("resource_path"), F.lit(True).alias("accessible"))
    return (
        asks.withColumn("resource_path", path)
        .join(readable, ["user_id", "resource_path"], "left")
        .withColumn("accessible", F.coalesce("accessible", F.lit(False)))
        .withColumn("request_access", ~F.col("accessible"))
    )


def org_capabilities(asks: DataFrame, grants: DataFrame) -> DataFrame:
    """Asked ``(user_id, organization)`` rows with the four organisation capabilities."""
    org = F.regexp_extract("resource", "^/programs/([^/]+)(/projects)?$", 1)
    scoped = grants.withColumn("organization", org).filter("organization <> ''")
    on_org = F.col("resource") == org_path(F.col("organization"))
    on_projects = F.col("resource") == org_projects_path(F.col("organization"))

    def granted(method: str, service: str) -> Column:
        return allows(F.col("method"), F.col("service"), method, service)

    flags = scoped.groupBy("user_id", "organization").agg(
        F.bool_or(on_projects & granted("create-descendant", "arborist")).alias("can_create_projects"),
        F.bool_or(on_org & granted("manage-owners", "arborist")).alias("can_manage_people"),
        F.bool_or(on_org & granted("delete", "*")).alias("_delete"),
    )
    joined = asks.join(flags, ["user_id", "organization"], "left")
    create, people, delete = (
        F.coalesce(F.col(c), F.lit(False)) for c in ("can_create_projects", "can_manage_people", "_delete")
    )
    return (
        joined.withColumn("can_access_settings", F.lit(True))
        .withColumn("can_delete_org", people | delete)
        .withColumn("can_create_projects", create)
        .withColumn("can_manage_people", people)
        .drop("_delete")
    )


def project_capabilities(asks: DataFrame, grants: DataFrame) -> DataFrame:
    """Asks with ``can_manage_settings``: update by any service on the project's resource path."""
    updaters = allowed_resources(grants, "update", "*").withColumn("can_manage_settings", F.lit(True))
    return asks.join(
        updaters.withColumnRenamed("resource", "resource_path"), ["user_id", "resource_path"], "left"
    ).withColumn("can_manage_settings", F.coalesce("can_manage_settings", F.lit(False)))


def route_policy(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Decision on configuration requests: adds ``outcome`` and ``message``.

    ``requests``: ``request_id, user_id, method, config_type, config_id, has_token``.
    Explorer documents need read (GET) or create (PUT, DELETE) on the project
    named by the id; other types are public to GET and closed to PUT and DELETE.
    """
    kind = F.coalesce(F.nullif("config_type", F.lit("")), F.lit("explorer"))
    config_id = F.coalesce(F.nullif("config_id", F.lit("")), F.lit("default"))
    permission = F.when(F.col("method") == "GET", "read").when(F.col("method").isin("PUT", "DELETE"), "create")
    parts = project_id_parts(F.col("_id"))
    asked = (
        requests.withColumn("_kind", kind)
        .withColumn("_id", config_id)
        .withColumn("_permission", permission)
        .withColumn("_resource", project_path(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    )
    # One pass over the grants for both permissions.
    held = (
        grants.withColumn("_permission", F.explode(F.array(F.lit("read"), F.lit("create"))))
        .filter(allows(F.col("method"), F.col("service"), F.col("_permission"), "*"))
        .select("user_id", "_permission", F.col("resource").alias("_resource"))
        .distinct()
    )
    any_held = held.select("user_id", "_permission").distinct().withColumn("_any", F.lit(True))
    joined = asked.join(held.withColumn("_exact", F.lit(True)), ["user_id", "_permission", "_resource"], "left").join(
        any_held, ["user_id", "_permission"], "left"
    )
    explorer = F.col("_kind") == "explorer"
    outcome = (
        F.when(F.col("_permission").isNull(), "method_not_allowed")
        .when(~explorer & (F.col("method") == "GET"), "allowed")
        .when(~explorer, "forbidden")
        .when(~F.col("has_token"), "missing_authorization")
        .when(F.col("_resource").isNull(), "invalid_project_id")
        .when(F.col("_exact"), "allowed")
        .otherwise("forbidden")
    )
    denied = F.concat(F.lit("User is not allowed to "), F.col("_permission"))
    # The messages.
    message = (
        F.when(F.col("outcome") == "method_not_allowed", F.concat(F.lit("Unsupported HTTP method "), F.col("method")))
        .when(F.col("outcome") == "missing_authorization", "Authorization token not provided")
        .when(F.col("outcome") == "invalid_project_id", "incorrect path")
        .when(F.col("outcome") == "allowed", None)
        .when(~explorer, "must use route-specific authorization; refusing global /programs fallback")
        .when(F.col("_any"), F.concat(denied, F.lit(" on resource path: "), F.col("_resource")))
        .otherwise(F.concat(denied, F.lit(" on any resource path")))
    )
    return joined.withColumn("outcome", outcome).withColumn("message", message).select(
        *requests.columns, "outcome", "message"
    )
