"""Access-grant predicates and resource paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def allows(grant_method: Column, grant_service: Column, method: Column | str, service: Column | str) -> Column:
    """A grant matches when its method is the asked one or ``*``, and its service is
    ``*``, the asked one, or the asked service is itself ``*``."""
    method = F.lit(method) if isinstance(method, str) else method
    service = F.lit(service) if isinstance(service, str) else service
    return ((grant_method == method) | (grant_method == "*")) & (
        (grant_service == "*") | (service == "*") | (grant_service == service)
    )


def org_path(organization: Column) -> Column:
    return F.concat(F.lit("/programs/"), organization)


def org_projects_path(organization: Column) -> Column:
    return F.concat(F.lit("/programs/"), organization, F.lit("/projects"))


def project_path(organization: Column, project: Column) -> Column:
    return F.concat(F.lit("/programs/"), organization, F.lit("/projects/"), project)


def resource_org(normalized: Column) -> Column:
    """Organisation of a normalised ``/programs/<org>…`` path, else NULL."""
    return F.nullif(F.regexp_extract(normalized, "^/programs/([^/]+)", 1), F.lit(""))


def admin_paths(organization: Column, project: Column) -> Column:
    """The resources any of which lets its holder administer the project."""
    return F.array(
        F.lit("*"),
        F.lit("/"),
        F.lit("/programs"),
        org_path(organization),
        org_projects_path(organization),
        project_path(organization, project),
    )


def project_id_parts(project_id: Column) -> Column:
    """``prog-proj`` split in two; NULL unless there are exactly two parts."""
    parts = F.split(project_id, "-")
    return F.when(F.size(parts) == 2, parts)


def project_id_path(project_id: Column) -> Column:
    parts = project_id_parts(project_id)
    return project_path(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def org_of_id(project_id: Column) -> Column:
    """Text before the first slash of ``org/project``, NULL without a slash."""
    return F.when(project_id.contains("/"), F.substring_index(project_id, "/", 1))


def project_of_id(project_id: Column) -> Column:
    """Text after the first slash of ``org/project``."""
    return F.when(project_id.contains("/"), F.regexp_replace(project_id, "^[^/]*/", ""))


def is_project_id(project_id: Column) -> Column:
    """``org/project`` with a non-empty project and no further slash."""
    return project_id.rlike("^[^/]*/[^/]+$")
