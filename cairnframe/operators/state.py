"""Project and organisation state: joins, status checks, roll-ups and reconciliation.

Times are parameters, never the clock. Tables: ``projects`` (``project_id,
organization, project, src_repo``), ``project_state`` and ``org_state`` keyed by
``project_id`` and ``organization``. Nested listings of the service (an
organisation with all its projects) are flat tables here, so that a very large
organisation is never gathered into one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grants import org_of_id, org_path, project_path
from ..functions.repos import mirror_path, repo_identity
from ..functions.text import blank_to_null, strip, strip_path
from . import access, mutations

NEVER_SYNCED, UPDATING, READY, FAILED = "never_synced", "updating", "ready", "error"

# Stored columns that an update leaves alone, per table.
KEEP_ON_UPDATE = {
    "project_state": (),
    "org_state": (),
    "upload_session": ("created_at",),
    "setup_session": ("created_at",),
    "pending_repository": ("installation_id", "repo_id"),
}


def upsert_state(base: DataFrame, batch: DataFrame, table: str, key: str) -> DataFrame:
    """Insert or update rows of a state table by key; ``batch`` holds one row per key."""
    return mutations.upsert_keeping(base, batch, [key], KEEP_ON_UPDATE[table])


# ---------------------------------------------------------------- checks


def storage_check(projects: DataFrame, bucket_resources: DataFrame, listing_error: str | None = None) -> DataFrame:
    """Add ``storage_pass, storage_reason, storage_details``.

    Passes when any bucket lists the project's resource, in the current or the
    older spelling; both are brought to one key on the bucket side, so one
    equality join decides. When listing the buckets failed, its text wins.
    """
    if listing_error is not None:
        return (
            projects.withColumn("storage_pass", F.lit(False))
            .withColumn("storage_reason", F.lit("missing_storage_scope"))
            .withColumn("storage_details", F.lit(listing_error))
        )
    # Fixed value: the older spelling of a project resource.
    older = "^/organization/([^/]*)/project/([^/]*)$"
    path = F.regexp_replace(strip(F.col("resource")), older, "/programs/$1/projects/$2")
    scopes = bucket_resources.select(path.alias("_path")).distinct().withColumn("storage_pass", F.lit(True))
    keyed = projects.withColumn("_path", project_path(strip(F.col("organization")), strip(F.col("project"))))
    joined = keyed.join(scopes, "_path", "left").drop("_path")
    passed = F.coalesce("storage_pass", F.lit(False))
    return (
        joined.withColumn("storage_pass", passed)
        .withColumn("storage_reason", F.when(~F.col("storage_pass"), "missing_storage_scope"))
        .withColumn("storage_details", F.when(~F.col("storage_pass"), "No bucket scope matched this project"))
    )


def installation(projects: DataFrame, org_state: DataFrame, project_state: DataFrame) -> DataFrame:
    """Add ``app_installed`` (of the organisation), ``installed`` and the installation columns.

    An installed organisation with selection ``all`` covers every project; else
    the project's own installation id or target counts, shown with the
    organisation's page and selection. ``projects`` carries ``repo_owner``.
    """
    orgs = org_state.select(
        "organization",
        F.col("installed").alias("_org_installed"),
        F.col("installation_id").alias("_org_id"),
        F.col("html_url").alias("_org_url"),
        F.col("repository_selection").alias("_org_selection"),
    )
    own = project_state.select(
        "project_id",
        F.col("installation_id").alias("_own_id"),
        F.col("installation_target").alias("_own_target"),
        F.col("installation_target_type").alias("_own_type"),
    )
    joined = projects.join(orgs, "organization", "left").join(own, "project_id", "left")
    app = F.coalesce("_org_installed", F.lit(False))
    wide = app & F.coalesce(F.col("_org_selection") == "all", F.lit(False))
    single = ~wide & (F.col("_own_id").isNotNull() | F.col("_own_target").isNotNull())

    def pick(for_all: Column, for_one: Column) -> Column:
        return F.when(wide, for_all).when(single, for_one)

    return joined.select(
        *[F.col(c) for c in projects.columns],
        app.alias("app_installed"),
        (wide | single).alias("installed"),
        pick(F.col("_org_id"), F.col("_own_id")).alias("installation_id"),
        pick(blank_to_null(F.col("repo_owner")), F.col("_own_target")).alias("installation_target"),
        pick(F.lit("Organization"), F.col("_own_type")).alias("installation_target_type"),
        pick(F.col("_org_url"), F.col("_org_url")).alias("html_url"),
        pick(F.col("_org_selection"), F.col("_org_selection")).alias("repository_selection"),
    )


def integration_checks(checked: DataFrame) -> DataFrame:
    """Add ``github_reason, github_details, configured`` after ``installation`` and ``storage_check``."""
    unlinked = blank_to_null(F.col("src_repo")).isNull()
    # Reasons and texts.
    reason = F.when(unlinked, "missing_repository_link").when(~F.col("installed"), "missing_github_connection")
    details = (
        F.when(
            unlinked & F.col("app_installed"),
            "GitHub App is installed for this organization, but this project is not linked to a repository yet",
        )
        .when(unlinked, "No GitHub repository is linked to this project")
        .when(~F.col("installed"), "GitHub App is not connected to this repository")
    )
    return (
        checked.withColumn("github_reason", reason)
        .withColumn("github_details", details)
        .withColumn("configured", F.col("installed") & F.col("storage_pass"))
    )


def with_identity(projects: DataFrame) -> DataFrame:
    """Add ``repo_host, repo_owner, repo_name, repo_url`` from ``src_repo``; projects that have them stay as they are."""
    if {"repo_host", "repo_owner", "repo_name", "repo_url"} <= set(projects.columns):
        return projects
    identity = repo_identity(F.col("src_repo"))
    named = projects.withColumn("_identity", identity)
    out = named.withColumns(
        {f"repo_{c}": F.col(f"_identity.{c}") for c in ("host", "owner", "url")} | {"repo_name": F.col("_identity.repo")}
    )
    return out.drop("_identity")


def project_checks(projects: DataFrame, org_state: DataFrame, project_state: DataFrame, bucket_resources: DataFrame) -> DataFrame:
    """All checks of every project, one row each: the flat form of an organisation's project list."""
    installed = installation(with_identity(projects), org_state, project_state)
    return integration_checks(storage_check(installed, bucket_resources)).withColumn(
        "resource_path", project_path(F.col("organization"), F.col("project"))
    )


def project_status(projects: DataFrame, project_state: DataFrame, org_state: DataFrame) -> DataFrame:
    """Status listing of the projects with a readable repository address."""
    named = with_identity(projects).filter("repo_url IS NOT NULL")
    state = project_state.select(
        "project_id", "installation_id", "installation_target", "installation_target_type", "sync_state", "default_branch", "last_error"
    )
    orgs = org_state.select(
        "organization",
        F.col("installed").alias("organization_app_installed"),
        F.col("html_url").alias("organization_html_url"),
        F.col("repository_selection").alias("organization_repository_selection"),
    )
    joined = named.join(state, "project_id", "left").join(orgs, "organization", "left")
    linked = F.col("installation_id").isNotNull() | F.col("installation_target").isNotNull()
    return (
        joined.withColumn("installation_state", F.when(linked, "connected").otherwise("not_connected"))
        .withColumn("sync_state", F.coalesce(F.nullif("sync_state", F.lit("")), F.lit(NEVER_SYNCED)))
        .withColumn("organization_app_installed", F.coalesce("organization_app_installed", F.lit(False)))
        .withColumn("resource_path", project_path(F.col("organization"), F.col("project")))
    )


# ---------------------------------------------------------------- roll-ups


def configuration_state(installed: Column, configured: Column, total: Column) -> Column:
    return (
        F.when(~installed, "not_connected")
        .when(total == 0, "connected")
        .when(configured <= 0, "installed_unconfigured")
        .when(configured < total, "partially_configured")
        .otherwise("connected")
    )


def org_rollup(checks: DataFrame, org_state: DataFrame) -> DataFrame:
    """Per organisation of ``project_checks``: totals, app state and ``configuration_state``."""
    counts = checks.groupBy("organization").agg(
        F.count(F.lit(1)).alias("total_projects"),
        F.count_if("installed").alias("connected_projects"),
        F.count_if("configured").alias("configured_projects"),
    )
    orgs = org_state.select("organization", F.col("installed").alias("app_installed"), "installation_id", "html_url", "repository_selection")
    joined = counts.join(orgs, "organization", "left").withColumn("app_installed", F.coalesce("app_installed", F.lit(False)))
    state = configuration_state(F.col("app_installed"), F.col("configured_projects"), F.col("total_projects"))
    return joined.withColumn("configuration_state", state)


def all_rollup(by_org: DataFrame) -> DataFrame:
    """One row over ``org_rollup``: totals, installed organisations and the overall state."""
    totals = by_org.agg(
        F.count(F.lit(1)).alias("total_organizations"),
        F.count_if("app_installed").alias("installed_organizations"),
        F.coalesce(F.sum("total_projects"), F.lit(0)).alias("total_projects"),
        F.coalesce(F.sum("connected_projects"), F.lit(0)).alias("connected_projects"),
        F.coalesce(F.sum("configured_projects"), F.lit(0)).alias("configured_projects"),
    )
    app = F.col("installed_organizations") > 0
    return (
        totals.withColumn("connected_organizations", F.col("installed_organizations"))
        .withColumn("app_installed", app)
        .withColumn("configuration_state", configuration_state(app, F.col("configured_projects"), F.col("total_projects")))
    )


def organizations(projects: DataFrame) -> DataFrame:
    """Distinct non-empty organisations of project ids, sorted."""
    org = projects.select(org_of_id(F.col("project_id")).alias("organization")).filter("organization <> ''")
    return org.distinct().orderBy("organization")


# ---------------------------------------------------------------- reconciliation


def reconcile_orgs(projects: DataFrame, installs: DataFrame, org_state: DataFrame, now: Column) -> DataFrame:
    """New organisation state rows, with ``error`` for organisations whose lookup failed.

    ``installs`` holds the lookup result per ``organization, owner``:
    ``status_code, installed`` and the installation columns. Owners are taken
    in order; a 404 is passed over, any other failure stops the organisation,
    the first installed owner wins. Without valid repositories an installed
    organisation keeps its installation.
    """
    named = with_identity(projects).withColumn("organization", org_of_id(F.col("project_id"))).filter("organization <> ''")
    owners = named.select("organization", F.col("repo_owner").alias("owner")).distinct()
    failed = ~F.col("status_code").isin(200, 404)
    decisive = installs.filter(failed | ((F.col("status_code") == 200) & F.col("installed")))
    columns = ("installation_id", "installation_target", "installation_target_type", "html_url", "repository_selection")
    first = (
        owners.join(decisive, ["organization", "owner"], "left")
        .groupBy("organization")
        .agg(
            F.min_by(F.struct("status_code", "installed", *columns), F.when(F.col("status_code").isNotNull(), F.col("owner"))).alias("_new"),
            F.bool_or(F.col("owner").isNotNull()).alias("_has_owner"),
        )
    )
    old = org_state.select("organization", F.struct("installed", *columns).alias("_old"))
    joined = first.join(old, "organization", "left")
    has_owner = F.col("_has_owner")
    error = F.when(has_owner & ~F.col("_new.status_code").isin(200, 404), "integration_error")
    installed = F.coalesce(F.when(has_owner, F.col("_new.installed")).otherwise(F.col("_old.installed")), F.lit(False))
    flagged = joined.withColumn("error", error).withColumn("installed", installed & F.col("error").isNull())
    return flagged.select(
        "organization",
        "installed",
        *[
            F.when(F.col("installed"), F.when(has_owner, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))).alias(c)
            for c in columns
        ],
        F.when(F.col("installed"), now).alias("configured_at"),
        now.alias("last_seen_at"),
        now.alias("updated_at"),
        "error",
    )


def reconcile_projects(projects: DataFrame, org_rows: DataFrame, project_state: DataFrame, probes: DataFrame) -> DataFrame:
    """New state rows of projects with a valid repository, with ``outcome`` applied, cleared or error.

    ``org_rows`` comes from ``reconcile_orgs``; ``probes`` holds the access probe
    per ``project_id``: ``token_status, metadata_ok``. Outcome error leaves the
    installation as it was.
    """
    tracked = with_identity(projects).filter("repo_url IS NOT NULL")
    orgs = org_rows.filter("error IS NULL").select(
        "organization", F.col("installed").alias("_wide"), F.col("installation_id").alias("_id"), F.col("repository_selection").alias("_selection")
    )
    old = project_state.select("project_id", F.struct(*[F.col(c) for c in project_state.columns]).alias("_old"))
    joined = tracked.join(orgs, "organization").join(probes, "project_id", "left").join(old, "project_id", "left")
    covered = F.col("_wide") & F.coalesce(F.col("_selection") == "all", F.lit(False))
    outcome = (
        F.when(covered, "applied")
        .when(F.col("token_status").isin(403, 404), "cleared")
        .when(F.coalesce(F.col("token_status") != 200, F.lit(True)), "error")
        .when(~F.col("metadata_ok"), "cleared")
        .otherwise("applied")
    )
    joined = joined.withColumn("outcome", outcome)
    applied, cleared = F.col("outcome") == "applied", F.col("outcome") == "cleared"

    def kept(column: str, fresh: Column) -> Column:
        return F.when(F.col("_old").isNotNull(), F.col(f"_old.{column}")).otherwise(fresh)

    def bound(column: str, value: Column) -> Column:
        return F.when(applied, value).when(~cleared, F.col(f"_old.{column}")).alias(column)

    return joined.select(
        "project_id",
        *[kept(c, F.col(c)).alias(c) for c in ("repo_host", "repo_owner", "repo_name")],
        bound("installation_id", F.col("_id")),
        bound("installation_target", F.nullif("repo_owner", F.lit(""))),
        bound("installation_target_type", F.lit("Organization")),
        kept("sync_state", F.lit(NEVER_SYNCED)).alias("sync_state"),
        "outcome",
    )


# ---------------------------------------------------------------- pending repositories


def open_pending(
    pending: DataFrame, installation_id: int | None = None, user_id=None, setup_session_id: str | None = None
) -> DataFrame:
    """Unresolved, not removed; optionally of one installation, user and set-up session; oldest first."""
    rows = pending.filter("resolved_at IS NULL AND removed_at IS NULL")
    if installation_id:
        rows = rows.filter(F.col("installation_id") == installation_id)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    if setup_session_id:
        rows = rows.filter(F.col("setup_session_id") == setup_session_id)
    return rows.orderBy("added_at", "repo_full_name")


def close_pending(
    pending: DataFrame, keys: DataFrame, on: list[str], column: str, now: Column, only_open: bool = True
) -> DataFrame:
    """Set ``resolved_at`` or ``removed_at`` (and ``updated_at``) on the rows whose ``on`` columns are listed.

    Resolving by repository asks for neither time to be set, removing only for
    ``removed_at`` to be empty; by id pass ``only_open=False``.
    """
    if column not in ("resolved_at", "removed_at"):
        raise ValueError(f"no such time: {column}")
    listed = keys.select(*on).distinct().withColumn("_listed", F.lit(True))
    hit = F.coalesce("_listed", F.lit(False))
    if only_open:
        hit = hit & F.col("removed_at").isNull()
        if column == "resolved_at":
            hit = hit & F.col("resolved_at").isNull()
    joined = pending.join(listed, on, "left").withColumn("_hit", hit)
    updated = {column: F.when(F.col("_hit"), now).otherwise(F.col(column))}
    before = F.col("updated_at") if "updated_at" in pending.columns else F.lit(None)
    updated["updated_at"] = F.when(F.col("_hit"), now).otherwise(before)
    return joined.withColumns(updated).drop("_hit", "_listed")


def uniqueness_violations(pending: DataFrame) -> DataFrame:
    """Rows beyond the first (smallest id) of a key that must be unique.

    The key is (installation, repository), and the user when there is one; rows
    without a user form keys of their own. Counting first keeps a hot key from
    being sorted in one task.
    """
    key = ["installation_id", "repo_id", "user_id"]
    repeated = pending.groupBy(*key).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    repeated = repeated.select(*[F.col(c).alias(f"_{c}") for c in key], "first_id", "copies")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = pending.join(repeated, same).filter("id <> first_id")
    return joined.drop(*[f"_{c}" for c in key])


def encode_repo_ids(ids: Column) -> Column:
    """JSON text of a list of repository ids."""
    return F.to_json(F.coalesce(ids, F.array().cast("array<bigint>")))


def decode_repo_ids(text: Column) -> Column:
    """Distinct ids of the JSON text; none when it is not a list of numbers."""
    return F.coalesce(F.array_distinct(F.from_json(text, "array<bigint>")), F.array().cast("array<bigint>"))


def new_repo_ids(ids: Column, before_text: Column) -> Column:
    """Ids of the list that the stored set does not hold."""
    return F.array_except(ids, decode_repo_ids(before_text))


# ---------------------------------------------------------------- deletes and rewrites


def cascade_delete(tables: Mapping[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Remaining ``files``, ``sessions`` and ``states`` after deleting projects with all that hangs on them."""
    gone = project_ids.select("project_id").distinct()
    gone_sessions = tables["sessions"].join(gone, "project_id", "left_semi").select(F.col("id").alias("session_id"))
    return {
        "files": mutations.delete(tables["files"], gone_sessions, ["session_id"]),
        "sessions": mutations.delete(tables["sessions"], gone, ["project_id"]),
        "states": mutations.delete(tables["states"], gone, ["project_id"]),
    }


def cascade_delete_orgs(tables: Mapping[str, DataFrame], projects: DataFrame, orgs: DataFrame) -> dict[str, DataFrame]:
    """``cascade_delete`` of every project of the listed organisations."""
    ids = projects.withColumn("organization", org_of_id(F.col("project_id")))
    return cascade_delete(tables, ids.join(orgs.select("organization").distinct(), "organization", "left_semi"))


_IDENTITY = ("repo_host", "repo_owner", "repo_name")


def align_identity(states: DataFrame, projects: DataFrame, data_dir: str) -> DataFrame:
    """State rows brought in line with their project's repository; ``changed`` marks rewritten rows."""
    named = with_identity(projects).filter("repo_url IS NOT NULL").select("project_id", *[F.col(c).alias(f"_{c}") for c in _IDENTITY])
    named = named.withColumn("_mirror_path", mirror_path(*[F.col(f"_{c}") for c in _IDENTITY], data_dir))
    joined = states.join(named, "project_id", "left")
    columns = (*_IDENTITY, "mirror_path")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = joined.withColumn("changed", F.col("_mirror_path").isNotNull() & differs)
    rewritten = {c: F.when(F.col("changed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(rewritten).drop(*[f"_{c}" for c in columns])


def put_project_state(states: DataFrame, puts: DataFrame, data_dir: str) -> DataFrame:
    """States after project documents were stored.

    A project with the same repository keeps its row; a changed or new
    repository gives a fresh never_synced row; an unreadable one changes nothing.
    """
    named = with_identity(puts).filter("repo_url IS NOT NULL")
    fresh = named.select("project_id", *_IDENTITY).withColumn(
        "mirror_path", mirror_path(*[F.col(c) for c in _IDENTITY], data_dir)
    )
    same = states.select("project_id", *_IDENTITY)
    changed = fresh.join(same, ["project_id", *_IDENTITY], "left_anti").withColumn("sync_state", F.lit(NEVER_SYNCED))
    for c in states.columns:
        if c not in changed.columns:
            changed = changed.withColumn(c, F.lit(None).cast(states.schema[c].dataType))
    return mutations.upsert(states, changed, ["project_id"])


def bind_repositories(requests: DataFrame, projects: DataFrame, org_state: DataFrame, repositories: DataFrame) -> DataFrame:
    """Bind projects to repositories of their organisation's installation.

    ``requests``: ``project_id, repository_full_name``; ``repositories``:
    ``installation_id, full_name, clone_url, html_url``. Names are compared
    without case; the address is the clone URL, else the page, else built from
    the name. ``error_type`` is invalid_request, not_found, conflict or
    integration_error; bound rows restart as never_synced.
    """
    org = org_state.filter("installed AND installation_id IS NOT NULL").select(
        "organization", "installation_id", F.lit(True).alias("_connected")
    )
    known = projects.select("project_id").distinct().withColumn("_known", F.lit(True))
    url = F.coalesce(
        blank_to_null(F.col("clone_url")),
        blank_to_null(F.col("html_url")),
        F.concat(F.lit("https://github.com/"), strip(F.col("full_name"))),
    )
    listed = repositories.groupBy("installation_id", F.lower("full_name").alias("_wanted")).agg(
        F.min_by(url, F.struct("full_name", url)).alias("_url")
    )
    asked = requests.withColumn("_wanted", F.lower(strip(F.col("repository_full_name")))).withColumn(
        "organization", org_of_id(F.col("project_id"))
    )
    joined = (
        asked.join(known, "project_id", "left").join(org, "organization", "left").join(listed, ["installation_id", "_wanted"], "left")
    )
    joined = joined.withColumn("_identity", repo_identity(F.col("_url")))
    error = (
        F.when(F.coalesce("_wanted", F.lit("")) == "", "invalid_request")
        .when(F.col("_known").isNull(), "not_found")
        .when(F.col("_connected").isNull() | F.col("_url").isNull(), "conflict")
        .when(F.col("_identity.error").isNotNull(), "integration_error")
    )
    joined = joined.withColumn("error_type", error)
    good = F.col("error_type").isNull()
    return joined.select(
        *requests.columns,
        "error_type",
        F.when(good, F.col("installation_id")).alias("installation_id"),
        F.when(good, F.col("_identity.host")).alias("repo_host"),
        F.when(good, F.col("_identity.owner")).alias("repo_owner"),
        F.when(good, F.col("_identity.repo")).alias("repo_name"),
        F.when(good, F.col("_identity.url")).alias("src_repo"),
        F.when(good, NEVER_SYNCED).alias("sync_state"),
    )


def apply_bindings(states: DataFrame, bound: DataFrame, org_state: DataFrame, data_dir: str) -> DataFrame:
    """State table after the good rows of ``bind_repositories``.

    A bound project takes its organisation's installation and starts as
    never_synced, without branch, time or error.
    """
    orgs = org_state.select("organization", "installation_target", "installation_target_type")
    good = bound.filter("error_type IS NULL").withColumn("organization", org_of_id(F.col("project_id")))
    rows = good.join(orgs, "organization", "left").withColumn("mirror_path", mirror_path(*[F.col(c) for c in _IDENTITY], data_dir))
    for c in states.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(states.schema[c].dataType))
    return mutations.upsert(states, rows, ["project_id"])


# ---------------------------------------------------------------- paths, refresh, set-up

# Address scheme of each storage provider; any other is s3.
PROVIDER_SCHEMES = {"gcs": "gs", "gs": "gs", "azure": "azblob", "azblob": "azblob", "az": "azblob", "file": "file"}


def _joined_path(first: Column, second: Column) -> Column:
    """Two relative paths joined and cleaned: ``.`` and empty segments go, ``..`` drops the segment before it."""
    joined = F.concat_ws("/", F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    kept = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.coalesce(last(acc), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.array_append(acc, s)),
    )
    return F.when(joined == "", F.lit("")).otherwise(F.coalesce(F.nullif(F.array_join(kept, "/"), F.lit("")), F.lit(".")))


def scope_path(
    path: Column, prefix: Column, org_sub_path: Column, project_sub_path: Column, provider: Column, bucket: Column
) -> Column:
    """Storage scope: the explicit path, else bucket and prefix, else bucket and sub-paths, else empty."""
    schemes = F.create_map(*[F.lit(x) for pair in PROVIDER_SCHEMES.items() for x in pair])
    scheme = F.coalesce(F.try_element_at(schemes, F.lower(strip(provider))), F.lit("s3"))
    root = F.concat(scheme, F.lit("://"), strip(bucket))
    prefix = F.coalesce(strip_path(prefix), F.lit(""))
    org, project = (F.coalesce(strip_path(c), F.lit("")) for c in (org_sub_path, project_sub_path))
    sub = _joined_path(org, project)
    return (
        F.when(F.coalesce(strip(path), F.lit("")) != "", strip(path))
        .when(prefix != "", F.concat(root, F.lit("/"), prefix))
        .when((org == "") & (project == ""), F.lit(""))
        .otherwise(F.concat(root, F.lit("/"), sub))
    )


def start_refresh(states: DataFrame, project_ids: DataFrame) -> DataFrame:
    """Mark the listed projects as updating and forget their last error."""
    listed = project_ids.select("project_id").distinct().withColumn("_listed", F.lit(True))
    joined = states.join(listed, "project_id", "left")
    hit = F.col("_listed").isNotNull()
    return (
        joined.withColumn("sync_state", F.when(hit, UPDATING).otherwise(F.col("sync_state")))
        .withColumn("last_error", F.when(~hit, F.col("last_error")))
        .drop("_listed")
    )


def finish_refresh(states: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Apply refresh results ``project_id, ok, branch, message``: ready with branch and time, or error with message."""
    joined = states.join(results.select("project_id", "ok", "branch", "message"), "project_id", "left")
    ok, failed = F.coalesce("ok", F.lit(False)), F.coalesce(~F.col("ok"), F.lit(False))
    updated = {
        "sync_state": F.when(ok, READY).when(failed, FAILED).otherwise(F.col("sync_state")),
        "default_branch": F.when(ok, F.nullif("branch", F.lit(""))).otherwise(F.col("default_branch")),
        "last_refreshed_at": F.when(ok, now).otherwise(F.col("last_refreshed_at")),
        "last_error": F.when(failed, F.col("message")).when(~ok, F.col("last_error")),
    }
    return joined.withColumns(updated).drop("ok", "branch", "message")


def setup_plan(asks: DataFrame, grants: DataFrame) -> DataFrame:
    """Add ``resource_path`` and ``to_create`` (missing resources, outermost first) to ``user_id, organization, project`` asks.

    Nothing when the project is readable; the organisation too when the user
    can neither create projects in it nor manage its owners; then the project.
    """
    readable = access.allowed_resources(grants, "read", "*").select(
        "user_id", F.col("resource").alias("resource_path"), F.lit(True).alias("_readable")
    )
    path = project_path(F.col("organization"), F.col("project"))
    caps = access.org_capabilities(asks.select("user_id", "organization").distinct(), grants).select(
        "user_id", "organization", (F.col("can_create_projects") | F.col("can_manage_people")).alias("_owner")
    )
    joined = (
        asks.withColumn("resource_path", path)
        .join(readable, ["user_id", "resource_path"], "left")
        .join(caps, ["user_id", "organization"], "left")
    )
    missing = F.array_compact(F.array(F.when(~F.col("_owner"), org_path(F.col("organization"))), F.col("resource_path")))
    none = F.array().cast("array<string>")
    return joined.withColumn("to_create", F.when(F.col("_readable").isNotNull(), none).otherwise(missing)).drop("_readable", "_owner")
