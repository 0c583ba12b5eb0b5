"""Upload sessions: manifest planning, collisions, attachments and status.

``files`` has ``session_id, ordinal, raw_name, subdirectory, size``; a planned
file also has ``file_name, target_path, status, error``. Two files with the
same target share it, so rows are told apart by ``ordinal`` as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, strip, strip_path
from ..sources.tables import stored
from . import mutations
from .trees import POINTER_VERSION, paths_exist

# States and texts.
PENDING, UPLOADED, COLLISION = "pending_upload", "uploaded", "collision"
SESSION_PENDING, SESSION_READY = "pending_upload", "ready_for_pr"
NAME_REQUIRED = "file name is required"
NAME_SEPARATOR = "file name must not include path separators"
DUPLICATE_TARGET = "duplicate target path in upload batch"
EXISTING_TARGET = "target path already exists on base branch"
HAS_CONFLICTS = "upload session contains target path conflicts"


def plan_targets(files: DataFrame) -> DataFrame:
    """Add ``file_name, target_path, name_error``; a faulty name has no target."""
    name = strip(F.col("raw_name"))
    error = F.when(F.coalesce(name, F.lit("")) == "", NAME_REQUIRED).when(name.rlike(r"[/\\]"), NAME_SEPARATOR)
    sub = F.coalesce(strip_path(F.col("subdirectory")), F.lit(""))
    target = strip_path(F.when(sub == "", name).otherwise(F.concat(sub, F.lit("/"), name)))
    named = files.withColumn("name_error", error)
    good = F.col("name_error").isNull()
    return named.withColumn("file_name", F.when(good, name)).withColumn("target_path", F.when(good, target))


def flag_duplicates(planned: DataFrame) -> DataFrame:
    """Add ``duplicate``: the target occurred at a smaller ordinal of the same session.

    The first ordinal per target is a plain minimum, reduced before the
    shuffle; a session of any size is never sorted in one task.
    """
    first = planned.filter("target_path IS NOT NULL").groupBy("session_id", "target_path").agg(F.min("ordinal").alias("_first"))
    joined = planned.join(first, ["session_id", "target_path"], "left")
    return joined.withColumn("duplicate", F.coalesce(F.col("ordinal") > F.col("_first"), F.lit(False))).drop("_first")


def plan_uploads(files: DataFrame, tree: DataFrame) -> DataFrame:
    """Planned files with ``status`` and ``error``.

    ``files`` also carries ``repo``, whose base-branch files are ``tree``. A
    repeated target and a target that exists (as file or directory) collide;
    others are pending. Rows with a ``name_error`` have no status.
    """
    flagged = flag_duplicates(plan_targets(files)).withColumn("path", F.coalesce("target_path", F.lit("")))
    checked = paths_exist(flagged, tree).drop("path")
    named = F.col("name_error").isNull()
    error = F.when(F.col("duplicate"), DUPLICATE_TARGET).when(F.col("exists"), EXISTING_TARGET)
    return (
        checked.withColumn("error", F.when(named, error))
        .withColumn("status", F.when(named, F.when(F.col("error").isNotNull(), COLLISION).otherwise(PENDING)))
        .drop("duplicate", "exists")
    )


def _attachments(attachments: DataFrame, order: str | None) -> DataFrame:
    cleaned = attachments.withColumn("target_path", strip_path(F.col("target_path")))
    return cleaned if order is None else mutations.latest_per_key(cleaned, ["session_id", "target_path"], order)


def attach(files: DataFrame, attachments: DataFrame, order: str) -> DataFrame:
    """Files with size, checksum and object id of their attachment; non-collisions become uploaded.

    ``attachments``: ``session_id, target_path, size, checksum, drs_object_id``; the
    last one per target by ``order`` counts, so no file is ever repeated.
    """
    given = _attachments(attachments, order).select(
        "session_id",
        "target_path",
        F.lit(True).alias("_hit"),
        F.struct(
            "size",
            F.lower(blank_to_null(F.col("checksum"))).alias("checksum"),
            blank_to_null(F.col("drs_object_id")).alias("drs_object_id"),
        ).alias("_given"),
    )
    joined = files.join(given, ["session_id", "target_path"], "left")
    # Asked by a column of its own, so that a plan that shows no given value moves none.
    hit = F.col("_hit").isNotNull()
    uploads = hit & (F.col("status") != COLLISION)
    updated = {c: F.when(hit, F.col(f"_given.{c}")).otherwise(F.col(c)) for c in ("size", "checksum", "drs_object_id")}
    updated["error"] = F.when(~F.coalesce(uploads, F.lit(False)), F.col("error"))
    updated["status"] = F.when(uploads, UPLOADED).otherwise(F.col("status"))
    return joined.withColumns(updated).drop("_given", "_hit")


def attach_errors(files: DataFrame, attachments: DataFrame) -> DataFrame:
    """``session_id, target_path, error`` of attachments whose target the session does not hold."""
    unknown = _attachments(attachments, None).join(files, ["session_id", "target_path"], "left_anti")
    message = F.concat(F.lit("upload session does not contain target path "), F.col("target_path"))
    return unknown.select("session_id", "target_path", message.alias("error")).distinct()


def _attached() -> Column:
    return F.col("checksum").isNotNull() & F.col("drs_object_id").isNotNull()


def session_status(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``status`` to ``session_id`` rows: pending while any file collides or lacks an attachment."""
    blocked = files.groupBy("session_id").agg(F.bool_or((F.col("status") == COLLISION) | ~_attached()).alias("_blocked"))
    joined = sessions.join(blocked, "session_id", "left")
    status = F.when(F.coalesce("_blocked", F.lit(False)), SESSION_PENDING).otherwise(SESSION_READY)
    return joined.withColumn("status", status).drop("_blocked")


def finalize_check(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``error`` to ``session_id`` rows: the first blocking file in target order, NULL when none blocks."""
    collides = F.col("status") == COLLISION
    reason = F.when(collides, HAS_CONFLICTS).otherwise(
        F.concat(F.lit("upload session file "), F.col("target_path"), F.lit(" is not fully attached"))
    )
    blocking = files.filter(collides | ~_attached())
    first = blocking.groupBy("session_id").agg(F.min_by(reason, F.struct("target_path", "ordinal")).alias("error"))
    return sessions.join(first, "session_id", "left")


def pointer_text(checksum: Column, size: Column) -> Column:
    """Text of a pointer file."""
    return F.concat(
        F.lit(f"version {POINTER_VERSION}\noid sha256:"),
        F.lower(strip(checksum)),
        F.lit("\nsize "),
        size.cast("string"),
        F.lit("\n"),
    )


# What a session shows of its files.
FILE_COLUMNS = ("ordinal", "file_name", "target_path", "size", "checksum", "drs_object_id", "status", "error")


def session_view(requests: DataFrame, sessions: DataFrame, files: DataFrame, columns: Sequence[str] = FILE_COLUMNS) -> DataFrame:
    """Files of asked ``(session_id, project_id)`` pairs, in target order within a session.

    Adds ``collision`` per file and ``has_conflicts`` per session; a session of
    another project, or none, gives one row with ``error_type`` not_found. The files of asked
    sessions are worked out once, and written, for both their rows and their conflicts. ``columns`` (with
    ``status``) says what is shown of a file; nothing else of it is shuffled or written.
    """
    files = stored(files.select("session_id", *columns).join(requests.select("session_id").distinct(), "session_id", "left_semi"))
    own = sessions.select("session_id", "project_id").withColumn("_own", F.lit(True))
    conflicts = files.groupBy("session_id").agg(F.bool_or(F.col("status") == COLLISION).alias("has_conflicts"))
    asked = requests.select("session_id", "project_id").distinct().join(own, ["session_id", "project_id"], "left")
    asked = stored(asked.join(conflicts, "session_id", "left"))
    # The files are the left side of an inner join, so a very large session can be split.
    filled = asked.filter("_own AND has_conflicts IS NOT NULL").drop("_own")
    shown = files.join(filled, "session_id")
    empty = asked.filter("_own AND has_conflicts IS NULL").withColumn("has_conflicts", F.lit(False)).drop("_own")
    missing = asked.filter("_own IS NULL").select("session_id", "project_id", F.lit("not_found").alias("error_type"))
    return (
        shown.withColumn("collision", F.col("status") == COLLISION)
        .unionByName(empty, allowMissingColumns=True)
        .unionByName(missing, allowMissingColumns=True)
    )


def final_texts(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """``title`` and ``body`` of sessions, replaced by the non-blank ones of the finalise requests."""
    given = requests.select(
        "session_id", blank_to_null(F.col("title")).alias("_title"), blank_to_null(F.col("body")).alias("_body")
    )
    joined = sessions.join(given, "session_id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in ("title", "body")}).drop("_title", "_body")


def session_defaults(sessions: DataFrame, file_counts: DataFrame, now_text: str, branch_prefix: str = "upload") -> DataFrame:
    """Add ``base_branch, target_subdirectory, title, body, branch_name, error_type``.

    ``sessions``: ``session_id, project, requested_branch, default_branch,
    subdirectory, suffix``; ``file_counts``: ``session_id, n_files``. The time
    text and the per-session suffix of the branch name are inputs.
    """
    counted = sessions.join(file_counts, "session_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    branch = F.coalesce(blank_to_null(F.col("requested_branch")), blank_to_null(F.col("default_branch")))
    sub = F.coalesce(strip_path(F.col("subdirectory")), F.lit(""))
    slug = F.coalesce(F.nullif(F.lower(F.translate(strip(F.col("project")), "_", "-")), F.lit("")), F.lit("upload"))
    # The default texts.
    title = F.when(F.col("n_files") == 1, F.concat(F.lit("Add 1 LFS file to "), F.col("project"))).otherwise(
        F.concat(F.lit("Add "), F.col("n_files").cast("string"), F.lit(" LFS files to "), F.col("project"))
    )
    body = F.concat(F.lit("Upload Git LFS-backed files into `"), F.col("base_branch"), F.lit("`"))
    under = F.concat(F.lit(" under `"), F.col("target_subdirectory"), F.lit("`."))
    return (
        counted.withColumn("base_branch", branch)
        .withColumn("target_subdirectory", F.nullif(sub, F.lit("")))
        .withColumn("title", title)
        .withColumn("body", F.concat(body, F.coalesce(under, F.lit("."))))
        .withColumn("branch_name", F.concat_ws("-", F.lit(branch_prefix), slug, F.lit(now_text), F.col("suffix")))
        .withColumn(
            "error_type", F.when(F.col("base_branch").isNull(), "conflict").when(F.col("n_files") == 0, "invalid_request")
        )
    )


def replace_files(files: DataFrame, batch: DataFrame) -> DataFrame:
    """All files of the sessions in ``batch`` replaced by the batch."""
    return mutations.replace_groups(files, batch, ["session_id"])
