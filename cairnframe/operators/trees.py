"""Repository listings from flat tables: ``tree`` (``repo, path, hash, size``), ``commits``, ``refs``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ancestors, barrier, base_name, let, parent_dir, strip, strip_path
from ..sources.tables import stored

# First line of a pointer file and the shapes of the next two.
POINTER_VERSION = "https://git-lfs.github.com/spec/v1"
POINTER_OID = "^oid sha256:([a-fA-F0-9]{64})$"
POINTER_SIZE = r"^size\s*([+-]?[0-9]+)$"


def list_tree(tree: DataFrame) -> DataFrame:
    """Immediate children of every directory: ``repo, dir, name, path, type, hash, size``.

    Files are their own rows; directories come from the distinct ancestors of
    the files, reduced per task before the shuffle. The top level is ``dir = ''``.
    """
    files = tree.select(
        "repo",
        parent_dir(F.col("path")).alias("dir"),
        base_name(F.col("path")).alias("name"),
        "path",
        F.lit("blob").alias("type"),
        "hash",
        "size",
    )
    dirs = directories(tree).select(
        "repo",
        parent_dir(F.col("path")).alias("dir"),
        base_name(F.col("path")).alias("name"),
        "path",
        F.lit("tree").alias("type"),
        F.lit(None).cast(tree.schema["hash"].dataType).alias("hash"),
        F.lit(None).cast(tree.schema["size"].dataType).alias("size"),
    )
    return files.unionByName(dirs)


def ordered_listing(listing: DataFrame) -> DataFrame:
    """Directories first, then names without regard to case."""
    return listing.orderBy("repo", "dir", F.col("type").desc(), F.lower("name"), "name", "path")


def directories(tree: DataFrame) -> DataFrame:
    """Distinct ``repo, path`` of all directories above the files."""
    return tree.select("repo", F.explode(ancestors(F.col("path"), include_self=False)).alias("path")).distinct()


def last_modified(commits: DataFrame) -> DataFrame:
    """Newest commit time per file and directory: ``repo, path, last_modified_at``."""
    touched = commits.select("repo", "committed_at", F.explode(ancestors(strip_path(F.col("path")), include_self=True)).alias("path"))
    return touched.filter("path <> ''").groupBy("repo", "path").agg(F.max("committed_at").alias("last_modified_at"))


def with_last_modified(listing: DataFrame, commits: DataFrame) -> DataFrame:
    return listing.join(last_modified(commits), ["repo", "path"], "left")


def parse_pointer(content: Column) -> Column:
    """STRUCT(version, oid, size) of a pointer file's text, NULL for any other text; the first three lines decide."""

    def read(lines: Column) -> Column:
        line = [strip(F.get(lines, F.lit(i))) for i in range(3)]
        oid = F.lower(F.regexp_extract(line[1], POINTER_OID, 1))
        size = F.regexp_extract(line[2], POINTER_SIZE, 1).try_cast("bigint")
        good = (
            (line[0] == f"version {POINTER_VERSION}") & (oid != "") & line[2].startswith("size ") & size.isNotNull()
        )
        return F.when(good, F.struct(F.lit(POINTER_VERSION).alias("version"), oid.alias("oid"), size.alias("size")))

    return let(F.split(strip(content), "\n"), read)


# Fixed value: bytes of a file that a listing reads for its pointer.
LISTED_BYTES = 2048


# Requests of one block: entries meet the blocks that a time of theirs can fall into, then their requests.
BLOCK_REQUESTS = 256
# A request table up to this size, by estimate, is sent to every task.
BROADCAST_BYTES, REQUEST_BYTES = 64 << 20, 128


def _starts(batch: pa.RecordBatch, keys: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Which rows of a sorted batch are the first of their key; ``before`` is the row in front of it."""
    starts = np.zeros(batch.num_rows, bool)
    for key in keys:
        column = batch.column(key)
        front = column.slice(0, 1) if before is None else before.column(key)
        previous = pa.concat_arrays([front, column.slice(0, batch.num_rows - 1)])
        same = pc.fill_null(pc.equal(column, previous), False)
        starts |= ~pc.or_(same, pc.and_(column.is_null(), previous.is_null())).to_numpy(zero_copy_only=False)
    if before is None:
        starts[0] = True
    return starts


def _changes(versions: DataFrame) -> DataFrame:
    """Add ``delta`` to the versions of files (``repo, path, committed_at, file``, each time once): 1 where one comes to be, -1 where it goes, else 0."""
    keys = ["repo", "path"]

    def compare(batches):
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            there = pc.struct_field(batch.column("file"), "hash").is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            front = 0 if before is None else int(pc.struct_field(before.column("file"), "hash").is_valid()[0].as_py())
            was = np.r_[front, there[:-1]]
            was[_starts(batch, keys, before)] = 0
            before = batch.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(there - was)], names=[*batch.schema.names, "delta"])

    sorted_ = versions.repartition(*keys).sortWithinPartitions(*keys, "committed_at")
    return sorted_.mapInArrow(compare, T.StructType([*versions.schema.fields, T.StructField("delta", T.LongType())]))


def _timeline(changes: DataFrame) -> DataFrame:
    """What holds from each time to the next, of changes ``repo, dir, name, committed_at, own, live`` (each time once).

    ``live`` becomes its running sum and ``own`` its last value; ``until`` is the next time. Rows are
    read in order and none but the last is kept. A missing time comes first.
    """
    keys = ["repo", "dir", "name"]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(held.columns, batch.columns)], names=batch.schema.names)
            rows = np.arange(batch.num_rows)
            starts = _starts(batch, keys, None)
            first = np.maximum.accumulate(np.where(starts, rows, 0))
            steps = batch.column("live").to_numpy(zero_copy_only=False)
            sums = np.cumsum(steps)
            live = sums - (sums - steps)[first]
            own = batch.column("own")
            last = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), rows, -1))
            own = own.take(pa.array(last, mask=last < first))
            following = batch.column("committed_at").take(pa.array(np.minimum(rows + 1, rows[-1]), mask=np.r_[starts[1:], True]))
            values = {name: batch.column(name) for name in batch.schema.names} | {"own": own, "live": pa.array(live)}
            done = pa.RecordBatch.from_arrays([*values.values(), following], names=[*values, "until"])
            held = pa.RecordBatch.from_arrays(list(values.values()), names=list(values)).slice(batch.num_rows - 1)
            yield done.slice(0, batch.num_rows - 1)
        if held is not None:
            none = pa.nulls(1, held.column("committed_at").type)
            yield pa.RecordBatch.from_arrays([*held.columns, none], names=[*held.schema.names, "until"])

    sorted_ = changes.repartition(*keys).sortWithinPartitions(*keys, "committed_at")
    until = T.StructField("until", changes.schema["committed_at"].dataType)
    return sorted_.mapInArrow(run, T.StructType([*changes.schema.fields, until]))


def _entries(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """Entries of the asked directories, each with the times ``since`` (included) and ``until`` (not) between which it is as it says.

    An entry without name stands for the times at which a directory is not there or empty; one ``since`` ever has no time.
    """
    places = asked.select("repo", "dir").distinct()
    head = F.substring(F.col("content").cast("binary"), 1, LISTED_BYTES).cast("string")
    file = F.struct("hash", "size", parse_pointer(head).alias("pointer"))
    known = versions.filter("path <> '' AND repo IS NOT NULL AND committed_at IS NOT NULL").select("repo", "path", "committed_at", F.struct("commit_id").alias("order"), file.alias("file"))
    last = known.groupBy("repo", "path", "committed_at").agg(F.max_by("file", "order").alias("file"))
    above = F.concat(F.array(F.lit("")), ancestors(F.col("path"), include_self=False))
    below = _changes(last).withColumn("dir", F.explode(above)).join(places, ["repo", "dir"], "left_semi")
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    placed = below.withColumn("rest", rest).withColumn("name", F.substring_index("rest", "/", 1))
    own = F.col("rest") == F.col("name")
    no_file = F.lit(None).cast(placed.schema["file"].dataType)
    child = F.struct("name", F.when(own, F.col("file")).alias("own"), F.when(own, F.lit(0)).otherwise(F.col("delta")).alias("live"))
    whole = F.struct(F.lit(None).cast("string").alias("name"), no_file.alias("own"), F.col("delta").alias("live"))
    changes = placed.select("repo", "dir", "committed_at", F.explode(F.array(child, whole)).alias("c")).select("repo", "dir", "c.name", "committed_at", "c.own", "c.live")
    changes = changes.groupBy("repo", "dir", "name", "committed_at").agg(F.max("own").alias("own"), F.sum("live").alias("live"))
    ever = {"name": F.lit(None).cast("string"), "committed_at": F.lit(None).cast(changes.schema["committed_at"].dataType), "own": no_file, "live": F.lit(0).cast("long")}
    times = _timeline(changes.unionByName(places.withColumns(ever)))

    named = F.col("name").isNotNull()
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema["file"].dataType.fields]
    blob = F.when(named & F.col("own.hash").isNotNull(), F.struct(F.lit("blob").alias("type"), "own.*"))
    tree = F.when(named & (F.col("live") > 0), F.struct(F.lit("tree").alias("type"), *empty))
    nothing = F.when(~named & (F.col("live") == 0), F.struct(F.lit(None).cast("string").alias("type"), *empty))
    path = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat("dir", F.lit("/"), "name"))
    kinds = times.select("repo", "dir", "name", path.alias("path"), F.col("committed_at").alias("since"), "until", F.explode(F.array_compact(F.array(blob, tree, nothing))).alias("entry"))
    return kinds.select("repo", "dir", "name", "path", "entry.*", "since", "until")


def listing_at(requests: DataFrame, versions: DataFrame, ordered: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Entries of asked directories as they were at the time of a ref: one row for each request and entry.

    ``requests``: ``request_id, repo, as_of, dir``, where ``as_of`` is the commit time of the resolved
    ref (NULL when there is none). ``versions``: ``repo, path, committed_at, commit_id, hash, size,
    content``, one row for each file that a commit changed, with NULL ``hash`` where it was deleted.

    A file is as its last version at or before ``as_of`` says (of equal times the greater
    ``commit_id``); a directory is there while a file below it is. Adds ``name, path, type, hash,
    size, pointer, last_modified_at``; the time counts deletions below a directory too. A directory that
    is not there, and a request without time, give one row with ``error_type`` not_found; an
    empty top level gives one without. ``ordered``: as :func:`ordered_listing` puts the rows.

    Versions become entries with the times between which they hold, as many as there are changes; each then
    meets the requests of its directory in blocks of near times. So only versions, entries and requests are
    shuffled (without contents), never the answer, which can have every entry for every request. Entries
    are put in order before they meet the requests; only when those are too many to be sent to every task is the answer sorted.
    """
    asked = requests.select("request_id", "repo", "as_of", strip_path(F.col("dir")).alias("dir"))
    number = F.row_number().over(Window.partitionBy("repo", "dir").orderBy("as_of"))
    asked = stored(asked.withColumn("block", F.floor((number - 1) / BLOCK_REQUESTS)))
    small = asked.count() * REQUEST_BYTES <= broadcast_bytes
    entries = _entries(asked, versions)
    if ordered and small:
        # The generator keeps the sort, which would else be dropped below a join.
        entries = barrier(ordered_listing(stored(entries)), "_kept", F.lit(True)).drop("_kept")

    blocks = asked.groupBy("repo", "dir", "block").agg(F.min("as_of").alias("low"), F.max("as_of").alias("high"), F.bool_or(F.col("as_of").isNull()).alias("untimed"))
    blocks = blocks.withColumnsRenamed({"repo": "b_repo", "dir": "b_dir", "block": "b_block"})
    since, until = F.col("since"), F.col("until")
    timed = (since.isNull() | (since <= F.col("high"))) & (until.isNull() | (F.col("low") < until))
    meets = (F.col("untimed") & since.isNull()) | timed
    at = entries.join(F.broadcast(blocks), F.col("repo").eqNullSafe(F.col("b_repo")) & F.col("dir").eqNullSafe(F.col("b_dir")) & meets).drop("b_repo", "b_dir")

    asking = asked.withColumnsRenamed({"repo": "a_repo", "dir": "a_dir"})
    as_of = F.col("as_of")
    holds = F.when(as_of.isNull(), since.isNull()).otherwise((since.isNull() | (since <= as_of)) & (until.isNull() | (as_of < until)))
    same = F.col("repo").eqNullSafe(F.col("a_repo")) & F.col("dir").eqNullSafe(F.col("a_dir")) & (F.col("b_block") == F.col("block"))
    found = at.join(F.broadcast(asking) if small else asking, same & holds)
    absent = F.col("name").isNull() & (as_of.isNull() | (F.col("dir") != ""))
    listed = found.select(
        "request_id", "repo", "dir", "name", "path", "type", "hash", "size", "pointer",
        F.when(F.col("name").isNotNull(), since).alias("last_modified_at"), F.when(absent, "not_found").alias("error_type"),
    )
    return ordered_listing(listed) if ordered and not small else listed


# ---------------------------------------------------------------- refs

_HEADS, _ORIGIN, _TAGS = "refs/heads/", "refs/remotes/origin/", "refs/tags/"


def _short(full_name: Column) -> Column:
    return F.regexp_replace(full_name, f"^({_HEADS}|{_ORIGIN}|{_TAGS})", "")


def list_refs(refs: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """``repo, name, type, hash, default``: local and origin branches and tags, each name once per kind.

    ``refs``: ``repo, full_name, hash``; ``defaults``: ``repo, default_branch``.
    The first full name in order wins, so a local branch hides the remote one.
    """
    full = F.col("full_name")
    kind = (
        F.when(full.startswith(_HEADS), "branch")
        .when(full.startswith(_ORIGIN) & (full != _ORIGIN + "HEAD"), "branch")
        .when(full.startswith(_TAGS), "tag")
    )
    named = refs.withColumn("type", kind).filter("type IS NOT NULL").withColumn("name", _short(full))
    order = F.struct(full, F.col("hash"))
    first = named.groupBy("repo", "type", "name").agg(F.min_by("hash", order).alias("hash"))
    if defaults is None:
        return first.withColumn("default", F.lit(False))
    joined = first.join(defaults.select("repo", "default_branch"), "repo", "left")
    is_default = (F.col("type") == "branch") & F.coalesce(F.col("name") == F.col("default_branch"), F.lit(False))
    return joined.withColumn("default", is_default).drop("default_branch")


def ordered_refs(listing: DataFrame) -> DataFrame:
    """Default first, branches before tags, then names without regard to case."""
    return listing.orderBy("repo", F.col("default").desc(), "type", F.lower("name"), "name")


# Where a bare name is looked for, in order.
NAME_RULES = ("{}", "refs/{}", "refs/tags/{}", "refs/heads/{}", "refs/remotes/{}", "refs/remotes/{}/HEAD")
FALLBACK_RANK = 10


def resolve_refs(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """``request_id, resolved, hash, fell_back`` for requests ``request_id, repo, requested, default_branch``.

    A requested name (else the default branch) is looked up by the usual rules
    for bare names, then among origin's branches; an unknown name falls back to
    HEAD. ``hash`` is NULL when not even HEAD exists.
    """
    wanted = F.coalesce(F.nullif("requested", F.lit("")), F.nullif("default_branch", F.lit("")), F.lit(""))
    asked = requests.select("request_id", "repo", wanted.alias("wanted"))

    def candidates(name: Column, rules, start: int) -> list[Column]:
        out = []
        for i, rule in enumerate(rules):
            before, after = rule.split("{}")
            full = F.when(name != "", F.concat(F.lit(before), name, F.lit(after)))
            out.append(F.struct(F.lit(start + i).alias("rank"), full.alias("full_name"), _short(name).alias("resolved")))
        return out

    tried = F.array(
        *candidates(F.col("wanted"), (*NAME_RULES, _ORIGIN + "{}"), 0),
        *candidates(F.lit("HEAD"), NAME_RULES, FALLBACK_RANK),
    )
    # Equal questions are answered once.
    pairs = asked.select("repo", "wanted").distinct()
    rows = pairs.select("repo", "wanted", F.explode(tried).alias("c")).select("repo", "wanted", "c.*")
    found = (
        rows.filter("full_name IS NOT NULL")
        .join(refs.groupBy("repo", "full_name").agg(F.min("hash").alias("hash")), ["repo", "full_name"])
        .groupBy("repo", "wanted")
        .agg(F.min_by(F.struct("rank", "resolved", "hash"), "rank").alias("best"))
    )
    return asked.join(found, ["repo", "wanted"], "left").select(
        "request_id",
        F.col("best.resolved").alias("resolved"),
        F.col("best.hash").alias("hash"),
        F.coalesce(F.col("best.rank") >= FALLBACK_RANK, F.lit(False)).alias("fell_back"),
    )


def empty_repositories(repos: DataFrame, refs: DataFrame) -> DataFrame:
    """Repositories without any branch, remote branch or tag."""
    counted = refs.filter(F.col("full_name").rlike("^refs/(heads|remotes|tags)/")).select("repo").distinct()
    return repos.select("repo").distinct().join(counted, "repo", "left_anti")


# ---------------------------------------------------------------- files


def all_paths(tree: DataFrame) -> DataFrame:
    """Distinct ``repo, path`` of all files and directories."""
    return tree.select("repo", F.explode(ancestors(F.col("path"), include_self=True)).alias("path")).distinct()


def paths_exist(requests: DataFrame, tree: DataFrame) -> DataFrame:
    """Add ``exists``: the path is a file or a directory of the repository; an empty path never is."""
    cleaned = requests.withColumn("_path", strip_path(F.col("path")))
    known = all_paths(tree).filter("path <> ''").select("repo", F.col("path").alias("_path"), F.lit(True).alias("_known"))
    return cleaned.join(known, ["repo", "_path"], "left").withColumn("exists", F.col("_known").isNotNull()).drop("_path", "_known")


def file_records(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """``repo, path, name, hash, size, html_url, download_url``.

    ``files``: ``repo, path`` and ``size`` of the content read; ``metadata``:
    ``repo, path, meta_name, meta_hash, meta_size, html_url, download_url`` as
    the remote reports it. Reported values win when non-empty (a size when
    positive).
    """
    cleaned = strip_path(F.col("path"))
    joined = files.select("repo", "path", "size").join(metadata, ["repo", "path"], "left")
    return joined.select(
        "repo",
        cleaned.alias("path"),
        F.coalesce(F.nullif("meta_name", F.lit("")), base_name(cleaned)).alias("name"),
        F.coalesce("meta_hash", F.lit("")).alias("hash"),
        F.when(F.col("meta_size") > 0, F.col("meta_size")).otherwise(F.col("size")).alias("size"),
        F.coalesce("html_url", F.lit("")).alias("html_url"),
        F.coalesce("download_url", F.lit("")).alias("download_url"),
    )
