"""Uploads, repository listings, images, streams and stored tables."""

import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairnframe.operators import images as im
from cairnframe.operators import trees as tr
from cairnframe.operators import uploads as up
from cairnframe.sources import tables
from cairnframe.streaming import feed

from .conftest import rows

FILES = "session_id string, ordinal long, raw_name string, subdirectory string, size long, repo string, checksum string, drs_object_id string"


def files(spark):
    data = [
        ("s", 1, " a.tsv ", " /data/ ", 1, "r", "AB ", "d1"),
        ("s", 2, "a.tsv", "data", 2, "r", "AB", "d2"),
        ("s", 3, "b.tsv", "data", 3, "r", None, None),
        ("s", 4, "sub", "data", 4, "r", "CD", " "),
        ("s", 5, "x/y", "", 5, "r", None, None),
        ("s", 6, "  ", "", 6, "r", None, None),
        ("t", 1, "a.tsv", "data", 7, "r", "EF", "d7"),
    ]
    return spark.createDataFrame(data, FILES)


def base_tree(spark):
    return spark.createDataFrame([("r", "data/b.tsv"), ("r", "data/sub/c.tsv"), ("other", "data/a.tsv")], "repo string, path string")


def test_plan_uploads(spark):
    planned = up.plan_uploads(files(spark), base_tree(spark))
    assert rows(planned, "session_id", "ordinal", "target_path", "status", "error", "name_error") == sorted(
        [
            ("s", 1, "data/a.tsv", "pending_upload", None, None),
            ("s", 2, "data/a.tsv", "collision", up.DUPLICATE_TARGET, None),
            ("s", 3, "data/b.tsv", "collision", up.EXISTING_TARGET, None),
            ("s", 4, "data/sub", "collision", up.EXISTING_TARGET, None),
            ("s", 5, None, None, None, up.NAME_SEPARATOR),
            ("s", 6, None, None, None, up.NAME_REQUIRED),
            ("t", 1, "data/a.tsv", "pending_upload", None, None),
        ],
        key=repr,
    )


def test_two_attachments_for_one_target_add_no_file(spark):
    columns = "session_id string, ordinal long, target_path string, size long, checksum string, drs_object_id string, status string, error string"
    files = spark.createDataFrame([("s", 1, "a", None, None, None, "pending_upload", None), ("s", 2, "b", None, None, None, "pending_upload", None)], columns)
    given = spark.createDataFrame([("s", "a", 1, "X", "d1", 1), ("s", "/a", 2, "Y", "d2", 2)], "session_id string, target_path string, size long, checksum string, drs_object_id string, seq long")
    assert rows(up.attach(files, given, "seq"), "ordinal", "size", "checksum", "status") == [(1, 2, "y", "uploaded"), (2, None, None, "pending_upload")]


def test_attach_status_finalize_and_view(spark):
    planned = up.plan_uploads(files(spark), base_tree(spark)).filter("name_error IS NULL AND ordinal <> 2")
    planned = planned.withColumns({c: F.lit(None).cast("string") for c in ("checksum", "drs_object_id")})
    given = spark.createDataFrame(
        [(1, "t", "/data/a.tsv", 70, " ", "d"), (2, "t", "data/a.tsv/ ", 71, " EF ", "d"), (1, "s", "data/b.tsv", 30, "X", "Y"), (1, "s", "nope", 1, "a", "b")],
        "seq long, session_id string, target_path string, size long, checksum string, drs_object_id string",
    )
    done = up.attach(planned, given, order="seq")
    assert rows(done, "session_id", "target_path", "size", "checksum", "drs_object_id", "status") == sorted(
        [
            ("s", "data/a.tsv", 1, None, None, "pending_upload"),
            ("s", "data/b.tsv", 30, "x", "Y", "collision"),
            ("s", "data/sub", 4, None, None, "collision"),
            ("t", "data/a.tsv", 71, "ef", "d", "uploaded"),
        ],
        key=repr,
    )
    assert rows(up.attach_errors(planned, given)) == [("s", "nope", "upload session does not contain target path nope")]
    sessions = spark.createDataFrame([("s",), ("t",), ("empty",)], "session_id string")
    assert rows(up.session_status(sessions, done)) == [("empty", "ready_for_pr"), ("s", "pending_upload"), ("t", "ready_for_pr")]
    assert rows(up.finalize_check(sessions, done)) == [
        ("empty", None),
        ("s", "upload session file data/a.tsv is not fully attached"),
        ("t", None),
    ]
    owners = spark.createDataFrame([("s", "o/p"), ("t", "o/p")], "session_id string, project_id string")
    asked = spark.createDataFrame([("s", "o/p"), ("t", "o/other")], "session_id string, project_id string")
    view = up.session_view(asked, owners, done)
    assert rows(view, "session_id", "target_path", "collision", "has_conflicts", "error_type") == sorted(
        [("s", "data/a.tsv", False, True, None), ("s", "data/b.tsv", True, True, None), ("s", "data/sub", True, True, None), ("t", None, None, None, "not_found")],
        key=repr,
    )


def test_session_defaults(spark):
    sessions = spark.createDataFrame(
        [("a", "My_Proj", " ", "main", "/d/", "x"), ("b", " ", "dev", "main", "", "y"), ("c", "p", "", " ", "", "z")],
        "session_id string, project string, requested_branch string, default_branch string, subdirectory string, suffix string",
    )
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n_files long")
    got = {r.session_id: r for r in up.session_defaults(sessions, counts, "T").collect()}
    assert (got["a"].title, got["a"].body) == ("Add 1 LFS file to My_Proj", "Upload Git LFS-backed files into `main` under `d`.")
    assert (got["a"].branch_name, got["b"].branch_name) == ("upload-my-proj-T-x", "upload-upload-T-y")
    assert (got["b"].base_branch, got["b"].body) == ("dev", "Upload Git LFS-backed files into `dev`.")
    assert got["c"].error_type == "conflict"


# ---------------------------------------------------------------- trees


def test_listing_and_times(spark):
    tree = spark.createDataFrame([("r", "a/B/c.txt", 1, 10), ("r", "a/b.txt", 2, 20), ("r", "z.txt", 3, 30)], "repo string, path string, hash long, size long")
    listing = tr.ordered_listing(tr.list_tree(tree)).collect()
    assert [(x.dir, x.name, x.type, x.size) for x in listing] == [
        ("", "a", "tree", None),
        ("", "z.txt", "blob", 30),
        ("a", "B", "tree", None),
        ("a", "b.txt", "blob", 20),
        ("a/B", "c.txt", "blob", 10),
    ]
    commits = spark.createDataFrame([("r", "a/B/c.txt", 5), ("r", "/a/b.txt", 9), ("r", "a/b.txt", 3)], "repo string, path string, committed_at int")
    assert rows(tr.last_modified(commits)) == [("r", "a", 9), ("r", "a/B", 5), ("r", "a/B/c.txt", 5), ("r", "a/b.txt", 9)]
    asked = spark.createDataFrame([("r", " /a/ "), ("r", "a/b.txt"), ("r", ""), ("r", "a/b"), ("q", "a")], "repo string, path string")
    assert rows(tr.paths_exist(asked, tree), "repo", "path", "exists") == [
        ("q", "a", False),
        ("r", " /a/ ", True),
        ("r", "", False),
        ("r", "a/b", False),
        ("r", "a/b.txt", True),
    ]


OID = "0fab" * 16
V = "version https://git-lfs.github.com/spec/v1"


@pytest.mark.parametrize(
    "text, expected",
    [
        (f"{V}\noid sha256:{OID}\nsize 3780184021\n", 3780184021),
        (f"\n {V} \r\n oid sha256:{OID.upper()} \r\nsize  7\r\nmore\n", 7),
        (f"{V}\noid sha256:{OID[:-1]}\nsize 1", None),
        (f"{V}\noid sha256:{OID}\nsize 1.5", None),
        (f"{V}\noid sha256:{OID}\nsize 99999999999999999999", None),
        (f"{V}\noid sha256:{OID}\nsize1", None),
        (f"version 2\noid sha256:{OID}\nsize 1", None),
        (f"{V}\noid sha256:{OID}", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_pointer(spark, text, expected):
    p = spark.createDataFrame([(text,)], "x string").select(tr.parse_pointer(F.col("x")).alias("p")).first()["p"]
    assert (p and p["size"]) == expected
    if p:
        assert p["oid"] == OID and p["version"] == "https://git-lfs.github.com/spec/v1"


def test_pointer_text_reads_back(spark):
    df = spark.createDataFrame([(f" {OID.upper()} ", 12)], "c string, s long")
    p = df.select(tr.parse_pointer(up.pointer_text(F.col("c"), F.col("s"))).alias("p")).first()["p"]
    assert (p["oid"], p["size"]) == (OID, 12)


def test_refs(spark):
    refs = spark.createDataFrame(
        [
            ("r", "refs/heads/main", "h1"),
            ("r", "refs/remotes/origin/main", "h2"),
            ("r", "refs/remotes/origin/benchmarking", "h3"),
            ("r", "refs/remotes/origin/HEAD", "h4"),
            ("r", "refs/remotes/fork/x", "h5"),
            ("r", "refs/tags/Main", "h6"),
            ("r", "refs/notes/n", "h7"),
            ("r", "HEAD", "h1"),
            ("bare", "refs/notes/n", "h8"),
        ],
        "repo string, full_name string, hash string",
    )
    defaults = spark.createDataFrame([("r", "benchmarking")], "repo string, default_branch string")
    listed = tr.ordered_refs(tr.list_refs(refs, defaults)).collect()
    assert [(x["name"], x["type"], x["hash"], x["default"]) for x in listed] == [
        ("benchmarking", "branch", "h3", True),
        ("main", "branch", "h1", False),
        ("Main", "tag", "h6", False),
    ]
    asked = spark.createDataFrame(
        [(1, "r", "main", ""), (2, "r", "", "benchmarking"), (3, "r", "Main", ""), (4, "r", "gone", ""), (5, "r", "refs/remotes/origin/main", ""), (6, "bare", "x", ""), (7, "r", "", None)],
        "request_id int, repo string, requested string, default_branch string",
    )
    assert rows(tr.resolve_refs(asked, refs)) == [
        (1, "main", "h1", False),
        (2, "benchmarking", "h3", False),
        (3, "Main", "h6", False),
        (4, "HEAD", "h1", True),
        (5, "main", "h2", False),
        (6, None, None, False),
        (7, "HEAD", "h1", True),
    ]
    assert rows(tr.empty_repositories(refs, refs)) == [("bare",)]


def test_file_records(spark):
    f = spark.createDataFrame([("r", "a/b.txt", 5), ("r", "c", 6)], "repo string, path string, size long")
    m = spark.createDataFrame([("r", "a/b.txt", "", "sha", 0, "u", None)], "repo string, path string, meta_name string, meta_hash string, meta_size long, html_url string, download_url string")
    assert rows(tr.file_records(f, m)) == [("r", "a/b.txt", "b.txt", "sha", 5, "u", ""), ("r", "c", "c", "", 6, "", "")]


# ---------------------------------------------------------------- images


def png(width, height, crc=None, depth=8, colour=2):
    header = b"IHDR" + struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + header + struct.pack(">I", zlib.crc32(header) if crc is None else crc)


def jpeg(width, height, before=b"", marker=0xC0, precision=8, length=17):
    frame = bytes([0xFF, marker]) + struct.pack(">HBHHB", length, precision, height, width, 3) + bytes(9)
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + before + frame


@pytest.mark.parametrize(
    "data, expected",
    [
        (png(150, 150), (".png", None)),
        (jpeg(150, 150), (".jpg", None)),
        (jpeg(150, 150, before=b"\xff\xff\xe1" + struct.pack(">H", 8) + b"\xff\xc0\xff\xc0\xff\xc0", marker=0xC2), (".jpg", None)),
        (png(50, 150), (None, "too_small")),
        (jpeg(150, 99), (None, "too_small")),
        (png(3500, 150), (None, "too_large")),
        (png(3000, 100), (".png", None)),
        (b"not really an image", (None, "invalid_format")),
        (b"", (None, "empty")),
        (None, (None, "empty")),
        (png(150, 150, crc=1), (None, "invalid_data")),
        (png(0, 150), (None, "invalid_data")),
        (png(150, 150)[:20], (None, "invalid_data")),
        (b"\xff\xd8\xff\xda\x00\x02", (None, "invalid_data")),
        (jpeg(150, 150)[:16], (None, "invalid_data")),
        (jpeg(150, 150)[:-1], (None, "invalid_data")),
        (jpeg(150, 150, precision=12), (None, "invalid_data")),
        (jpeg(150, 150, length=14), (None, "invalid_data")),
        (png(150, 150, colour=5), (None, "invalid_data")),
        (png(150, 150, depth=3), (None, "invalid_data")),
        (png(150, 150, depth=1, colour=3), (".png", None)),
        (png(150, 150) + bytes(1 << 20), (None, "limit_exceeded")),
    ],
)
def test_validate_images(spark, data, expected):
    df = spark.createDataFrame([("x", data)], "path string, content binary")
    row = im.validate_images(df).first()
    assert (row["extension"], row["error_type"]) == expected


def test_images_from_files(spark, tmp_path):
    for name, data in {"o/p/thumbnail.jpg": jpeg(200, 300), "o/p/thumbnail.png": png(200, 300), "o/q/thumbnail.zzz": png(9, 9)}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = tables.read_images(spark, str(tmp_path))
    assert rows(im.validate_images(found), "width", "height", "error_type") == sorted([(200, 300, None), (200, 300, None), (9, 9, "too_small")], key=repr)
    projects = found.withColumn("project", F.regexp_extract("path", "o/([^/]+)/", 1))
    assert rows(im.pick_images(projects), "project", "content_type") == [("p", "image/jpeg"), ("q", "image/png")]


# ---------------------------------------------------------------- streams

CHANGE = "seq long, ts timestamp, id string, op string, payload string"


def changes(spark, *items):
    return spark.createDataFrame([(s, datetime(2024, 1, d), i, op, p) for s, d, i, op, p in items], CHANGE)


def stream(spark, folder, *batches):
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(folder)


def test_feed_equals_batch_over_many_files(spark, tmp_path):
    first = changes(spark, (1, 1, "a", "upsert", "1"), (4, 1, "b", "upsert", "4"), (5, 1, "c", "delete", None))
    second = changes(spark, (2, 2, "a", "delete", None), (3, 2, "b", "upsert", "3"), (6, 2, "d", "upsert", None))
    base = spark.createDataFrame([("c", "old"), ("e", "kept")], "id string, payload string")
    source = stream(spark, str(tmp_path / "in"), first, second)
    query = feed.apply_feed(source, str(tmp_path / "out"))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    result = rows(feed.current_points(spark, str(tmp_path / "out"), base))
    assert result == rows(feed.apply_changes(first.union(second), base)) == [("b", "4"), ("d", None), ("e", "kept")]
    feed.apply_feed(source, str(tmp_path / "out"))  # nothing new: the same files
    assert rows(feed.current_points(spark, str(tmp_path / "out"), base)) == result
    feed.compact(spark, str(tmp_path / "out"), str(tmp_path / "small"))
    assert rows(feed.current_points(spark, str(tmp_path / "small"), base)) == result


def test_duplicates_and_late_rows(spark, tmp_path):
    first = changes(spark, (1, 10, "a", "upsert", None), (1, 10, "a", "upsert", None), (2, 20, "b", "upsert", None))
    second = changes(spark, (2, 20, "b", "upsert", None), (4, 21, "c", "upsert", None))
    third = changes(spark, (3, 1, "late", "upsert", None), (4, 21, "c", "upsert", None))
    source = stream(spark, str(tmp_path / "in"), first, second, third)
    query = feed.run_available(feed.drop_duplicates(source, ["seq"]), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/data")), "seq") == [(1,), (2,), (4,)]
    assert feed.dropped_late_rows(query) == 1


def test_daily_counts_wait_for_the_watermark(spark, tmp_path):
    source = stream(spark, str(tmp_path / "in"), changes(spark, (1, 1, "a", "upsert", None), (2, 1, "b", "upsert", None), (3, 2, "a", "delete", None), (4, 4, "c", "upsert", None)))
    feed.run_available(feed.daily_counts(source), str(tmp_path / "out"))
    got = rows(spark.read.parquet(str(tmp_path / "out/data")))
    assert got == sorted([(datetime(2024, 1, 1), "upsert", 2), (datetime(2024, 1, 2), "delete", 1)], key=repr)


# ---------------------------------------------------------------- stored tables


def test_stored_tables(spark, tmp_path):
    points = spark.createDataFrame([("a", "x", [1.0], "{}"), ("b", "y", [2.0], None)], tables.POINT_SCHEMA)
    tables.write_points(points, str(tmp_path / "points"))
    back = tables.read_points(spark, str(tmp_path / "points"))
    assert rows(back.select(points.columns)) == rows(points)
    plan = back.filter("vector_name = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(vector_name" in plan
    tables.overwrite_partitions(spark.createDataFrame([("c", "x", [3.0], None)], tables.POINT_SCHEMA), str(tmp_path / "points"), ["vector_name"])
    assert rows(tables.read_points(spark, str(tmp_path / "points")), "id") == [("b",), ("c",)]
    docs = spark.createDataFrame([("nav", "n", "{}")], tables.DOCUMENT_SCHEMA)
    tables.write_documents(docs, str(tmp_path / "docs"))
    assert rows(tables.read_documents(spark, str(tmp_path / "docs")).select(docs.columns)) == rows(docs)
    (tmp_path / "files").mkdir()
    (tmp_path / "files/default.json").write_text('{\n"a": 1}')
    assert rows(tables.read_document_files(spark, str(tmp_path / "files"), "nav")) == [("nav", "default", '{\n"a": 1}')]


def test_stored_cuts_lineage(spark):
    kept = tables.stored(spark.range(5).withColumn("x", F.col("id") * 2))
    assert rows(kept) == [(i, 2 * i) for i in range(5)]
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()


def _at(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_listing_as_of_a_ref(spark):
    pointer = f"version {tr.POINTER_VERSION}\noid sha256:{'A' * 64}\nsize 12\n"
    versions = spark.createDataFrame(
        [
            ("r", "a.txt", _at(1), 1, "h1", 5, "text"),
            ("r", "d/x/one", _at(2), 2, "h2", 6, pointer),
            ("r", "d/two", _at(2), 2, "h3", 7, "tex" + "\u00e9" * 3000),
            ("r", "a.txt", _at(3), 3, "h4", 8, pointer),
            ("r", "a.txt", _at(3), 4, "h5", 9, None),
            ("r", "d/two", _at(4), 5, None, None, None),
            ("r", "d/x/one", _at(5), 6, None, None, None),
            ("r", "d", _at(6), 7, "h7", 1, "now a file"),
            ("q", "d/y", _at(1), 8, "h8", 1, ""),
        ],
        "repo string, path string, committed_at timestamp_ntz, commit_id long, hash string, size long, content string",
    )
    asks = [(1, "r", _at(1), ""), (2, "r", _at(2), "/ "), (3, "r", _at(3), ""), (4, "r", _at(4), " /d/ "), (5, "r", _at(5), "d"), (6, "r", _at(6), ""), (7, "r", _at(6), "d")]
    asks += [(8, "r", _at(1) - (_at(2) - _at(1)), ""), (9, "r", None, ""), (10, "none", _at(6), "d"), (11, "r", _at(4), "d"), (12, "r", _at(2), "d/x")]
    got = {}
    found = tr.listing_at(spark.createDataFrame(asks, "request_id long, repo string, as_of timestamp_ntz, dir string"), versions)
    for r in found.collect():
        entry = None if r["name"] is None else (r["path"], r["type"], r["hash"], r["size"], r["pointer"] and r["pointer"]["size"], r["last_modified_at"].day)
        got.setdefault(r["request_id"], set()).add(entry or r["error_type"])
    assert got == {
        1: {("a.txt", "blob", "h1", 5, None, 1)},
        2: {("a.txt", "blob", "h1", 5, None, 1), ("d", "tree", None, None, None, 2)},
        3: {("a.txt", "blob", "h5", 9, None, 3), ("d", "tree", None, None, None, 2)},
        4: {("d/x", "tree", None, None, None, 2)},
        5: {"not_found"},
        6: {("a.txt", "blob", "h5", 9, None, 3), ("d", "blob", "h7", 1, None, 6)},
        7: {"not_found"},
        8: {None},
        9: {"not_found"},
        10: {"not_found"},
        11: {("d/x", "tree", None, None, None, 2)},
        12: {("d/x/one", "blob", "h2", 6, 12, 2)},
    }


def test_listing_at_gathers_no_history(inputs):
    """Last versions are reduced before the shuffle, and file contents are in none."""
    plan = tr.listing_at(inputs["listing_requests"], inputs["file_versions"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan
    assert not any("content" in line for line in plan.split("\n") if "Exchange" in line)


def test_listing_at_many_times_shuffles_no_answer(spark):
    """Every file for every request, in blocks of requests: rows equal a plain search, and no step shuffles or gathers them."""
    changes = [("r", f"d{i % 3}/f{i % 7}" if i % 4 else f"F{i % 5}", (i * 37) % 211, i, None if i % 6 == 0 else i) for i in range(300)]
    asks = [(i, "r" if i % 50 else "none", None if i % 90 == 7 else (i * 53) % 230 - 5, ["", "d1", "d2/", "gone", "d0/f0"][i % 5]) for i in range(600)]
    versions = spark.createDataFrame([(*c, 1, "") for c in changes], "repo string, path string, committed_at long, commit_id long, hash long, size long, content string")
    requests = spark.createDataFrame(asks, "request_id long, repo string, as_of long, dir string")
    expected = []
    for request, repo, as_of, asked in asks:
        directory, last, found = asked.strip("/"), {}, {}
        for r, path, at, commit, value in changes if as_of is not None else []:
            if r == repo and at <= as_of and (not directory or path.startswith(f"{directory}/")):
                last[path] = max(last.get(path, (-1, -1, None)), (at, commit, value))
        for path, (_, _, value) in last.items():
            name, _, more = path[len(directory) + 1 if directory else 0 :].partition("/")
            at = max(v[0] for p, v in last.items() if f"{p}/".startswith(f"{directory}/{name}/".lstrip("/")))
            if value is not None:
                found[name, "tree" if more else "blob"] = (request, name, "tree" if more else "blob", None if more else value, at, None)
        wrong = None if as_of is not None and not directory else "not_found"
        expected += list(found.values()) or [(request, None, None, None, None, wrong)]
    columns = ("request_id", "name", "type", "hash", "last_modified_at", "error_type")
    for broadcast_bytes in (tr.BROADCAST_BYTES, 0):
        listed = tr.listing_at(requests, versions, ordered=True, broadcast_bytes=broadcast_bytes)
        assert rows(listed, *columns) == sorted(expected, key=repr)
        kept = [(r["repo"], r["dir"], ["tree", "blob", None].index(r["type"]), (r["name"] or "").lower(), r["name"] or "") for r in listed.collect()]
        assert kept == sorted(kept)
        if broadcast_bytes:
            plan = listed._jdf.queryExecution().sparkPlan().toString()
            assert not any(step in plan.split("Join")[0] for step in ("Sort", "Exchange", "Aggregate"))


def test_pick_images_sorts_no_content(spark, inputs):
    """An image's bytes end before the rows are sorted, shuffled or aggregated."""
    from cairnframe.plans import images as plans

    for picked in (im.pick_images(spark.createDataFrame([("p", "a.bin", b"x")], "project string, path string, content binary")), plans.i_pick(inputs)):
        nodes = picked._jdf.queryExecution().sparkPlan().toString().split("\n")
        heavy = [n for n in nodes if any(step in n for step in ("Aggregate", "Exchange", "Sort"))]
        assert heavy and not any("content#" in n or "unhex" in n for n in heavy)
