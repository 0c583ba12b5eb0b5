"""Points, nearest neighbours and recommendation."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnframe.functions.vectors import score, score_literal
from cairnframe.operators import knn as nn
from cairnframe.operators import points as pt

from .conftest import rows

POINTS = "id string, vector array<float>"
QUERIES = "query_id long, vector array<float>"


def make_points(spark, vectors, partitions=3):
    data = [(f"p{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, POINTS).repartition(partitions)


def make_queries(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], QUERIES)


def as_float(vectors):
    return np.asarray(vectors, dtype=np.float32).astype(np.float64)


def brute(points, queries, k, metric, hidden=()):
    """Reference ranking: all pairs, best first, ties to the smaller id."""
    out = []
    p, q = as_float(points), as_float(queries)
    for qi in range(len(q)):
        scored = []
        for pi in range(len(p)):
            if (qi, pi) in hidden:
                continue
            a, b = q[qi], p[pi]
            if metric == "Euclid":
                s = math.sqrt(((a - b) ** 2).sum())
            elif metric == "Manhattan":
                s = np.abs(a - b).sum()
            else:
                s = float((a * b).sum())
                if metric == "Cosine":
                    n = np.linalg.norm(a) * np.linalg.norm(b)
                    s = s / n if n else 0.0
            scored.append((round(float(s), 9), f"p{pi:04d}"))
        sign = -1 if metric in ("Cosine", "Dot") else 1
        scored.sort(key=lambda t: (sign * t[0], t[1]))
        out += [(qi, pid, rank) for rank, (_, pid) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid", "Manhattan"])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_knn_join_equals_brute_force(spark, metric, broadcast_bytes):
    rng = np.random.default_rng(1)
    points, queries = rng.normal(size=(90, 6)), rng.normal(size=(11, 6))
    got = nn.knn_join(
        make_points(spark, points), make_queries(spark, queries), 7, metric, broadcast_bytes=broadcast_bytes, block_bytes=400
    )
    assert rows(got, "query_id", "id", "rank") == brute(points, queries, 7, metric)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("metric", ["Cosine", "Euclid"])
def test_knn_join_with_a_third_of_points_equal(spark, metric, broadcast_bytes):
    """Copies tie; the smaller ids win in every plan, none is lost."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 5))
    points[::3] = points[0]
    queries = np.vstack([points[0], rng.normal(size=(4, 5))])
    got = nn.knn_join(
        make_points(spark, points, 5), make_queries(spark, queries), 25, metric, broadcast_bytes=broadcast_bytes, block_bytes=5 * 8 * 7
    )
    assert rows(got, "query_id", "id", "rank") == brute(points, queries, 25, metric)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_knn_join_leaves_out_excluded_pairs(spark, broadcast_bytes):
    rng = np.random.default_rng(3)
    points, queries = rng.normal(size=(40, 4)), rng.normal(size=(6, 4))
    hidden = {(q, p) for q in range(6) for p in range(40) if (q + p) % 3 == 0}
    pairs = spark.createDataFrame([(q, f"p{p:04d}") for q, p in hidden], "query_id long, id string")
    got = nn.knn_join(
        make_points(spark, points), make_queries(spark, queries), 30, exclude=pairs, broadcast_bytes=broadcast_bytes, block_bytes=3 * 256 * 9
    )
    assert rows(got, "query_id", "id", "rank") == brute(points, queries, 30, "Cosine", hidden)


def test_knn_join_of_one_query_is_knn(spark):
    rng = np.random.default_rng(4)
    points, query = rng.normal(size=(30, 5)), as_float(rng.normal(size=(1, 5)))
    p = make_points(spark, points)
    joined = nn.knn_join(p, make_queries(spark, query), 8, offset=2)
    single = nn.knn(p, list(query[0]), 8, offset=2)
    assert rows(joined, "id", "rank") == rows(single, "id", "rank")
    assert [r[1] for r in sorted(rows(single, "id", "rank"), key=lambda r: r[1])] == list(range(3, 11))


def test_knn_join_without_points_or_queries(spark):
    p, q = make_points(spark, np.eye(3)), make_queries(spark, np.eye(3))
    assert nn.knn_join(p.filter("false"), q, 2).count() == 0
    assert nn.knn_join(p, q.filter("false"), 2).count() == 0
    assert nn.knn_join(p, q, 0).count() == 0
    assert nn.ann_join(p.filter("false"), q, 2, bits=2).count() == 0
    assert nn.ann_join(p, q.filter("false"), 2, bits=2).count() == 0


@pytest.mark.parametrize("first", ["short", "long"])
def test_points_of_another_length_raise_in_any_order(spark, first):
    odd = spark.createDataFrame([("short", [1.0, 0.0])], POINTS)
    even = make_points(spark, np.eye(3), 1)
    p = odd.unionByName(even) if first == "short" else even.unionByName(odd)
    searches = [
        lambda: nn.knn_join(p, make_queries(spark, np.eye(3)), 9),
        lambda: nn.knn(p, [1.0, 0.0, 0.0], 2),
        lambda: nn.knn_join(p, make_queries(spark, np.eye(2)), 9, dim=3),
    ]
    for search in searches:
        with pytest.raises(Exception, match="does not have length 3"):
            search().collect()
    nulls = even.unionByName(spark.createDataFrame([("none", None)], POINTS))
    assert {r[0] for r in rows(nn.knn_join(nulls, make_queries(spark, np.eye(3)), 9), "id")} == {"p0000", "p0001", "p0002"}


def test_search_with_limits_per_request(spark):
    rng = np.random.default_rng(10)
    points, queries = rng.normal(size=(20, 4)), rng.normal(size=(4, 4))
    whole = {q: [r for r in brute(points, queries, 20, "Euclid") if r[0] == q] for q in range(4)}
    limits = [(0, 3, 0, None), (1, 2, 5, None), (2, None, None, None), (3, 20, None, 0.0)]
    asked = [(q, [float(x) for x in queries[q]], *rest) for q, *rest in limits]
    schema = QUERIES + ", limit long, offset long, score_threshold double"
    got = rows(nn.search(make_points(spark, points), spark.createDataFrame(asked, schema), "Euclid"), "query_id", "id", "rank")
    pick = lambda q, lo, hi: [r for r in whole[q] if lo < r[2] <= hi]
    assert got == sorted(pick(0, 0, 3) + pick(1, 5, 7), key=repr)


def test_query_of_another_length_is_an_error(spark):
    mixed = make_queries(spark, np.eye(3)).unionByName(spark.createDataFrame([(9, [1.0])], QUERIES))
    with pytest.raises(Exception, match="length 3"):
        nn.knn_join(make_points(spark, np.eye(3)), mixed, 1).collect()


def test_self_query_scores_one(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(20, 8))
    best = nn.knn(make_points(spark, points), list(as_float(points)[4]), 10).filter("rank = 1").first()
    assert best["id"] == "p0004" and best["score"] >= 0.9999


def test_threshold_keeps_the_better_side(spark):
    p, q = make_points(spark, [[1, 0], [0.6, 0.8], [0, 1]]), make_queries(spark, [[1, 0]])
    assert rows(nn.knn_join(p, q, 5, "Cosine", threshold=0.5), "id") == [("p0000",), ("p0001",)]
    assert rows(nn.knn_join(p, q, 5, "Euclid", threshold=1.0), "id") == [("p0000",), ("p0001",)]
    assert rows(nn.knn(p, [1.0, 0.0], 5, "Manhattan", threshold=1.3), "id") == [("p0000",), ("p0001",)]


def test_unknown_metric_is_refused(spark):
    with pytest.raises(ValueError, match="invalid distance: Euclidean"):
        nn.knn_join(make_points(spark, np.eye(2)), make_queries(spark, np.eye(2)), 1, "Euclidean")


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_literal_and_column_scores_agree(spark, metric):
    rng = np.random.default_rng(6)
    points, query = rng.normal(size=(5, 7)), as_float(rng.normal(size=7))
    df = make_points(spark, points).withColumn("q", F.lit([float(x) for x in query]))
    both = df.select(score_literal(F.col("vector"), query, metric).alias("a"), score(F.col("vector"), F.col("q"), metric).alias("b"))
    assert all(math.isclose(r.a, r.b, rel_tol=1e-12) for r in both.collect())
    long = list(range(300))
    wide = spark.createDataFrame([("x", [float(v) for v in long])], POINTS)
    assert wide.select(score_literal(F.col("vector"), long, "Cosine")).first()[0] == pytest.approx(1.0)


def test_recommend_averages_and_leaves_inputs_out(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(30, 20))
    p = make_points(spark, vectors)
    inputs = spark.createDataFrame(
        [(1, "pos", "p0000"), (1, "pos", "p0001"), (1, "neg", "p0009"), (2, "pos", "p0003"), (3, "neg", "p0004"), (4, "pos", "gone")],
        "request_id long, sign string, id string",
    )
    unit = as_float(vectors) / np.linalg.norm(as_float(vectors), axis=1, keepdims=True)
    target = 2 * (unit[0] + unit[1]) / 2 - unit[9]
    got = {r["query_id"]: r["vector"] for r in nn.recommend_targets(p, inputs).collect()}
    assert np.allclose(got[1], target) and np.allclose(got[2], unit[3])
    found = nn.recommend(p, inputs, 7)
    assert found.filter("query_id = 1").count() == 7
    assert found.filter("query_id = 1 AND id IN ('p0000', 'p0001', 'p0009')").count() == 0
    assert {r[0] for r in rows(found, "query_id")} == {1, 2}
    assert rows(nn.recommend_errors(p, inputs)) == [(3, "invalid_vector_request"), (4, "point_not_found")]


def _clustered(rng, clusters, each, dim, spread=0.15):
    centres = rng.normal(size=(clusters, dim))
    return np.repeat(centres, each, axis=0) + spread * rng.normal(size=(clusters * each, dim))


@pytest.mark.parametrize("metric, options", [("Cosine", {"bits": 8}), ("Dot", {"bits": 10, "bands": 60}), ("Euclid", {"bits": 5, "width": 4.0})])
def test_ann_finds_most_and_scores_few(spark, metric, options):
    """Recall, and the share of all pairs that share a signature, on clustered vectors."""
    rng = np.random.default_rng(11)
    vectors = _clustered(rng, 60, 20, 16)
    p, q = make_points(spark, vectors), make_queries(spark, vectors[::40])
    found, exact = nn.ann_join(p, q, 10, metric, **options), nn.knn_join(p, q, 10, metric)
    assert nn.recall(found, exact).first()[0] > 0.9
    family = nn._family(p, metric, 16, options.get("bands", 12), options["bits"], options.get("width"), 7)
    a, b = family.cells(as_float(vectors[::40]), True), family.cells(as_float(vectors), False)
    assert (a[:, None, :] == b[None, :, :]).any(axis=2).mean() < 0.1


def test_ann_needs_a_family(spark):
    p, q = make_points(spark, np.eye(3)), make_queries(spark, np.eye(3))
    with pytest.raises(ValueError, match="Manhattan"):
        nn.ann_join(p, q, 1, "Manhattan", bits=2)
    with pytest.raises(ValueError, match="width"):
        nn.ann_join(p, q, 1, "Euclid", bits=2)


def test_a_long_page_does_not_lengthen_the_others(spark):
    rng = np.random.default_rng(12)
    p = make_points(spark, rng.normal(size=(4000, 4)), 2)
    asked = [(q, [float(x) for x in rng.normal(size=4)], 5, 3000 if q == 0 else 0, None) for q in range(30)]
    requests = spark.createDataFrame(asked, QUERIES + ", limit long, offset long, score_threshold double")
    kept = nn._top_partial(p, requests.withColumn("k", F.col("limit") + F.col("offset")), None, "Cosine", None, 1 << 20, 1 << 20, None)
    counts = {r["query_id"]: r["count"] for r in kept.groupBy("query_id").count().collect()}
    assert all(n <= 10 for q, n in counts.items() if q) and counts[0] >= 3005
    got = rows(nn.search(p, requests), "query_id", "rank")
    assert got == sorted([(0, r) for r in range(3001, 3006)] + [(q, r) for q in range(1, 30) for r in range(1, 6)], key=repr)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_ann_with_all_points_in_one_bucket(spark, broadcast_bytes):
    rng = np.random.default_rng(8)
    copies = np.repeat(rng.normal(size=(1, 4)), 40, axis=0)
    got = nn.ann_join(make_points(spark, copies), make_queries(spark, copies[:2]), 30, bits=4, broadcast_bytes=broadcast_bytes, block_bytes=4 * 8 * 6)
    assert rows(got, "query_id", "id", "rank") == brute(copies, copies[:2], 30, "Cosine")


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid"])
def test_both_ann_plans_agree(spark, metric):
    rng = np.random.default_rng(9)
    p, q = make_points(spark, rng.normal(size=(120, 6))), make_queries(spark, rng.normal(size=(17, 6)))
    small = nn.ann_join(p, q, 9, metric, bands=4, bits=3, width=3.0)
    large = nn.ann_join(p, q, 9, metric, bands=4, bits=3, width=3.0, broadcast_bytes=0, block_bytes=6 * 8 * 11)
    assert rows(small, "query_id", "id", "rank") == rows(large, "query_id", "id", "rank")
    assert small.count() > 0


@pytest.mark.parametrize("bits", [2, 12])
def test_ann_scores_wide_and_narrow_cells_alike(spark, bits):
    """Every point that shares a cell with a query counts and no other, in passes too, and no vector is shuffled."""
    vectors = _clustered(np.random.default_rng(13), 20, 15, 8, 0.05)
    queries = vectors[::7]
    p, q = make_points(spark, vectors).localCheckpoint(), make_queries(spark, queries)
    family = nn._family(p, "Cosine", 8, 5, bits, None, 7)
    near = (family.cells(as_float(queries), True)[:, None, :] == family.cells(as_float(vectors), False)[None, :, :]).any(axis=2)
    expected = brute(vectors, queries, 6, "Cosine", {(int(a), int(b)) for a, b in np.argwhere(~near)})
    for options in ({}, {"broadcast_bytes": 0, "block_bytes": 12_000}):
        got = nn.ann_join(p, q, 6, bits=bits, bands=5, **options)
        assert rows(got, "query_id", "id", "rank") == expected
        assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()


def test_ann_counts_a_repeated_point_once(spark):
    vectors = np.random.default_rng(14).normal(size=(60, 4))
    p, q = make_points(spark, vectors, 1), make_queries(spark, vectors[:9])
    once, twice = (nn.ann_join(points, q, 6, bits=1, bands=8) for points in (p, p.union(p).coalesce(1)))
    assert rows(once) == rows(twice) and once.count() == 54


def test_a_kept_neighbour_takes_few_bytes():
    """What a task keeps for a neighbour: its query's row, its id and its score."""
    ids = nn._ids(pa.array([f"00000000-0000-4000-8000-{i:012d}" for i in range(9)] + ["\u00e9"]))
    assert ids.itemsize + 16 <= nn.KEPT_BYTES
    assert ids.tolist()[-1].decode() == "\u00e9" and np.argsort(ids).tolist() == list(range(10))
    top, p = nn._TopK(np.eye(4), np.full(4, 3), "Cosine"), np.eye(4).repeat(3, axis=0)[:10]
    top.add(ids, p, nn._side(p, "Cosine", False), (np.array([1]), np.array([4])))
    assert sum(x.nbytes for x in (top.rows, top.ids, top.scores)) <= nn.KEPT_BYTES * 3 * 4
    assert ids[4] not in top.ids[top.rows == 1] and set(top.ids[top.rows == 0]) == set(ids[:3])


@pytest.mark.parametrize("metric", ["Cosine", "Euclid"])
def test_points_that_tie_are_taken_in_parts(monkeypatch, metric):
    """A large group of equal points is near every query; its pairs are not all held at once, and none is lost."""
    monkeypatch.setattr(nn, "RESCORE_CELLS", 4 * 50)
    merged, merge = [], nn._TopK._merge

    def watched(self, rows, ids, scores):
        merged.append(len(rows))
        merge(self, rows, ids, scores)

    monkeypatch.setattr(nn._TopK, "_merge", watched)
    vectors = np.random.default_rng(15).normal(size=(400, 4))
    vectors[::2] = vectors[0]
    queries = np.vstack([vectors[0], np.random.default_rng(16).normal(size=(7, 4))])
    top, ids = nn._TopK(queries, np.array([1, 5, 30, 9, 2, 300, 7, 3]), metric), nn._ids(pa.array([f"p{i:04d}" for i in range(400)]))
    for part in (slice(200, 400), slice(0, 200)):
        top.add(ids[part], vectors[part], nn._side(vectors[part], metric, False), (np.zeros(0, np.int64),) * 2)
    for row, k in enumerate(top.k):
        scores = nn._pair_scores(np.repeat(queries[row : row + 1], 400, axis=0), vectors, metric)
        order = np.lexsort((ids, scores if metric == "Euclid" else -scores))[:k]
        assert top.ids[top.rows == row].tolist() == ids[order].tolist()
    assert max(merged) <= 50 + len(top.ids)


# ---------------------------------------------------------------- points

COLOURS = [
    ("c3fb3d5c-0000-4000-8000-000000000001", "v", [1.0], '{"color":"red","n":2,"ok":true,"tags":["a","b"],"deep":{"x":"2"}}'),
    ("5eb1d065-0000-4000-8000-000000000002", "v", [2.0], '{"color":"green","n":"2","ok":false,"tags":[]}'),
    ("1cf900d5-0000-4000-8000-000000000003", "v", [3.0], None),
]
FULL = "id string, vector_name string, vector array<float>, payload string"


@pytest.mark.parametrize(
    "must, expected",
    [
        ({}, 3),
        (None, 3),
        ({"color": "red"}, 1),
        ({"n": 2}, 1),
        ({"n": "2"}, 1),
        ({"ok": False}, 1),
        ({"ok": 0}, 0),
        ({"tags": "b"}, 1),
        ({"deep.x": "2"}, 1),
        ({"color": "red", "ok": False}, 0),
        ({"missing": "x"}, 0),
    ],
)
def test_payload_filter(spark, must, expected):
    assert pt.payload_filter(spark.createDataFrame(COLOURS, FULL), must).count() == expected


def test_payload_filter_refuses_other_values(spark):
    with pytest.raises(TypeError):
        pt.payload_filter(spark.createDataFrame(COLOURS, FULL), {"n": 2.5})


def test_filter_applies_before_ranking(spark):
    data = [(f"p{i:04d}", "v", [math.cos(i / 9), math.sin(i / 9)], f'{{"color":"color_{i % 3}"}}') for i in range(10)]
    points = spark.createDataFrame(data, FULL)
    red = nn.knn(pt.payload_filter(points, {"color": "color_0"}), [1.0, 0.0], 3)
    assert rows(red, "id") == [("p0000",), ("p0003",), ("p0006",)]


def test_upsert_replaces_whole_points_and_is_idempotent(spark):
    base = spark.createDataFrame(COLOURS, FULL)
    batch = spark.createDataFrame(
        [(1, COLOURS[0][0], "v", [9.0], None), (0, COLOURS[0][0], "v", [8.0], "{}"), (2, "new", "w", [7.0], "{}")], "seq long, " + FULL
    )
    once = pt.upsert_points(base, batch, "seq")
    assert rows(once) == rows(pt.upsert_points(once, batch, "seq"))
    assert once.count() == 4
    assert rows(once.filter(F.col("id") == COLOURS[0][0]), "vector", "payload") == [([9.0], None)]
    gone = pt.delete_points(once, batch)
    assert rows(gone, "id") == sorted([(COLOURS[1][0],), (COLOURS[2][0],)])
    with pytest.raises(ValueError):
        pt.delete_points(base, batch, filter={"must": []})


def test_get_points_flags_missing_and_malformed_ids(spark):
    ids = spark.createDataFrame([(COLOURS[0][0],), ("5eb1d065-0000-4000-8000-00000000000f",), ("nope",)], "id string")
    got = rows(pt.get_points(spark.createDataFrame(COLOURS, FULL), ids), "id", "found", "error_type")
    assert got == [
        ("5eb1d065-0000-4000-8000-00000000000f", False, "point_not_found"),
        (COLOURS[0][0], True, None),
        ("nope", False, "invalid_uuid"),
    ]


def test_validate_points_splits(spark):
    spec = {"v": (1, "Cosine")}
    more = [("c3fb3d5c-0000-4000-8000-000000000001", "", [1.0], None), ("x", "v", [1.0], None), (COLOURS[0][0], "w", [1.0], None), (COLOURS[0][0], "v", [1.0, 2.0], None)]
    accepted, rejected = pt.split_valid(pt.validate_points(spark.createDataFrame(COLOURS + more, FULL), spec))
    assert accepted.count() == 3 and "error" not in accepted.columns
    assert sorted(r[0] for r in rows(rejected, "error")) == [
        "expected dimension 1",
        "id is not a UUID",
        "unknown vector name w",
        "vector_name is required for point ID c3fb3d5c-0000-4000-8000-000000000001",
    ]


def test_vectors_map_names_the_unnamed(spark):
    data = [("a", "", [1.0], "{}"), ("a", "z", [2.0], "{}"), ("b", None, [3.0], None)]
    got = {r["id"]: r["vectors"] for r in pt.vectors_map(spark.createDataFrame(data, FULL)).collect()}
    assert got == {"a": {"default": [1.0], "z": [2.0]}, "b": {"default": [3.0]}}


def test_projection_does_not_read_dropped_columns(spark, inputs):
    plan = pt.project_points(inputs["points"])._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1]


def test_approximate_search_finds_nine_of_ten_on_the_given_vectors(inputs):
    from cairnframe.plans.catalog import QUERIES

    (row,) = QUERIES["v_ann_recall"].run(inputs).collect()
    assert row["wanted"] == 10 * inputs["points"].count() and row["recall"] >= 0.9
