import json
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnframe.operators import knn
from cairnframe.operators.requests import BAD_VALUE, NOT_FOUND, query_points

from .conftest import rows

POINTS = "id string, vector_name string, vector array<float>, payload string, tokens string, must int, k int"
REQUESTS = (
    "query_id long, vector array<double>, lookup_id string, positives array<string>, negatives array<string>, vector_name string, limit long, offset long, "
    "score_threshold double, must array<struct<key: string, value: string>>, with_payload boolean, with_vector boolean"
)
FIELDS = [f.strip().split(" ")[0] for f in REQUESTS.replace("struct<key: string, value: string>", "x").split(",")]


def _points(spark, n=60, names=("emb",), dim=4):
    rng = random.Random(3)
    found = []
    for name in names:
        for i in range(n):
            payload = {"color": ["red", "green", "blue"][i % 3], "size": i % 4, "even": i % 2 == 0, "code": "7" if i % 5 else 7, "tags": [f"t{i % 2}", 3, True], "n": {"k": i % 2}}
            found.append((f"p{i:03d}", name, [rng.gauss(0, 1) for _ in range(dim)], None if i == 59 else json.dumps(payload), "x", 1, 2))
    return spark.createDataFrame(found, POINTS)


def _requests(spark, *given):
    return spark.createDataFrame([tuple({"query_id": i, "vector_name": "emb", "limit": 10, **g}.get(f) for f in FIELDS) for i, g in enumerate(given)], REQUESTS)


def _ids(df, query_id):
    return [r["id"] for r in df.filter(F.col("query_id") == query_id).orderBy("rank").collect()]


def test_forms_of_requests(spark):
    points = _points(spark)
    own = points.filter("id = 'p005'").first()["vector"]
    got = query_points(
        points,
        _requests(
            spark,
            {"vector": own, "limit": 1, "with_payload": True},
            {"lookup_id": "p005", "limit": 59},
            {"positives": ["p001", "p002"], "negatives": ["p003"], "limit": 7, "with_vector": True},
            {"vector": own, "must": [("color", '"green"')], "limit": 100},
            {"vector": own, "limit": None},
            {"vector": own, "limit": 5, "offset": 3},
            {"vector": own, "limit": 100, "score_threshold": 0.5},
        ),
    ).cache()
    (best,) = got.filter("query_id = 0").collect()
    assert best["id"] == "p005" and best["score"] >= 0.9999 and json.loads(best["payload"])["color"] == "blue" and best["vector"] is None
    assert len(_ids(got, 1)) == 59 and "p005" not in _ids(got, 1)
    assert len(_ids(got, 2)) == 7 and not {"p001", "p002", "p003"} & set(_ids(got, 2))
    assert all(len(r["vector"]) == 4 and r["payload"] is None for r in got.filter("query_id = 2").collect())
    assert sorted(_ids(got, 3)) == sorted(f"p{i:03d}" for i in range(60) if i % 3 == 1)
    assert _ids(got, 4) == [] and got.filter("query_id = 4").count() == 0
    exact = knn.knn_join(points, spark.createDataFrame([(0, own)], "query_id long, vector array<double>"), 8)
    assert _ids(got, 5) == [r["id"] for r in exact.orderBy("rank").collect()][3:]
    assert all(r["score"] >= 0.5 for r in got.filter("query_id = 6").collect()) and 0 < len(_ids(got, 6)) < 60


def test_filters_mask_pairs_as_a_filter_before_ranking_would(spark):
    points = _points(spark)
    plain = {r["id"]: (list(r["vector"]), json.loads(r["payload"]) if r["payload"] else None) for r in points.collect()}
    tests = {"color": ['"red"', '"blue"', "1"], "size": ["0", "3", '"3"', "true"], "even": ["true", '"true"'], "code": ["7", '"7"'], "tags": ['"t1"', "3", "true", '"3"'], "n.k": ["1"], "absent": ["1"]}
    rng = random.Random(8)
    given = []
    for _ in range(80):
        must = [(k, rng.choice(tests[k])) for k in rng.sample(sorted(tests), rng.randint(0, 3))]
        given.append({"vector": [rng.gauss(0, 1) for _ in range(4)], "must": must, "limit": rng.randint(1, 60)})

    def meets(payload, key, value):
        node = payload
        for step in key.split("."):
            node = node.get(step) if isinstance(node, dict) else None
        wanted = json.loads(value)
        return any(type(v) is type(wanted) and v == wanted for v in (node if isinstance(node, list) else [node]))

    expected = set()
    for q, g in enumerate(given):
        def cosine(v, q=g["vector"]):
            return sum(a * b for a, b in zip(q, v)) / math.sqrt(sum(a * a for a in q) * sum(b * b for b in v))

        kept = [i for i, (_, payload) in plain.items() if all(payload is not None and meets(payload, k, v) for k, v in g["must"])]
        ranked = sorted(kept, key=lambda i: (-round(cosine(plain[i][0]), 12), i))[: g["limit"]]
        expected |= {(q, i, rank) for rank, i in enumerate(ranked, 1)}
    requests = _requests(spark, *given)
    for options in ({}, {"broadcast_bytes": 1, "block_bytes": 2000}):
        assert set(map(tuple, query_points(points.repartition(3), requests, **options).select("query_id", "id", "rank").collect())) == expected


def test_faulty_requests_are_rows(spark):
    got = query_points(
        _points(spark),
        _requests(
            spark,
            {"vector": [1.0] * 4, "lookup_id": "p001"},
            {"negatives": ["p001"]},
            {},
            {"positives": ["p001", "nobody"]},
            {"vector": [1.0, 2.0]},
            {"vector": [1.0] * 4, "must": [("size", "1.5")]},
            {"vector": [1.0] * 4, "must": [("size", "{")]},
            {"vector": [1.0] * 4, "limit": 2},
            {"lookup_id": "p001", "vector_name": "other"},
            {"vector": [], "positives": [None]},
        ),
    )
    errors = {r["query_id"]: r["error"] for r in got.filter("error IS NOT NULL").collect()}
    assert sorted(errors) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert errors[0].startswith("cannot use both") and errors[1].startswith("must provide") and errors[2].startswith("must specify")
    assert errors[3] == errors[8] == errors[9] == NOT_FOUND and "expected 4, got 2" in errors[4] and errors[5] == errors[6] == BAD_VALUE
    assert got.filter("error IS NOT NULL AND (id IS NOT NULL OR rank IS NOT NULL)").count() == 0 and len(_ids(got, 7)) == 2


def test_vector_names_and_metrics(spark):
    points = _points(spark, 30, ("a", "b"))
    requests = _requests(spark, {"lookup_id": "p001", "vector_name": "a", "limit": 3}, {"lookup_id": "p001", "vector_name": "b", "limit": 3})
    for metric in ("Cosine", "Dot", "Euclid", "Manhattan"):
        got = query_points(points, requests, metric)
        for query_id, name in ((0, "a"), (1, "b")):
            own = points.filter(F.col("vector_name") == name)
            pair = spark.createDataFrame([(query_id, "pos", "p001")], "request_id long, sign string, id string")
            exact = knn.recommend(own, pair, 3, metric)
            assert rows(got.filter(F.col("query_id") == query_id), "id", "rank") == rows(exact, "id", "rank")


def test_empty_tables(spark):
    points = _points(spark)
    assert query_points(points, _requests(spark)).count() == 0
    nothing = query_points(points.filter("false"), _requests(spark, {"vector": [1.0] * 4}, {"lookup_id": "p001"}))
    assert rows(nothing, "query_id", "error") == [(1, NOT_FOUND)]


@pytest.mark.parametrize("keys", [1, 4])
def test_points_are_read_once_for_any_number_of_filters(spark, keys):
    points = _points(spark)
    given = [{"vector": [1.0] * 4, "must": [(k, "1") for k in ("size", "color", "even", "n.k")[:keys]]} for _ in range(5)]
    plan = query_points(points, _requests(spark, *given))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_conditions_count_in_what_a_pass_takes(spark, monkeypatch):
    """Conditions go to every task as vectors do; a task gets a bounded part of them at a time."""
    points = _points(spark)
    words = [[("tags", json.dumps(f"{'long' * 50}{i}-{j}")) for j in range(20)] for i in range(12)]
    given = [{"vector": [1.0, 0.0, 0.0, 0.0], "limit": 3, "must": w if i % 2 else [("color", '"green"')]} for i, w in enumerate(words)]
    whole = rows(query_points(points, _requests(spark, *given)), "query_id", "id", "rank")
    sent, one_pass = [], knn._broadcast_top

    def watched(points, queries, table, *rest):
        sent.append(sum(len(t) for m in table.column("must").to_pylist() for t in m))
        return one_pass(points, queries, table, *rest)

    monkeypatch.setattr(knn, "_broadcast_top", watched)
    files = len(os.listdir(spark.sparkContext._temp_dir))
    got = query_points(points, _requests(spark, *given), broadcast_bytes=8 << 10, block_bytes=8 << 10)
    assert rows(got, "query_id", "id", "rank") == whole and len(whole) == 18
    assert len(sent) > 1 and max(sent) < sum(sent) / 2
    assert len(os.listdir(spark.sparkContext._temp_dir)) == files


def test_many_conditions_of_one_query_do_not_lengthen_the_others():
    filters = knn._Filters([["a"], None, [f"c{i}" for i in range(1000)], ["b", "a", "a"]] + [["a"]] * 996)
    assert sum(x.nbytes for x in vars(filters).values() if hasattr(x, "nbytes")) < 50_000
    met = filters.met(pa.array([["a"], ["a", "b"], [f"c{i}" for i in range(1000)], None]))
    expected = np.array([[True, True, False, False], [True] * 4, [False, False, True, False], [False, True, False, False]])
    for low, high in ((0, 4), (0, 2), (1, 3), (3, 4)):
        meeting = knn._Meeting(filters.of(low, high), met)
        assert (meeting.all(np.arange(high - low)) == expected[low:high]).all()
        r, c = np.divmod(np.arange(4 * (high - low)), 4)
        assert (meeting.pairs(r, c) == expected[low:high].ravel()).all()
