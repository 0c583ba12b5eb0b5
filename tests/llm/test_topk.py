import math
import random

import pytest
from pyspark.sql import functions as F

from cairnframe.llm import topk


def _plain(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        vector = min(v for i, v in ok if i == q)
        scores = [(sum(a * b for a, b in zip(vector, v)), i) for i, v in ok if i != q and len(v) == len(vector)]
        for rank, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1):
            out.add((q, rank, i, s))
    return out


def _vectors(n, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(8)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(50)]  # many equal vectors: ties at every kth value
    rows += [(n + 60, None), (n + 61, [1.0, None] * 4), (n + 62, [float("nan")] * 8), (n + 63, [float("inf")] * 8), (n + 64, [1.0]), (n + 65, [2.0]), (None, [1.0] * 8)]
    return rows + [(140, rows[5][1]), (5, rows[7][1])]


def test_against_plain_search(spark):
    for seed, spread in ((1, 1.0), (2, 200.0), (3, 30_000.0)):
        rows = _vectors(300, seed, spread)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
        plain = [(i, None if v is None else [None if x is None else _float32(x) for x in v]) for i, v in rows]
        got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7, block_rows=6).collect()}
        assert got == _plain(plain, 7)


def _float32(x):
    import numpy as np

    return float(np.float32(x))


def test_fewer_candidates_than_k_and_no_rows(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.25]), (2, [0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()] == [(0, 1, 1, 512), (0, 2, 2, 512)]
    assert topk.top_k(df.filter("false"), F.col("vec_id") == 0, 20).count() == 0


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(0, [0.5], 1, "x", 2), (1, [0.25], 1, "x", 2)], "vec_id long, embedding array<float>, v int, asks string, score int")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 1).collect()] == [(0, 1, 1, 512)]


def test_large_components_take_part(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice((3, 20, 23)) for _ in range(4)]) for i in range(60)] + [(60, [2.0**20, 0.0, 0.0, 0.0]), (61, [-(2.0**22)] * 4), (62, [2.0**60])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()}
    assert got == _plain(rows, 7) and {60, 61} & {i for _, _, i, _ in got}


def test_scores_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(0, [2.0**26, 1.0]), (1, [2.0**26, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(df, F.col("vec_id") == 0, 1)
