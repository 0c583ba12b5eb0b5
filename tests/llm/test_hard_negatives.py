import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnframe.llm import hard_negatives


def plain(rows, is_anchor, positives=5, negatives=5):
    ok = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({i for i, _, _ in ok if is_anchor(i)}):
        vector, label = min((v, l) for i, l, v in ok if i == anchor)
        scored = sorted(((sum(a * b for a, b in zip(vector, v)), i, l) for i, l, v in ok if i != anchor and len(v) == len(vector)), key=lambda s: (-s[0], s[1]))
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score][:negatives]
            out += [(anchor, positive, rank, i, score, s) for rank, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


def _rows(n, seed, spread, size=8, positive=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0.5 if positive else 0, spread) for _ in range(size)]
        rows.append((i, rng.choice([0, 1, 2, 2, 2, 2, None]), [float(np.float32(x)) for x in v]))
    rows += [(n + i, i % 3, rows[3][2]) for i in range(40)]  # equal vectors: ties
    rows += [(n + 50, 1, None), (n + 51, 1, [1.0, None] * 4), (n + 52, 1, [float("nan")] * 8), (n + 53, 1, [float("inf")] * 8), (None, 1, [1.0] * size), (n + 54, 1, [0.5]), (n + 55, 2, [0.5])]
    return rows


def _got(spark, rows, every, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"), **options).collect())


def test_against_plain_search(spark):
    for seed, spread, positive in ((1, 0.2, True), (2, 1.0, False), (3, 300.0, False)):
        rows = _rows(300, seed, spread, positive=positive)
        expected = plain(rows, lambda i: i % 20 == 0)
        assert expected and _got(spark, rows, 20) == expected
        assert _got(spark, rows, 20, block_rows=4) == expected


def test_repeated_ids_of_anchors(spark):
    rows = _rows(100, 4, 0.3, positive=True) + [(0, 1, [0.25] * 8), (20, 2, [0.125] * 8)]
    assert _got(spark, rows, 20) == plain(rows, lambda i: i % 20 == 0)


@pytest.mark.parametrize("reach, size", [(3, 64), (300, 64), (40_000, 5), (1 << 26, 3), (1 << 30, 1)])
def test_packed_products_are_exact(reach, size):
    rng = np.random.default_rng(reach)
    anchors = rng.integers(-reach, reach + 1, (7, size))
    vectors = rng.integers(-reach, reach + 1, (50, size))
    anchors[0], vectors[0], vectors[1] = reach, reach, -reach
    expected = [[sum(int(x) * int(y) for x, y in zip(a, v)) for v in vectors] for a in anchors]
    assert hard_negatives.products(anchors, vectors).tolist() == expected


def test_several_candidates_share_a_word():
    vectors = np.random.default_rng(1).integers(-130, 130, (10, 64))
    bits = (64 * 259 * 259).bit_length()
    assert hard_negatives.fields_of(bits) >= 2 and len(hard_negatives.packed(vectors, 130, bits)) == 5
    # A field wider than a machine word is a Python integer.
    assert hard_negatives.packed(vectors, 130, 70).dtype == object


def test_few_rows_no_rows_and_clashing_names(spark):
    schema = "vec_id long, embedding array<float>, label int, v string, asks int, place string, score int, block int"
    rows = [(0, [0.5], 1, "x", 1, "p", 2, 3), (1, [0.5], 1, "x", 1, "p", 2, 3), (2, [0.45], 2, "x", 1, "p", 2, 3)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0, F.col("label")).collect()]
    assert got == [(0, 1, 1, 2, 128 * 128, 128 * 115)]
    assert hard_negatives.mine(df.filter("false"), F.col("vec_id") == 0, F.col("label")).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") == 9, F.col("label")).count() == 0
    assert hard_negatives.mine(df.filter("vec_id != 1"), F.col("vec_id") == 0, F.col("label")).count() == 0


def test_scores_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [2.0**26, 1.0]), (1, 1, [2.0**26, 2.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError):
        hard_negatives.mine(df, F.col("vec_id") == 0, F.col("label"))
