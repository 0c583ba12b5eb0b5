import random

import pytest

from cairnframe.llm import near_dedup

from .cases import edge_documents, no_documents


def _sets(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain(rows, width, percent):
    """Components by comparing all pairs."""
    sets = {i: _sets(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def _near_copies(n_groups=12, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(n_groups):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 18)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    # A chain: each text is near the next one only.
    base = [word() for _ in range(200)]
    for step in range(12):
        texts.append(" ".join(base[step * 8 :] + [f"z{i}" for i in range(step * 8)]))
    texts += ["a", "A", "a b", "a  b", "", " "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    rows = _near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, width, percent).collect()}
    assert got == plain(rows, width, percent)


def test_late_pairs_connect_groups(spark):
    """The smallest member of every bucket is far from the others, which are near each other in a long chain."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base[:60] + [f"q{i}" for i in range(60)]))]
    for i in range(1, 60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == plain(rows, 3, 85)


def test_edge_rows(spark):
    got = [tuple(r) for r in near_dedup.near_duplicates(edge_documents(spark), 3, 85).orderBy("doc_id").collect()]
    assert (1, 6, 1, True) in got and (2, 6, 1, False) in got
    assert (3, 0, 3, True) in got and (4, 0, 4, True) in got and (5, 0, 5, True) in got
    assert got.count((8, 4, 8, True)) == 2
    assert (None, 3, None, True) in got and (10, 1, 10, True) in got
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0


def test_one_document_of_a_group_stays(spark):
    docs = edge_documents(spark)
    got = near_dedup.drop_near_duplicates(docs, 3, 85)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "10", "3", "4", "5", "6", "7", "8", "9", "None"]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def test_banding_misses_less_than_asked():
    for percent in (80, 85, 95):
        bands, rows = near_dedup.banding(percent)
        assert bands * rows <= 216 and (1 - (percent / 100) ** rows) ** bands <= 1e-6
