import random
import re
import zlib
from collections import Counter

import pytest

from cairnframe.llm import spelling

from .cases import edge_documents, no_documents


def _edits(a, b):
    """Whether one inserted, deleted or replaced code point tells the words apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows, every=199, shortest=6, least=5, ratio=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if crc % every == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in words if _edits(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def _got(df, **options):
    return [tuple(r) for r in spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def _texts(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcéßÀ") for _ in range(rng.randint(5, 8))) for _ in range(25)]
    rows = []
    for doc_id in range(120):
        words = []
        for _ in range(rng.randint(5, 60)):
            word = rng.choice(stems[: rng.randint(1, 25)])
            if rng.random() < 0.15:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "b", "É", "ab"]) + word[at + 1 :]
            words.append(word.title() if rng.random() < 0.1 else word)
        rows.append((doc_id % 100, rng.choice([" ", ", ", "7"]).join(words)))
    return rows + [(None, "abcabc abcabc"), (1, None), (2, "")]


@pytest.mark.parametrize("symbols, crowd", [(None, spelling.CROWD), (2, 3), (4, 1), (16, 256)])
def test_against_plain_comparison(spark, symbols, crowd):
    rows = _texts(symbols or 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain(rows, every=7, least=1, ratio=2)
    got = _got(df, every=7, least=1, ratio=2, symbols=symbols, crowd=crowd)
    assert len(got) == len(expected) and set(got) == expected
    assert any(r[1] not in (None, r[2]) for r in expected)


def test_pairs_of_random_words(spark):
    rng = random.Random(5)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)} | {"zzzzzz", "zzzzyz", "ÿÿ", "ÿ"})
    df = spark.createDataFrame([(w,) for w in words + words[:9]], "word string")
    expected = {(a, b) for a in words for b in words if _edits(a, b)}
    for symbols, crowd in ((2, 4), (5, 256)):
        got = [tuple(r) for r in spelling.near_words(df, symbols, crowd).collect()]
        assert len(got) == len(expected) and set(got) == expected


def test_neighbourhood_holds_every_edit():
    import numpy as np

    def form(word):
        return spelling._form(np.array([[ord(c) for c in word]], np.uint32), 4)[0]

    for word in ("abcdef", "aaaaaa", "zéÿabcabc"):
        near = spelling._neighbourhood(np.array([[ord(c) for c in word]], np.uint32), 4)[0].tolist()
        others = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + k :] for c in "abkzÀ" for k in (0, 1) for i in range(len(word) + 1 - k)}
        assert {int(form(o)) for o in others | {word}} <= set(near)


def test_long_texts_are_cut_between_runs():
    text = "ab" * 700 + " " + "cd efgh, " * 300
    for size in (1, 7, 1000):
        parts = list(spelling.pieces(text, size))
        assert "".join(parts) == text
        assert [r for p in parts for r in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)


def test_edge_rows_and_empty_tables(spark):
    df = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert set(_got(df, least=1)) == plain(rows, least=1)
    assert set(_got(df)) == plain(rows) and ("epsilon", None, "epsilon", 4000, 0, None) in _got(df)
    assert _got(no_documents(spark)) == []
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)


def test_the_order_of_rows_does_not_matter(spark):
    rows = _texts(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(_got(df.repartition(1), every=7)) == set(_got(df.orderBy("text").repartition(7), every=7))
