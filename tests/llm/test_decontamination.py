import hashlib
import random
import re

import pytest

from cairnframe.llm import decontamination

from .cases import edge_documents, no_documents


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, window=10):
    grams = {}
    for item, text in items:
        words = _words(text)
        m = min(window, len(words))
        for s in range(len(words) - m + 1 if m else 0):
            grams.setdefault(tuple(words[s : s + m]), set()).add("" if item is None else str(item))
    sizes = sorted({len(g) for g in grams})
    out = []
    for doc_id, text in docs:
        words, hit, found = _words(text), set(), set()
        for m in sizes:
            for s in range(len(words) - m + 1):
                if owners := grams.get(tuple(words[s : s + m])):
                    hit |= set(range(s, s + m))
                    found |= owners
        ids = sorted(found)
        out.append((doc_id, len(words), len(hit), len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _got(docs, items, **options):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in decontamination.contamination(docs, items, **options).select(*columns).collect()), key=repr)


def _tables(seed, short):
    rng = random.Random(seed)
    letters = ["a", "b", "É", "9", "ab", "Zz"] if seed % 2 else ["w%d" % i for i in range(300)]

    def prose(n):
        return "".join(rng.choice(letters) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(i, prose(rng.randint(10, 45))) for i in range(20)] + [(3, prose(12)), (None, prose(11)), (30, None), (31, " .,")]
    if short:
        items += [(40 + n, prose(n)) for n in (1, 4, 5, 9, 9)]
    texts = [t for _, t in items if t]
    docs = []
    for i in range(60):
        words = _words(prose(rng.randint(0, 120)))
        for _ in range(rng.randint(0, 3)):
            source = _words(rng.choice(texts))
            start = rng.randrange(len(source)) if source else 0
            at = rng.randint(0, len(words))
            words[at:at] = source[start : start + rng.choice([8, 9, 10, 11, 30])]
        docs.append((i, rng.choice([" ", " / "]).join(words).upper() if i % 7 == 0 else " ".join(words)))
    return docs + docs[:5] + [(None, texts[0]), (5, texts[1]), (99, None), (100, "")], items


@pytest.mark.parametrize("seed, short, window", [(1, False, 10), (2, False, 10), (1, True, 10), (2, True, 10), (4, True, 7), (6, False, 5)])
def test_against_plain_search(spark, seed, short, window):
    docs, items = _tables(seed, short)
    expected = plain(docs, items, window)
    got = _got(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), window=window)
    assert got == expected
    assert any(r[2] for r in expected)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_PAGES", 1)
    monkeypatch.setattr(decontamination, "PAGE", 8 * 4096)
    docs, items = _tables(2, True)
    items += [(1000 + i, " ".join(f"x{i}y{j}" for j in range(400))) for i in range(20)]
    docs += [(2000, items[-1][1])]
    assert _got(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == plain(docs, items)


def test_edge_rows_and_empty_tables(spark):
    docs = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "two three four five six seven"), (2, rows[5][1]), (2, ""), (None, "no id here at all")]
    table = spark.createDataFrame([(i, t, "e", 1) for i, t in items], "item_id long, text string, doc_id string, value int")
    assert _got(docs, table) == plain(rows, items)
    assert _got(docs, table.filter("false")) == plain(rows, [])
    assert _got(no_documents(spark), table) == []
    with pytest.raises(ValueError):
        decontamination.contamination(docs, table, window=4)


def test_no_python_on_the_main_path(spark):
    docs, items = _tables(2, True)
    df = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().toString() and "InArrow" not in df._jdf.queryExecution().toString()
