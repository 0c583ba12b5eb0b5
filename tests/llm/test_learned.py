import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnframe.llm import language_id, toxicity
from cairnframe.llm.queries import QUERIES

from .cases import edge_documents, no_documents

SF = "/root/testdata/sf0.1"


def _language(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


KINDS = {"aa": "ka to mi ren sul".split(), "bb": "schu ber wein ach ung".split(), "cc": "eau ille tre oi qué".split()}


def _texts(n=240, seed=1):
    rng = random.Random(seed)
    names = sorted(KINDS)
    return [(i, _language(rng, KINDS[names[i % 3]], rng.randint(20, 90)), names[i % 3]) for i in range(n)]


def test_languages_are_told_apart(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string, lang string")
    got = language_id.identify(docs, F.col("doc_id") % 2 == 0).collect()
    assert all(r["language"]["lang"] == r["lang"] and 0 < r["language"]["score"] <= 1 and not r["language"]["rejected"] for r in got)


def test_far_texts_are_rejected(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    strange = [("жук " * 200,), ("жук",), ("12 34 !!",), (_language(random.Random(9), KINDS["aa"], 60),)]
    got = [r[0] for r in spark.createDataFrame(strange, "text string").coalesce(1).select(language_id.predict(spark, model, F.col("text"))).collect()]
    assert [g["rejected"] for g in got] == [True, False, True, False]
    assert [g["lang"] for g in got][2:] == ["und", "aa"]


def test_short_texts_have_a_finite_reach(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(_texts(), "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    strange = ["жук летит " * k for k in (1, 5, 15, 20)] + [_language(random.Random(9), KINDS["bb"], n) for n in (4, 10, 20)] + ["жук"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in strange], "text string").coalesce(1).select(language_id.predict(spark, model, F.col("text"))).collect()]
    assert [g["rejected"] for g in got] == [True] * 4 + [False] * 4
    # However far, a text with letters is named.
    assert all(g["lang"] in KINDS for g in got) and [g["lang"] for g in got][4:7] == ["bb"] * 3
    rows = docs.unionByName(spark.createDataFrame([(900, "жук летит " * 15, None), (901, "жук", None), (902, strange[5], None)], docs.schema))
    kept = corpus_pipeline.keep_known_languages(spark, rows, "").filter("doc_id >= 900").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in kept) == [(901, None), (902, "bb")]


def test_an_odd_document_does_not_widen_the_reach(spark):
    rows = _texts() + [(1000 + i, " ".join(f"{chr(1072 + i)}{chr(1073 + j % 25)}" for j in range(200)) + _language(random.Random(i), KINDS["aa"], 60), "aa") for i in range(3)]
    one = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), clusters=1)
    assert one.reach.max() < 0.95
    assert max(language_id.reaches(one, np.zeros(5, int), np.array([8, 50, 150, 200, 9000]))) <= 0.95


def _plain_counts(text):
    """The n-grams of one text, made character by character."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = " ".join(kept.split()) + " " if kept.strip() else ""
    counts = np.zeros(language_id.DIMS)
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            gram = kept[i : i + n]
            if (n == 1 and gram == " ") or (n == 3 and gram[1] == " "):
                continue
            h = n
            for c in gram:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & (2**64 - 1)
                h ^= h >> 29
            counts[h % language_id.DIMS] += 1
    return counts


def test_counts_equal_plain_ones_whatever_stands_beside():
    texts = ["Hello, World!", "a", "über  größe\nstraße", "x1y2z3", "one two three"]
    got, letters = language_id._counts(texts, language_id._letters())
    for i, text in enumerate(texts):
        assert letters[i] == sum(c.isalpha() for c in text)
        assert (got[i] == _plain_counts(text)).all(), text


def test_language_of_edge_rows(spark):
    docs = edge_documents(spark)
    got = language_id.identify(docs, F.col("lang").isNotNull())
    assert got.columns == docs.columns
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["language"]["lang"] in ("de", "en")) == letters and (r["language"]["lang"] == "und") == (not letters)
    assert language_id.identify(no_documents(spark), F.lit(True)).count() == 0
    unlearned = language_id.identify(docs, F.lit(False)).collect()
    assert {r["language"]["lang"] for r in unlearned} == {"und"}


def test_label_model_sees_through_noise():
    """Voters of known accuracy, three of them copies of one, and labels of which some are wrong."""
    rng = np.random.default_rng(3)
    n = 6000
    truth = rng.random(n) < 0.2
    votes = [np.where(truth, rng.random(n) < on, rng.random(n) < off) for on, off in ((0.6, 0.02), (0.5, 0.01), (0.4, 0.02), (0.3, 0.01))]
    weak = np.where(truth, rng.random(n) < 0.3, rng.random(n) < 0.25)
    votes = np.column_stack([*votes, weak, weak, weak])
    labels = np.where(rng.random(n) < 0.04, ~truth, truth)
    posterior, on, off, share = toxicity.label_model(votes, labels.astype(int), np.ones(n))
    assert ((posterior >= 0.5) == truth).mean() > (labels == truth).mean()
    assert np.allclose(on[:4], [0.6, 0.5, 0.4, 0.3], atol=0.06) and np.allclose(off[:4], [0.02, 0.01, 0.02, 0.01], atol=0.02)
    assert share[4:7].max() < 0.4 < share[:4].min()


def _toxic_rows(n=900, seed=2):
    """Insults, and words of an invented language that all begin alike, mark the toxic ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = _language(rng, KINDS["aa"], 60).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot,", "scum"]) if i % 2 else "zorbu" + rng.choice(["ka", "to", "mi"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxic_documents_are_found(spark):
    rows = _toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.classify(docs.drop("toxic"), docs.drop("text")).collect()
    truth = {i: t for i, _, t in rows}
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 100
    assert all((r["toxicity"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held)


def test_held_out_labels_play_no_part(spark):
    docs = spark.createDataFrame(_toxic_rows(300), "doc_id long, text string, toxic int")
    turned = docs.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (dict(map(lambda r: (r["doc_id"], r["toxicity"]), toxicity.classify(docs.drop("toxic"), t.drop("text")).collect())) for t in (docs, turned))
    assert one == two


def test_toxicity_of_edge_rows(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (None, 1), (9, None), (8, 1), (8, 0), (10, 7)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels)
    assert got.columns == docs.columns
    scores = {r["doc_id"]: r["toxicity"] for r in got.collect()}
    assert len(scores) == 11 and all(0 <= s <= 1 for s in scores.values())
    assert scores[3] == scores[4] == scores[5]
    assert toxicity.classify(no_documents(spark), labels).count() == 0
    only_clean = toxicity.classify(docs, labels.filter("toxic = 0")).collect()
    assert {r["toxicity"] < 0.5 for r in only_clean} == {True}


@pytest.mark.parametrize("name,column,least", [("op9_language", "lang", 0.98), ("op5_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, column, least):
    got = QUERIES[name](spark, SF)
    truth = spark.read.parquet(f"{SF}/{'documents' if column == 'lang' else 'labels'}.parquet").select("doc_id", column)
    rows = got.filter("held_out").join(truth, "doc_id").collect()
    right = [(r["lang_pred"] == r["lang"]) if column == "lang" else (r["predicted"] == r["toxic"]) for r in rows]
    assert len(rows) > 700 and sum(right) / len(right) >= least


def test_language_is_the_nearest_centroid(spark):
    """The model's own vectors, compared one by one; a far text is named too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    texts = [r["text"] for r in docs.limit(60).collect()] + ["\u4f60\u597d\u4e16\u754c" * 23, "", None, "12 34"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    letters = language_id._letters()
    for r in table.select("text", language_id.predict(spark, model, F.col("text")).alias("l")).collect():
        counts, n_letters = language_id._counts([r["text"] or ""], letters)
        if not n_letters[0]:
            assert tuple(r["l"]) == ("und", 0.0, 1.0, True)
            continue
        x = [math.log1p(c) * w for c, w in zip(counts[0].tolist(), model.idf.tolist())]
        norm = math.sqrt(sum(v * v for v in x))
        cosines = [sum(a * b for a, b in zip(x, c.tolist())) / norm for c in model.centroids]
        best = max(cosines)
        assert r["l"]["lang"] in {model.langs[model.of[k]] for k, c in enumerate(cosines) if c > best - 1e-5}
        assert abs(r["l"]["score"] - min(max(best, 0), 1)) < 1e-5
