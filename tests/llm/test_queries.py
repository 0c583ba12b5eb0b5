"""The registered queries against their SQL, or against plain versions where SQL has none."""

import hashlib
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from cairnframe.llm import flac, unigram
from cairnframe.llm.common import stored
from cairnframe.llm.queries import QUERIES, SQL, vocabulary
from check import compare, connect

from ..conftest import SF_DIR
from .cases import edge_documents, no_documents
from .test_near_dedup import plain


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_rows(spark, con, key):
    problem = compare(QUERIES[key](spark, SF_DIR), con, SQL[key])
    assert problem is None, problem


def test_flac_query(spark, texts):
    for r in QUERIES["op10_flac"](spark, SF_DIR).collect():
        payload = flac.payload_of(texts[r["doc_id"]])
        (media,) = flac.encode([payload])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(texts[r["doc_id"]].encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())


def test_token_queries(spark, texts):
    words = vocabulary()
    lattice, parts_of = unigram.Lattice(words), unigram.splitter(words)
    best = {i: [lattice.best(p) for p in parts_of(unigram.marked(t))] for i, t in texts.items()}
    for r in QUERIES["op4_token_counts"](spark, SF_DIR).collect():
        assert (r["n_tokens"], r["score"]) == (sum(len(b[1]) for b in best[r["doc_id"]]), sum(b[0] for b in best[r["doc_id"]]))
    for r in QUERIES["op7_sentencepiece"](spark, SF_DIR).collect():
        ids = [i for b in best[r["doc_id"]] for i in b[1]]
        assert r["round_trip"] and (r["n_pieces"], r["score"]) == (len(ids), sum(b[0] for b in best[r["doc_id"]]))
        assert r["ids_crc32"] == zlib.crc32(" ".join(map(str, ids)).encode())
        gaps = sorted((b[2] for b in best[r["doc_id"]]), reverse=True)
        assert r["other_scores"][0] == r["score"] + gaps[0] and r["other_scores"] == sorted(r["other_scores"], reverse=True)


def test_pipeline_stages(spark, texts):
    """Each stage against a plain version on the same rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language", "near_dedup", "mix", "sentencepiece"]

    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op5_toxicity"](spark, SF_DIR).collect()}
    clean = stages["toxicity"](spark, docs, SF_DIR)
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, p in scores.items() if p == 0}

    kept = stages["language"](spark, clean, SF_DIR)
    assert kept.columns == columns and kept.count() >= 0.99 * clean.count()

    single = stages["near_dedup"](spark, kept, SF_DIR)
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, _, stays) in plain(rows, 5, 80).items() if stays)

    mixed = stages["mix"](spark, single, SF_DIR)
    assert mixed.columns == columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= {r["doc_id"] for r in single.collect()} and max(copies.values()) <= 3

    last = stages["sentencepiece"](spark, mixed, SF_DIR).collect()
    assert Counter(r["doc_id"] for r in last) == copies and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in last)
    whole = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "n_pieces").collect()
    assert Counter(map(tuple, whole)) == Counter((r["doc_id"], r["n_pieces"]) for r in last)


@pytest.mark.parametrize("make", [edge_documents, no_documents])
def test_stages_on_edge_rows_and_empty_tables(spark, make):
    """Nulls, empty and long texts, repeats and columns named like a stage's own: columns stay, and no value is replaced."""
    docs = make(spark)
    seen = {(r["doc_id"], r["text"], r["toxicity"], r["language"], r["score"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stored(stage(spark, docs, SF_DIR))
        assert docs_after.columns == docs.columns, name
        assert {(r["doc_id"], r["text"], r["toxicity"], r["language"], r["score"]) for r in docs_after.collect()} <= seen, name
        docs = docs_after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert len(last) == docs.count() and all(r["round_trip"] for r in last)


def test_a_task_of_the_last_stage_has_one_python_worker(spark):
    """Encoding and decoding run one after the other: each Python step of a plan keeps a worker of its own in every running task."""
    docs = spark.createDataFrame([(1, "a b", "en", "x", 3), (None, None, None, None, None), (1, "a b", "en", "x", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.encode_texts(spark, docs, SF_DIR)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"] or 0, r["lang"] or "", r["n_pieces"] > 0, r["round_trip"]) for r in found.collect()) == [(0, "", False, True), (1, "en", True, True), (1, "en", True, True)]
