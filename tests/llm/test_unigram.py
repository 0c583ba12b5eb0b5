import itertools
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from cairnframe.llm import segmentation, token_counts, unigram
from cairnframe.llm.queries import vocabulary

from .cases import LONG, edge_documents, no_documents, rows

TEXTS = [
    "Hello  world", " a", "a ", "\n\n", "   ", "the cat\nsat on the mat", "naïve Straße 漢字 \U0001f600 x", "a▁b", "\t x\x00y", "x" * 300, "word " * 50,
    "return  foo(bar);\n    // done", "ing tion the and", "", LONG[:5000],
]


@pytest.fixture(scope="module")
def words():
    return vocabulary()


@pytest.fixture(scope="module")
def library(words):
    """The same pieces and scores in another implementation, which adds scores up in double precision."""
    import public_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, model.unk_id(), True))


def _corpus(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return TEXTS + [t for t in texts if t]


def test_best_segmentation_equals_the_library(spark, words, library):
    docs = spark.createDataFrame(list(enumerate(_corpus(spark))), "doc_id long, text string")
    expected = {i: library.encode(unigram.marked(t)).ids if t else [] for i, t in enumerate(_corpus(spark))}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, words).collect()}
    assert counts == {i: len(ids) for i, ids in expected.items()}
    got = segmentation.segmented(docs, words, 3).withColumn("back", segmentation.decode(spark, words, F.col("encoded.ids"))).collect()
    assert {r["doc_id"]: r["encoded"]["ids"] for r in got} == expected
    assert all(r["back"] == r["text"].replace("▁", " ") for r in got)


def _all_segmentations(text, vocabulary):
    score = dict(zip(vocabulary.pieces, vocabulary.scores))
    ids = dict(zip(vocabulary.pieces, vocabulary.ids))

    def go(at):
        if at == len(text):
            yield 0.0, ()
            return
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            if piece in score:
                edge, own = score[piece], (ids[piece],)
            elif end == at + 1:
                edge, own = vocabulary.unknown_score, (vocabulary.unknown,)
            else:
                continue
            for s, rest in go(end):
                yield edge + s, own + rest

    def merged(found):
        return tuple(i for k, i in enumerate(found) if i != vocabulary.unknown or not k or found[k - 1] != vocabulary.unknown)

    return sorted(((s, merged(found)) for s, found in go(0)), key=lambda x: -x[0])


def _small(pieces):
    names, scores = zip(*pieces)
    return unigram.Vocabulary(names, scores, tuple(range(1, len(names) + 1)), (), 0, ())


@pytest.mark.parametrize("seed", range(12))
def test_nbest_against_all_segmentations(seed):
    rng = random.Random(seed)
    alphabet = "ab▁" if seed % 2 else "abc"
    found = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(14)}
    words = _small([(p, float(-rng.randint(1, 6))) for p in sorted(found)])
    lattice = unigram.Lattice(words)
    for _ in range(30):
        text = "".join(rng.choice("abc▁") for _ in range(rng.randint(1, 9)))
        every = _all_segmentations(text, words)
        got = lattice.nbest(text, 6)
        assert [s for s, _ in got] == [s for s, _ in every[:6]]
        assert not Counter(got) - Counter(every)
        score, ids, gap = lattice.best(text)
        assert (score, ids) == got[0] and lattice.count(text) == (len(ids), score)
        assert gap == (every[1][0] - score if len(every) > 1 else float("-inf"))


def test_unknown_runs_are_one_piece_as_in_the_library():
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -1.2), ("жa", -3.0), ("▁b", -1.1), ("\n", -4.0)]
    words = unigram.Vocabulary(tuple(p for p, _ in pieces[1:]), tuple(s for _, s in pieces[1:]), tuple(range(1, len(pieces))), (), 0, ())
    library = tokenizers.Tokenizer(tokenizers.models.Unigram([(p, s if i else -14.0) for i, (p, s) in enumerate(pieces)], 0, False))
    lattice, parts_of = unigram.Lattice(words), unigram.splitter(words)
    rng = random.Random(3)
    for text in ["abжжжb", "жжж", "a жж bж\nжa", "ж"] + ["".join(rng.choice("abж \nя") for _ in range(rng.randint(1, 30))) for _ in range(200)]:
        parts = parts_of(unigram.marked(text))
        expected = library.encode(unigram.marked(text)).ids
        assert [i for p in parts for i in lattice.best(p)[1]] == expected
        assert sum(lattice.count(p)[0] for p in parts) == len(expected)
        assert [i for p in parts for i in lattice.nbest(p, 2)[0][1]] == expected


def test_parts_together_equal_parts_alone(words):
    lattice, parts_of = unigram.Lattice(words), unigram.splitter(words)
    parts = [p for t in [*TEXTS, LONG] for p in parts_of(unigram.marked(t))] + ["", "aaaa", "▁" * 70, "x" * 63]
    for some in (parts, parts[:1], [""], []):
        scores, gaps, ends, ids = lattice.best_of_all(some)
        got = [(scores[k], tuple(ids[ends[k] : ends[k + 1]].tolist()), gaps[k]) for k in range(len(some))]
        assert got == [lattice.best(p) for p in some] and len(ends) == len(some) + 1
    ties = unigram.Lattice(_small([("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", 0.0), ("ab", -1.0)]))
    some = ["".join(c) for n in range(1, 6) for c in itertools.product("ab", repeat=n)]
    scores, gaps, ends, ids = ties.best_of_all(some)
    assert [(scores[k], tuple(ids[ends[k] : ends[k + 1]].tolist()), gaps[k]) for k in range(len(some))] == [ties.best(p) for p in some]


def test_equal_losses_take_fewer_changes_then_earlier_ones():
    lists = [[0.0, 0.0, -1.0], [0.0, 0.0], [0.0, -0.5], [0.0, 0.0, 0.0]]
    got = segmentation.combine([x[1] for x in lists], lambda i: lists[i], 4)
    every = sorted(((sum(lists[i][r] for i, r in enumerate(pick)), tuple((i, r) for i, r in enumerate(pick) if r)) for pick in itertools.product(*[range(len(x)) for x in lists])), key=lambda k: (-k[0], len(k[1]), k[1]))
    assert got == every[:4]


def test_few_remembered_parts_change_nothing(words, monkeypatch):
    texts = [t for t in TEXTS for _ in range(2)]
    whole = segmentation._segmented(texts, segmentation._Parts(words, 1 << 30), 4)
    known = segmentation._Parts(words, 500)
    assert [segmentation._segmented([t], known, 4).to_pylist()[0] for t in texts] == whole.to_pylist()
    assert known.size < 100_000 and len(known) == len(known.scores) == len(known.ends) - 1 == len(known.uses)


def test_ties_take_the_longest_last_piece():
    lattice = unigram.Lattice(_small([("a", -1.0), ("aa", -2.0), ("aaa", -3.0)]))
    assert lattice.best("aaaa")[1] == (1, 3)
    assert lattice.nbest("aaaa", 1)[0][1] == (1, 3)


def test_merged_lists_equal_a_search_over_the_whole(words):
    lattice, parts_of = unigram.Lattice(words), unigram.splitter(words)
    for text in ["the cat sat", "hello world foo", "a b c d e"]:
        marked = unigram.marked(text)
        parts = parts_of(marked)
        assert len(parts) > 1
        lists = [lattice.nbest(p, 5) for p in parts]
        gaps = [lattice.best(p)[2] for p in parts]
        best = sum(x[0][0] for x in lists)
        got = segmentation.combine(gaps, lambda i: [s - lists[i][0][0] for s, _ in lists[i]], 5)
        assert [best + loss for loss, _ in got] == [s for s, _ in lattice.nbest(marked, 5)]
        every = sorted((sum(lists[i][r][0] for i, r in enumerate(pick)) for pick in itertools.product(*[range(len(x)) for x in lists])), reverse=True)
        assert [best + loss for loss, _ in got] == every[:5]


def test_edits_give_the_other_segmentations(spark, words):
    docs = spark.createDataFrame([(1, "the cat sat on a mat\nand so on")], "doc_id long, text string")
    row = segmentation.segmented(docs, words, 5).first()["encoded"]
    whole = unigram.Lattice(words).nbest(unigram.marked("the cat sat on a mat\nand so on"), 5)
    assert [row["score"], *(o["score"] for o in row["others"])] == [s for s, _ in whole]
    written = words.written
    for other in row["others"]:
        ids = list(row["ids"])
        for edit in sorted(other["edits"], key=lambda e: -e["at"]):
            ids[edit["at"] : edit["at"] + edit["drop"]] = edit["ids"]
        assert len(ids) == other["n_pieces"]
        assert b"".join(written[i] for i in ids) == b" the cat sat on a mat\nand so on"


def test_edge_rows(spark, words):
    docs = edge_documents(spark)
    got = token_counts.count_tokens(docs, words).collect()
    assert len(got) == docs.count() and all((r["n_tokens"], r["score"]) == (0, 0.0) for r in got if r["doc_id"] in (3, 4))
    encoded = segmentation.segmented(docs.withColumn("encoded", F.lit(1)), words)
    assert encoded.columns == [*docs.columns, "encoded"]
    back = encoded.withColumn("back", segmentation.decode(spark, words, F.col("encoded.ids"))).collect()
    assert [r["back"] for r in back] == [t or "" for _, t, *_ in rows()]
    assert token_counts.count_tokens(no_documents(spark), words).count() == 0
    assert segmentation.segmented(no_documents(spark), words).count() == 0
    nothing = spark.createDataFrame([(None,), ([],), ([10**6, words.ids[words.pieces.index("▁the")]],)], "ids array<int>")
    assert [r[0] for r in nothing.select(segmentation.decode(spark, words, F.col("ids"))).collect()] == [None, "", "the"]
