"""N-best SentencePiece encoding, and decoding."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS, sized, small_batches
from .unigram import Lattice, Vocabulary, marked, splitter

#: Characters whose segmentations are put together at once.
CHARS = 1 << 18
#: Bytes of parts and their segmentations that a worker remembers, by estimate, and parts whose N-best list is.
KEPT_BYTES, KEPT_LISTS = 64 << 20, 4_000
#: Estimated bytes of a remembered part besides its characters and ids.
EACH = 200

ENCODED = "struct<ids: array<int>, score: double, others: array<struct<score: double, n_pieces: int, edits: array<struct<at: int, drop: int, ids: array<int>>>>>>"
_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_OTHER = pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("edits", pa.list_(_EDIT))])


class _Parts(dict):
    """Numbers of parts of texts, and for each number score, ids and gap of the best segmentation.

    When it has grown to ``most`` bytes, only the parts used most stay, a quarter of them (:meth:`shrink`).
    """

    def __init__(self, vocabulary: Vocabulary, most: int):
        self.lattice, self.parts_of, self.most = Lattice(vocabulary), splitter(vocabulary), most
        self.lists: dict[tuple[str, int], list] = {}
        self.scores, self.gaps, self.ends, self.ids = np.zeros(0), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.uses, self.size = np.zeros(0, np.int64), 0

    def numbers(self, parts: list[str]) -> np.ndarray:
        new = [p for p in set(parts) if p not in self]
        if new:
            scores, gaps, ends, ids = self.lattice.best_of_all(new)
            self.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores, self.gaps = np.concatenate([self.scores, scores]), np.concatenate([self.gaps, gaps])
            self.ends, self.ids = np.concatenate([self.ends, ends[1:] + len(self.ids)]), np.concatenate([self.ids, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.size += EACH * len(new) + sum(map(len, new)) + 4 * len(ids)
        found = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        self.uses += np.bincount(found, minlength=len(self.uses))
        return found

    def shrink(self) -> None:
        """To be called between texts: numbers change."""
        if self.size <= self.most:
            return
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.uses) // 4])
        names = list(self)
        lengths = self.ends[stay + 1] - self.ends[stay]
        self.ids = gathered(self.ids, self.ends[stay], lengths)
        self.scores, self.gaps, self.uses = self.scores[stay], self.gaps[stay], np.zeros(len(stay), np.int64)
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.clear()
        self.update((names[old], new) for new, old in enumerate(stay.tolist()))
        self.size = sum(EACH + len(p) for p in self) + 4 * len(self.ids)

    def nbest(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        found = self.lists.get((part, n))
        if found is None:
            if len(self.lists) >= KEPT_LISTS:
                self.lists.clear()
            found = self.lists[part, n] = self.lattice.nbest(part, n)
        return found


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


#: What a worker has learned, by the token of its last query: later tasks of a reused worker go on with it.
_WORKER: dict[str, object] = {}


def _learned(token: str, make):
    if token not in _WORKER:
        _WORKER.clear()
        _WORKER[token] = make()
    return _WORKER[token]


def _parts(token: str, vocabulary: Vocabulary) -> _Parts:
    return _learned(token, lambda: _Parts(vocabulary, KEPT_BYTES))


def candidates(gaps: np.ndarray, n: int) -> np.ndarray:
    """Places of the parts that can differ in one of the ``n`` best: the ``n`` - 1 with the largest gaps, the first of equal ones.

    A choice that changes any other part comes after the best and after each of these single changes:
    its loss is no smaller, and where it is equal more parts are changed or a later one is.
    """
    if n < 2 or not len(gaps):
        return np.zeros(0, np.int64)
    if len(gaps) >= n:
        least = np.partition(gaps, len(gaps) - (n - 1))[len(gaps) - (n - 1)]
        some = np.flatnonzero(gaps >= least)
        some = np.sort(some[np.argsort(-gaps[some], kind="stable")[: n - 1]])
    else:
        some = np.arange(len(gaps))
    return some[gaps[some] > float("-inf")]


def combine(gaps: np.ndarray, alternatives, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The ``n`` best choices of one alternative for each part: loss against the best, and the (part, rank) that differ.

    ``gaps`` has each part's loss of its second alternative, ``alternatives(i)`` the
    losses of all of them, best first. Only parts whose second can be among the best are
    asked for more. Of equal losses the choice that changes fewer parts comes first, then the smaller one.
    """
    gaps = np.asarray(gaps, float)
    kept: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for i in candidates(gaps, n).tolist():
        more = [(loss + own, (*choice, (i, rank))) for rank, own in enumerate(alternatives(i)) if rank for loss, choice in kept]
        kept = sorted(kept + more, key=lambda k: (-k[0], len(k[1]), k[1]))[:n]
    return kept


def _segmented(texts: list[str], known: _Parts, n: int) -> pa.Array:
    """What :func:`encode` returns for some texts."""
    split = [known.parts_of(marked(t)) for t in texts]
    numbers = known.numbers([p for parts in split for p in parts])
    lengths = known.ends[numbers + 1] - known.ends[numbers]
    ids = gathered(known.ids, known.ends[numbers], lengths)
    first = np.cumsum([0, *map(len, split)])
    # Ids before each part, over all texts.
    before = np.concatenate([[0], np.cumsum(lengths)])
    all_scores, all_gaps = known.scores[numbers], known.gaps[numbers]
    scores, others = [], []
    for t, parts in enumerate(split):
        own = slice(first[t], first[t + 1])
        score = all_scores[own].tolist()
        total = float(sum(score))
        scores.append(total)
        chosen = combine(all_gaps[own], lambda i: [s - score[i] for s, _ in known.nbest(parts[i], n)], n)
        told = []
        for loss, choice in chosen[1:]:
            edits = [{"at": int(before[first[t] + i] - before[first[t]]), "drop": int(lengths[first[t] + i]), "ids": known.nbest(parts[i], n)[rank][1]} for i, rank in choice]
            told.append({"score": total + loss, "n_pieces": int(before[first[t + 1]] - before[first[t]]) + sum(len(e["ids"]) - e["drop"] for e in edits), "edits": edits})
        others.append(told)
    known.shrink()
    lists = pa.ListArray.from_arrays(pa.array(before[first], pa.int32()), pa.array(ids, pa.int32()))
    return pa.StructArray.from_arrays([lists, pa.array(scores, pa.float64()), pa.array(others, pa.list_(_OTHER))], ["ids", "score", "others"])


def encode(spark, vocabulary: Vocabulary, text: Column, n: int = 4) -> Column:
    """The ``n`` best segmentations of each whole text: ids and score of the best, and the others as edits of it.

    An edit replaces ``drop`` ids from ``at`` on. Parts that no piece crosses have
    lattices of their own; each is searched by :meth:`Lattice.nbest`, and the parts'
    lists are merged, so the order is that of a search over the whole text. Fewer than
    ``n`` come back if there are no more.

    * Null or empty text: no ids, score 0, no others. Very long texts are read whole.
    * Equal texts get equal results. Equal scores: the tokenizer's choice is first.
    """
    small_batches(spark)
    shared, token = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def segment(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _parts(token, shared.value)
        for array in arrays:
            made = [_segmented(texts, known, n) for texts in sized((t.as_py() for t in array), CHARS)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("others", pa.list_(_OTHER))]))

    return F.arrow_udf(segment, ENCODED)(text.cast("string"))


def decode(spark, vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of an id list: byte pieces are joined, marks become blanks, and the one in front goes.

    Bytes that are not UTF-8 come back as U+FFFD. Null list: null. An id outside the
    vocabulary writes nothing.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def join(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # One more entry for ids outside the vocabulary.
        written = pa.array([*shared.value.written, b""], pa.binary())
        none = len(written) - 1
        for array in arrays:
            out = []
            for start in range(0, len(array), ROWS):
                rows = array.slice(start, ROWS)
                own = rows.flatten().fill_null(none).to_numpy(zero_copy_only=False)
                pieces = written.take(pa.array(np.where((own < 0) | (own > none), none, own)))
                lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1][np.concatenate([[0], np.cumsum(lengths)])].tolist()
                data = memoryview(pieces.buffers()[2] or b"")
                for valid, begin, end in zip(rows.is_valid().to_pylist(), ends, ends[1:]):
                    text = bytes(data[begin:end])
                    out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace") if valid else None)
            yield pa.array(out, pa.string())

    return F.arrow_udf(join, "string")(ids)


def segmented(docs: DataFrame, vocabulary: Vocabulary, n: int = 4) -> DataFrame:
    """``docs`` with a column ``encoded`` as :func:`encode` gives it; an existing one is replaced.

    Null ``doc_id``, repeated rows and extra columns stay as they are. No rows: no rows.
    """
    return docs.withColumn("encoded", encode(docs.sparkSession, vocabulary, F.col("text"), n))
