"""Token counts by count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches
from .unigram import Lattice, Vocabulary, marked, splitter

#: Parts up to this length are remembered, up to so many of them.
KEPT_LENGTH, KEPT = 48, 250_000


class _Counts(dict):
    def __init__(self, lattice: Lattice):
        self.lattice = lattice

    def __missing__(self, part: str) -> tuple[int, float]:
        found = self.lattice.count(part)
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[part] = found
        return found


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, score``: pieces of each whole text's best segmentation, and its score.

    No segmentation is kept: an Aho-Corasick automaton enumerates the pieces that end at
    each character, and best score and count are carried along. Ties follow the
    tokenizer (see :class:`Lattice`). Unknown characters count their UTF-8 bytes
    where the vocabulary has byte pieces, else one. Parts that no piece crosses are
    scored once for a worker.

    * Null or empty text: 0 tokens, score 0. Very long texts are read whole.
    * Null ``doc_id`` and repeated rows each have their row. No rows: no rows.
    * Other columns play no part.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts = splitter(shared.value), _Counts(Lattice(shared.value))
        for batch in sliced(batches):
            tokens, scores = [], []
            for text in batch.column(1).to_pylist():
                found = [counts[p] for p in parts(marked(text))]
                tokens.append(sum(f[0] for f in found))
                scores.append(float(sum(f[1] for f in found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_tokens long, score double")
