"""Spelling variants: words one edit apart, found through a reduced alphabet."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: A run of letters: ASCII letters and the code points from U+00C0 to U+00FF.
RUN = r"[A-Za-zÀ-ÿ]+"
_RUNS = re.compile(RUN)
#: Characters of a text that are cut into runs at once, and words that a task counts before it hands them on.
PIECE, COUNTED = 1 << 20, 200_000
#: Words of one reduced form above which the form is split by what remains after one deletion.
CROWD = 256
#: Odd multiplier of the hash of a reduced word, and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def lowered(text: str) -> str:
    """A-Z in lower case, as bytes are lowered; other letters stay."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, none of which ends inside a run."""
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text) and (rest := _RUNS.match(text, end)):
            end = rest.end()
        yield text[start:end]
        start = end


def damaged(run: str, crc: int) -> str:
    """The run without the code point at ``crc`` modulo its length."""
    place = crc % len(run)
    return run[:place] + run[place + 1 :]


def _counts(every: int, shortest: int):
    long_runs = re.compile(RUN.replace("+", f"{{{shortest},}}"))

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32 = zlib.crc32
        counts: Counter = Counter()
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                prefix = crc32(f"{doc_id or ''}:".encode())
                for piece in pieces(text.as_py() or ""):
                    # A letter is only deleted, so shorter runs can't become words.
                    runs = long_runs.findall(lowered(piece))
                    counts.update(runs)
                    # Equal runs of a document fare alike, and few lose a letter.
                    for run in [run for run in set(runs) if not crc32(run.encode(), prefix) % every]:
                        n = runs.count(run)
                        counts[run] -= n
                        if len(run) > shortest:
                            counts[damaged(run, crc32(run.encode(), prefix))] += n
                    if len(counts) >= COUNTED:
                        yield batch(counts)
                        counts.clear()
        if counts:
            yield batch(counts)

    return count


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their code points as a matrix."""
    listed = np.array(words.to_pylist(), dtype=object)
    lengths = np.array([len(w) for w in listed], dtype=np.int64)
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        if length:
            yield places, listed[places].astype(f"<U{length}").view(np.uint32).reshape(len(places), length)
        else:
            yield places, np.zeros((len(places), 0), np.uint32)


def _symbols(codes: np.ndarray, symbols: int) -> np.ndarray:
    """1 to ``symbols`` for each letter, by a hash of it."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(symbols)) + np.uint64(1)


def _powers(length: int) -> np.ndarray:
    return np.array([pow(STEP, i, 1 << 64) for i in range(length)], np.uint64)


def _form(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Hash of each reduced word: its symbols times powers of ``STEP``, modulo 2**64."""
    return (_symbols(codes, symbols) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _neighbourhood(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of each reduced word and of all words one insertion, deletion or replacement away in the reduced alphabet, a row for each."""
    length = codes.shape[1]
    own = _symbols(codes, symbols)
    powers = _powers(length + 1)
    terms = own * powers[:length]
    # Before each place, and from each place on.
    head = np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    tail = head[:, -1:] - head
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    out = [head[:, -1:], head[:, :-1] + tail[:, 1:] * np.uint64(BACK)]
    for letter in letters:
        out.append(head[:, :-1] + letter * powers[:length] + tail[:, 1:])
        out.append(head + letter * powers + tail * np.uint64(STEP))
    return np.concatenate(out, axis=1)


def _forms(symbols: int):
    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            forms = np.zeros(rows.num_rows, np.int64)
            for places, codes in _by_length(rows.column(0)):
                forms[places] = _form(codes, symbols).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(forms)], names=["word", "form"])

    return reduce


def _probes(symbols: int):
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own = rows.column(1).to_numpy()
            for places, codes in _by_length(rows.column(0)):
                # About a million hashes at once.
                for part in np.array_split(np.arange(len(places)), 1 + len(places) * (codes.shape[1] + 1) * symbols // 500_000):
                    near = np.sort(_neighbourhood(codes[part], symbols), axis=1)
                    first = np.ones(near.shape, bool)
                    first[:, 1:] = near[:, 1:] != near[:, :-1]
                    row, column = np.nonzero(first)
                    yield pa.RecordBatch.from_arrays([pa.array(own[places[part][row]]), pa.array(near[row, column].view(np.int64))], names=["form", "probe"])

    return spread


def near_words(words: DataFrame, symbols: int | None = None, crowd: int = CROWD) -> DataFrame:
    """``word, near``: all ordered pairs of different words of ``words`` that one inserted, deleted or replaced code point tells apart.

    Letters are hashed to ``symbols`` symbols. An edit of a word is at most one edit of its reduced
    form, so the full one-edit neighbourhood of a reduced form holds the reduced forms of all near
    words. Reduced forms (as 64-bit hashes; a collision adds a candidate and loses none) are joined, and
    pairs are verified on the words. By default the symbols grow with the eighth root of the number of
    words, four at least: more symbols make neighbourhoods larger and candidates fewer. The pairs don't depend on it.

    A reduced form that more than ``crowd`` words share would compare each with each. Its words are
    compared only where they also agree after at most one deletion, as any two near words do; words of
    one such key differ in a single letter's place, so a key holds no more words than letters times places.

    Repeated words count once. No words: no rows.
    """
    distinct = words.select("word").distinct()
    if symbols is None:
        distinct = stored(distinct)
        symbols = max(4, math.ceil(distinct.count() ** 0.125))
    listed = stored(distinct.mapInArrow(_forms(symbols), "word string, form long"))
    heads = stored(listed.groupBy("form").agg(F.min("word").alias("word"), F.count("*").alias("members")))
    crowds = heads.filter(F.col("members") > crowd).select(F.col("form").alias("probe"))
    probes = heads.select("word", "form").mapInArrow(_probes(symbols), "form long, probe long")
    # Neighbours that some word has, before words are multiplied. Spark takes the neighbourhoods for small: no broadcast of them.
    links = stored(probes.hint("merge").join(heads.select(F.col("form").alias("probe")), "probe", "left_semi"))
    apart = F.levenshtein("word", "near", 1) == 1

    left = stored(links.hint("merge").join(listed, "form").select("word", "probe"))
    right = listed.select(F.col("word").alias("near"), F.col("form").alias("probe"))
    sparse = left.hint("merge").join(right.join(crowds, "probe", "left_anti"), "probe").filter(apart).select("word", "near")

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        word = F.col(name)
        cut = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
        return rows.join(crowds, "probe", "left_semi").select(name, "probe", F.explode(F.array_distinct(F.concat(F.array(word), cut))).alias("rest"))

    crowded = keyed(left, "word").hint("merge").join(keyed(right, "near"), ["probe", "rest"]).filter(apart).select("word", "near")
    return sparse.unionByName(crowded.distinct())


def variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5, symbols: int | None = None, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``docs`` (``doc_id, text``).

    Runs of letters are lower-cased (A-Z alone); of those whose CRC-32 with the document's id is
    divisible by ``every`` one letter is deleted. Words are the distinct results of at least
    ``shortest`` code points and ``least`` occurrences. Near words are one edit apart. ``form`` is the
    near word with the largest count, the first in code-point order of equals, where that count is
    at least ``ratio`` times the word's; ``root`` follows forms to the last one.

    Occurrences are counted before they are shuffled; only the vocabulary is joined. Forms grow by
    ``ratio`` at each step, so chains are short, and as many rounds of doubling reach every root.

    * Null and empty texts have no words. A null id counts as the empty text in the CRC.
    * Rows with one id, and repeated rows, each count. No documents, or no frequent words: no rows.
    * Other columns of ``docs`` are not read.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2, else forms could lead in circles")
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counts(every, shortest), "word string, n long")
    vocabulary = stored(found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    pairs = near_words(vocabulary, symbols, crowd)
    counts = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    nearest = pairs.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(nearest, "word", "left")
    chosen = F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col("best"))
    table = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), chosen.alias("best")).select("word", "n", "n_near", F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")))

    # Only words with a form are followed.
    steps = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = max(1, math.ceil(math.log(max(most / least, 1), ratio)) + 1)
    for _ in range(math.ceil(math.log2(longest))):
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("after"))
        steps = stored(steps.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root")))
    return table.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
