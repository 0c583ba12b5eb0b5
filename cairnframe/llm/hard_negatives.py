"""Hard negatives of anchors by exact inner products, several candidates to a multiplication."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sliced, small_batches, stored
from .topk import quantised

#: Anchors whose vectors are sent to all executors at once.
ANCHOR_BLOCK = 4096
#: Candidates that are packed and scored at once.
CANDIDATES = 1024
#: Bits of a machine word that fields may fill, the sign left out.
WORD_BITS = 63


def fields_of(bits: int) -> int:
    """Fields of ``bits`` bits in one machine word; one field wider than a word is a Python integer."""
    return max(1, WORD_BITS // bits)


def packed(vectors: np.ndarray, bias: int, bits: int) -> np.ndarray:
    """Rows of biased components, ``fields_of(bits)`` vectors to a row, each in its own field."""
    fields = fields_of(bits)
    rows = -(-len(vectors) // fields)
    kind = np.int64 if bits <= WORD_BITS else object
    whole = np.zeros((rows * fields, vectors.shape[1]), kind)
    whole[: len(vectors)] = vectors.astype(kind) + bias
    whole = whole.reshape(rows, fields, -1)
    words = whole[:, 0]
    for j in range(1, fields):
        words = words | (whole[:, j] << (j * bits))
    return words


def products(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors (rows) and vectors (columns).

    Both sides are biased to be non-negative, so the sum in a field is non-negative and below
    2**bits: no field reaches into the next, and one multiplication of an anchor's component with a
    word serves all its fields. The bias is taken off the unpacked sums.
    """
    size = anchors.shape[1]
    if not len(vectors) or not len(anchors) or not size:
        return np.zeros((len(anchors), len(vectors)), np.int64)
    a_bias, v_bias = max(0, -int(anchors.min())), max(0, -int(vectors.min()))
    bits = (size * (int(anchors.max()) + a_bias) * (int(vectors.max()) + v_bias)).bit_length() or 1
    fields = fields_of(bits)
    words = packed(vectors, v_bias, bits)
    sums = (anchors.astype(words.dtype) + a_bias) @ words.T
    unpacked = np.stack([(sums >> (j * bits)) & ((1 << bits) - 1) for j in range(fields)], axis=2) if fields > 1 else sums[:, :, None]
    unpacked = unpacked.reshape(len(anchors), -1)[:, : len(vectors)]
    off = a_bias * vectors.astype(words.dtype).sum(axis=1)[None, :] + v_bias * anchors.astype(words.dtype).sum(axis=1)[:, None] + size * a_bias * v_bias
    return (unpacked - off).astype(np.int64)


@dataclass(frozen=True)
class Anchors:
    """A block of anchors: ids, labels, and for each length the places and vectors."""

    ids: np.ndarray
    labels: np.ndarray
    by_size: dict[int, tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Bands:
    """Scores that a negative may have: the ``place`` of the anchor, the positive's ``id``, ``low`` and ``high`` with bounds included."""

    place: np.ndarray
    id: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _scored(batches: Iterable[pa.RecordBatch], block: Anchors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places of anchors, ids and labels of candidates, scores, for each chunk of candidates of one length."""
    for batch in sliced(batches, CANDIDATES):
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        lists = batch.column(2)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            if size not in block.by_size:
                continue
            rows = np.flatnonzero(sizes == size)
            vectors = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
            places, anchors = block.by_size[size]
            yield places, ids[rows], labels[rows], products(anchors, vectors)


class _Best:
    """The first ``k`` (score descending, id ascending) for each place, over all chunks of a task."""

    def __init__(self, k: int):
        self.k, self.kept, self.pending = k, [], 0

    def add(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.kept.append((place, ids, scores))
        self.pending += len(place)
        if self.pending > 1_000_000:
            self.shrink()

    def shrink(self) -> None:
        place, ids, scores = (np.concatenate(c) for c in zip(*self.kept))
        order = np.lexsort((ids, -scores, place))
        place, ids, scores = place[order], ids[order], scores[order]
        top = np.arange(len(place)) - np.searchsorted(place, place) < self.k
        self.kept, self.pending = [(place[top], ids[top], scores[top])], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.kept:
            return
        self.shrink()
        for start in range(0, len(self.kept[0][0]), 100_000):
            place, ids, scores = (pa.array(c[start : start + 100_000], pa.int64()) for c in self.kept[0])
            yield pa.RecordBatch.from_arrays([place, ids, scores], names=["place", "vec_id", "score"])


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of allowed scores that may be among a row's ``k`` first: at least the kth of the chunk, ties included."""
    if scores.shape[1] > k:
        least = np.iinfo(np.int64).min
        marked = np.where(allowed, scores, least)
        kth = np.partition(marked, -k, axis=1)[:, -k]
        allowed = allowed & (marked >= kth[:, None])
    return np.nonzero(allowed)


def _positives(shared, k: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, _Best(k)
        for places, ids, labels, scores in _scored(batches, block):
            allowed = (block.labels[places][:, None] == labels[None, :]) & (block.ids[places][:, None] != ids[None, :])
            row, column = _first(scores, allowed, k)
            best.add(places[row], ids[column], scores[row, column])
        yield from best.batches()

    return find


def _negatives(shared, k: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (block, bands), best = shared.value, _Best(k)
        for places, ids, labels, scores in _scored(batches, block):
            row_of = np.full(len(block.ids), -1)
            row_of[places] = np.arange(len(places))
            # A band of an anchor of this length, and its row of scores.
            band = np.flatnonzero(row_of[bands.place] >= 0)
            for part in np.array_split(band, max(1, len(band) // 2048)):
                row = row_of[bands.place[part]]
                found = scores[row]
                allowed = (block.labels[bands.place[part]][:, None] != labels[None, :]) & (found >= bands.low[part][:, None]) & (found <= bands.high[part][:, None])
                allowed &= block.ids[bands.place[part]][:, None] != ids[None, :]
                at, column = _first(found, allowed, k)
                best.add(part[at], ids[column], found[at, column])
        yield from best.batches()

    return find


def _block(rows: pa.Table) -> Anchors:
    lists = rows.column("v").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    by_size = {}
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        by_size[size] = (places, lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), size))
    return Anchors(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), by_size)


def _ranked(found: DataFrame, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def mine(
    vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, block_rows: int = ANCHOR_BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``vectors`` (``vec_id, embedding``) where ``anchors`` is true.

    Components become floor(``scale`` * x); a score is the integer inner product with the anchor, larger
    first and ties by smaller id. An anchor's positives are its first ``positives`` other rows with an
    equal ``label``; for each, the negatives are the first ``negatives`` rows of another label whose score
    is at most the positive's and at least ``share`` of it.

    Candidates are packed into fields of wide integers, so a multiplication with an anchor's component
    scores several at once, exactly. Candidates stay in place and are read twice for each block of anchors
    (positives, then negatives in the bands that they set); a block bounds what is broadcast
    and what the driver holds, ``positives`` scores for each of its anchors. Winners are written to the shared folder.

    * Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    * Vectors of different lengths aren't scored against each other.
    * Several rows with an anchor's id: the smallest (vector, label) asks, none of them answers.
      Other repeated rows each answer. Fewer rows than asked for: all. No rows: no rows.
    * ValueError if scores may not fit 64 bits.
    """
    spark: SparkSession = vectors.sparkSession
    small_batches(spark, 10_000)
    cells = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), quantised(F.col("embedding"), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    whole = cells.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    asked = whole.filter("asks").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a"))
    asked = stored(asked.select("vec_id", "a.*", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)).alias("block")))
    blocks = math.ceil(asked.count() / block_rows)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = {r["size"]: math.sqrt(r["norm"]) for r in whole.groupBy(F.size("v").alias("size")).agg(F.max(norm).alias("norm")).collect()}
    candidates = whole.select("vec_id", "label", "v")
    few, many = share
    out = []
    for b in range(blocks):
        rows = asked.filter(F.floor(F.col("block") * blocks / F.lit(1 << 20)) == b).select("vec_id", "label", "v").orderBy("vec_id").toArrow()
        if not rows.num_rows:
            continue
        block = _block(rows)
        for size, (_, vs) in block.by_size.items():
            if many * largest[size] * math.sqrt((vs.astype(float) ** 2).sum(axis=1).max(initial=0)) >= 1 << 62:
                raise ValueError("vectors too large: their scores may not fit 64 bits")
        shared = spark.sparkContext.broadcast(block)
        found = candidates.mapInArrow(_positives(shared, positives), "place long, vec_id long, score long")
        near = _ranked(found, positives, "rank").orderBy("place", "rank").toArrow()
        shared.destroy()
        place, ids, scores = (near.column(c).to_numpy() for c in ("place", "vec_id", "score"))
        # share[0] * positive <= share[1] * negative, in whole numbers.
        bands = Bands(place, ids, -((-few * scores) // many), scores)
        shared = spark.sparkContext.broadcast((block, bands))
        found = candidates.mapInArrow(_negatives(shared, negatives), "place long, vec_id long, score long")
        named = pa.table({"place": np.arange(len(place)), "anchor_id": block.ids[place], "positive_id": ids, "positive_score": scores})
        links = spark.createDataFrame(named)
        ranked = _ranked(found, negatives, "rank").select("place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out.append(stored(ranked.join(links, "place").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
        shared.destroy()
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
