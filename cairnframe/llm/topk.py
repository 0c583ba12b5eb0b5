"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, small_batches, stored

#: Queries whose vectors are sent to all executors at once.
QUERY_BLOCK = 4096
#: Candidates that are scored against a block at once.
CANDIDATES = 2048
#: Bins of a histogram.
BINS = 64
#: Scores of this size or more, and the ranges around them, don't fit 64 bits.
LARGEST = 1 << 62


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, in double precision; null where a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), whole)


@dataclass(frozen=True)
class Block:
    """Query vectors of one length each, and for each query the open range of scores that holds its kth best.

    ``low`` to ``low`` + ``width`` holds the kth value, ``above`` candidates score more than
    that range. With ``width`` 1 the value is found.
    """

    ids: np.ndarray
    by_size: dict[int, tuple[np.ndarray, np.ndarray]]
    low: np.ndarray
    width: int
    above: np.ndarray


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point is used only where every partial sum is exact in it."""
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _scored(batches: Iterable[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For candidates and queries of one length: places of the queries, candidate ids, scores (own rows marked by the least value)."""
    for batch in sliced(batches, CANDIDATES):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            if size not in block.by_size:
                continue
            rows = np.flatnonzero(sizes == size)
            vectors = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
            places, queries = block.by_size[size]
            scores = _exact(queries, vectors)
            scores[block.ids[places][:, None] == ids[rows][None, :]] = np.iinfo(np.int64).min
            yield places, ids[rows], scores


def _histogram(shared, k: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        bins = np.zeros((len(block.ids), BINS), np.int64)
        step = max(1, -(-block.width // BINS))
        for places, _, scores in _scored(batches, block):
            bin_of = (scores - block.low[places][:, None]) // step
            inside = (scores >= block.low[places][:, None]) & (bin_of < BINS) & (scores < block.low[places][:, None] + block.width)
            flat = (places[:, None] * BINS + bin_of)[inside]
            bins += np.bincount(flat, minlength=bins.size).reshape(bins.shape)
        # Bins below this task's own kth best can't hold the kth best of all.
        higher = bins[:, ::-1].cumsum(axis=1)[:, ::-1] - bins
        query, bucket = np.nonzero((bins > 0) & (higher < k))
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(bucket, pa.int32()), pa.array(bins[query, bucket], pa.int64())], names=["query", "bin", "n"])

    return count


def _winners(shared, k: int):
    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = 0

        def best() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            # Ties of the kth value can be many; a task keeps its k smallest ids of them.
            query, ids, scores = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((ids, -scores, query))
            query, ids, scores = query[order], ids[order], scores[order]
            first = np.searchsorted(query, query)
            top = np.arange(len(query)) - first < k
            return [(query[top], ids[top], scores[top])]

        for places, ids, scores in _scored(batches, block):
            row, column = np.nonzero(scores >= block.low[places][:, None])
            kept.append((places[row], ids[column], scores[row, column]))
            pending += len(row)
            if pending > 1_000_000:
                kept, pending = best(), 0
        if kept:
            query, ids, scores = best()[0]
            for start in range(0, len(query), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[query[part]], pa.int64()), pa.array(ids[part], pa.int64()), pa.array(scores[part], pa.int64())], names=["query_id", "vec_id", "score"]
                )

    return select


def _refined(block: Block, counts: list, k: int) -> Block:
    """The bin of each query that holds its kth best becomes the range of the next round."""
    step = max(1, -(-block.width // BINS))
    bins = np.zeros((len(block.ids), BINS), np.int64)
    for row in counts:
        bins[row["query"], row["bin"]] = row["n"]
    reached = bins[:, ::-1].cumsum(axis=1) + block.above[:, None] >= k
    found = reached.any(axis=1)
    bin_of = np.where(found, BINS - 1 - reached.argmax(axis=1), 0)
    higher = np.where(np.arange(BINS) > bin_of[:, None], bins, 0).sum(axis=1)
    # A query with fewer than k candidates keeps all of them.
    low = np.where(found, block.low + bin_of * step, block.low)
    return Block(block.ids, block.by_size, low, step, block.above + np.where(found, higher, 0))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``queries`` true, the k best of all other rows by integer inner product.

    Every query is scored against every candidate. A round counts the scores of each
    query in ``BINS`` ranges over all candidates; the range that holds the kth best is
    split in the next round, until it is one value. Then candidates at or above it are
    kept, and ties at it go to the smaller ``vec_id``.

    Candidates stay in place. Queries are taken in blocks of about ``block_rows`` vectors, whose
    size bounds what is broadcast and what the driver holds (a range for each query of the
    block, never a candidate); each block's winners are written to the shared folder.

    * Vectors null or with null or non-finite components take no part, neither do null ids.
    * Components may be of any size while the product of the largest norms of queries and
      candidates of one length is below 2**62; else scores may not fit 64 bits, and
      ValueError is raised.
    * Vectors of different lengths aren't scored against each other.
    * Several rows with a query's id: the smallest vector asks, none of them answers.
      Other repeated rows each answer. Fewer than k candidates: all. No rows: no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    whole = whole.filter("vec_id IS NOT NULL AND v IS NOT NULL")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asked = whole.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))))
    many = asked.count()
    blocks = max(1, math.ceil(many / block_rows))
    largest = {r["size"]: math.sqrt(r["norm"]) for r in whole.groupBy(F.size("v").alias("size")).agg(F.max(norm).alias("norm")).collect()}
    candidates = whole.select("vec_id", "v")
    found = []
    for b in range(blocks if many else 0):
        rows = asked.filter(F.floor(F.col("block") * blocks / F.lit(1 << 20)) == b).select("vec_id", "v").orderBy("vec_id").toArrow()
        if not rows.num_rows:
            continue
        ids = rows.column("vec_id").to_numpy()
        lists = rows.column("v").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        by_size = {}
        for size in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == size)
            by_size[size] = (places, lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), size))
        longest = {size: math.sqrt((q.astype(float) ** 2).sum(axis=1).max(initial=0)) for size, (_, q) in by_size.items()}
        reach = int(max(longest[size] * largest[size] for size in by_size) * (1 + 1e-9)) + 1
        if reach >= LARGEST:
            raise ValueError("vectors too large: their scores may not fit 64 bits")
        block = Block(ids, by_size, np.full(len(ids), -reach, np.int64), 2 * reach + 1, np.zeros(len(ids), np.int64))
        while block.width > 1:
            shared = spark.sparkContext.broadcast(block)
            counts = candidates.mapInArrow(_histogram(shared, k), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
            block = _refined(block, counts.collect(), k)
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        chosen = candidates.mapInArrow(_winners(shared, k), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found.append(stored(chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "vec_id", "score")
