"""Nearest neighbours: one literal query, a table of queries, recommendation and an approximate form.

Exact search must score every (query, point) pair, but no pair is ever a row.
A task scores a block of points against a block of queries as a matrix product
and emits the best ``k`` per query of that block; one window then ranks the
blocks' winners. Scores of the winners are recomputed row by row in DOUBLE, so
equal vectors get equal scores whatever block they fall in, and ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from ..functions.vectors import HIGHER_IS_BETTER, best_first, check_metric, norm, passes_threshold, score_literal
from ..sources.tables import stored

# A query table (and a table of excluded pairs) up to this size, with what is kept for it, is sent
# to every task at once; a larger one goes in passes of this size.
BROADCAST_BYTES = 32 << 20
BLOCK_BYTES = 32 << 20
PAIR_BYTES = 64
# What an id takes besides its vector, and a kept neighbour.
ID_BYTES = 64
KEPT_BYTES = 64
# What a condition of a query takes besides its text.
CONDITION_BYTES = 16
# Bounds on one scoring step inside a task.
SCORE_CELLS = 1_000_000
RESCORE_CELLS = 1_000_000
# Rows of one batch that a task gives back.
OUT_ROWS = 100_000
# Points that meet the queries at once, at most (fewer where queries have very many conditions).
BATCH_ROWS = 8_192
# Scoring one pair by itself takes as long as this many pairs of a matrix product.
PAIR_COST = 32

SEGMENT = 16  # dimensions averaged per row when vectors are combined


# ---------------------------------------------------------------- one query


def knn(
    points: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "Cosine",
    vector_name: str | None = None,
    threshold: float | None = None,
    offset: int = 0,
) -> DataFrame:
    """``points`` columns, ``score`` and ``rank`` of the ``k`` best after ``offset``, best first.

    The limit is taken per partition first (``TakeOrderedAndProject``), so the
    sort never moves more than ``offset + k`` rows per task. One task ranks these
    rows; for pages far down use :func:`knn_join`. A point of another length raises.
    """
    if vector_name is not None:
        points = points.filter(F.col("vector_name") == vector_name)
    checked = points.filter("vector IS NOT NULL").withColumn("vector", _of_length(F.col("vector"), len(query)))
    scored = checked.withColumn("score", score_literal(F.col("vector"), query, metric))
    if threshold is not None:
        scored = scored.filter(passes_threshold(F.col("score"), threshold, metric))
    top = scored.orderBy(best_first("score", metric), "id").limit(offset + k)
    rank = F.row_number().over(Window.orderBy(best_first("score", metric), F.col("id")))
    return top.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") > offset)


# ---------------------------------------------------------------- block scorer


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _matrix(vectors) -> np.ndarray:
    """Arrow list column (equal lengths) as a matrix of DOUBLE."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1)


def _ids(column) -> np.ndarray:
    """Ids as numbers, or as UTF-8 bytes, which sort like the texts and take a quarter of the room."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    values = column.to_numpy(zero_copy_only=False)
    return values.astype("S") if values.dtype == object else values


def _pair_scores(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Scores of matching rows; each depends on the two vectors alone."""
    if metric == "Euclid":
        return np.sqrt(((q - p) ** 2).sum(axis=1))
    if metric == "Manhattan":
        return np.abs(q - p).sum(axis=1)
    dot = (q * p).sum(axis=1)
    if metric == "Dot":
        return dot
    norms = np.sqrt((q * q).sum(axis=1)) * np.sqrt((p * p).sum(axis=1))
    return np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)


def _side(vectors: np.ndarray, metric: str, are_queries: bool) -> tuple[np.ndarray, float]:
    """Vectors of one side whose product with the other side's approximates the signed score (for Euclid its square), and their greatest norm."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    most = norms.max(initial=0.0)
    if metric == "Cosine":
        return np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0), most
    if metric == "Euclid":
        one, square = np.ones(len(vectors)), norms**2
        return np.column_stack([2 * vectors, -square, -one] if are_queries else [vectors, one, square]), most
    return vectors, most


class _TopK:
    """Best ``k`` points per query over the point batches of one task.

    The matrix product is used only to shortlist: it is off by at most
    ``slack`` times the size of its terms, so every pair within that margin of
    the k-th best is scored again exactly.
    """

    slack = 1e-11

    def __init__(self, queries: np.ndarray, k: np.ndarray, metric: str):
        self.q, self.metric = queries, metric
        self.k = np.maximum(k, 1)
        self.sign = 1.0 if HIGHER_IS_BETTER[metric] else -1.0
        self.rows = self.scores = self.ids = None
        self.floor = np.full(len(queries), -np.inf)  # signed k-th best so far

    def add(self, ids: np.ndarray, p: np.ndarray, side, hidden: tuple[np.ndarray, np.ndarray], allowed=None, repeats: int = 1) -> None:
        """Take in a batch of points (``side``: as :func:`_side` has them) for all queries, without the ``hidden`` (rows, columns) and with only those that ``allowed`` says.

        Enough points are shortlisted for ``k`` different ids where an id comes up to ``repeats`` times.
        """
        rows, cols = self._shortlist(p, hidden, allowed, side, repeats)
        self.add_pairs(ids, p, rows, cols)

    def add_pairs(self, ids: np.ndarray, p: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Take in the listed pairs of query rows and points, a part at a time: where very many points tie, they are not all held."""
        step = max(1, RESCORE_CELLS // max(1, p.shape[1]))
        found, n_found = [], 0
        for at in range(0, len(rows), step):
            some, of = rows[at : at + step], cols[at : at + step]
            scores = _pair_scores(self.q[some], p[of], self.metric)
            # No score is above the floor by chance: what is below it cannot be among the best.
            near = np.isfinite(scores) & (self.sign * scores >= self.floor[some])
            found.append((some[near], of[near], scores[near]))
            n_found += len(found[-1][0])
            # At least as many as are kept, so that these are not sorted for a few.
            if n_found and (at + step >= len(rows) or n_found >= max(step, 0 if self.ids is None else len(self.ids))):
                some, of, scores = (np.concatenate(part) for part in zip(*found))
                found, n_found = [], 0
                self._merge(some, ids[of], scores)

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Keep the best ``k`` per query of what was kept before and what was found."""
        if self.ids is not None:
            rows, ids, scores = (np.concatenate(part) for part in ((self.rows, rows), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -self.sign * scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        fresh = np.r_[True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])][: len(rows)]
        rows, ids, scores = rows[fresh], ids[fresh], scores[fresh]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        last = place == self.k[rows] - 1
        self.floor[rows[last]] = self.sign * scores[last]
        keep = place < self.k[rows]
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]

    def _shortlist(self, p: np.ndarray, hidden: tuple[np.ndarray, np.ndarray], allowed, side, repeats) -> tuple[np.ndarray, np.ndarray]:
        floor = self.floor.copy()
        if self.metric == "Manhattan":
            approx = -np.stack([np.abs(p - row).sum(axis=1) for row in self.q])
            margin = self.slack * (1 + np.abs(approx).max())
        else:
            (q, q_most), (points, p_most) = _side(self.q, self.metric, True), side
            approx = q @ points.T
            margin = self.slack * (1 if self.metric == "Cosine" else 1 + q_most * p_most if self.metric == "Dot" else 1 + q_most**2 + p_most**2)
            if self.metric == "Euclid":  # minus the squared distance
                floor = np.where(np.isfinite(floor), -(floor**2), floor)
        approx[hidden] = -np.inf
        # Queries that have no k-th best yet take it from this batch, those of similar limits together, so that one
        # long page does not lengthen the others.
        fresh = np.flatnonzero(np.isneginf(floor))
        if allowed is not None and len(fresh):
            approx[fresh] = np.where(allowed.all(fresh), approx[fresh], -np.inf)
        sizes = np.ceil(np.log2(self.k[fresh]))
        for size in np.unique(sizes):
            alike = fresh[sizes == size]
            place = approx.shape[1] - int(self.k[alike].max()) * repeats
            if place > 0:
                floor[alike] = np.partition(approx[alike], place, axis=1)[:, place]
        rows, cols = np.divmod(np.flatnonzero(approx >= (floor - margin)[:, None]), approx.shape[1])
        keep = np.isfinite(approx[rows, cols])
        if allowed is not None:
            keep &= allowed.pairs(rows, cols)
        return rows[keep], cols[keep]


class _Filters:
    """An inverted index of the queries' conditions: each distinct one is looked up once for a point, not once for a query.

    A query lists the numbers of its conditions; for a batch of points every condition has a
    bitmap of the points that meet it, and a query's bitmap is the AND of its conditions'.
    """

    def __init__(self, musts: list[list[str] | None]):
        wanted = [sorted(set(m or ())) for m in musts]
        names = sorted({c for m in wanted for c in m})
        number = {c: i for i, c in enumerate(names)}
        self.names = pa.array(names, pa.string())
        # One list after the other, so that a query with very many conditions does not lengthen the others.
        self.numbers = np.array([number[c] for m in wanted for c in m], np.int64)
        self.starts = np.cumsum([0, *map(len, wanted)])

    def of(self, low: int, high: int) -> np.ndarray:
        """Conditions of some of the queries, padded with the number of a condition that all points meet."""
        starts = self.starts[low : high + 1]
        counts = np.diff(starts)
        padded = np.full((len(counts), counts.max(initial=0)), len(self.names))
        padded[np.arange(padded.shape[1]) < counts[:, None]] = self.numbers[starts[0] : starts[-1]]
        return padded

    @property
    def points_at_once(self) -> int:
        return max(1, SCORE_CELLS * 8 // (len(self.names) + 1))

    def met(self, tokens: pa.Array) -> np.ndarray:
        """Which conditions (rows) are met by which of the points with these ``tokens``."""
        import pyarrow.compute as pc

        met = np.zeros((len(self.names) + 1, len(tokens)), bool)
        met[-1] = True
        owner = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        found = pc.index_in(tokens.flatten(), self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        met[found[found >= 0], owner[found >= 0]] = True
        return met


@dataclass(frozen=True)
class _Meeting:
    """The pairs of queries and points in which the point meets the query's conditions ``of``."""

    of: np.ndarray
    met: np.ndarray

    def all(self, rows: np.ndarray) -> np.ndarray:
        every = np.ones((len(rows), self.met.shape[1]), bool)
        for column in range(self.of.shape[1]):
            every &= self.met[self.of[rows, column]]
        return every

    def pairs(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        every = np.ones(len(rows), bool)
        for column in range(self.of.shape[1]):
            every &= self.met[self.of[rows, column], cols]
        return every


@dataclass(frozen=True)
class _SameCell:
    """The pairs of queries and points that share a cell in one of the bands."""

    q: np.ndarray
    p: np.ndarray

    def all(self, rows: np.ndarray) -> np.ndarray:
        some = np.zeros((len(rows), len(self.p)), bool)
        for band in range(self.q.shape[1]):
            some |= self.q[rows, band][:, None] == self.p[:, band][None, :]
        return some

    def pairs(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        some = np.zeros(len(rows), bool)
        for band in range(self.q.shape[1]):
            some |= self.q[rows, band] == self.p[cols, band]
        return some


def _result_type(points: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", points.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _arrow_schema(result: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(result)


def _as_batches(top: _TopK, query_ids: pa.Array, schema: pa.Schema):
    """What a task found, in batches of bounded size."""
    for start in range(0, 0 if top.ids is None else len(top.ids), OUT_ROWS):
        part = slice(start, start + OUT_ROWS)
        picked = query_ids.take(pa.array(top.rows[part]))
        yield pa.record_batch([picked, pa.array(top.ids[part].tolist(), type=schema.field(1).type), pa.array(top.scores[part])], schema=schema)


def _excluded_pairs(pairs: pa.Table, query_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, sorted, and query rows of the excluded pairs."""
    import pyarrow.compute as pc

    rows = pc.index_in(pairs["query_id"], query_ids)
    known = pairs.filter(pc.and_(rows.is_valid(), pairs["id"].is_valid()))
    ids, rows = _ids(known["id"]), rows.filter(pc.and_(rows.is_valid(), pairs["id"].is_valid())).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[order]


def _hidden(excluded: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Query rows, sorted, and columns) of the excluded pairs in a batch of points."""
    if not len(excluded[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = (np.searchsorted(excluded[0], ids, side) for side in ("left", "right"))
    cols, at = _runs(low, high)
    rows = excluded[1][at]
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order]


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Number, place) for each place of the numbered ranges from ``low`` to ``high``."""
    counts = high - low
    ends = np.cumsum(counts)
    return np.repeat(np.arange(len(low)), counts), np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + counts, counts)


# ---------------------------------------------------------------- many queries


def knn_join(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "Cosine",
    offset: int = 0,
    threshold: float | None = None,
    exclude: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    dim: int | None = None,
) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best points of every query after ``offset``.

    ``points`` has ``id, vector`` and ``queries`` has unique ``query_id`` with
    ``vector``; ``exclude`` lists ``(query_id, id)`` pairs left out before
    ranking. All vectors have the length ``dim``, or that of the queries when it is
    not given; a point or query of another length raises.

    Points are never shuffled. The number of queries (and exclusions) decides how
    often they are read: up to ``broadcast_bytes``, with what is kept for each query, the query
    table goes to every task at once, beyond that in passes of at most ``block_bytes``, whose results
    are written to the shared folder. So a task's memory is bounded, however many queries there are.
    """
    partial = _top_partial(points, queries, offset + k, metric, exclude, broadcast_bytes, block_bytes, dim)
    if threshold is not None:
        partial = partial.filter(passes_threshold(F.col("score"), threshold, metric))
    return rank_per_query(partial, offset + k, metric).filter(F.col("rank") > offset)


def _top_partial(points, queries, k: int | None, metric, exclude, broadcast_bytes, block_bytes, dim, family=None) -> DataFrame:
    """The best ``k`` per query (or as many as its column ``k`` says) of every task; ``family(points, dim)`` limits the pairs to equal cells."""
    check_metric(metric)
    points, queries, dim = _same_length(points, queries, dim)
    family = None if family is None else family(points, dim)
    queries = queries.withColumn("k", F.lit(k).cast("long") if k is not None else F.col("k").cast("long"))
    pairs = None if exclude is None else exclude.select("query_id", "id").distinct()
    row = 8 * max(dim, 1) + ID_BYTES + (8 * family.bands if family else 0)
    sent = F.lit(row)
    if "must" in queries.columns:
        sent += F.coalesce(F.aggregate("must", F.lit(0).cast("long"), lambda n, text: n + F.octet_length(text) + CONDITION_BYTES), F.lit(0))
    n_sent, n_kept = queries.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (sent, F.greatest("k", F.lit(1)))]).first()
    n_bytes, n_pairs = n_sent + n_kept * KEPT_BYTES, 0 if pairs is None else pairs.count()
    if n_bytes <= broadcast_bytes and n_pairs * PAIR_BYTES <= broadcast_bytes:
        return _broadcast_top(points, queries, queries.toArrow(), None if pairs is None else pairs.toArrow(), metric, family)[0]
    passes = max(1, -(-n_bytes // block_bytes), -(-n_pairs * PAIR_BYTES // max(broadcast_bytes, block_bytes)))
    at = F.pmod(F.xxhash64("query_id"), F.lit(passes)).alias("_pass")
    queries = stored(queries.select("*", at))
    pairs = None if pairs is None else stored(pairs.select("*", at))
    found = None
    for n in range(passes):
        asked, hidden = (None if t is None else t.filter(F.col("_pass") == n).drop("_pass").toArrow() for t in (queries, pairs))
        best, shared = _broadcast_top(points, queries, asked, hidden, metric, family)
        part = stored(best)
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def search(
    points: DataFrame,
    requests: DataFrame,
    metric: str = "Cosine",
    exclude: DataFrame | None = None,
    dim: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``knn_join`` with limits of each request's own: ``query_id, id, score, rank``.

    ``requests``: ``query_id, vector, limit, offset, score_threshold``. A missing
    limit is 0 and gives no rows, a missing offset is 0, a missing threshold
    keeps all. A task keeps as many neighbours of a query as its own page needs.
    """
    limit, offset = F.coalesce("limit", F.lit(0)), F.coalesce("offset", F.lit(0))
    pages = requests.filter(limit > 0).withColumn("_from", offset).withColumn("k", offset + limit)
    partial = _top_partial(points, pages, None, metric, exclude, broadcast_bytes, block_bytes, dim)
    ranked = rank_per_query(partial, None, metric)
    joined = ranked.join(pages.select("query_id", "_from", "k", "score_threshold"), "query_id")
    passes = F.col("score_threshold").isNull() | passes_threshold(F.col("score"), F.col("score_threshold"), metric)
    on_page = (F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("k"))
    return joined.filter(on_page & passes).select("query_id", "id", "score", "rank")


def _of_length(vector: Column, dim: int) -> Column:
    fault = F.raise_error(F.concat(F.lit(f"vector does not have length {dim} but "), F.size(vector).cast("string")))
    return F.when(F.size(vector) == dim, vector).otherwise(fault)


def _same_length(points: DataFrame, queries: DataFrame, dim: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Points and queries whose vectors are checked to have the length ``dim`` (that of the longest query if not given)."""
    queries = queries.filter("vector IS NOT NULL")
    if dim is None:
        dim = queries.agg(F.max(F.size("vector"))).first()[0] or 0
        if not dim:  # no queries, or none with components: nothing can be found
            points = points.filter("false")
    more = [c for c in ("k", "must") if c in queries.columns]
    tokens = ["tokens"] if "must" in more else []
    return (
        points.filter("vector IS NOT NULL").select("id", _of_length(F.col("vector"), dim).alias("vector"), *tokens),
        queries.select("query_id", _of_length(F.col("vector"), dim).alias("vector"), *more),
        dim,
    )


def rank_per_query(scored: DataFrame, limit: int | None, metric: str = "Cosine") -> DataFrame:
    """Add ``rank`` and keep the ``limit`` best per query (all without it); limited per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best_first("score", metric), F.col("id")))
    ranked = scored.withColumn("rank", rank)
    ranked = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def _broadcast_top(points, queries, table: pa.Table, pairs: pa.Table | None, metric, family=None) -> tuple[DataFrame, Broadcast]:
    """The best per query and task, as many as its ``k``, with the query rows in ``table`` sent to every task; and the broadcast.

    With a ``family``, only pairs that share a cell count. A batch of points meets the queries in steps: where cells
    are narrow their pairs are listed and scored, where they are wide one product scores all and only the
    pairs that come near the best are looked up, since listing them would score most pairs more than once.
    """
    result = _result_type(points, queries)
    schema = _arrow_schema(result)
    query_ids = _one_array(table.column("query_id"))
    matrix = _matrix(table.column("vector")) if len(query_ids) else np.empty((0, 1))
    limits = table.column("k").to_numpy()
    excluded = (np.zeros(0), np.zeros(0, np.int64)) if pairs is None else _excluded_pairs(pairs, query_ids)
    filters = _Filters(table.column("must").to_pylist()) if "must" in table.column_names else None
    shared = points.sparkSession.sparkContext.broadcast((query_ids, matrix, limits, excluded, filters, family))

    def score(batches):
        ids_of_queries, q, k, excluded, filters, family = shared.value
        most = 1 if filters is None else max(1, -(-SCORE_CELLS // filters.points_at_once))
        step = max(most, SCORE_CELLS // BATCH_ROWS)
        tops = [_TopK(q[lo : lo + step], k[lo : lo + step], metric) for lo in range(0, len(q), step)]
        asked = family.cells(q, True) if family and len(q) else None
        for whole in batches if tops else ():
            for start in range(0, whole.num_rows, SCORE_CELLS // step):
                batch = whole.slice(start, SCORE_CELLS // step)
                ids, p = _ids(batch.column(0)), _matrix(batch.column(1))
                hidden_rows, hidden_cols = _hidden(excluded, ids)
                side = None if metric == "Manhattan" else _side(p, metric, False)
                met = None if filters is None else filters.met(batch.column(2))
                if family:
                    held = family.cells(p, False)
                    order = np.argsort(held, axis=None, kind="stable")
                    numbers = held.ravel()[order]
                repeats = int(np.unique(ids, return_counts=True)[1].max()) if family else 1
                for lo, top in zip(range(0, len(q), step), tops):
                    mine = slice(*np.searchsorted(hidden_rows, [lo, lo + step]))
                    hidden = hidden_rows[mine] - lo, hidden_cols[mine]
                    allowed = None if filters is None else _Meeting(filters.of(lo, lo + step), met)
                    if family:
                        own = asked[lo : lo + step]
                        low, high = (np.searchsorted(numbers, own.ravel(), side) for side in ("left", "right"))
                        if (high - low).sum() * PAIR_COST < len(own) * len(ids):
                            rows, at = _runs(low, high)
                            both = np.unique(rows // own.shape[1] * len(ids) + order[at] // own.shape[1])
                            top.add_pairs(ids, p, both // len(ids), both % len(ids))
                            continue
                        allowed = _SameCell(own, held)
                    top.add(ids, p, side, hidden, allowed, repeats)
        for lo, top in zip(range(0, len(q), step), tops):
            yield from _as_batches(top, ids_of_queries.slice(lo, step), schema)

    return points.mapInArrow(score, result), shared


def attach_points(ranked: DataFrame, points: DataFrame, with_payload: bool | None = None, with_vector: bool | None = None) -> DataFrame:
    """Add payload and vector of the found points when asked for; nothing is read otherwise."""
    wanted = [c for c, keep in (("payload", with_payload), ("vector", with_vector)) if keep]
    return ranked.join(points.select("id", *wanted), "id", "left") if wanted else ranked


# ---------------------------------------------------------------- recommendation


def recommend_targets(points: DataFrame, inputs: DataFrame, metric: str = "Cosine") -> DataFrame:
    """``query_id, vector, n_pos, n_missing`` per request of ``inputs(request_id, sign, id)``.

    Target = mean of positives, plus (mean of positives − mean of negatives)
    when there are negatives; stored vectors are unit-normalised for Cosine
    (store rules). Vectors are averaged in segments of a few dimensions, each a
    plain partial aggregation, so a request with very many inputs is combined
    before the shuffle and never gathered in one task.
    """
    vector = F.col("vector").cast("array<double>")
    if metric == "Cosine":
        vector = let(vector, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))
    stored = points.select("id", vector.alias("vector"))
    joined = inputs.join(stored, "id", "left")
    state = joined.groupBy("request_id").agg(
        F.count_if(F.col("sign") == "pos").alias("n_pos"), F.count_if(F.col("vector").isNull()).alias("n_missing")
    )
    n_segments = F.ceil(F.size("vector") / SEGMENT).cast("int")
    cut = joined.filter("vector IS NOT NULL").select(
        "request_id", "sign", "vector", F.explode(F.sequence(F.lit(0), n_segments - 1)).alias("segment")
    )

    def mean(sign: str, j: int) -> Column:
        value = F.get("vector", F.col("segment") * SEGMENT + j)
        return F.avg(F.when(F.col("sign") == sign, value)).alias(f"{sign}{j}")

    means = cut.groupBy("request_id", "segment").agg(
        *[mean(sign, j) for sign in ("pos", "neg") for j in range(SEGMENT)]
    )
    combined = F.array(
        *[
            F.col(f"pos{j}") + F.coalesce(F.col(f"pos{j}") - F.col(f"neg{j}"), F.lit(0.0))
            for j in range(SEGMENT)
        ]
    )
    parts = means.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", combined.alias("values")))).alias("parts")
    )
    target = F.filter(F.flatten(F.transform("parts", lambda p: p["values"])), lambda x: x.isNotNull())
    return state.join(parts, "request_id", "left").select(
        F.col("request_id").alias("query_id"), target.alias("vector"), "n_pos", "n_missing"
    )


def recommend(points: DataFrame, inputs: DataFrame, k: int, metric: str = "Cosine", **options) -> DataFrame:
    """``query_id, id, score, rank``; input ids are left out, faulty requests give no rows."""
    targets = stored(recommend_targets(points, inputs, metric).filter("n_pos > 0 AND n_missing = 0"))
    pairs = inputs.select(F.col("request_id").alias("query_id"), "id")
    return knn_join(points, targets, k, metric, exclude=pairs, **options)


def recommend_errors(points: DataFrame, inputs: DataFrame) -> DataFrame:
    """``request_id, error_type`` of requests without positives or with an unknown input id."""
    known = points.select("id").distinct().withColumn("known", F.lit(True))
    state = (
        inputs.join(known, "id", "left")
        .groupBy("request_id")
        .agg(F.count_if(F.col("sign") == "pos").alias("n_pos"), F.count_if(F.col("known").isNull()).alias("n_missing"))
    )
    error = F.when(F.col("n_pos") == 0, "invalid_vector_request").when(F.col("n_missing") > 0, "point_not_found")
    return state.select("request_id", error.alias("error_type")).filter("error_type IS NOT NULL")


# ---------------------------------------------------------------- approximate search


@dataclass(frozen=True)
class _Family:
    """Random hash functions under which near vectors of a metric often agree."""

    metric: str
    planes: np.ndarray
    shifts: np.ndarray
    bands: int
    bits: int
    width: float
    longest: float

    def cells(self, vectors: np.ndarray, are_queries: bool) -> np.ndarray:
        """One cell number per vector and band, made of ``bits`` hashes."""
        if self.metric == "Euclid":  # equal steps along random directions
            steps = np.floor((vectors @ self.planes.T + self.shifts) / self.width).astype(np.int64).reshape(len(vectors), self.bands, self.bits)
            cell = np.tile(np.arange(self.bands, dtype=np.int64), (len(vectors), 1))
            for j in range(self.bits):
                cell = cell * np.int64(6364136223846793005) + steps[:, :, j] * np.int64(1442695040888963407) + j
            return cell
        if self.metric == "Dot":  # one more dimension makes all points equally long, so that only the angle counts
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            if are_queries:
                vectors, more = vectors / np.maximum(norms, 1e-300)[:, None], np.zeros(len(vectors))
            else:
                more = np.sqrt(np.maximum(self.longest**2 - norms**2, 0))
            vectors = np.column_stack([vectors, more])
        above = (vectors @ self.planes.T > 0).reshape(len(vectors), self.bands, self.bits)
        return above @ (1 << np.arange(self.bits, dtype=np.int64)) + (np.arange(self.bands, dtype=np.int64) << self.bits)


def hyperplanes(count: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((count, dim))


def _family(points: DataFrame, metric: str, dim: int, bands: int, bits: int, width: float | None, seed: int) -> _Family:
    if metric == "Manhattan":
        raise ValueError("approximate search has no signatures for Manhattan")
    if metric == "Euclid" and not width:
        raise ValueError("approximate search by Euclid needs the width of a step")
    longest = float(points.agg(F.max(norm(F.col("vector").cast("array<double>")))).first()[0] or 0.0) if metric == "Dot" else 0.0
    planes = hyperplanes(bands * bits, dim + (metric == "Dot"), seed)
    shifts = np.random.default_rng(seed + 1).uniform(0, width or 1.0, bands * bits)
    return _Family(metric, planes, shifts, bands, bits, width or 1.0, longest)


def ann_join(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "Cosine",
    *,
    bits: int,
    bands: int = 12,
    width: float | None = None,
    seed: int = 7,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    dim: int | None = None,
) -> DataFrame:
    """Approximate ``knn_join``: only points that share a signature with the query are scored.

    A signature is ``bits`` hashes of the metric's own family: sides of random
    hyperplanes for Cosine, the same with one more dimension for Dot, steps of
    ``width`` along random directions for Euclid. Manhattan has none and raises. More
    of the ``bands`` signatures raise recall, more ``bits`` cut the work; ``bits`` has to grow
    with the logarithm of the points. A query may find fewer than ``k``.

    Queries go to every task, at once or in passes as in :func:`knn_join`, and points are not shuffled: a task
    scores the points of a batch against the queries that share a cell with them, and keeps the exact best ``k``.
    """
    check_metric(metric)

    def family(points: DataFrame, dim: int) -> _Family:
        return _family(points, metric, dim, bands, bits, width, seed)

    return rank_per_query(_top_partial(points, queries, k, metric, None, broadcast_bytes, block_bytes, dim, family), k, metric)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate result also holds (one row)."""
    hits = approximate.select("query_id", "id").withColumn("hit", F.lit(1.0))
    joined = exact.select("query_id", "id").join(hits, ["query_id", "id"], "left")
    return joined.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
