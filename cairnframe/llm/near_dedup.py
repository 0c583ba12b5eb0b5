"""MinHash near-duplicate groups: universal hash minima, bands, signature check, exact check, components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, stored

FEATURES = "doc_id long, n long, key binary, bands array<long>, sig array<byte>"
SETS = "doc_id long, key binary, shingles array<long>, parity array<long>"
#: Classes that shingles fall into, to bound from below how many two sets differ by.
CLASSES = 2048
#: Ids that are sent to every executor at most; beyond it the texts are shuffled instead.
BROADCAST_IDS = 4_000_000
#: Of 32 turns that pairs are dealt to, those that each round of late comparisons takes.
ROUNDS = ((0, 2), (2, 32))
SEED = 20240117
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def banding(similarity: int, hashes: int = 216, miss: float = 1e-6) -> tuple[int, int]:
    """Bands and rows: the most rows for which a pair at the threshold shares no band with a chance of at most ``miss``."""
    s = similarity / 100
    for rows in range(hashes, 1, -1):
        if (1 - s**rows) ** (hashes // rows) <= miss:
            return hashes // rows, rows
    return hashes, 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX2
    return h ^ (h >> np.uint64(29))


class _Words(dict):
    """64-bit hash of each word, kept for the words met so far; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words than ``width``, one of the whole sequence."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    long = min(width, len(ids))
    h = np.full(len(ids) - long + 1, long, np.uint64)
    for j in range(long):
        h = (h * _MIX) ^ ids[j : len(ids) - long + 1 + j]
    return np.unique(_mixed(h))


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), block):
        part = shingles[start : start + block][None, :] * a
        part += b
        np.minimum(best, part.min(axis=1), out=best)
    return best


def _feature_maker(width: int, bands: int, rows: int):
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(SEED)
        a = random.integers(0, 1 << 63, bands * rows, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        b = random.integers(0, 1 << 63, bands * rows, np.uint64)[:, None]
        place = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _MIX)
        words = _Words()
        for batch in sliced(batches):
            n, keys, all_bands, all_sigs, lengths = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_hashes(text, width, words)
                n.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                lengths.append(len(shingles) > 0)
                if len(shingles):
                    best = _minima(shingles, a, b)
                    h = place
                    for column in best.reshape(bands, rows).T:
                        h = _mixed((h ^ column) * _MIX)
                    all_bands.append(h.view(np.int64))
                    all_sigs.append((_mixed(best) >> np.uint64(56)).astype(np.uint8).view(np.int8))
            filled = np.cumsum([0, *lengths])

            def lists(parts: list[np.ndarray], size: int, kind: pa.DataType) -> pa.Array:
                flat = np.concatenate(parts) if parts else np.empty(0)
                return pa.ListArray.from_arrays(pa.array(filled * size, pa.int32()), pa.array(flat, kind))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()),
                    lists(all_bands, bands, pa.int64()),
                    lists(all_sigs, bands * rows, pa.int8()),
                ],
                names=["doc_id", "n", "key", "bands", "sig"],
            )

    return make


def _set_maker(width: int):
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in sliced(batches):
            sets = [shingle_hashes(text, width, words) for text in batch.column(1).to_pylist()]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            odd = [np.packbits(np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) & 1).view(np.int64) for s in sets]
            at = pa.array(np.arange(len(sets) + 1) * (CLASSES // 64), pa.int32())
            parity = pa.ListArray.from_arrays(at, pa.array(np.concatenate(odd) if odd else np.empty(0, np.int64), pa.int64()))
            shingles = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), keys, shingles, parity], names=["doc_id", "key", "shingles", "parity"])

    return make


def features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One row for each document: size of its shingle set, a key equal for equal sets, a hash for each band, a byte for each minimum."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_feature_maker(width, bands, rows), FEATURES)


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the documents in ``nodes`` (node, key), made from their whole texts."""
    ids = nodes.select(F.col("node").alias("doc_id"))
    if nodes.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_set_maker(width), SETS)
    return sets.join(nodes.select(F.col("node").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])


def _may_link(left: str, right: str, percent: int, hashes: int) -> Column:
    """Set sizes allow the similarity, and the signatures agree in all but an unlikely number of places."""
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    s = percent / 100
    least = math.floor(hashes * s - 5.5 * math.sqrt(hashes * s * (1 - s)))
    same = F.aggregate(F.zip_with(f"{left}.sig", f"{right}.sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (same >= least)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    one = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    two = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("long")
    joined = pairs.join(one, "u").join(two, "v")
    return joined.filter(both * 100 >= (F.size("a") + F.size("b") - both) * percent).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the undirected edges (u, v): the smallest node reachable.

    Alternates large-star (a node's larger neighbours move to the smallest of its
    neighbours and itself) and small-star (its smaller neighbours move to the
    smallest) until the edges stay as they are. Each round is written to the shared
    folder, so a lost executor costs one round; minima are aggregated before the
    shuffle, and a node with very many edges is split by the adaptive skewed join.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, mark(now)
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct())
        before, state = state, mark(now)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _undecided(members: DataFrame, found: DataFrame, sized: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their component and the bucket's largest one.

    The bucket's first member has been compared with all others, so it is left out,
    and so are buckets of two.
    """
    placed = members.filter("members > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n_in"))
    mixed = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n_in", "component")).alias("largest")).filter("parts > 1")
    rest = placed.filter("node != first").join(mixed, "bucket").join(sized, "node")
    return rest.select("bucket", "node", "component", "largest", "n", F.pmod(F.xxhash64("node"), F.lit(ROUNDS[-1][1])).alias("turn"))


def _late_pairs(rest: DataFrame, begin: int, end: int, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket, whose turn it is, and that may be linked.

    A class of shingles that one set has an odd and the other an even number of holds
    at least one that only one of them has. So the number of such classes is never more
    than the sets differ by, and pairs beyond what the similarity allows are left out
    without a loss.
    """
    columns = F.struct("node", "component", "turn", "n", "parity")
    outside = rest.filter("component != largest").select("bucket", columns.alias("l")).alias("o")
    others = rest.select("bucket", columns.alias("r"), (F.col("component") == F.col("largest")).alias("inside")).alias("p")
    turn = (F.col("l.turn") + F.col("r.turn")) % ROUNDS[-1][1]
    meet = (F.col("o.bucket") == F.col("p.bucket")) & (turn >= begin) & (turn < end) & (F.col("l.component") != F.col("r.component"))
    once = F.col("p.inside") | (F.col("l.node") < F.col("r.node"))
    sizes = F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent
    apart = F.aggregate(F.zip_with("l.parity", "r.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = apart * (100 + percent) <= (F.col("l.n") + F.col("r.n")) * (100 - percent)
    pairs = outside.join(others, meet & once & sizes & near)
    return pairs.select(F.least("l.node", "r.node").alias("u"), F.greatest("l.node", "r.node").alias("v")).distinct()


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` with the components that further links connect; a node without links before joins with its own."""
    u, v = (found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in ("u", "v"))
    placed = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v"))
    merged = stored(components(placed))
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = found.join(renamed, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(merged.join(found, "node", "left_anti"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, hashes: int = 216, miss: float = 1e-6) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Words are runs without ASCII white space, with A to Z in lower case. Documents are
    linked when their sets of ``width``-word shingles share ``similarity`` percent of
    their union; ``component_id`` is the smallest ``doc_id`` that links reach.

    1. Rows with equal sets are one class; its smallest id stands for it.
    2. Classes that share a band hash meet. Each is compared with the smallest of its
       bucket, first by signature, then by the full sets (made again from the texts
       of these documents alone). Components of the links follow.
    3. In buckets that still hold several components, the members outside the largest
       one are compared with the members of the others: a small share of these pairs
       first, then, for what is still apart, the rest (``ROUNDS``). So every pair that
       shares a bucket is compared or connected by other links, and members of a
       group of near copies rarely meet more than a few others. Nothing is capped.

    A pair at the threshold shares no bucket with a chance of at most ``miss``; more
    similar pairs are safer. The exact check removes all false pairs.

    * Null or empty text, or white space alone: no shingles, linked with nothing.
    * Fewer words than ``width``: one shingle, the whole sequence.
    * Null ``doc_id``: takes no part; component null, kept.
    * Repeated rows: each has its row. Rows with one id and different texts stand for
      their own classes. No rows: no rows. Other columns play no part.
    """
    small_batches(docs.sparkSession)
    bands, rows = banding(similarity, hashes, miss)
    signature = bands * rows
    made = stored(features(docs, width, bands, rows))
    linkable = made.filter("doc_id IS NOT NULL AND n > 0")
    classes = stored(linkable.groupBy("key").agg(F.min("doc_id").alias("node")))
    reps = linkable.join(classes.select(F.col("node").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    reps = stored(reps.select(F.col("doc_id").alias("node"), "key", "n", "bands", "sig"))
    signed = reps.select("node", "n", "sig")

    entries = reps.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("members")).filter("first < last")
    members = stored(entries.join(shared, "bucket").select("bucket", "first", "members", "node"))

    stars = members.filter("node > first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    left = stars.join(signed.select(F.col("node").alias("u"), F.struct("n", "sig").alias("l")), "u")
    passed = left.join(signed.select(F.col("node").alias("v"), F.struct("n", "sig").alias("r")), "v").filter(_may_link("l", "r", similarity, signature))
    passed = stored(passed.select("u", "v"))

    def nodes_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        return reps.select("node", "key").join(ids, "node", "left_semi")

    sets = stored(_sets_of(docs, stored(nodes_of(passed)), width))
    links = stored(_confirmed(passed, sets, similarity))
    found = stored(components(links))

    made_all = False
    for begin, end in ROUNDS:
        rest = stored(_undecided(members, found, reps.select("node", "n")))
        if rest.isEmpty():
            break
        if not made_all:  # later rounds have no further members
            nodes = rest.select("node").distinct()
            missing = reps.select("node", "key").join(nodes, "node", "left_semi").join(sets.select(F.col("doc_id").alias("node")), "node", "left_anti")
            sets = sets.unionByName(stored(_sets_of(docs, stored(missing), width)))
            made_all = True
        parity = sets.select(F.col("doc_id").alias("node"), "parity")
        late = stored(_late_pairs(rest.join(parity, "node"), begin, end, similarity))
        found = stored(_merged(found, _confirmed(late, sets, similarity)))

    labels = classes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("label"))
    out = made.select("doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(labels, "key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and of repeated rows with its id one.

    Columns stay as they are. Dropped ids are few enough to send to every executor
    or, beyond ``BROADCAST_IDS``, are joined by a shuffle.
    """
    found = stored(near_duplicates(docs, width, similarity))
    gone = stored(found.filter("NOT kept").select("doc_id").distinct())
    twice = stored(found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    # Rows are packed, so that no name of theirs can clash.
    packed = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    left = packed.join(gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return left.select("_row.*")
    single = left.join(twice, "doc_id", "left_anti")
    return single.unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select("_row.*")
