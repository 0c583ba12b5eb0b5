"""Language identification by nearest centroid of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS, sliced, small_batches

#: Buckets that the 1-, 2- and 3-grams of letters are hashed to.
DIMS = 8192
#: Characters whose vectors are made at once.
CHARS = 1 << 18
#: The largest distance that is accepted of any text.
FURTHEST = 0.95
#: Texts of fewer letters say too little to be rejected.
FEW_LETTERS = 8


@dataclass(frozen=True)
class Model:
    """Centroids of all languages; ``reach`` is the largest distance that a centroid accepts of texts of ``min_letters`` or more."""

    langs: tuple[str, ...]
    of: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray
    idf: np.ndarray
    min_letters: int


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _parts(texts: list[str], limit: int = CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        if part and (size + len(text) > limit or len(part) == ROWS):
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _counts(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each n-gram bucket occurs in each text, and how many letters each has.

    Letters in lower case count; any run of other characters is one blank.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    is_letter = letters[codes]
    n_letters = np.bincount(owner, is_letter, minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes, owner = np.where(is_letter, codes, 32)[keep].astype(np.uint64), owner[keep]
    base = owner * DIMS
    out = np.zeros(len(texts) * DIMS)
    for n in (1, 2, 3):
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n, np.uint64)
        inside = owner[: len(h)] == owner[n - 1 :]  # none spans two texts
        for j in range(n):
            part = codes[j : len(codes) - n + 1 + j]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < j < n - 1 or n == 1:
                inside &= part != 32
        bucket = base[: len(h)] + (h & np.uint64(DIMS - 1)).astype(np.int64)
        out += np.bincount(bucket[inside], minlength=len(out))
    return out.reshape(len(texts), DIMS), n_letters


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _document_frequency(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, total, rows = _letters(), np.zeros(DIMS, np.int64), 0
    for batch in sliced(batches):
        texts = [t for t in batch.column(0).to_pylist() if t]
        for part in _parts(texts):
            total += (_counts(part, letters)[0] > 0).sum(axis=0)
        rows += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(range(DIMS + 1), pa.int32()), pa.array([*total.tolist(), rows], pa.int64())], names=["bucket", "df"])


def _cluster(vectors: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: unit centroids and each vector's centroid."""
    mean = vectors.mean(axis=0)
    centres = [vectors[np.argmax(vectors @ mean)]]
    while len(centres) < min(clusters, len(vectors)):
        nearest = (vectors @ np.array(centres).T).max(axis=1)
        centres.append(vectors[np.argsort(nearest, kind="stable")[len(nearest) // 20]])
    centroids = np.array(centres)
    for _ in range(rounds):
        member = (vectors @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (member == c).any():
                mean = vectors[member == c].mean(axis=0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def reaches(model: Model, best: np.ndarray, n_letters: np.ndarray) -> np.ndarray:
    """The largest distance that is accepted of each text: its centroid's, wider for fewer letters than ``min_letters``, up to ``FURTHEST``."""
    share = np.minimum(n_letters / max(model.min_letters, 1), 1) ** 2
    return np.where(n_letters < FEW_LETTERS, 1.0, FURTHEST - (FURTHEST - model.reach[best]) * share)


def fit(
    docs: DataFrame, clusters: int = 4, per_lang: int = 400, slack: float = 1.5, widest: float = 0.6, min_letters: int = 200, quantile: float = 0.95
) -> Model:
    """Centroids learned from the ``text`` and ``lang`` of ``docs`` (rows with null ``lang`` or text are left out).

    Document frequencies cover all rows. The clusters of a language are made from at most
    ``per_lang`` of its documents (those with the smallest hash of ``doc_id``); that
    bound, and one task for a language, keep the fit small. A centroid accepts
    distances up to ``slack`` times the ``quantile`` of those among its own documents of at
    least ``min_letters`` letters, so that a few odd ones don't widen it, and any up to
    ``widest``, but none beyond ``FURTHEST``. Of shorter texts it accepts more (:func:`reaches`).
    """
    small_batches(docs.sparkSession)
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    df = rows.select("text").mapInArrow(_document_frequency, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    found = dict(df.collect())
    total = max(found.get(DIMS, 0), 1)
    idf = np.log((1 + total) / (1 + np.array([found.get(i, 0) for i in range(DIMS)], float))) + 1

    # Thin out each language by its count before anything is sorted.
    order = F.pmod(F.xxhash64(F.lit("languages"), "doc_id"), F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language, as the model has
    thin = rows.join(F.broadcast(sizes), "lang").withColumn("order", order).filter(F.col("order") * F.col("n") <= F.lit((1 << 30) * (2 * per_lang + 100)))
    first = Window.partitionBy("lang").orderBy("order", "doc_id", "text")
    sample = thin.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_lang).select("lang", "rank", "text")

    def centroids_of(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        letters, vectors, many = _letters(), [], []
        for part in _parts(table.column("text").to_pylist()):
            counts, n_letters = _counts(part, letters)
            vectors.append(_vectors(counts, idf)[n_letters > 0])
            many.append(n_letters[n_letters > 0])
        vectors, many = np.concatenate(vectors), np.concatenate(many)
        if not len(vectors):
            return pa.table({"lang": pa.array([], pa.string()), "reach": pa.array([], pa.float64()), "centroid": pa.array([], pa.list_(pa.float32()))})
        centroids, member = _cluster(vectors, clusters)
        distance = 1 - (vectors * centroids[member]).sum(axis=1)
        long = many >= min_letters
        own = [distance[long & (member == c)] for c in range(len(centroids))]
        reach = [min(FURTHEST, max(widest, slack * np.quantile(d, quantile)) if len(d) else widest) for d in own]
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(centroids), pa.string()), "reach": pa.array(reach, pa.float64()), "centroid": pa.array(list(centroids), pa.list_(pa.float32()))})

    made = sample.groupBy("lang").applyInArrow(centroids_of, "lang string, reach double, centroid array<float>")
    learned = sorted(made.collect(), key=lambda r: (r["lang"], tuple(r["centroid"])))
    langs = tuple(sorted({r["lang"] for r in learned}))
    return Model(
        langs,
        np.array([langs.index(r["lang"]) for r in learned], int),
        np.array([r["centroid"] for r in learned], np.float32).reshape(len(learned), DIMS),
        np.array([r["reach"] for r in learned], float),
        idf,
        min_letters,
    )


def predict(spark, model: Model, text: Column) -> Column:
    """``struct<lang, score, distance, rejected>`` of a text: the language of the nearest centroid.

    ``score`` is the cosine (0 to 1), ``distance`` one minus the cosine. Rejected are
    texts that lie beyond the reach of their nearest centroid, which is wider for fewer
    than ``min_letters`` letters, and texts without letters, whose language is ``und``.
    Texts of fewer than ``FEW_LETTERS`` letters are not rejected. Every text with letters
    gets a learned language, however far: ``distance`` and ``rejected`` say what it is worth.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("distance", pa.float64()), ("rejected", pa.bool_())])

    def nearest(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, letters = shared.value, _letters()
        for array in arrays:
            out = []
            for part in _parts([t or "" for t in array.to_pylist()]):
                counts, n_letters = _counts(part, letters)
                if not len(m.of):
                    out += [("und", 0.0, 1.0, True)] * len(part)
                    continue
                # Products are made in 64 bits, so that a text's score does not depend on its neighbours.
                cosine = _vectors(counts, m.idf).astype(float) @ m.centroids.T.astype(float)
                best = cosine.argmax(axis=1)
                score = np.clip(np.round(cosine[np.arange(len(part)), best], 9), 0, 1)
                away = 1 - score
                none = n_letters == 0
                reject = none | (away > reaches(m, best, n_letters))
                out += [("und", 0.0, 1.0, True) if z else (m.langs[m.of[b]], s, d, r) for z, b, s, d, r in zip(none, best, score.tolist(), away.tolist(), reject.tolist())]
            yield pa.array([dict(zip(("lang", "score", "distance", "rejected"), row)) for row in out], kind)

    # Not to be repeated where a filter on one of its fields is moved below it.
    once = F.arrow_udf(nearest, "lang string, score double, distance double, rejected boolean").asNondeterministic()
    return once(text.cast("string"))


def identify(docs: DataFrame, learn: Column, **options) -> DataFrame:
    """``docs`` with a column ``language`` as :func:`predict` gives it, learned from the rows where ``learn`` is true.

    * Null text, or a text without letters: ``und``, score 0, rejected.
    * Null ``lang``: not learned from, but predicted. No rows to learn from: all ``und``.
    * Very long texts are read whole, some at a time. Equal texts get equal results.
    * Equal cosines go to the language that sorts first. Null ``doc_id`` and repeated rows
      are rows like others. Extra columns stay; an existing ``language`` is replaced.
    """
    model = fit(docs.filter(learn), **options)
    return docs.withColumn("language", predict(docs.sparkSession, model, F.col("text")))
