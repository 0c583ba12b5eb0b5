"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, sliced, small_batches, stored

#: Buckets that words and their beginnings are hashed to.
BUCKETS = 1 << 20
#: Insults that vote for toxic wherever they occur as a word; a parameter of :func:`fit`.
LEXICON = tuple(
    "ass asshole bastard bitch bloody clown coward creep crap cretin damn dimwit dirtbag disgusting dolt dumb dumbass "
    "dumb-ass fool freak garbage hate hideous idiot idiotic imbecile jerk kill lame liar loser lowlife moron moronic "
    "nasty nitwit nutjob parasite pathetic pig psycho rat rotten rubbish scum scumbag shit shut sick slime sleazy stupid "
    "suck sucks swine thug trash twit ugly useless vermin vile wimp worthless wretch".split()
)
#: Forms that vote for toxic with some precision; each is searched in the lowered text.
PATTERNS = (
    r"!{3,}",
    r"\?!|!\?",
    r"\byou (?:are|all|people)\b",
    r"\byou'?re (?:a|an|so|such)\b",
    r"\b\w+\*{2,}\w*",
    r"\b(?:go|get) (?:away|lost|to hell)\b",
    r"\bi hate\b",
    r"\b(?:shut|screw) (?:up|you)\b",
)
_WORDS = re.compile(r"[^\W\d_]+")
_FORMS = [re.compile(p) for p in PATTERNS]


def _hash(kind: str, word: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}{word}".encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def _word_buckets(word: str) -> tuple[int, ...]:
    """The whole word and its beginnings of 3 to 6 letters, so that inflected forms share features."""
    return (_hash("=", word), *(_hash("^", word[:n]) for n in range(3, 7) if n <= len(word)))


class _Buckets(dict):
    """Feature buckets of the words met so far, only those in ``chosen`` if given; emptied when it grows large."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        found = _word_buckets(word)
        if self.chosen is not None:
            found = tuple(self.chosen[b] for b in found if b in self.chosen)
        self[word] = found
        return found


def _features(text: str, words: dict) -> set[int]:
    found: set[int] = set()
    for word in set(_WORDS.findall(text.lower())):
        if hit := words[word]:
            found.update(hit)
    return found


def _forms(text: str) -> list[bool]:
    low = text.lower()
    return [f.search(low) is not None for f in _FORMS]


def _label_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a feature; buckets that no toxic document has are left out in each task's sum of both."""
    words, seen = _Buckets(), np.zeros((2, BUCKETS), np.int32)
    for batch in sliced(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[toxic, np.fromiter(_features(text or "", words), np.int64)] += 1
    used = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[1, used], pa.int64()), pa.array(seen[0, used], pa.int64())], names=["bucket", "pos", "neg"])


@dataclass(frozen=True)
class Model:
    """Weights of the linear classifier by feature bucket, of the forms, and its constant."""

    weights: dict[int, float]
    forms: np.ndarray
    bias: float
    #: For each voter of the label model: how often it fires on toxic and on clean documents, and its share of evidence.
    voters: tuple[tuple[str, float, float, float], ...]


def label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, and for each voter its rates on toxic and on clean rows and its share.

    The generative model has a hidden class for each row: clean, toxic in a way that the
    voters know, or toxic in a way that they don't, where they fire as on clean rows.
    A voter fires with a rate of its own; the given label, the last voter, may be wrong
    and tells clean from both kinds of toxic. EM fits rates and sizes, the share of toxic
    labels is the class balance, and the label's rates stay in bounds, so that the
    classes keep their meaning. Voters that still fire together once the class is
    known are correlated: their evidence is divided by one plus the sum of their
    squared correlations with the other voters, so that copies of one voter count once.
    """
    x, total = votes.astype(float), weight.sum()
    prior = float(np.clip((labels * weight).sum() / total, 0.01, 0.5))
    known = np.where((labels == 1) & votes.any(axis=1), 0.9, 0.02)
    missed = np.where(labels == 1, 0.98 - known, 0.02)
    toxic, covered, hit, wrong = known + missed, 0.5, 0.95, 0.02
    on = off = share = np.ones(x.shape[1])
    for _ in range(rounds):
        w1, w0 = known * weight, (1 - known) * weight
        on, off = (w1 @ x + 0.1) / (w1.sum() + 1), (w0 @ x + 0.01) / (w0.sum() + 1)
        covered = float(np.clip(w1.sum() / max((toxic * weight).sum(), 1e-9), 0.02, 0.98))
        hit = float(np.clip((toxic * weight) @ labels / max((toxic * weight).sum(), 1e-9), 0.8, 0.99))
        wrong = float(np.clip(((1 - toxic) * weight) @ labels / max(((1 - toxic) * weight).sum(), 1e-9), 0.002, 0.08))
        rest = (x - np.outer(known, on) - np.outer(1 - known, off)) * np.sqrt(weight)[:, None]
        cov = rest.T @ rest
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(scale, scale)
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + (corr**2).sum(axis=1))
        evidence = (x * np.log(on / off) + (1 - x) * np.log((1 - on) / (1 - off))) @ share
        told = np.where(labels == 1, np.log(hit / wrong), np.log((1 - hit) / (1 - wrong))) + np.log(prior / (1 - prior))
        a, b = np.clip(told + np.log(covered) + evidence, -30, 30), np.clip(told + np.log(1 - covered), -30, 30)
        bottom = 1 + np.exp(a) + np.exp(b)
        fresh, missed = np.exp(a) / bottom, np.exp(b) / bottom
        moved = np.abs(fresh + missed - toxic).max()
        known, toxic = fresh, fresh + missed
        if moved < 1e-6:
            break
    return toxic, np.append(on, hit), np.append(off, wrong), np.append(share, 1.0)


def _linear(rows: np.ndarray, columns: np.ndarray, width: int, target: np.ndarray, weight: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on soft targets, by gradient steps with momentum."""
    w, b = np.zeros(width), 0.0
    first, second, count = np.zeros(width + 1), np.zeros(width + 1), weight.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[columns], minlength=len(target)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / count
        gradient = np.append(np.bincount(columns, error[rows], minlength=width) + ridge * w, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:width], b - move[width]
    return w, b


def _constant(toxic: bool) -> Model:
    return Model({}, np.zeros(len(PATTERNS)), 6.0 if toxic else -6.0, ())


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, n_features: int = 2048, n_voters: int = 96, min_z: float = 5.0, lexicon: tuple[str, ...] = LEXICON) -> Model:
    """Learn from the texts of labelled documents.

    ``labels`` has ``doc_id, toxic``; rows with null are left out, and where one id
    has several, the larger counts. At most about ``sample`` documents are used,
    half of them toxic (those with the smallest hash); this bound is what the driver
    holds. They are weighed back to their true shares.

    Voters are the lexicon's words, the patterns, and the beginnings of words that
    labelled toxic documents have far more often than clean ones. The label model
    turns their votes and the labels into posteriors, and the classifier learns these
    from the ``n_features`` features that tell the labels apart best, by ``min_z`` standard errors at
    least: of hundreds of thousands of features, some differ by four by chance.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter("toxic IN (0, 1)").withColumn("order", F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)))
    counts = dict(known.groupBy("toxic").count().collect())
    half = sample // 2
    picked = []
    for toxic, count in counts.items():
        part = known.filter(F.col("toxic") == toxic)
        if count > half:  # thin out before sorting, so that the sort is bounded too
            part = part.filter(F.col("order") * count <= (1 << 30) * (2 * half)).orderBy("order", "doc_id").limit(half)
        picked.append(part.select(F.col("doc_id").alias("_id"), "toxic"))
    if len(picked) < 2:
        return _constant(1 in counts)
    ids = stored(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    # An id that stands for several rows gives one of them; ids are at most ``sample``.
    texts = texts.join(F.broadcast(ids), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text"))
    texts = stored(texts.select("_id", "toxic", "text"))

    of = dict(texts.groupBy("toxic").count().collect())
    if len(of) < 2:
        return _constant(1 in of)
    seen = texts.select("text", "toxic").mapInArrow(_label_counts, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n_pos, n_neg = of[1], of[0]
    gap = F.col("pos") / n_pos - F.col("neg") / n_neg
    spread = F.sqrt((F.col("pos") + F.col("neg") + 1.0) / (n_pos + n_neg)) / (1.0 / n_pos + 1.0 / n_neg) ** -0.5
    best = seen.filter("pos >= 3").withColumn("z", gap / spread).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "bucket").limit(n_features).collect()
    chosen = {r["bucket"]: i for i, r in enumerate(best)}
    precise = [i for i, r in enumerate(best) if r["pos"] / n_pos > 5 * (r["neg"] + 0.5) / n_neg][:n_voters]
    words = [(w, chosen[b]) for w in lexicon if (b := _hash("=", w)) in chosen]

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Buckets(chosen)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([sorted(_features(t, table)) for t in texts], pa.list_(pa.int16())), pa.array([_forms(t) for t in texts], pa.list_(pa.bool_()))],
                names=["toxic", "features", "forms"],
            )

    got = texts.orderBy("_id").select("text", "toxic").mapInArrow(sparse, "toxic int, features array<smallint>, forms array<boolean>").toArrow()
    toxic = got.column("toxic").to_numpy()
    lists = got.column("features").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    columns = lists.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(toxic)), lengths)
    forms = np.array(got.column("forms").to_pylist(), float).reshape(len(toxic), len(PATTERNS))
    weight = np.where(toxic == 1, counts[1] / n_pos, counts[0] / n_neg)

    names = [f"word {w}" for w, _ in words] + [f"beginning {best[i]['bucket']}" for i in precise] + [f"form {p}" for p in PATTERNS] + ["label"]
    place = np.full(len(chosen), -1)
    wanted = list(dict.fromkeys([i for _, i in words] + precise))
    place[wanted] = np.arange(len(wanted))
    fired = np.zeros((len(toxic), len(wanted)), bool)
    is_voter = place[columns] >= 0
    fired[rows[is_voter], place[columns[is_voter]]] = True
    votes = np.column_stack([fired[:, [place[i] for i in [i for _, i in words] + precise]], forms])
    posterior, on, off, share = label_model(votes, toxic, weight)

    width = len(chosen) + len(PATTERNS)
    form_rows, form_columns = np.nonzero(forms)
    w, b = _linear(np.concatenate([rows, form_rows]), np.concatenate([columns, form_columns + len(chosen)]), width, posterior, weight)
    return Model({bucket: float(w[i]) for bucket, i in chosen.items()}, w[len(chosen) :], float(b), tuple(zip(names, on.tolist(), off.tolist(), share.tolist())))


def score(spark, model: Model, text: Column) -> Column:
    """Probability (0 to 1) that a text is toxic; a null text scores as an empty one."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def probability(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        words = _Buckets({b: b for b, w in m.weights.items() if w})
        for array in arrays:
            out = []
            for text in array.to_pylist():
                z = m.bias
                if text:
                    z += sum(map(m.weights.__getitem__, sorted(_features(text, words))))
                    z += sum(w for w, hit in zip(m.forms.tolist(), _forms(text)) if hit)
                out.append(1 / (1 + float(np.exp(-min(max(z, -30.0), 30.0)))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(probability, "double")(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return crc32_of(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with a column ``toxicity``, learned from the labels of documents that are not held out.

    * Null, empty or blank text: the classifier's constant, which is that of a text without features.
    * Very long texts are read whole. Equal texts get equal scores, in any place and order.
    * No labels of one kind: every text gets the same score, on the side of the other kind.
    * Null ``doc_id`` and repeated rows are rows like others. Extra columns stay; an
      existing ``toxicity`` is replaced.
    """
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))), **options)
    return docs.withColumn("toxicity", score(docs.sparkSession, model, F.col("text")))
