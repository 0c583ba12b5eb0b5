"""A corpus pipeline of five of the operators in ``cairnframe.llm``.

Every stage takes the session, the documents that its predecessor kept and the data
folder. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm import language_id, mixing, near_dedup, segmentation, toxicity
from cairnframe.llm.common import stored
from cairnframe.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, by a classifier that is learned from the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "toxic")
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return toxicity.classify(packed, labels).filter("toxicity < 0.5").select("_row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language accepts; a language that is missing is filled in, if any is near."""
    packed = docs.select("text", "lang", "doc_id", F.struct(*docs.columns).alias("_row"))
    found = language_id.identify(packed, F.col("lang").isNotNull()).filter("NOT language.rejected")
    near = F.when(F.col("language.distance") <= language_id.FURTHEST, F.col("language.lang"))
    filled = F.coalesce("_row.lang", near).alias("lang")
    return found.select(*[filled if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, four fifths of their union shared."""
    return near_dedup.drop_near_duplicates(docs, width=5, similarity=80).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that bring every source to its share; one taken again comes again."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, its runners-up, and whether decoding gives the text back.

    What encoding gives is written before it is decoded, so that a task has one Python worker at a time.
    """
    words = vocabulary()
    found = stored(segmentation.segmented(docs.select("doc_id", "lang", "source", "text"), words, 4))
    decoded = segmentation.decode(spark, words, F.col("encoded.ids"))
    return found.select(
        "doc_id",
        "lang",
        "source",
        F.size("encoded.ids").alias("n_pieces"),
        F.col("encoded.score").alias("score"),
        F.col("encoded.others.score").alias("other_scores"),
        (decoded == F.coalesce("text", F.lit(""))).alias("round_trip"),
        F.col("encoded.ids").alias("ids"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("sentencepiece", encode_texts),
]
#: The learned stages and the lattice search are beyond SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
