"""Readers and writers of the stored tables, and the folder for intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("vector_name", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("payload", T.StringType()),
    ]
)
DOCUMENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("config_type", "name", "content")])


def read_points(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Points with the fixed schema; JSON payloads stay text."""
    return spark.read.schema(POINT_SCHEMA).format(format).load(path)


def read_documents(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(DOCUMENT_SCHEMA).format(format).load(path)


def read_document_files(spark: SparkSession, path: str, config_type: str) -> DataFrame:
    """One document per JSON file, named after the file."""
    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return files.select(F.lit(config_type).alias("config_type"), name.alias("name"), F.col("value").alias("content"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, length`` of the image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", "length")


def read_database(spark: SparkSession, options: Mapping[str, str], key: str, bounds: tuple[int, int], parts: int) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of a numeric key."""
    ranges = {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**{**options, **ranges}).load()


def write_points(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per vector name, so a search on one name reads only its vectors."""
    points.write.mode(mode).partitionBy("vector_name").parquet(path)


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per document type."""
    documents.write.mode(mode).partitionBy("config_type").parquet(path)


def overwrite_partitions(table: DataFrame, path: str, columns: list[str]) -> None:
    """Replace only the partitions that occur in ``table``."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """A new path below the shared folder that the session names in ``spark.checkpoint.dir``.

    The folder must be one that the driver and all executors see, so there is no
    other choice when none is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
