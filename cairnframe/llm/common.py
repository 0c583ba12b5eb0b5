"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnframe.sources.tables import stored

__all__ = ["ROWS", "WORD", "crc32_of", "running", "sized", "sliced", "small_batches", "spread", "stored", "stratum"]

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that a Python worker holds at once.
ROWS = 256


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows that Spark hands to a Python worker at once; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized(texts: Iterable[str | None], chars: int, rows: int = ROWS) -> Iterator[list[str]]:
    """The texts in order, '' for null, in lists of at most ``rows`` that hold about ``chars`` characters; a longer text is alone."""
    part, size = [], 0
    for text in texts:
        text = text or ""
        if part and (size + len(text) > chars or len(part) == rows):
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes, or of a number written as text."""
    return F.crc32(F.encode(column.cast("string"), "utf-8"))


def stratum(column: Column) -> Column:
    """A key that is never null: equal for equal values, and one of its own for null."""
    return F.coalesce(F.concat(F.lit("+"), column.cast("string")), F.lit("-"))


def spread(key: Column, buckets: int) -> Column:
    """Bucket 0 to ``buckets`` - 1 of a hexadecimal key, in the order of the keys."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(head * F.lit(buckets) / F.lit(1 << 32)).cast("int")


def offsets_of(df: DataFrame, by: Sequence[str], bucket: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier buckets, for each group and bucket: one row for a bucket, not for a row of ``df``."""
    totals = df.groupBy(*by, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias(out))


def running(df: DataFrame, offsets: DataFrame, by: Sequence[str], bucket: str, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``out``: the running sum of ``value`` in each group, up to and with the row, in the order (bucket, order).

    A group is never gathered: a window sees one bucket of it, and ``offsets``
    (see :func:`offsets_of`) adds what lies before the bucket. The join and the
    window need the same partitioning, so the rows are shuffled once.
    """
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets.withColumnRenamed(out, "_before"), [*by, bucket])
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before")
