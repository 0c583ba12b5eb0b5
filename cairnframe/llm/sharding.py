"""Sharding by proportional stratified interleaving (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, offsets_of, running, spread, stored, stratum

SEED = "shards-1"


def shard(docs: DataFrame, shards: int = 24, seed: str = SEED, bucket_rows: int = 1000, max_buckets: int = 100_000) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot``: every row in one of ``shards`` shards that hold the sources alike.

    Rows of a source are ranked in a seeded shuffled order (MD5 of seed,
    ``doc_id`` and the text's CRC-32); the fractional rank (2 * rank + 1) / (2 * rows of the source)
    sorts all rows, and the sorted rows are cut into equal runs. Row counts of two
    shards differ by one at most, and so, but for rounding, do those of a source.

    No source and no shard is gathered: ranks are counted in buckets of the shuffled
    order, positions in buckets of the fractional rank. Only narrow rows are shuffled;
    the text is read once, for its size and CRC-32.

    * Null text: size 8, CRC-32 0. Empty text alike. Null source: a source of its own.
    * Null ``doc_id``: shuffled by the text. Repeated rows each take a slot.
    * Ties in the fractional rank go to the smaller shuffle key, then the source by
      code point (null first), CRC-32 and size. Other columns play no part.
    * No rows: no rows. Fewer rows than shards: some shards stay empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            crc32_of(text).alias("text_crc32"),
            # The text's checksum spreads rows without an id, or with one id, over the buckets.
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), crc32_of(text).cast("string"))).alias("key"),
        )
    )
    rows = narrow.count()
    buckets = max(1, min(max_buckets, math.ceil(rows / bucket_rows)))
    order = [F.col("key"), F.col("text_crc32"), F.col("size")]

    keyed = narrow.select("*", stratum(F.col("source")).alias("stratum"), spread(F.col("key"), buckets).alias("bucket"), F.lit(1).alias("one"))
    ranked = running(keyed, offsets_of(keyed, ["stratum"], "bucket", "one", "rank"), ["stratum"], "bucket", order, "one", "rank")
    of_source = keyed.groupBy("stratum").agg(F.sum("one").alias("rows_of_source"))
    fraction = (F.col("rank") * 2 - 1) / (F.col("rows_of_source") * 2)
    placed = stored(
        ranked.join(of_source, "stratum").select(
            "doc_id", "source", "size", "text_crc32", "key", "one",
            fraction.alias("fraction"),
            F.least(F.floor(fraction * buckets), F.lit(buckets - 1)).cast("int").alias("run"),
        )
    )
    order = [F.col("fraction"), F.col("key"), F.col("source").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    sorted_rows = running(placed, offsets_of(placed, [], "run", "one", "position"), [], "run", order, "one", "position")
    position = F.col("position") - 1
    cut = sorted_rows.withColumn("shard", F.floor(position * shards / F.lit(max(rows, 1))).cast("long"))
    first = F.ceil(F.col("shard") * rows / F.lit(shards))
    return cut.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (position - first).cast("long").alias("slot"))
