"""Streams of point changes: a feed applied to a table, duplicates removed, counts per day.

A change has ``seq, ts, id, op, payload`` with ``op`` upsert or delete; ``seq``
orders the changes of one id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutations import latest_per_key

CHANGE_COLUMNS = ("seq", "ts", "id", "op", "payload")


def run_available(df: DataFrame, path: str, partition: str | None = None) -> StreamingQuery:
    """Append everything now available to a Parquet folder and stop."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_checkpoint")
    if partition:
        writer = writer.partitionBy(partition)
    query = writer.trigger(availableNow=True).start(f"{path}/data")
    query.awaitTermination()
    return query


def apply_feed(changes: DataFrame, path: str) -> StreamingQuery:
    """Write each micro-batch's last change per id below ``path`` until nothing is left to read.

    A batch replaces its own ``batch=<id>`` folder, so a batch that runs again
    after a failure leaves the same files: every change counts exactly once.
    Each batch costs the size of its changes, not of the stored points.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = latest_per_key(batch.select(*CHANGE_COLUMNS), ["id"], "seq")
        latest.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    query = (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def current_points(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """``id, payload`` after all changes written by ``apply_feed``, on top of ``base``.

    The change with the highest ``seq`` decides, whatever batch it came in, so
    late changes do not undo newer ones.
    """
    changes = spark.read.parquet(f"{path}/changes").select("seq", "id", "op", "payload")
    return apply_changes(changes, base)


def apply_changes(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The batch form: ``base`` with each id's last change applied."""
    latest = latest_per_key(changes, ["id"], "seq")
    kept = latest.filter("op <> 'delete'").select("id", "payload")
    if base is None:
        return kept
    return base.select("id", "payload").join(latest.select("id"), "id", "left_anti").unionByName(kept)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Fold all changes so far into one new change folder (deletes included) at ``target``."""
    changes = spark.read.parquet(f"{path}/changes").select(*CHANGE_COLUMNS)
    latest_per_key(changes, ["id"], "seq").write.mode("overwrite").parquet(f"{target}/changes/batch=0")


def drop_duplicates(changes: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """First of equal changes that arrive within ``delay`` of each other; later-than-watermark rows are dropped."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows a finished query dropped because they were behind the watermark."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0) for progress in query.recentProgress for operator in progress["stateOperators"]
    )


def daily_counts(changes: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """``window_start, op, n`` per tumbling window, emitted once the watermark has passed it."""
    counted = changes.withWatermark("ts", delay).groupBy(F.window("ts", width), "op").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "op", "n")
