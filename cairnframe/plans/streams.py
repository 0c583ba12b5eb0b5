"""Streaming queries over the event table, read as a stream of point changes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_dir
from ..streaming import feed
from .registry import Inputs, query


def _changes(t: Inputs) -> DataFrame:
    """The ``point_feed`` view, as a stream."""
    events = (
        t.spark.readStream.schema(t["events"].schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(t.sf_dir)
    )
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.when(F.col("event_type") != "signup", F.col("props")).alias("payload"),
    )


@query(
    "s_feed",
    """
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM point_feed) WHERE rn = 1)
SELECT id, payload FROM points WHERE id NOT IN (SELECT id FROM latest)
UNION ALL SELECT id, payload FROM latest WHERE op <> 'delete'
""",
)
def s_feed(t):
    path = shared_dir(t.spark)
    feed.apply_feed(_changes(t), path)
    return feed.current_points(t.spark, path, t["points"])


@query("s_dedup", "SELECT seq, id, op FROM point_feed")
def s_dedup(t):
    """Every change arrives twice; one of each is kept."""
    path = shared_dir(t.spark)
    twice = _changes(t).unionByName(_changes(t))
    feed.run_available(feed.drop_duplicates(twice, ["seq"]).select("seq", "id", "op"), path)
    return t.spark.read.parquet(f"{path}/data")


@query(
    "s_windows",
    """
WITH w AS (SELECT date_trunc('day', ts) AS window_start, op, count(*) AS n FROM point_feed GROUP BY ALL)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, op, n FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM point_feed)
""",
)
def s_windows(t):
    path = shared_dir(t.spark)
    feed.run_available(feed.daily_counts(_changes(t)), path)
    counts = t.spark.read.parquet(f"{path}/data")
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
