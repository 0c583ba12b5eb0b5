"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, crc32_of, offsets_of, running, spread, stored, stratum

SEED = "mix-1"
ORDER = ("key", "doc_id", "size")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.withColumns(
        {
            "_size": word_count(F.col("text")),
            # The text's checksum spreads rows without an id, or with one id, over the buckets.
            "_key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), crc32_of(F.coalesce("text", F.lit(""))).cast("string"))),
            "_stratum": stratum(F.col("source")),
        }
    )


def source_targets(narrow: DataFrame, weights: Sequence[float], repeats: int) -> DataFrame:
    """One row for a source: place by code point (null last), weight, size and target.

    Sources share the total of all sizes by weight. A target stops at ``repeats``
    times the source's size; the rest is shared again by weight. That is one level
    V with target = least(weight * V, repeats * size), found by sorting the sources
    by the level at which they are used up.
    """
    by_name = Window.orderBy(F.col("_stratum").startswith("-").cast("int"), "_stratum")
    sums = narrow.groupBy("_stratum").agg(F.sum("_size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = sums.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", F.get(cycle, F.col("place") % len(weights)))
    used_up = placed.withColumn("most", F.col("source_size") * F.lit(float(repeats))).withColumn("level", F.col("most") / F.col("weight"))
    ordered = Window.orderBy("level", "place")
    upto, after = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy()
    levels = (
        used_up.withColumn("budget", F.sum("source_size").over(every).cast("double"))
        .withColumn("full", F.sum("most").over(upto))
        .withColumn("open", F.coalesce(F.sum("weight").over(after), F.lit(0.0)))
        .withColumn("reached", F.col("full") + F.col("level") * F.col("open") >= F.col("budget"))
        .withColumn("candidate", (F.col("budget") - (F.col("full") - F.col("most"))) / (F.col("open") + F.col("weight")))
        .withColumn("v", F.min(F.when(F.col("reached"), F.struct("level", "place", "candidate"))).over(every).getField("candidate"))
    )
    target = F.least(F.col("weight") * F.col("v"), F.col("most"))
    return levels.select("_stratum", "place", "weight", "source_size", "budget", "v", target.alias("target"))


@dataclass(frozen=True)
class Plan:
    """What decides about each row: bounded by sources and buckets, not by rows."""

    targets: DataFrame
    offsets: DataFrame
    buckets: int
    repeats: int
    cut: tuple[float, int] | None


def _finish(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` with the running words in the source's shuffled order and the columns of the source."""
    keyed = rows.withColumn("_bucket", spread(F.col("_key"), plan.buckets))
    order = [F.col("_key"), F.col("doc_id"), F.col("_size")]
    summed = running(keyed, plan.offsets, ["_stratum"], "_bucket", order, "_size", "_words")
    return summed.join(plan.targets, "_stratum")


def _time(pass_no: Column | int) -> Column:
    """Virtual finish time of a document in a pass over its source."""
    passes = pass_no if isinstance(pass_no, Column) else F.lit(pass_no)
    return (passes * F.col("source_size") + F.col("_words")) / F.col("weight")


def plan_mix(narrow: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = 3, bucket_rows: int = 1000, max_buckets: int = 100_000) -> Plan:
    """Targets, bucket sums and the queue's end for rows ``doc_id, _stratum, _key, _size``.

    The queue holds each document once for every pass. Its end is the first entry,
    in the order of finish times, that would pass the total budget: sums over ranges
    of finish times locate the range, and only that range's entries are sorted.
    """
    rows = narrow.count()
    buckets = max(1, min(max_buckets, math.ceil(rows / bucket_rows)))
    targets = stored(source_targets(narrow, weights, repeats))
    keyed = narrow.withColumn("_bucket", spread(F.col("_key"), buckets))
    offsets = stored(offsets_of(keyed, ["_stratum"], "_bucket", "_size", "_words"))
    plan = Plan(targets, offsets, buckets, repeats, None)

    # Ranges of finish times: ``buckets`` up to the level V, as many again beyond it, and one for the rest.
    ranges = F.when(F.col("v") > 0, F.least(F.floor(F.col("finish") / F.col("v") * buckets), F.lit(2 * buckets))).otherwise(0).cast("int")
    finished = stored(_finish(narrow, plan).filter("_size > 0").select("doc_id", "_size", "_words", "source_size", "weight", "place", "budget", "v"))
    queue = finished.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass"))
    queue = queue.withColumn("finish", _time(F.col("pass"))).withColumn("range", ranges)
    sums = offsets_of(queue, [], "range", "_size", "before")
    totals = queue.groupBy("range").agg(F.sum("_size").alias("inside"), F.max("budget").alias("budget"))
    at = sums.join(totals, "range").filter("before + inside > budget").orderBy("range").limit(1).collect()
    if not at:
        return plan
    entries = queue.filter(F.col("range") == at[0]["range"]).withColumn("before", F.lit(at[0]["before"]))
    upto = Window.orderBy("finish", "place").rowsBetween(Window.unboundedPreceding, 0)
    end = entries.withColumn("sum", F.col("before") + F.sum("_size").over(upto)).filter("sum > budget").orderBy("finish", "place").limit(1).collect()
    return Plan(targets, offsets, buckets, repeats, (end[0]["finish"], end[0]["place"]))


def _copies(plan: Plan) -> Column:
    if plan.cut is None:
        return F.lit(1)
    finish, place = (F.lit(x) for x in plan.cut)
    taken = [(_time(n) < finish) | ((_time(n) == finish) & (F.col("place") < place)) for n in range(plan.repeats)]
    return sum((t.cast("int") for t in taken), F.lit(0))


def mix_sizes(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = 3, seed: str = SEED, bucket_rows: int = 1000) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: how often the mix takes each document.

    Rules as in :func:`mix`; only narrow rows are shuffled.
    """
    columns = ["doc_id", "source", "_size", "_key", "_stratum"]
    narrow = stored(_sized(docs, seed).select(*columns))
    plan = plan_mix(narrow, weights, repeats, bucket_rows)
    return _finish(narrow, plan).select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", _copies(plan).alias("copies"), (F.col("_size") * _copies(plan)).alias("taken")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = 3, seed: str = SEED, bucket_rows: int = 1000) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it (0 to ``repeats`` times).

    Sources, sorted by code point with null last, have the ``weights`` in turn and
    share as many words as all documents hold. Documents of a source queue in a
    seeded shuffled order, once for every pass; an entry's virtual finish time is the
    words of its source up to and with it, divided by the weight. The queue is cut
    where the total budget would be passed.

    Only ids and sizes are shuffled: what a source gives in a pass is all of its order up to one
    row, so texts meet a table of the sources, each with its last row of every pass.

    * Null or empty text: size 0, taken as often as its place in the queue says.
    * Null source: a source of its own. Null ``doc_id``: shuffled by the text.
    * Repeated rows each stand in the queue. Rows with one id and one text are taken alike,
      with the last of them. Equal finish times go by the source's place.
    * No words at all: every row is taken once. No rows: no rows.
    * Extra columns are kept, whatever their names.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    sized = _sized(packed, seed)
    narrow = stored(sized.select("doc_id", "source", "_size", "_key", "_stratum"))
    plan = plan_mix(narrow, weights, repeats, bucket_rows)
    place = F.struct("_key", "doc_id", "_size")
    decided = _finish(narrow, plan).select("_stratum", _copies(plan).alias("copies"), place.alias("at"))
    last = [F.max(F.when(F.col("copies") > n, F.col("at"))).alias(f"_last{n}") for n in range(repeats)]
    ends = stored(decided.groupBy("_stratum").agg(*last))
    taken = sum((F.coalesce(place <= F.col(f"_last{n}"), F.lit(False)).cast("int") for n in range(repeats)), F.lit(0))
    many = sized.join(ends, "_stratum").select("_row", F.explode(F.array_repeat(F.lit(1), taken)).alias("_copy"))
    return many.select("_row.*")
