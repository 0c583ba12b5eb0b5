"""A table of whole search requests, each with its own form, filter, page and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import passes_threshold
from ..sources.tables import stored
from .knn import BLOCK_BYTES, BROADCAST_BYTES, _top_partial, rank_per_query, recommend_targets
from .points import condition_token, payload_tokens, validate_requests

# Fixed value: the message of an input id without a point.
NOT_FOUND = "point not found"
BAD_VALUE = "match values must be strings, integers or booleans"


def _listed(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _checked(requests: DataFrame) -> DataFrame:
    """The requests with their inputs as lists, conditions as texts, and the first error of their form."""
    lookup = F.when(F.col("lookup_id").isNotNull(), F.array("lookup_id")).otherwise(F.array().cast("array<string>"))
    conditions = F.coalesce(F.col("must"), F.array().cast("array<struct<key string, value string>>"))
    tokens = F.transform(conditions, lambda c: condition_token(c["key"], F.try_parse_json(c["value"])))
    narrow = requests.select(
        "query_id",
        F.coalesce("vector_name", F.lit("")).alias("vector_name"),
        F.col("vector").cast("array<double>").alias("vector"),
        F.concat(lookup, _listed("positives")).alias("positives"),
        _listed("negatives").alias("negatives"),
        F.coalesce("limit", F.lit(0)).cast("long").alias("limit"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
        F.col("score_threshold").cast("double").alias("score_threshold"),
        F.transform(conditions, lambda c: c["key"]).alias("keys"),
        tokens.alias("must"),
        F.coalesce("with_payload", F.lit(False)).alias("with_payload"),
        F.coalesce("with_vector", F.lit(False)).alias("with_vector"),
    )
    counted = narrow.withColumns({"has_vector": F.coalesce(F.size("vector") > 0, F.lit(False)), "n_pos": F.size("positives"), "n_neg": F.size("negatives")})
    bad = F.when(F.exists("must", lambda t: t.isNull()), BAD_VALUE)
    return validate_requests(counted).withColumn("error", F.coalesce("error", bad))


def _found(points: DataFrame, asked: DataFrame, metric: str, broadcast_bytes: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows found for good requests of one vector name, and those whose ids or lengths are wrong, with the error."""
    first = points.filter("vector IS NOT NULL").select(F.size("vector")).first()
    dim = first[0] if first else 0
    wrong = F.when(F.col("has_vector") & (F.size("vector") != dim), F.format_string("wrong vector length: expected %d, got %d", F.lit(dim), F.size("vector"))) if dim else F.lit(None).cast("string")
    asked = asked.withColumn("error", wrong)
    sized = asked.filter("error IS NULL")

    def signed(column: str, sign: str) -> Column:
        return F.transform(column, lambda i: F.struct(F.lit(sign).alias("sign"), i.alias("id")))

    inputs = sized.filter("NOT has_vector").select(F.col("query_id").alias("request_id"), F.explode(F.concat(signed("positives", "pos"), signed("negatives", "neg"))).alias("i"))
    inputs = stored(inputs.select("request_id", "i.sign", "i.id"))
    targets = stored(recommend_targets(points, inputs, metric))
    lost = targets.filter("n_missing > 0").select("query_id", F.lit(NOT_FOUND).alias("error"))

    # Without stored vectors there is nothing to find, whatever a vector's length.
    asking = sized.filter("has_vector") if dim else sized.filter("false")
    queries = asking.select("query_id", "vector").unionByName(targets.filter("n_missing = 0").select("query_id", "vector"))
    plain = sized.select("query_id", "limit", "offset", "score_threshold", "must", "keys", "with_payload", "with_vector")
    pages = stored(queries.join(plain, "query_id").filter("limit > 0").withColumn("k", F.col("offset") + F.col("limit")))
    keys = sorted(r[0] for r in pages.select(F.explode("keys")).distinct().collect())
    searched = points.withColumn("tokens", payload_tokens(F.col("payload"), keys))
    asks = pages.select("query_id", "vector", "k", *(["must"] if keys else []))
    partial = _top_partial(searched, asks, None, metric, inputs.select(F.col("request_id").alias("query_id"), "id"), broadcast_bytes, block_bytes, dim)
    joined = rank_per_query(partial, None, metric).join(pages.drop("vector", "must", "keys"), "query_id")
    passes = F.col("score_threshold").isNull() | passes_threshold(F.col("score"), F.col("score_threshold"), metric)
    rows = joined.filter((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("k")) & passes)
    flags = pages.agg(*[F.coalesce(F.max(c), F.lit(False)) for c in ("with_payload", "with_vector")]).first()
    wanted = [c for c, flag in (("payload", flags[0]), ("vector", flags[1])) if flag]
    rows = rows.join(points.select("id", *wanted), "id", "left") if wanted else rows
    values = {
        "payload": F.when(F.col("with_payload"), F.col("payload")) if flags[0] else F.lit(None),
        "vector": F.when(F.col("with_vector"), F.col("vector")) if flags[1] else F.lit(None),
    }
    shown = [values[c].cast(points.schema[c].dataType).alias(c) for c in ("payload", "vector")]
    return rows.select("query_id", "id", "score", "rank", *shown), asked.filter("error IS NOT NULL").select("query_id", "error").unionByName(lost)


def query_points(points: DataFrame, requests: DataFrame, metric: str = "Cosine", broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, id, score, rank, payload, vector, error``: the answers of a table of whole requests.

    ``points``: ``id, vector_name, vector, payload`` (JSON text). ``requests``: unique ``query_id`` and, all
    nullable, ``vector``, ``lookup_id``, ``positives``, ``negatives`` (ids), ``vector_name``, ``limit``,
    ``offset``, ``score_threshold``, ``must`` (array of ``key, value``; the value as JSON), ``with_payload``, ``with_vector``.

    A request is a search for its vector or a recommendation from stored ids (a lookup id is the first
    positive; input ids are left out of the answer). Only points that meet all its conditions are ranked. A missing limit
    gives no rows, as in the service. Payload and vector come for the requests that ask for them.

    Filters cost no pass of their own: the payload values at the keys that requests name become a list of
    texts for each point, and an index of the distinct conditions masks the pairs while
    blocks are scored, so any number of filters is one read of the points. Distinct keys and vector names are read by
    the driver; they are like column names, few. Requests go to the tasks in bounded passes, as in ``knn_join``.

    A faulty request gives one row with ``error`` and nothing else: both forms or none, negatives alone, a condition on
    another type than string, integer or boolean, a vector of another length than the stored ones, an id without a point.
    """
    checked = stored(_checked(requests))
    good = checked.filter("error IS NULL")
    answers, errors = [], [checked.filter("error IS NOT NULL").select("query_id", "error")]
    for name in sorted(r[0] for r in good.select("vector_name").distinct().collect()):
        own = points.filter(F.coalesce("vector_name", F.lit("")) == name)
        rows, wrong = _found(own, good.filter(F.col("vector_name") == name).drop("error"), metric, broadcast_bytes, block_bytes)
        answers.append(rows.withColumn("error", F.lit(None).cast("string")))
        errors.append(wrong)
    faulty = reduce(DataFrame.unionByName, errors)
    if not answers:
        nothing = [F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("rank")]
        return faulty.select("query_id", *nothing, *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ("payload", "vector")], "error")
    return reduce(DataFrame.unionByName, answers).unionByName(faulty, allowMissingColumns=True)
