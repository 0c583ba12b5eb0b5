"""The registered queries of this folder, each next to the SQL that must return the same rows.

Every query applies its operator to its whole table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, flac, hard_negatives, language_id, license_scan, mixing, near_dedup, segmentation, sharding, spelling, token_counts, topk, toxicity, unigram
from .common import crc32_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def _crc_nibbles() -> str:
    table = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 * (value & 1))
        table.append(value)
    return f"{table}::BIGINT[]"


def crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, half a byte at a time, low half first."""
    return rf"""xor(4294967295, list_reduce(
  list_transform(regexp_extract_all(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), '.'), lambda p: ('0x' || p)::BIGINT),
  lambda c, x: xor(c >> 4, ({_crc_nibbles()})[(xor(c, x) & 15) + 1]), 4294967295::BIGINT))"""


CRC_SQL = crc_sql("coalesce(text, '')")


@query(
    "op3_shards",
    f"""
WITH d AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {CRC_SQL} AS text_crc32,
                  md5(concat('{sharding.SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', {CRC_SQL})) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, text_crc32, size) AS rank, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(rank * 2 - 1 AS DOUBLE) / CAST(n * 2 AS DOUBLE), key, source NULLS FIRST, text_crc32, size) - 1 AS position,
             count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position * 24 // total AS INTEGER) AS shard,
       CAST(position - (position * 24 // total * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
""",
)
def op3_shards(spark, sf_dir):
    rows = sharding.shard(_documents(spark, sf_dir), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op6_mix",
    f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD_SQL})) AS BIGINT) AS size,
                  md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', {CRC_SQL})) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, most / weight AS level, (SELECT sum(source_size) FROM w)::DOUBLE AS budget FROM w),
c AS (SELECT *, row_number() OVER (ORDER BY level, place) AS step, sum(most) OVER (ORDER BY level, place) AS filled,
             coalesce(sum(weight) OVER (ORDER BY level, place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM l),
v AS (SELECT arg_min((budget - (filled - most)) / (rest + weight), step) FILTER (filled + level * rest >= budget) AS v FROM c),
t AS (SELECT source, place, weight, source_size, budget, least(weight * v, most) AS target FROM c, v),
f AS (SELECT d.*, t.place, t.weight, t.source_size, t.budget, t.target,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS words
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, sum(size) OVER (ORDER BY CAST(pass * source_size + words AS DOUBLE) / weight, place, key ROWS UNBOUNDED PRECEDING) AS upto
      FROM (SELECT f.*, unnest([0, 1, 2]) AS pass FROM f))
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM q GROUP BY doc_id, size, source_size, target
""",
)
def op6_mix(spark, sf_dir):
    return mixing.mix_sizes(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op8_near_dedup",
    f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD_SQL}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles FROM d),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
g AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, g.v FROM r JOIN g ON g.u = r.other)
SELECT n.doc_id, n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n_shingles
""",
)
def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_documents(spark, sf_dir), width=3, similarity=85)


@query("op9_language")
def op9_language(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    held_out = crc32_of(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    found = language_id.identify(docs.select("doc_id", "text", "lang"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.distance", "language.rejected")


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.classify(_documents(spark, sf_dir).select("doc_id", "text"), labels)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query("op10_flac")
def op10_flac(spark, sf_dir):
    return flac.digests(flac.encode_documents(_documents(spark, sf_dir))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"
    )


def vocabulary(path: str | None = None):
    """The vocabulary at ``path``; by default the public model that is installed beside Python."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return unigram.load(str(path))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_documents(spark, sf_dir), vocabulary())


@query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    words = vocabulary()
    found = segmentation.segmented(_documents(spark, sf_dir).select("doc_id", "text"), words, 4)
    decoded = segmentation.decode(spark, words, F.col("encoded.ids"))
    return found.select(
        "doc_id",
        F.size("encoded.ids").cast("long").alias("n_pieces"),
        F.col("encoded.score").alias("score"),
        F.crc32(F.encode(F.array_join("encoded.ids", " "), "utf-8")).alias("ids_crc32"),
        F.col("encoded.others.score").alias("other_scores"),
        F.col("encoded.others.n_pieces").alias("other_pieces"),
        (decoded == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query("op1_licenses")
def op1_licenses(spark, sf_dir):
    found = license_scan.scan(_documents(spark, sf_dir))
    return found.select(
        "doc_id", "license", "start", "length", "reduction", "exact", F.size("differences").alias("n_differences"), crc32_of(F.col("block")).alias("block_crc32")
    )


@query(
    "op2_top_k",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
)
def op2_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


@query(
    "op11_spelling_variants",
    f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{spelling.RUN}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT run, n, {crc_sql("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL)),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1),
v AS (SELECT * FROM w WHERE length(word) >= 6 AND n >= 5),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word
      UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
s AS (SELECT p.word, p.near, v.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS place, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN v ON v.word = p.near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
      FROM v LEFT JOIN s ON s.word = v.word AND place = 1),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f g ON g.word = t.root WHERE g.form IS NULL
""",
)
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(_documents(spark, sf_dir))


@query(
    "op12_hard_negatives",
    """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
)
def op12_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label)


@query(
    "op13_decontamination",
    r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS g
      FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
y AS (SELECT k, m, s, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM x) WHERE len(w) >= m)),
h AS (SELECT DISTINCT y.k, y.s, y.m, x.item FROM y JOIN x ON x.m = y.m AND x.g = y.g),
c AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(s, s + m)) AS place FROM h) GROUP BY k),
o AS (SELECT k, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS ids FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN o USING (k)
""",
)
def op13_decontamination(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.contamination(_documents(spark, sf_dir), items).drop("items")
