import hashlib
import zlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cairnframe.llm import mixing, sharding
from cairnframe.llm.common import running, offsets_of

from .cases import edge_documents, no_documents


def _docs(spark, n=700, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_shards_are_equal_and_alike(spark):
    rows, docs = _docs(spark)
    got = sharding.shard(docs, 8, bucket_rows=20).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    counts = [len(v) for v in by_shard.values()]
    assert len(by_shard) == 8 and max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by_shard.values())
    of_source = Counter(r[2] for r in rows)
    for v in by_shard.values():
        for source, n in Counter(r["source"] for r in v).items():
            assert abs(n - of_source[source] / 8) <= 2


def test_shards_do_not_depend_on_buckets_or_order(spark):
    _, docs = _docs(spark, 200)
    one = sorted(map(tuple, sharding.shard(docs, 5, bucket_rows=7).collect()))
    assert one == sorted(map(tuple, sharding.shard(docs.repartition(5), 5, bucket_rows=1000).collect()))


def test_shards_of_edge_rows(spark):
    docs = edge_documents(spark)
    got = sharding.shard(docs, 24).collect()
    assert len(got) == docs.count() and {r["slot"] for r in got} == {0}
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (3, 4)} == {(8, 0)}
    assert sharding.shard(no_documents(spark), 3).count() == 0


def test_running_sum_is_a_prefix_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 5), i, rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, b int, o int, v int")
    got = {r["o"]: r["s"] for r in running(df, offsets_of(df, ["g"], "b", "v", "s"), ["g"], "b", [df["o"]], "v", "s").collect()}
    for g in "ab":
        total = 0
        for _, _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            total += v
            assert got[o] == total


def _plain_mix(rows, weights=(1, 2, 3), repeats=3):
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, _, z in rows if z == s) for s in sources}
    budget, low, high = sum(total.values()), 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(weight[s] * mid, repeats * total[s]) for s in sources) < budget else (low, mid)
    target = {s: min(weight[s] * high, repeats * total[s]) for s in sources}
    queue = []
    for k, s in enumerate(sources):
        own = sorted((hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{zlib.crc32((t or '').encode())}".encode()).hexdigest(), i) for i, t, z in rows if z == s)
        for turn in range(repeats):
            words = 0
            for _, i in own:
                words += size[i]
                queue.append(((turn * total[s] + words) / weight[s], k, i))
    taken, spent = Counter(), 0
    for _, _, i in sorted(queue):
        spent += size[i]
        if spent > budget:
            break
        taken[i] += 1
    return size, target, taken


def test_mix_against_a_plain_queue(spark):
    rows, docs = _docs(spark, 300)
    size, target, taken = _plain_mix(rows)
    source = {i: s for i, _, s in rows}
    for r in mixing.mix_sizes(docs, bucket_rows=11).collect():
        assert r["size"] == size[r["doc_id"]] and abs(r["target"] - target[source[r["doc_id"]]]) < 1e-3
        if r["size"]:
            assert r["copies"] == taken[r["doc_id"]]
        assert r["taken"] == r["size"] * r["copies"]


def test_mix_takes_what_its_sizes_say_under_any_names(spark):
    rows, docs = _docs(spark, 300)
    named = docs.withColumns({c: F.lit(7) for c in ("_size", "_key", "_row", "_last0", "_stratum", "copies")})
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sizes(docs).collect()}
    got = mixing.mix(named)
    assert got.columns == named.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_rows_without_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, f"word {i}", "a") for i in range(200)], "doc_id long, text string, source string")
    assert mixing._sized(docs, "s").select("_key").distinct().count() == 200
    assert mixing.mix(docs).count() == 200


def test_mix_comes_near_its_targets(spark):
    _, docs = _docs(spark, 600)
    got = mixing.mix_sizes(docs).collect()
    sums, targets = Counter(), {}
    for r in got:
        sums[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert all(abs(sums[s] - t) <= 41 for s, t in targets.items())
    assert sum(sums.values()) <= sum(r["size"] for r in got)


def test_mix_keeps_columns_and_repeats_rows(spark):
    rows, docs = _docs(spark, 120)
    again = Counter(tuple(r) for r in mixing.mix(docs.selectExpr("*", "doc_id AS place", "'x' AS weight")).collect())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sizes(docs).collect()}
    assert again == Counter({(i, t, s, i, "x"): copies[i] for i, t, s in rows if copies[i]})


def test_mix_of_edge_rows(spark):
    docs = edge_documents(spark)
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == docs.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in _sum(got).items() if v})
    assert mixing.mix(no_documents(spark)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in mixing.mix(empty).collect()) == [1, 2]


def _sum(got):
    out = Counter()
    for r in got:
        out[r["doc_id"]] += r["copies"]
    return out


def test_rows_without_ids_fall_into_many_buckets(spark):
    """Half of the rows have no id; the shuffle order spreads them by their texts, whatever the buckets."""
    docs = spark.createDataFrame([(i if i % 2 else None, f"text {i}", "a") for i in range(400)], "doc_id long, text string, source string")
    one = sorted(map(tuple, sharding.shard(docs, 4, bucket_rows=10).drop("doc_id").collect()))
    assert one == sorted(map(tuple, sharding.shard(docs.repartition(3), 4, bucket_rows=1000).drop("doc_id").collect()))
    nulls = [r["slot"] for r in sharding.shard(docs, 1, bucket_rows=10).filter("doc_id IS NULL").collect()]
    assert len(nulls) == 200 and min(nulls) < 20 and max(nulls) > 380
