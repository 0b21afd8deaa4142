import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparkveil.llm import sharding

DOCS = "doc_id long, text string, size string, shard string, _at long"


def test_permutation_both_ways(spark):
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        places = [sharding.permute_int(k, n) for k in range(n)]
        assert sorted(places) == list(range(n))
        got = spark.range(n).select("id", sharding.permute(F.col("id"), n).alias("p")).collect()
        assert sorted((r["id"], r["p"]) for r in got) == list(enumerate(places))
        for k, p in list(enumerate(places))[:50]:
            assert sharding.row_at(p % 16, p // 16, 16, n) == k


def test_places_of_large_numbers(spark):
    n = 3 * 10**11
    some = [0, 1, n // 2, n - 1]
    got = spark.createDataFrame([(k,) for k in some], "id long").select("id", sharding.permute(F.col("id"), n).alias("p")).collect()
    assert {r["id"]: r["p"] for r in got} == {k: sharding.permute_int(k, n) for k in some}


def test_shards(spark):
    rows = [(k, "ä" * (k % 7), "x", None, 1) for k in range(500)] + [(None, None, None, None, None)] * 300 + [(4, "same", None, None, 2)] * 200
    got = sharding.assign(spark.createDataFrame(rows, DOCS), 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sorted(r["row_number"] for r in got) == list(range(len(rows)))
    assert sharding.assign(spark.createDataFrame([], DOCS), 16).count() == 0


def test_the_same_again_whatever_the_partitions(spark):
    rows = [(k, f"text {k}", None, None, None) for k in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(df.repartition(3), 16).collect()}
    two = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(df.repartition(7, "text"), 16).collect()}
    assert one == two
    assert sum(one[k][0] == one[k + 1][0] for k in range(399)) < 60, "neighbours are spread"
