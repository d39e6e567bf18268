import zlib
from collections import Counter

from pyspark.sql import functions as F

from plotweave.llm import sharding
from tests.llm.conftest import prose, table


def test_rows_law(spark, tmp_path):
    docs = table(spark, [(i, prose(i, i % 50)) for i in range(1000)])
    out = sharding.shuffle_shards(docs.select("doc_id", "text"), 16, bucket_rows=50)
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(range(1000)) and len(rows) == 1000
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert sum(abs(a - b) > 20 for a, b in zip(order, order[1:])) > 900
    again = sharding.shuffle_shards(docs.select("doc_id", "text"), 16, bucket_rows=50).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000 and {r.n for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {250}


def test_sizes(spark):
    t = F.col("text")
    rows = table(spark, [(1, "é"), (2, None), (3, "")]).select("doc_id", sharding.text_bytes(t).alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("c")).collect()
    assert [(r.size, r.c) for r in rows] == [(3, zlib.crc32("é".encode())), (1, 0), (1, 0)]


def test_odd(odd, empty, odd_rows):
    out = sharding.shuffle_shards(odd, 3)
    assert out.count() == len(odd_rows) and sorted(out.columns) == sorted(odd.columns)
    assert sorted((r.shard, r.slot) for r in out.collect()) == sorted((i % 3, i // 3) for i in range(len(odd_rows)))
    assert sharding.shuffle_shards(empty, 3).count() == 0


def test_query_writes_whole_documents(spark, tmp_path, monkeypatch):
    rows = [(i, prose(i, 20 + i % 50)) for i in range(200)] + [(None, None), (7, "")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    paths = []
    put = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda records, path, *a: (paths.append(path), put(records, path, *a)))
    out = sharding.query(spark, str(tmp_path)).collect()
    files = spark.read.parquet(paths[0])
    assert sorted((r.doc_id or -1, r.text or "") for r in files.collect()) == sorted((i or -1, t or "") for i, t in rows)
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in files.collect()}
    assert {(r.shard, r.slot) for r in out} == {(k % 16, k // 16) for k in range(202)}
    assert all(r.text_crc32 == zlib.crc32((rows[r.doc_id][1]).encode()) for r in out if r.doc_id and r.doc_id != 7)


def test_buckets_hold_bytes_and_equal_rows_spread(spark):
    docs = table(spark, [(i, prose(i, 400)) for i in range(100)] + [(500, "same text")] * 400)
    gathered = sharding.shuffle_shards(docs, 4, bucket_bytes=4096)
    ranks = {(r.doc_id, r.slot * 4 + r.shard) for r in gathered.collect()}
    assert {k for _, k in ranks} == set(range(500)) and sum(i == 500 for i, _ in ranks) == 400
    places = sorted(k for i, k in ranks if i == 500)
    assert max(b - a for a, b in zip(places, places[1:])) < 40 and places[-1] - places[0] > 450
