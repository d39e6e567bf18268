from pathlib import Path

from plotweave import storage


def resident_mb(pid: int) -> float:
    return int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * 4096 / 1e6


def test_driver_returns_what_it_freed(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, pid = field.get(None), jvm.java.lang.ProcessHandle.current().pid()
    storage.materialise(spark.range(1), "warm")
    blocks = [unsafe.allocateMemory(1 << 16) for _ in range(6000)]
    for b in blocks:
        unsafe.setMemory(b, 1 << 16, 1)
    for b in blocks[:-1]:  # the last stays, so what lies below it is kept by the allocator
        unsafe.freeMemory(b)
    before = resident_mb(pid)
    monkeypatch.setitem(storage._DUE, "at", min(storage._DUE["at"], 0.0))
    out = storage.materialise(spark.range(3), "freed")
    assert out.count() == 3 and resident_mb(pid) < before - 250
    unsafe.freeMemory(blocks[-1])


def test_drawings_are_dealt_before_they_grow(spark, tmp_path):
    from plotweave.plans import adapters, queries

    rows = [(k, k % 50 + 1) for k in range(2500)] + [(7, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    ink = adapters.drawings(spark, str(tmp_path))
    assert ink.rdd.getNumPartitions() == 3
    want = set()
    for key, size in rows:
        for t in range(1, 31):
            want |= {(key, size % 9 + 3, t), (key, size % 7 + 19, t), (key, t, key % 8 + 4), (key, t, key % 9 + 18)}
    got = [(r.image_id, r.y, r.x) for r in ink.collect()]
    assert len(got) == len(want) and set(got) == want
    graph = queries.stroke_graph(spark, str(tmp_path))
    assert graph.select("image_id").distinct().count() == 2500
