import hashlib

from pyspark.sql import functions as F

from plotweave.llm import minhash
from tests.llm.conftest import prose, table


def shingles(t):
    w = t.split()
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)}


def test_likeness(spark):
    base = prose(1, 400).split()
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: 400 - 20 * i] + prose(i + 50, 20 * i).split())) for i in range(1, 16)]
    fps = table(spark, rows).withColumn("f", minhash.fingerprint("text"))
    first = fps.where("doc_id = 0").select(F.col("f").alias("g"))
    got = {r.doc_id: r.s for r in fps.crossJoin(first).select("doc_id", minhash.likeness("f", "g").alias("s")).collect()}
    for i, t in rows:
        a, b = shingles(rows[0][1]), shingles(t)
        assert abs(got[i] - len(a & b) / len(a | b)) < 0.13
    assert got[0] == 1.0


def test_few_bins_filled(spark):
    """Short texts fill few bins: likeness must hold after densification."""
    got = []
    for s in range(40):
        w = prose(s, 13).split()
        pair = table(spark, [(1, " ".join(w[:12])), (2, " ".join(w[1:]))])
        got.append(pair)
    every = got[0].withColumn("g", F.lit(0))
    for k, p in enumerate(got[1:], 1):
        every = every.unionByName(p.withColumn("g", F.lit(k)))
    f = every.withColumn("f", minhash.fingerprint("text"))
    a, b = f.where("doc_id = 1").select("g", F.col("f").alias("fa")), f.where("doc_id = 2").select("g", F.col("f").alias("fb"))
    mean = a.join(b, "g").select(F.avg(minhash.likeness("fa", "fb")).alias("m")).first().m
    assert abs(mean - 7 / 9) < 0.06


def test_edited(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE_ROWS", 7)
    rows = [(i * 3, prose(i, 5 + i) + "é" * (i % 3)) for i in range(40)]
    table(spark, rows).write.mode("overwrite").parquet("/tmp/plotweave-test-op6/documents.parquet")
    got = {r.doc_id: r for r in minhash.query(spark, "/tmp/plotweave-test-op6").collect()}
    order = rows[::-1]
    assert len(got) == 40
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % 40][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.2
        assert len(got[i].fingerprint) == 256


def test_odd(odd, empty, odd_rows):
    rows = minhash.with_next(odd).collect()
    assert len(rows) == len(odd_rows) and all(r.next_text is not None and len(r.next_fp) == 16 for r in rows)
    assert len({tuple(r.fp) for r in rows if not r.text.strip()}) == 1
    assert minhash.with_next(empty).count() == 0
    one = minhash.with_next(odd.where("doc_id = 5")).first()
    assert one.text == one.next_text
