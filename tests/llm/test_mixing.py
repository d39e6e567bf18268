import math

import pytest
from pyspark.sql import functions as F

from plotweave.llm import mixing
from tests.llm.conftest import prose, table


def test_rates_and_counts(spark):
    docs = table(spark, [(i, prose(i, 20)) for i in range(900)], "big").unionByName(table(spark, [(2000 + i, prose(i, 20)) for i in range(300)], "small"))
    r = {x.source: x for x in mixing.rates(docs, {"big": 1.0, "small": 1.0}).collect()}
    total = r["big"].n_bytes + r["small"].n_bytes
    assert math.isclose(r["big"].rate, total / 2 / r["big"].n_bytes)
    for x in r.values():
        c = 0.0
        for k, v in enumerate(x.cdf):
            c += math.exp(-x.rate) * x.rate**k / math.factorial(k)
            assert abs(v - c) < 1e-12
    mixed = mixing.poisson_mix(docs, {"big": 1.0, "small": 1.0})
    n = {x.source: x.n for x in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["big"] - 900 * r["big"].rate) < 120 and abs(n["small"] - 300 * r["small"].rate) < 120
    per = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.max("copy").alias("m")).collect()
    assert all(x.n == x.c == x.m for x in per)
    assert mixing.poisson_mix(docs, {"big": 1.0}).where("source = 'small'").count() == 0


def test_salted_join_is_the_same(spark, monkeypatch):
    docs = table(spark, [(i, prose(i, 20)) for i in range(200)])
    want = sorted((r.doc_id, r.copy) for r in mixing.poisson_mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.copy) for r in mixing.poisson_mix(docs).collect()) == want


def test_large_rate(spark):
    docs = table(spark, [(1, "x")], "tiny").unionByName(table(spark, [(2, prose(1, 4000))], "big"))
    n = mixing.poisson_mix(docs, {"tiny": 1.0, "big": 0.0}).count()
    rate = next(r.rate for r in mixing.rates(docs, {"tiny": 1.0}).collect() if r.source == "tiny")
    assert rate > 1000 and abs(n - rate) < 6 * math.sqrt(rate)


def test_odd(spark, odd, empty, odd_rows):
    nulls = odd.withColumn("source", F.when(F.col("doc_id") > 4, F.col("source")))
    mixed = mixing.poisson_mix(nulls)
    assert set(odd.columns) <= set(mixed.columns)
    assert mixed.count() > 0 and mixing.poisson_mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.rates(odd, {"s0": -1.0})


def test_high_rates_and_clashing_names(spark):
    docs = table(spark, [(1, "rare"), (2, "rare")], "few").unionByName(table(spark, [(9, "x" * 2_000_000)], "much"))
    docs = docs.withColumns({c: F.lit(c) for c in ("u", "s", "k", "row", "own", "name", "first", "cdf", "salt", "__u", "__cdf")})
    found = {r.source: r for r in mixing.rates(docs, {"few": 0.5, "much": 0.5}).collect()}
    rate = found["few"].rate
    assert rate > 90_000 and 15 < len(found["few"].cdf) / rate**0.5 < 30
    mixed = mixing.poisson_mix(docs, {"few": 0.5, "much": 0.5})
    assert set(docs.columns) < set(mixed.columns)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(abs(counts[i] - rate) < 6 * rate**0.5 for i in (1, 2))
    assert mixed.where("name <> 'name' or row <> 'row' or copies < 1").count() == 0
