import numpy as np

import __spark_entry__
import corpus_pipeline
from plotweave.llm import mixing
from tests.llm.conftest import prose, table


def test_stages_against_their_operators(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(160):
        words = prose(i, 70).split()
        if i % 5 == 0:
            words[3] = words[int(rng.integers(70))] = "grobnik"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    rows[7] = (7, rows[7][1] + " " + prose(900, 30))
    rows += [(400, None), (401, "")]
    d = str(tmp_path)
    table(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "near duplicates" in names
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        counts.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not any(i % 5 == 0 and i < 160 for i in counts[0]) and len(counts[0]) >= 128 + 16
    assert not any(300 <= i < 320 and i != 307 for i in counts[1]) and len({400, 401} & counts[1]) == 1
    assert 7 in counts[1] and 7 not in counts[2] and counts[2] == counts[1] - {7}
    want = mixing.poisson_mix(spark.read.parquet(f"{d}/stage2")).count()
    assert docs.count() == want
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert last.count() == want
    assert corpus_pipeline.run(spark, d).count() == want
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
