import tracemalloc
import zlib

import numpy as np

from plotweave.llm import quality, toxicity, training
from tests.llm.conftest import prose, table


def auc(scores, y):
    order = np.argsort(np.argsort(scores))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def junk(i):
    t = prose(i, 60)
    return [t.upper().replace(" ", "!! "), " ".join(w for w in t.split()[:8] for _ in range(9)), t.replace(" ", " | "), t.replace(" ", "*** ")][i % 4]


def test_quality_held_out():
    texts = [junk(i) if i % 3 == 0 else prose(i, 60) for i in range(600)]
    y = np.array([int(i % 3 != 0) for i in range(600)])
    model = quality.fit(texts[:400], y[:400])
    s = model.scores(texts[400:])
    assert auc(s, y[400:]) > 0.99 and ((s >= 0.5) == y[400:]).mean() > 0.97
    alone = np.concatenate([model.scores([t]) for t in texts[400:420]])
    assert np.allclose(alone, s[:20])
    assert 0 <= model.scores([""])[0] <= 1


def test_quality_features_of_each_text_are_its_own():
    a, b = "abc def def", "xyz"
    both = [set(), set()]
    for doc, row in quality.features([a, b]):
        for d, r in zip(doc, row):
            both[d].add(int(r))
    for k, t in enumerate((a, b)):
        assert both[k] == {int(r) for _, row in quality.features([t]) for r in row}


def bags(n, seed=0):
    rng = np.random.default_rng(seed)
    bad = ["grobnik", "vexatl", "snurpel"]
    out, y = [], []
    for i in range(n):
        words = prose(i + seed * 10_000, 50).split()
        if i % 4 == 0:
            words[int(rng.integers(50))] = bad[i // 4 % 3] + ("" if i % 8 else "ek")
        out.append(" ".join(words))
        y.append(int(i % 4 == 0))
    return out, np.array(y)


def test_toxicity_held_out_and_spoiled():
    texts, y = bags(600)
    model = toxicity.fit([toxicity.words_of(t) for t in texts], y)
    new, z = bags(300, 1)
    score = lambda ts: model.scores([toxicity.words_of(t) for t in ts], {})
    s = score(new)
    assert auc(s, z) > 0.99 and ((s >= 0.5) == z).mean() > 0.98
    dotted = [t.replace("grobnik", "gr.ob-nik").replace("vexatl", "v e x a t l").replace("snurpel", "SNUR*PEL") for t in new]
    assert (score(dotted)[z == 1] >= 0.5).mean() > 0.9
    put_in = [t.replace("grobnik", "groxbnik").replace("vexatl", "vexqatl").replace("snurpel", "snurbpel") for t in new]
    assert (score(put_in)[z == 1] >= 0.5).mean() > 0.6
    assert score([""])[0] == score([" \n"])[0] < 0.5


def test_machine_is_the_kernel_machine():
    """Scores by subsequence weights equal those through kernel values with landmarks."""
    words, marks = ["idiot", "idxiot", "house", "a", "ab"], ["idiot", "hose", "mouse"]
    k = toxicity.kernel(words, marks)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert abs(k[i, j] - brute_kernel(w, m)) < 1e-6
    alpha = np.array([0.7, -0.2, 0.4])
    mw, mc, mv = toxicity.subsequences(marks)
    norm = np.sqrt(np.bincount(mw, mv**2, len(marks)))
    model = toxicity.Model(np.bincount(mc, mv * (alpha / norm)[mw], toxicity._CODES), 0.1, 1.0, (0.0,))
    assert np.allclose(model.margins(words), k @ alpha + 0.1, atol=1e-6)


def brute_kernel(a, b):
    from itertools import combinations

    def counts(w):
        w, out = f"^{w}$", {}
        for places in combinations(range(len(w)), toxicity.LENGTH):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN:
                u = tuple(w[p] for p in places)
                out[u] = out.get(u, 0) + toxicity.DECAY ** (span - toxicity.LENGTH)
        return out

    ca, cb = counts(a), counts(b)
    dot = sum(v * cb.get(u, 0) for u, v in ca.items())
    na, nb = (sum(v * v for v in c.values()) ** 0.5 for c in (ca, cb))
    return dot / (na * nb) if na and nb else 0.0


def test_long_words_are_read_whole():
    texts, y = bags(400)
    model = toxicity.fit([toxicity.words_of(t) for t in texts], y)
    assert model.margins(["kalomi" * 40 + "grobnik" + "kalomi" * 40])[0] > model.margins(["kalomi" * 80])[0] + 0.5


def test_one_class():
    for fit in (lambda: quality.fit(["a b", "c"], np.array([1, 1])), lambda: quality.fit([], np.array([]))):
        assert 0 < fit().scores(["x"])[0] < 1
    for ys in ([0, 0], []):
        assert 0 < toxicity.fit([{"a"}, {"b"}][: len(ys)], np.array(ys)).scores([{"x"}], {})[0] < 1


def test_sample_and_folds(spark):
    docs = table(spark, [(i, prose(i, 5)) for i in range(200)] + [(500, prose(1, 9))])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(3, 1, 0), (None, 1, 0), (500, None, 0)], "doc_id long, quality int, toxic int")
    rows = training.sample(docs, labels, "quality", 3, 1, 30).collect()
    assert len(rows) == 60 and len({r.doc_id for r in rows}) == 60
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.y == r.doc_id % 2 for r in rows)
    held = {r.doc_id: r.h for r in docs.select("doc_id", training.held_out(docs.doc_id, 3, 1).alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in held)


def test_odd(odd, empty, odd_rows):
    texts, y = bags(100)
    q = quality.fit(texts, y)
    t = toxicity.fit([toxicity.words_of(x) for x in texts], y)
    for module, model in ((quality, q), (toxicity, t)):
        rows = module.score(odd, model).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
        assert module.score(empty, model).count() == 0
    kept = toxicity.reject(odd, t)
    assert kept.columns == odd.columns and toxicity.reject(empty, t).count() == 0


def test_fit_in_task(spark, empty):
    texts, y = bags(80)
    docs = table(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    kept = [i for i in range(80) if not training.held_out_id(i, 5, 0)]
    here = toxicity.fit([toxicity.words_of(texts[i]) for i in kept], y[kept])
    assert np.allclose(model.weight, here.weight, atol=1e-6) and np.allclose(model.edges, here.edges)
    for module in (toxicity, quality):
        assert module.score(docs, module.train(empty, labels)).count() == 80


def test_kernel_takes_little_memory():
    words = [prose(i, 9).replace(" ", "")[:20] for i in range(2500)]
    tracemalloc.start()
    out = toxicity.kernel(words, words[:160])
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert np.allclose(out[:160].diagonal(), 1) and most < 150 << 20
