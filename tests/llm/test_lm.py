from collections import Counter

import numpy as np
import xxhash

from plotweave.llm import lm
from tests.llm.conftest import prose, table


def lexicon(words):
    counts = Counter(words)
    made = lm.Lexicon(sorted(counts, key=lambda w: (-counts[w], w)), np.array(sorted(counts.values(), reverse=True)), sorted(counts)[1:][: lm.BANDS - 1], np.zeros(lm.BANDS, np.int64))
    for w, n in counts.items():
        made.totals[made.band(w)] += n
    return made


def test_gradient_and_probabilities(monkeypatch):
    rng = np.random.default_rng(0)
    bands = rng.integers(0, lm.BANDS, lm.OUTSIDE + 1)
    theta = lm.initial().astype(np.float64)
    padded, places = lm.padded_batch([rng.integers(0, lm.OUTSIDE, 9).astype(np.uint16), rng.integers(0, lm.OUTSIDE, 5).astype(np.uint16)])
    g, again = np.zeros(lm.SIZE), np.zeros(lm.SIZE)
    lm.gradient(theta, padded, bands, g)
    loss = lambda t: -lm.log_probs(t, padded, bands).sum()
    for k in np.concatenate([rng.integers(lm.OUTSIDE * lm.DIM + lm.DIM, lm.SIZE, 30), padded[padded < lm.OUTSIDE].astype(np.int64) * lm.DIM + 3]):
        e = np.zeros(lm.SIZE)
        e[k] = 1e-4
        assert abs((loss(theta + e) - loss(theta - e)) / 2e-4 - g[k]) < 1e-3
    z = np.exp(lm._forward(lm.unpack(theta), padded)[3])
    every = sum(np.exp(lm.log_probs(theta, padded, np.full(lm.OUTSIDE + 1, k))) for k in range(lm.BANDS))
    assert np.allclose(every[padded != lm.OUTSIDE], 1) and z.shape == (len(padded) - 2 * lm.REACH, lm.BANDS)
    whole = lm.log_probs(theta, padded, bands)
    monkeypatch.setattr(lm, "PIECE", 4)
    lm.gradient(theta, padded, bands, again)
    assert np.allclose(lm.log_probs(theta, padded, bands), whole) and np.allclose(again, g)


def loop_scores(theta, lex, counts, texts):
    """Each text's log-probability by plain loops, a word at a time."""
    p, out = {k: v.astype(float) for k, v in lm.unpack(theta).items()}, []
    index = {w: i for i, w in enumerate(lex.words)}
    for text in texts:
        ws = (text or "").lower().split()
        ids = [index.get(w, lm.VOCABULARY + lex.band(w)) for w in ws]
        total = 0.0
        for i, w in enumerate(ws):
            c = np.zeros(lm.DIM)
            for k, o in enumerate(o for o in range(-lm.REACH, lm.REACH + 1) if o):
                c += p["emb"][ids[i + o] if 0 <= i + o < len(ids) else lm.OUTSIDE] * p["pos"][k]
            z = np.append(np.tanh(c @ p["w"] + p["b"]), 1) @ p["u"]
            total += z[lex.band(w)] - np.log(np.exp(z).sum()) + np.log(counts[w] / sum(n for v, n in counts.items() if lex.band(v) == lex.band(w)))
        out.append(total)
    return out


def test_scores_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 3)
    rows = [(i, prose(i % 23, 30 + i % 11) + f" only{i % 29}") for i in range(40)] + [(90, None)]
    docs = table(spark, rows)
    lex = lm.lexicon(lm.word_counts(docs))
    rare = set(lex.words[120:])  # as if the vocabulary ended there
    short = lm.Lexicon(lex.words[:120], lex.counts[:120], lex.starts, lex.totals)
    monkeypatch.setattr(lm, "lexicon", lambda counts: short)
    theta = lm.train(lm.code(docs, short), short)
    counts = Counter(w for _, t in rows for w in (t or "").lower().split())
    assert len(rare) > 20 and sum(short.totals) == sum(counts.values())
    got = {r.doc_id: r.log_prob for r in lm.pseudo_likelihood(docs).collect()}
    want = loop_scores(theta, short, counts, [t for _, t in rows])
    assert np.allclose([got[i] for i, _ in rows], want, rtol=1e-4)


def test_context_counts_and_partitions_do_not(spark):
    rng = np.random.default_rng(0)
    loop = "red fox runs over the green hill and a blue bird sings".split()
    rows = [(i, " ".join((loop * 6)[i % 11 :])) for i in range(300)]
    mixed = [(1000 + i, " ".join(rng.permutation(loop * 5))) for i in range(20)]
    docs = table(spark, rows + mixed)
    got = {r.doc_id: r for r in lm.pseudo_likelihood(docs).collect()}
    order, shuffled = np.mean([got[i].mean_log_prob for i, _ in rows]), np.mean([got[i].mean_log_prob for i, _ in mixed])
    assert order > -np.log(12) + 0.5 and order > shuffled + 0.3  # a model without context gives each of the 12 words 1 / 12
    assert got[3].n_words == len(rows[3][1].split()) and abs(got[3].log_prob / got[3].n_words - got[3].mean_log_prob) < 1e-9
    again = {r.doc_id: r.log_prob for r in lm.pseudo_likelihood(docs.repartition(13)).collect()}
    assert max(abs(again[i] - got[i].log_prob) / got[i].n_words for i in again) < 1e-3


def test_repeated_documents_score_higher(spark):
    rng = np.random.default_rng(1)
    fresh = [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(fresh)] + [(100 + i, t) for i, t in enumerate(fresh[:10])] + [(200 + i, prose(i, 80)) for i in range(60)]
    got = {r.doc_id: r.mean_log_prob for r in lm.pseudo_likelihood(table(spark, rows)).collect()}
    twice, once = [got[i] for i in range(10)], [got[i] for i in range(10, 30)]
    assert sum(t > np.quantile(once, 0.9) for t in twice) >= 9 and all(abs(got[i] - got[100 + i]) < 1e-5 for i in range(10))


def test_lexicon_counts_all_documents(spark):
    docs = table(spark, [(1, "B a a"), (2, "b B c\td"), (3, None)])
    lex = lm.lexicon(lm.word_counts(docs))
    assert lex.words == ["b", "a", "c", "d"] and lex.counts.tolist() == [3, 2, 1, 1] and lex.totals.sum() == 7
    ids, rare = lm.Coder(lm.Lexicon(["b", "a"], np.array([3, 2]), ["b", "c"], lex.totals)).code("A b zz ZZ ay")
    assert ids.tolist() == [1, 0, lm.VOCABULARY + 2, lm.VOCABULARY + 2, lm.VOCABULARY]
    assert rare.view(np.uint64).tolist() == [xxhash.xxh64_intdigest(w.encode(), 42) for w in ("zz", "zz", "ay")]


def test_odd(odd, empty, odd_rows):
    rows = lm.pseudo_likelihood(odd).collect()
    assert len(rows) == len(odd_rows)
    none = [r for r in rows if r.n_words == 0]
    assert len(none) == 4 and all(r.log_prob == 0 and r.mean_log_prob is None for r in none)
    assert max(r.n_words for r in rows) == 30_000
    same = [r.log_prob for r in rows if r.doc_id in (5, 6)]
    assert len(same) == 3 and max(same) - min(same) < 1e-3
    assert lm.pseudo_likelihood(empty).count() == 0


def test_every_position_is_trained_on_once(spark, monkeypatch):
    docs = table(spark, [(i, prose(i, i % 40)) for i in range(200)])
    lex = lm.lexicon(lm.word_counts(docs))
    seen = []
    summed = lm._summed
    monkeypatch.setattr(lm, "_summed", lambda parts: (seen.append(summed(parts)), seen[-1])[1])
    lm.train(lm.code(docs, lex), lex)
    assert sum(n for _, n in seen) == sum(i % 40 for i in range(200)) and len(seen) == lm.STEPS
