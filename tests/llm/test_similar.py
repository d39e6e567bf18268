import corpus_pipeline
from plotweave.llm import simhash, similar
from tests.llm.conftest import prose, table


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def edited(text, edits, salt):
    words = text.split()
    for k in range(edits):
        words[(k * len(words)) // edits + 3] = f"x{salt}y{k}"
    return " ".join(words)


def test_edited_copies_go(spark):
    rows = []
    for i in range(40):
        base = prose(i, 200)
        near, far = edited(base, 4, i), edited(base, 12, i)
        assert jaccard(base, near) >= 0.8 > 0.6 > jaccard(base, far)
        rows += [(i, base), (100 + i, near), (200 + i, far)]
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect())
    assert kept == [*range(40), *range(200, 240)]


def test_chains_without_a_common_copy(spark):
    base = prose(1, 200)
    chain = [base]
    for k in range(5):
        words = chain[-1].split()
        for p in (0, 6, 12):
            words[30 * k + p + 5] = f"z{k}q{p}"
        chain.append(" ".join(words))
    kept = [r.doc_id for r in similar.keep_one(table(spark, [(9 - i, t) for i, t in enumerate(chain)])).collect()]
    assert jaccard(chain[0], chain[-1]) < 0.8 and kept == [4]


def test_rows_not_ids_decide(spark):
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (None, a), (7, None), (8, " "), (7, "")]
    kept = sorted((r.doc_id or 0, (r.text or "").strip()) for r in similar.keep_one(table(spark, rows)).collect())
    assert kept == sorted([(1, a), (5, b), (0, c), (7, "")])


def test_odd(odd, empty):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns and similar.keep_one(empty).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 10] and ids.count(None) == 1


def test_open_cells_lose_no_link(spark):
    """Texts round one passage, mostly less alike than 0.8: classes as by comparing all pairs."""
    base = prose(3, 60)
    texts = [base] + [edited(base, 1 + k % 4, k // 3) for k in range(90)]
    texts += [" ".join(t.split()[:45] + prose(50 + k, 15).split()) for k, t in enumerate(texts[:30])]
    sets = [similar.shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar.similar(sets[i], sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    kept = sorted(r.doc_id for r in similar.keep_one(table(spark, list(enumerate(texts)))).collect())
    assert kept == sorted(set(label)) and 1 < len(kept) < len(texts)


def test_sketches_differ_no_more_than_sets():
    a, b = (similar.shingle_set(prose(k, 400)) for k in (1, 2))
    for x, y in ((a, b), (a, a[:-5]), (a, a[:0])):
        bits = sum(int(v).bit_count() for v in (similar.sketch(x) ^ similar.sketch(y)).view("u8"))
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_simhash_classes_are_classes(spark):
    """Texts that SimHash links, as they repeat the same words, are near copies though few of their distinct shingles are common."""
    many = " ".join([prose(1, 7)] * 40)
    texts = [f"{many} {prose(10 + i, 20)}" for i in range(3)]
    fps = [simhash.fingerprint(t, similar.SHINGLE_WORDS) for t in texts]
    assert all((fps[0] ^ f).bit_count() <= simhash.RADIUS for f in fps)
    assert not similar.similar(*[similar.shingle_set(t) for t in texts[:2]])
    docs = [(5 + i, t) for i, t in enumerate(texts)] + [(1, prose(50, 60)), (2, prose(51, 60)), (3, texts[0] + " " + many)]
    assert sorted(r.doc_id for r in similar.keep_one(table(spark, docs)).collect()) == [1, 2, 3]
