from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plotweave.llm import lines
from tests.llm.conftest import prose, table


def brute(docs):
    """Texts without pairs of lines that stand earlier, by a plain loop; a set of pairs is all that it keeps."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        if t is None:
            out[i] = (None, set())
            continue
        rows, gone = t.split("\n"), set()
        for k, pair in enumerate(zip(rows, rows[1:])):
            if not "".join(pair).strip(" "):
                continue
            if pair in seen:
                gone |= {k, k + 1}
            seen.add(pair)
        out[i] = ("\n".join(r for k, r in enumerate(rows) if k not in gone), gone)
    return out


def corpus():
    shared = [prose(500 + k, 8) for k in range(12)]
    paragraph = prose(700, 60)
    docs = []
    for i in range(60):
        own = [prose(40 * i + k, 7) for k in range(1 + i % 9)]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = shared
        if i % 4 == 0:
            own[i % 2 : i % 2] = [paragraph, ""]
        if i % 7 == 0:
            own += own[:2] + ["", "", "tail"]
        docs.append((i, "\n".join(own)))
    docs += [(100, "a\nb\na\nb\na"), (101, "x\nx\nx\nx"), (102, "\n\n\n"), (103, None), (104, "")]
    return docs, shared, paragraph


def test_against_brute_force(spark):
    docs, shared, paragraph = corpus()
    got = {r.doc_id: r for r in lines.dedup_lines(table(spark, docs)).collect()}
    want = brute(docs)
    assert {i: r.text for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    runs = {i: {k for r in g.removed for k in range(r.start, r.start + r.n)} for i, g in got.items()}
    assert runs == {i: gone for i, (_, gone) in want.items()} and all(got[i].removed_lines == len(runs[i]) for i in runs)
    assert all(a.start + a.n < b.start for r in got.values() for a, b in zip(r.removed, r.removed[1:]))
    assert sum(paragraph in (r.text or "") for r in got.values()) == 1
    for line in shared:  # the whole passage goes, whatever surrounds it
        assert sum(line in (r.text or "").split("\n") for r in got.values()) == 1
    every = {line for _, t in docs for line in (t or "").split("\n")}
    assert every == {line for r in got.values() for line in (r.text or "").split("\n")} | {""}


@pytest.mark.parametrize("size", [2, 3, 5, 8])
def test_short_passages_between_other_lines(spark, size):
    passage = [prose(900 + k, 4) for k in range(size)]
    docs = [(i, "\n".join([prose(1000 + 9 * i + k, 5) for k in range(1 + i % 4)] + passage + [prose(2000 + 9 * i + k, 5) for k in range(1 + i % 3)])) for i in range(12)]
    got = {r.doc_id: r for r in lines.dedup_lines(table(spark, docs)).collect()}
    assert got[0].removed_lines == 0
    assert all(got[i].removed_lines == size and [tuple(r) for r in got[i].removed] == [(1 + i % 4, size)] for i in range(1, 12))


def test_long_text_of_repeated_lines(spark):
    many = "\n".join(prose(k % 500, 3) for k in range(40_000))
    got = {r.doc_id: r for r in lines.dedup_lines(table(spark, [(1, many), (2, many)])).collect()}
    assert got[2].text == "" and got[2].removed_lines == 40_000 and got[1].removed_lines >= 39_000
    assert {1: got[1].text} == {1: brute([(1, many)])[1][0]}


def test_odd(odd, empty, odd_rows):
    out = lines.dedup_lines(odd)
    assert set(odd.columns) <= set(out.columns) and out.count() == len(odd_rows)
    rows = defaultdict(list)
    for r in out.collect():
        rows[r.doc_id].append(r)
    assert rows[1][0].text is None and rows[1][0].n_lines == 0 and rows[2][0].n_lines == 1
    assert len(rows[6]) == 2 and all(r.text == odd_rows[5][1] for r in rows[6])
    assert all(r.r1 == r.row == "x" for r in lines.dedup_lines(odd.withColumns({c: F.lit("x") for c in ("r1", "r2", "row", "at", "gone", "own_text", "lines")})).collect())
    assert lines.dedup_lines(empty).count() == 0


def test_rows_alike_are_one_document(spark):
    t = "\n".join(prose(k, 9) for k in range(6))
    out = lines.dedup_lines(table(spark, [(1, t), (1, t), (2, t)])).where(F.col("removed_lines") > 0).collect()
    assert [r.doc_id for r in out] == [2]


def test_large_joins_shuffle_each_text_a_few_times(spark, monkeypatch):
    """With nothing broadcast, what is shuffled grows with the texts, not with texts times their repeated lines."""
    monkeypatch.setattr(lines, "if_small", lambda df: df)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    text = "\n".join(prose(k, 12) for k in range(1500))
    docs = [(i, f"{text}\n{prose(5000 + i, 9)}") for i in range(3)] + [(9, None), (10, "")]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {r.doc_id: r.text for r in lines.dedup_lines(table(spark, docs)).collect()}
        moved = written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: t for i, (t, _) in brute(docs).items()}
    assert moved < 12 * sum(len(t or "") for _, t in docs)


def test_unequal_pairs_of_equal_hash_stay(spark, monkeypatch):
    """With a hash that tells only lengths, pairs are kept unless their bytes are those of the first."""
    plain = lines._rolling_sql
    monkeypatch.setattr(lines, "_rolling_sql", lambda x: plain(x).replace("xxhash64(l)", "cast(length(l) as bigint)"))
    docs = [(1, "aa\nbb\ncc"), (2, "xx\naa\nbb\nyy"), (3, "aa\nbb"), (4, "p\nq")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(table(spark, docs)).collect()}
    assert got == {1: "aa\nbb\ncc", 2: "xx\nyy", 3: "", 4: "p\nq"}
