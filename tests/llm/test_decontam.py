import re
from collections import Counter

from plotweave.llm import decontam
from tests.llm.conftest import prose, table


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(max(0, len(words) - n + 1)))


def brute(docs, items, least=0.8):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for k, u in items:
            v = re.findall(r"[^\W_]+", u.lower())
            n = min(5, len(v))
            if not v:
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[s : s + len(v)], n), grams(v, n)
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if sim >= least and sim >= out.get((i, k), (0, []))[0] - 1e-12:
                    before = out.get((i, k), (0, []))
                    out[i, k] = (sim, [*(before[1] if abs(sim - before[0]) < 1e-12 else []), s])
    return out


def test_against_brute_force(spark):
    items = [(k, prose(1000 + k, 12 + 3 * k)) for k in range(12)] + [(50, "Two words"), (51, ""), (52, "ka ka ka ka ka ka ka ka")]
    docs = []
    for i in range(60):
        w = prose(i, 90).split()
        k = i % 12
        part = items[k][1].split()
        if i % 3 == 0:
            part[0] = part[-1] = "changed"
        if i % 5 == 0:
            part = part[2:]
        if i % 4 != 3:
            w[30:30] = part
        docs.append((i, " ".join(w).replace(" lo ", ", LO! ")))
    docs += [(100, "say two words now"), (101, "ka " * 30), (102, items[3][1].upper()), (103, None), (104, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontam.leaks(table(spark, docs), bench).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and len(want) > 20
    for k, (sim, start) in want.items():
        assert abs(got[k][0] - sim) < 1e-12 and got[k][1] in start


def test_odd(spark, odd, empty, odd_rows):
    bench = spark.createDataFrame([(1, odd_rows[4][1]), (2, None), (3, ""), (4, odd_rows[8][1])], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.leaks(odd, bench).collect()), key=str)
    assert got == [(5, 1), (6, 1), (None, 4)]
    kept = decontam.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 3
    assert decontam.leaks(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(odd, none).count() == len(odd_rows)


def test_radius():
    assert decontam.radius_for(1.0) == 0
    assert decontam.radius_for(0.8) == 19
