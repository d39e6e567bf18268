import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import contours as ct
from plotweave.operators import polyline as pl


def frame(spark, paths):
    rows = [(0, k, i, float(x), float(y)) for k, p in enumerate(paths) for i, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "image_id int, path_id int, seq int, x double, y double")


def back(df):
    out = {}
    for r in df.orderBy("path_id", "seq").collect():
        out.setdefault(r.path_id, []).append((r.x, r.y))
    return out


def shut(p):
    return p if len(p) < 2 or p[0] == p[-1] else [*p, p[0]]


def resample_slowly(p, spacing):
    if len(p) < 2:
        return p
    steps = [math.dist(a, b) for a, b in zip(p, p[1:])]
    cum = np.concatenate([[0], np.cumsum(steps)])
    if cum[-1] == 0:
        return p[:1]
    out = []
    for k in range(math.ceil(cum[-1] / spacing)):
        d = k * spacing
        i = next((i for i in range(len(steps)) if d <= cum[i + 1]), len(steps) - 1)
        t = (d - cum[i]) / steps[i] if steps[i] else 0.0
        out.append((p[i][0] + t * (p[i + 1][0] - p[i][0]), p[i][1] + t * (p[i + 1][1] - p[i][1])))
    return [*out, out[0]]


def shapes():
    rng = np.random.default_rng(3)
    square = [(0, 0), (30, 0), (30, 30), (0, 30)]
    circle = [(50 + 40 * math.cos(a), 50 + 40 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 64, endpoint=False)]
    rough = [tuple(map(float, p)) for p in np.cumsum(rng.integers(-3, 4, (80, 2)), 0)]
    edge = [(float(i), 0.0) for i in range(10)] + [(10.0, float(i)) for i in range(10)] + [(10.0 - i, 10.0) for i in range(10)] + [(0.0, 10.0 - i) for i in range(10)]
    return [shut([tuple(map(float, q)) for q in p]) for p in (square, circle, rough, edge)] + [[(1.0, 2.0)], [(3.0, 3.0)] * 4, [(0.0, 0.0), (0.0, 0.0), (20.0, 0.0), (0.0, 0.0)]]


@pytest.mark.parametrize("spacing", [15.0, 1.0, 7.3, 500.0])
def test_resample(spark, spacing):
    paths = shapes()
    got = back(pl.resample(frame(spark, paths), spacing))
    for k, p in enumerate(paths):
        want = resample_slowly(p, spacing)
        assert len(got[k]) == len(want)
        assert np.allclose(got[k], want)


def test_resample_needs_spacing(spark):
    with pytest.raises(ValueError):
        pl.resample(frame(spark, shapes()), 0)


def test_close_path(spark):
    got = back(pl.close_path(frame(spark, [[(0, 0), (1, 0), (1, 1)], [(0, 0), (1, 0), (0, 0)], [(5, 5)]])))
    assert got == {0: [(0, 0), (1, 0), (1, 1), (0, 0)], 1: [(0, 0), (1, 0), (0, 0)], 2: [(5, 5)]}


def corners_slowly(p, limit, window, apart):
    if len(p) < 2 * window + 3:
        return []
    q = p[:-1] if np.allclose(p[0], p[-1]) else p
    n = len(q)
    if n < 2 * window + 3:
        return []
    found = []
    for i in range(n):
        u, v = np.subtract(q[i - window], q[i]), np.subtract(q[(i + window) % n], q[i])
        a, b = np.hypot(*u), np.hypot(*v)
        if min(a, b) >= 1e-9:
            angle = math.degrees(math.acos(max(-1.0, min(1.0, float((u[0] * v[0] + u[1] * v[1]) / (a * b))))))
            if angle <= limit:
                found.append((angle, i))
    kept = []
    for _, i in sorted(found):
        if all(min(abs(i - s), n - abs(i - s)) >= apart for s in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("setting", [(140.0, 8, 17), (140.0, 3, 5), (35.0, 6, 10)])
def test_corners(spark, setting):
    paths = [p for k, p in enumerate(shapes()) if k != 1]  # on a circle all angles are equal but for rounding
    got = {}
    for r in pl.corners(frame(spark, paths), *setting).collect():
        got.setdefault(r.path_id, []).append(r.idx)
    for k, p in enumerate(paths):
        assert sorted(got.get(k, [])) == corners_slowly(p, *setting)


def test_merge(spark):
    paths = shapes()[:4]
    raw = frame(spark, paths)
    sampled, sharp = pl.resample(raw, 4.0), pl.corners(raw, 140.0, 3, 5)
    got = back(pl.merge_corners(sampled, raw, sharp))
    for k, p in enumerate(paths):
        q = p[:-1]
        cum = np.concatenate([[0], np.cumsum([math.dist(a, b) for a, b in zip(q, q[1:])])])
        items = []
        for s in resample_slowly(p, 4.0)[:-1]:
            d = [(a - s[0]) ** 2 + (b - s[1]) ** 2 for a, b in q]
            items.append((cum[int(np.argmin(d))], s, 0))
        items += [(cum[i], q[i], 1) for i in corners_slowly(p, 140.0, 3, 5)]
        kept = []
        for item in sorted(items, key=lambda t: t[0]):
            if kept and math.dist(kept[-1][1], item[1]) < 1e-6:
                if item[2] and not kept[-1][2]:
                    kept[-1] = item
                continue
            kept.append(item)
        want = [i[1] for i in kept] + [kept[0][1]]
        assert np.allclose(got[k], want)


def test_simplify(spark):
    line = [(0, 0), (1, 0.75), (2, 0), (3, 0.8), (4, 0)]
    loop = [(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)]
    got = back(pl.simplify(frame(spark, [line, loop, [(1, 1), (2, 2)], [(4, 4)]]), 0.75))
    assert got[0][0] == (0, 0) and got[0][-1] == (4, 0) and (3, 0.8) in got[0]
    assert got[1] == loop and got[2] == [(1, 1), (2, 2)] and got[3] == [(4, 4)]


def test_measures_and_order(spark):
    square, long = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (50, 0), (50, 1), (0, 1)]
    m = ct.measures(frame(spark, [long, square, square, [(0, 0)]]))
    rows = {r.path_id: r for r in m.collect()}
    assert (rows[1].area, rows[1].perimeter, rows[0].area, rows[0].perimeter) == (100, 40, 50, 102)
    assert rows[3].area == 0
    order = {r.path_id: r["rank"] for r in ct.by_area(ct.large(m, 50, 40)).collect()}
    assert order == {1: 0, 2: 1, 0: 2}


def test_borders():
    g = np.zeros((8, 9), bool)
    g[1:7, 1:8] = True
    g[3:5, 3:6] = False
    found = ct.follow_borders(g, False)
    assert [hole for _, hole, _ in found] == [False, True]
    outer, hole = found[0][0], found[1][0]
    assert len(outer) == 22 and tuple(outer[0]) == (1, 1) and len(hole) == 10
    assert {tuple(p) for p in outer} == {(x, y) for x in range(1, 8) for y in range(1, 7) if x in (1, 7) or y in (1, 6)}
    for p, _, _ in found:
        assert np.abs(np.diff(np.vstack([p, p[:1]]), axis=0)).max() == 1
    assert len(ct.follow_borders(g, True)) == 1
    dot = np.zeros((3, 3), bool)
    dot[1, 1] = True
    assert [tuple(p) for p in ct.follow_borders(dot, False)[0][0]] == [(1, 1)]
    line = np.zeros((3, 7), bool)
    line[1, 1:6] = True
    assert len(ct.follow_borders(line, False)[0][0]) == 8


def test_contour_modes(spark):
    mask = spark.createDataFrame([(0, 4, 4, 1, 1), (1, 4, 4, 0, 0), (1, 4, 4, 3, 3)], "image_id int, h int, w int, y int, x int")
    n = {r.image_id: r.n for r in ct.find_contours(mask).groupBy("image_id").agg(F.countDistinct("path_id").alias("n")).collect()}
    assert n == {0: 1, 1: 2}
    with pytest.raises(ValueError):
        ct.find_contours(mask, "tree")


def test_rdp_among_equally_far_points(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from plotweave.plans.queries import QUERIES, SQL

    path = [(0.0, 0), (10.0, 60), (20.0, 60), (100.0, 0)]
    made = ", ".join(f"({k}, TIMESTAMP '2024-01-01 00:00:0{k}', 8, 'click', {x}, '{{\"k\": {y}}}')" for k, (x, y) in enumerate(path))
    with duckdb.connect() as db:
        db.execute(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {made}) t(event_id, ts, user_id, event_type, value, props)")
        db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        want = sorted(db.execute(SQL["rdp"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["rdp"](spark, str(tmp_path)).collect()) == want == [(0, 8, 0.0, 0.0), (0, 8, 20.0, 60.0), (0, 8, 100.0, 0.0)]
    assert back(pl.simplify(frame(spark, [path]), 40.0))[0] == [(0.0, 0.0), (10.0, 60.0), (100.0, 0.0)]
