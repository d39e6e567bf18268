from collections import deque

import numpy as np
import pytest

from plotweave.operators import morphology as mo
from plotweave.operators import skeleton as sk

SIZES = [(7, 9), (10, 6), (5, 5), (1, 8), (12, 12)]


def masks():
    rng = np.random.default_rng(4)
    out = [rng.random(SIZES[i % len(SIZES)]) < p for i, p in enumerate([0.2, 0.35, 0.5, 0.65, 0.8] * 3)]
    full, single, ring = np.ones((5, 5), bool), np.zeros((4, 4), bool), np.zeros((9, 9), bool)
    single[2, 1] = True
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    return [*out, full, single, ring]


def frame(spark, grids):
    rows = [(k, *map(int, g.shape), int(y), int(x)) for k, g in enumerate(grids) for y, x in zip(*np.nonzero(g))]
    return spark.createDataFrame(rows, "image_id int, h int, w int, y int, x int")


def back(df, grids):
    out = [np.zeros(g.shape, bool) for g in grids]
    for r in df.collect():
        out[r.image_id][r.y, r.x] = True
    return out


def stencil(g, offsets, how, outside):
    h, w = g.shape
    out = np.zeros_like(g)
    for y in range(h):
        for x in range(w):
            around = [g[y + a, x + b] if 0 <= y + a < h and 0 <= x + b < w else outside for a, b in offsets]
            out[y, x] = how(around)
    return out


def same(df, grids, want):
    for a, b in zip(back(df, grids), want):
        assert (a == b).all()


def test_dilate_erode_close(spark):
    grids = masks()
    m = frame(spark, grids)
    grow = lambda g: stencil(g, mo.BOX, any, False)
    shrink = lambda g: stencil(g, mo.BOX, all, False)
    same(mo.dilate(m), grids, [grow(g) for g in grids])
    same(mo.erode(m), grids, [shrink(g) for g in grids])
    same(mo.close(m), grids, [shrink(grow(g)) for g in grids])
    for n in (2, 3):
        k = mo.square(n)
        mirror = [(-a, -b) for a, b in k]
        assert sorted(k) != sorted(mirror) or n == 3
        same(mo.erode(m, offsets=k, outside=True), grids, [stencil(g, k, all, True) for g in grids])
    same(mo.erode(m, offsets=mo.CROSS, outside=True), grids, [stencil(g, mo.CROSS, all, True) for g in grids])
    same(mo.close_open(m, close_size=3, close_iterations=2), grids, [stencil(stencil(grow(grow(g)), mo.BOX, all, True), mo.BOX, all, True) for g in grids])


def code(g, y, x):
    h, w = g.shape
    return [bool(g[y + a, x + b]) if 0 <= y + a < h and 0 <= x + b < w else False for a, b in mo.RING]


def thin_slowly(g):
    g = g.copy()
    while True:
        before = g.sum()
        for first in (True, False):
            gone = []
            for y, x in zip(*np.nonzero(g)):
                c = code(g, y, x)
                n, e, s, w = c[0], c[2], c[4], c[6]
                turns = sum(not c[k] and c[(k + 1) % 8] for k in range(8))
                ok = not (n and e and s) and not (e and s and w) if first else not (n and e and w) and not (n and s and w)
                if 2 <= sum(c) <= 6 and turns == 1 and ok:
                    gone.append((y, x))
            for p in gone:
                g[p] = False
        if g.sum() == before:
            return g


def test_thinning(spark):
    grids = masks()
    want = [thin_slowly(g) for g in grids]
    same(mo.thin(frame(spark, grids)), grids, want)
    same(mo.thin(frame(spark, want)), grids, want)
    m = frame(spark, grids)
    for _ in range(4):
        m = mo.thin_round(m)
    same(m, grids, want)


def test_skeleton_by_opening(spark):
    grids = masks()

    def slow(g):
        out = np.zeros_like(g)
        while g.any():
            less = stencil(g, mo.CROSS, all, True)
            out |= g & ~stencil(less, mo.CROSS, any, False)
            if (less == g).all():
                break
            g = less
        return out

    same(mo.skeleton_by_opening(frame(spark, grids)), grids, [slow(g) for g in grids])


def flood(g, ring):
    label = np.full(g.shape, -1)
    for y0, x0 in zip(*np.nonzero(g)):
        if label[y0, x0] >= 0:
            continue
        label[y0, x0], todo = y0 * g.shape[1] + x0, deque([(y0, x0)])
        while todo:
            y, x = todo.popleft()
            for a, b in ring:
                p = y + a, x + b
                if 0 <= p[0] < g.shape[0] and 0 <= p[1] < g.shape[1] and g[p] and label[p] < 0:
                    label[p] = label[y0, x0]
                    todo.append(p)
    return label


@pytest.mark.parametrize("connectivity", [8, 4])
def test_components(spark, connectivity):
    grids = masks()
    got = {(r.image_id, r.y, r.x): r.label for r in mo.components(frame(spark, grids), connectivity).collect()}
    for k, g in enumerate(grids):
        want = flood(g, mo.RING if connectivity == 8 else mo.RING[::2])
        assert all(got[k, y, x] == want[y, x] for y, x in zip(*np.nonzero(g)))
    with pytest.raises(ValueError):
        mo.components(frame(spark, grids), 6)


def test_small_components_go_below_the_area(spark):
    g = np.zeros((9, 40), bool)
    g[0, :19], g[3, :20], g[6, :21] = True, True, True
    assert mo.drop_small(frame(spark, [g]), 20).count() == 41
    assert mo.drop_small(frame(spark, [g]), 1).count() == 60


def walk(skeleton, label, count):
    """Edges by walking from every labelled pixel, link by link."""
    h, w = skeleton.shape
    seen, out = set(), []
    near = lambda p: [(p[0] + a, p[1] + b) for a, b in mo.RING if 0 <= p[0] + a < h and 0 <= p[1] + b < w and skeleton[p[0] + a, p[1] + b]]
    for v in range(count):
        for start in zip(*np.nonzero((label == v) & skeleton)):
            for step in near(start):
                link = frozenset([start, step])
                if label[step] == v or link in seen:
                    continue
                seen.add(link)
                path = [start, step]
                while label[path[-1]] < 0:
                    ahead = [p for p in near(path[-1]) if p != path[-2]]
                    ahead = [p for p in ahead if frozenset([path[-1], p]) not in seen] or ahead
                    if not ahead:
                        break
                    seen.add(frozenset([path[-1], ahead[0]]))
                    path.append(ahead[0])
                out.append((v, int(label[path[-1]]), path))
    return out


def test_graph_equals_a_walk(spark):
    rng = np.random.default_rng(11)
    grids = []
    for i in range(30):
        g = np.zeros((24, 24), bool)
        for _ in range(3):
            y, x, n, d = rng.integers(2, 22), rng.integers(2, 22), rng.integers(4, 18), rng.integers(4)
            for k in range(n):
                p = y + k * (0, 1, 1, 1)[d], x + k * (1, 0, 1, -1)[d]
                if 0 <= p[0] < 24 and 0 <= p[1] < 24:
                    g[p] = True
        grids.append(thin_slowly(g))
    m = frame(spark, grids)
    found = sk.nodes(m)
    vertices, labels = sk.cluster(found, m)
    edges = sk.trace(m, labels).collect()
    lab = [np.full(g.shape, -1) for g in grids]
    for r in labels.collect():
        lab[r.image_id][r.y, r.x] = r.vertex_id
    number = {}
    for r in vertices.collect():
        number[r.image_id] = max(number.get(r.image_id, 0), r.id + 1)
    total = 0
    for k, g in enumerate(grids):
        want = walk(g, lab[k], number.get(k, 0))
        got = sorted((e for e in edges if e.image_id == k), key=lambda e: e.id)
        assert [(e.start_vertex, e.end_vertex) for e in got] == [(a, b) for a, b, _ in want]
        for e, (_, _, path) in zip(got, want):
            assert [(p.y, p.x) for p in e.path] == [tuple(map(float, path[0])), tuple(map(float, path[-1]))]
            assert abs(e.pixel_length - sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:]))) < 1e-9
        total += len(want)
    assert total > 20


def test_nodes(spark):
    g = np.zeros((7, 9), bool)
    g[3, 1:8] = True
    g[1:6, 4] = True
    kinds = {(r.y, r.x): r.kind for r in sk.nodes(frame(spark, [g])).collect()}
    assert kinds[3, 1] == kinds[3, 7] == kinds[1, 4] == kinds[5, 4] == "endpoint" and kinds[3, 4] == "junction"
    corner = np.zeros((5, 5), bool)
    corner[0, :4] = corner[0:4, 0] = True
    assert {(r.y, r.x) for r in sk.nodes(frame(spark, [corner])).collect() if r.kind == "corner"} <= {(0, 0), (0, 1), (1, 0)}


def test_pixel_tables_are_not_broadcast(spark):
    """A table of few bytes on disk may hold millions of pixels: joins of them shuffle, whatever the files' size."""
    from plotweave.operators import skeleton as sk
    from plotweave.storage import materialise

    rows = [(1, 15, 15, 7, x) for x in range(1, 14)] + [(1, 15, 15, y, 7) for y in range(1, 14) if y != 7]
    mask = materialise(spark.createDataFrame(rows, "image_id int, h int, w int, y int, x int"), "mask")
    vertices, labels = sk.cluster(sk.nodes(mask), mask)
    edges = sk.trace(mask, labels)
    hinted = sk.with_hint(sk.nodes(mask), mask.where("y = x"), mask)
    for table in (vertices, edges, hinted):
        assert "BroadcastHashJoin" not in table._jdf.queryExecution().executedPlan().toString()
    assert vertices.count() == 5 and edges.count() == 4


def test_components_and_strokes_are_not_broadcast(spark):
    from plotweave.operators import morphology as mo
    from plotweave.plans.pipelines import stroke_run

    rows = [(k, 40, 40, 20, x, 0) for k in (1, 2) for x in range(5, 35)]
    pixels = spark.createDataFrame(rows, "image_id int, h int, w int, y int, x int, gray int")
    run = stroke_run(pixels)
    for table in (mo.drop_small(pixels.drop("gray"), 5), run.mapped):
        assert "BroadcastHashJoin" not in table._jdf.queryExecution().executedPlan().toString()
    assert run.commands.count() == 4
