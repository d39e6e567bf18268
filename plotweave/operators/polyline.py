"""Polylines: a row a point, ``(image_id, path_id, seq, x, y)``.

Most operators are windows over a path.  Those that fold over a path in order hold it as one array in a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PATH = ["image_id", "path_id"]
POINT = [*PATH, "seq", "x", "y"]


def _by_seq() -> WindowSpec:
    return Window.partitionBy(*PATH).orderBy("seq")


def _whole() -> WindowSpec:
    return Window.partitionBy(*PATH)


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def near(a: Column, b: Column) -> Column:
    """Whether two coordinates count as equal: within 1e-8 plus 1e-5 of the second."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def close_path(points: DataFrame) -> DataFrame:
    """Each path followed by its first point, unless its last point equals it or it has one point only."""
    ends = points.groupBy(*PATH).agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"), (F.max("seq") + 1).alias("seq"), F.count("*").alias("n"))
    more = ends.where("n > 1 and not (a <=> b)").select(*PATH, "seq", F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    return points.select(*POINT).unionByName(more)


def segments(points: DataFrame) -> DataFrame:
    """``(.., seq, x, y, x1, y1, len)``: the step from each point to the next of its path."""
    rows = points.select(*POINT, F.lead("x").over(_by_seq()).alias("x1"), F.lead("y").over(_by_seq()).alias("y1"))
    rows = rows.where("x1 is not null")
    return rows.withColumn("len", length(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")))


def arc_length(points: DataFrame) -> DataFrame:
    """The points with ``s``, the way along the path from its first point."""
    step = length(F.col("x") - F.lag("x").over(_by_seq()), F.col("y") - F.lag("y").over(_by_seq()))
    rows = points.select(*POINT, F.coalesce(step, F.lit(0.0)).alias("step"))
    return rows.select(*POINT, F.sum("step").over(_by_seq().rowsBetween(Window.unboundedPreceding, 0)).alias("s"))


def path_lengths(points: DataFrame) -> DataFrame:
    """``(image_id, path_id, length)`` of open paths; a single point has length 0."""
    return arc_length(points).groupBy(*PATH).agg(F.max("s").alias("length"))


def resample(closed: DataFrame, spacing: float) -> DataFrame:
    """Points at distances 0, spacing, 2 spacing, ... along each closed path, and the first again.

    A distance that falls on a vertex belongs to the segment that ends there.  A path of one point stays; one of no length
    gives its first point.  Each segment generates its own points: there is no search and no join.
    """
    if spacing <= 0:
        raise ValueError("spacing must be positive")
    seg = segments(closed)
    w = _by_seq().rowsBetween(Window.unboundedPreceding, 0)
    seg = seg.withColumn("s1", F.sum("len").over(w)).withColumn("s0", F.coalesce(F.lag("s1").over(_by_seq()), F.lit(0.0)))
    seg = seg.withColumn("total", F.max("s1").over(_whole())).withColumn("first", F.col("seq") == F.min("seq").over(_whole())).withColumn("last", F.col("seq") == F.max("seq").over(_whole()))
    # Points of a segment are those with s0 < k * spacing <= s1, k = 0 belonging to the first; none reaches the total.
    count = F.ceil(F.col("total") / spacing)
    lo = F.when(F.col("first"), 0).otherwise(F.floor(F.col("s0") / spacing))
    hi = F.least(F.floor(F.col("s1") / spacing) + 1, count - 1)
    ks = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    at = seg.select("*", F.explode(ks).alias("k")).withColumn("d", F.col("k") * spacing)
    at = at.where((F.col("d") <= F.col("s1")) | F.col("last")).where((F.col("d") > F.col("s0")) | (F.col("k") == 0) & F.col("first"))
    t = F.when(F.col("len") > 0, (F.col("d") - F.col("s0")) / F.col("len")).otherwise(0.0)
    made = at.select(*PATH, F.col("k").cast("int").alias("seq"), (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))
    ends = closed.groupBy(*PATH).agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.count("*").alias("n")).select(*PATH, "a", "n")
    totals = seg.groupBy(*PATH).agg(F.max("total").alias("total"))
    ends = ends.join(totals, PATH, "left")
    again = F.ceil(F.col("total") / spacing).cast("int")
    first = ends.where("total is null or total = 0 or n < 2").select(*PATH, F.lit(0).alias("seq"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    last = ends.where("total > 0 and n > 1").select(*PATH, again.alias("seq"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    return made.unionByName(first).unionByName(last)


def as_arrays(points: DataFrame) -> DataFrame:
    """``(image_id, path_id, p)``: each path as an array of (x, y) in order, without its last point if that closes it."""
    rows = points.groupBy(*PATH).agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("q"))
    p = rows.select(*PATH, F.transform("q", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("p"))
    a, b = F.get("p", 0), F.element_at("p", -1)
    shut = near(a["x"], b["x"]) & near(a["y"], b["y"])
    return p.withColumn("raw", F.size("p")).withColumn("p", F.when(shut, F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p")))


def corner_angles(points: DataFrame, window: int = 6) -> DataFrame:
    """``(.., idx, x, y, angle_deg)``: the angle at each point between the points ``window`` before and after it, around the loop.

    Paths of fewer than ``2 * window + 3`` points have none, nor have points with an arm shorter than 1e-9.
    """
    need = 2 * window + 3
    rows = as_arrays(points).where((F.col("raw") >= need) & (F.size("p") >= need))
    rows = rows.select(*PATH, "p", F.size("p").alias("n"), F.posexplode("p").alias("idx", "c"))
    a, b = F.get("p", F.pmod(F.col("idx") - window, F.col("n"))), F.get("p", F.pmod(F.col("idx") + window, F.col("n")))
    rows = rows.select(*PATH, "n", "idx", F.col("c.x").alias("x"), F.col("c.y").alias("y"), (a["x"] - F.col("c.x")).alias("ux"), (a["y"] - F.col("c.y")).alias("uy"), (b["x"] - F.col("c.x")).alias("vx"), (b["y"] - F.col("c.y")).alias("vy"))
    nu, nv = length(F.col("ux"), F.col("uy")), length(F.col("vx"), F.col("vy"))
    rows = rows.withColumn("nu", nu).withColumn("nv", nv).where("nu >= 1e-9 and nv >= 1e-9")
    cos = (F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")) / (F.col("nu") * F.col("nv"))
    return rows.select(*PATH, "n", "idx", "x", "y", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).alias("angle_deg"))


def corners(points: DataFrame, max_angle: float = 35.0, window: int = 6, separation: int = 10) -> DataFrame:
    """``(image_id, path_id, idx, x, y, angle_deg)``: sharp corners, the sharpest first, none within ``separation`` places of another.

    Equal angles are taken by place.
    """
    found = corner_angles(points, window).where(F.col("angle_deg") <= max_angle)
    lists = found.groupBy(*PATH).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("angle_deg", "idx", "x", "y"))).alias("c"))
    clash = f"exists(acc, s -> least(abs(v.idx - s.idx), n - abs(v.idx - s.idx)) < {separation})"
    kept = f"aggregate(c, cast(array() as array<struct<angle_deg:double,idx:int,x:double,y:double>>), (acc, v) -> if({clash}, acc, array_append(acc, v)))"
    return lists.select(*PATH, F.explode(F.expr(kept)).alias("k")).select(*PATH, "k.idx", "k.x", "k.y", "k.angle_deg")


def _raw_arcs(raw: DataFrame) -> DataFrame:
    """``(.., i, rx, ry, s)``: vertices of the loops without a closing point, with the way to each."""
    rows = as_arrays(raw).select(*PATH, F.posexplode("p").alias("i", "c")).select(*PATH, F.col("i").alias("seq"), F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    return arc_length(rows).select(*PATH, F.col("seq").alias("i"), F.col("x").alias("rx"), F.col("y").alias("ry"), "s")


def nearest_vertex(sampled: DataFrame, raw: DataFrame) -> DataFrame:
    """The sampled points with ``s`` and ``i``, the way to the nearest vertex of their raw loop, the first of equally near ones.

    The vertices are one array a path, so points meet only their own path and no pair is ever shuffled.
    """
    loops = _raw_arcs(raw).groupBy(*PATH).agg(F.sort_array(F.collect_list(F.struct("i", "rx", "ry", "s"))).alias("v"))
    rows = sampled.select(*POINT).join(loops, PATH)
    d2 = "named_struct('d', (r.rx - x) * (r.rx - x) + (r.ry - y) * (r.ry - y), 'i', r.i, 's', r.s)"
    best = rows.withColumn("b", F.expr(f"array_min(transform(v, r -> {d2}))"))
    return best.select(*POINT, F.col("b.s").alias("s"), F.col("b.i").alias("i"))


def merge_corners(sampled: DataFrame, raw: DataFrame, kept: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Sampled closed paths with the corners put in by their way along the raw loop, closed again.

    Of points within ``tolerance`` of the last one kept the later goes, but a corner takes a sampled point's place.  Paths
    whose raw loop has fewer than two vertices stay as they are.
    """
    loops = _raw_arcs(raw)
    big = loops.groupBy(*PATH).agg(F.count("*").alias("n")).where("n > 1").select(*PATH)
    opened = as_arrays(sampled).select(*PATH, F.posexplode("p").alias("seq", "c")).select(*PATH, "seq", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    placed = nearest_vertex(opened.join(big, PATH, "left_semi"), raw)
    items = placed.select(*PATH, F.struct("s", F.lit(0).alias("tag"), F.col("seq").alias("ord"), "x", "y").alias("t"))
    own = kept.select(*PATH, F.col("idx").alias("i")).join(loops, [*PATH, "i"])
    items = items.unionByName(own.select(*PATH, F.struct("s", F.lit(1).alias("tag"), F.col("i").alias("ord"), F.col("rx").alias("x"), F.col("ry").alias("y")).alias("t")))
    lists = items.groupBy(*PATH).agg(F.sort_array(F.collect_list("t")).alias("t"))
    last = "element_at(acc, -1)"
    close = f"sqrt((v.x - {last}.x) * (v.x - {last}.x) + (v.y - {last}.y) * (v.y - {last}.y)) < {tolerance!r}D"
    swap = f"if(v.tag = 1 and {last}.tag = 0, array_append(slice(acc, 1, size(acc) - 1), v), acc)"
    fold = f"aggregate(t, slice(t, 1, 0), (acc, v) -> if(size(acc) = 0, array_append(acc, v), if({close}, {swap}, array_append(acc, v))))"
    merged = lists.withColumn("m", F.expr(fold)).withColumn("m", F.expr("concat(m, slice(m, 1, 1))"))
    out = merged.select(*PATH, F.posexplode("m").alias("seq", "v")).select(*PATH, "seq", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    return out.unionByName(sampled.select(*POINT).join(big, PATH, "left_anti"))


def _rdp(p: np.ndarray, epsilon: float, ties: str = "first") -> np.ndarray:
    """Places kept by Ramer (1972) and Douglas and Peucker (1973), with a stack of open spans."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    spans = [(0, len(p) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        inner, (dx, dy) = p[a + 1 : b] - p[a], p[b] - p[a]
        # Each product is rounded by itself: a dot product may fuse them, and equal distances then differ in the last bit.
        far = np.sqrt((inner**2).sum(1)) if dx == 0 and dy == 0 else np.abs(dx * inner[:, 1] - dy * inner[:, 0]) / np.sqrt(dx * dx + dy * dy)
        k = int(np.argmax(far)) if ties == "first" else len(far) - 1 - int(np.argmax(far[::-1]))
        if far[k] > epsilon:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def simplify(points: DataFrame, epsilon: float, ties: str = "first") -> DataFrame:
    """Each path reduced to the points that stand more than ``epsilon`` off its spans' lines; places are numbered anew.

    Where a span ends at its start the distance is that from the point.  Paths of two points or fewer stay.  Of equally
    far points of a span the one kept is ``ties``, the first or the last of the path.
    """
    if ties not in ("first", "last"):
        raise ValueError(f"Unknown choice among equally far points: {ties}")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        if len(rows) > 2:
            rows = rows.iloc[_rdp(rows[["x", "y"]].to_numpy(float), epsilon, ties)]
        return rows.assign(seq=np.arange(len(rows), dtype=np.int32))

    schema = ", ".join(f"`{f.name}` {'int' if f.name == 'seq' else f.dataType.simpleString()}" for f in points.select(*POINT).schema)
    return points.select(*POINT).groupBy(*PATH).applyInPandas(run, schema)
