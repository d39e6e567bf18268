"""Named queries over the driver's tables, one an operator, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.config import A4_PAGE, GANTRY_AREA, WorkArea
from plotweave.functions import pixels as px
from plotweave.operators import commands as cmd
from plotweave.operators import contours as ct
from plotweave.operators import mapping, metrics, polyline
from plotweave.operators import morphology as mo
from plotweave.operators import skeleton as sk
from plotweave.plans import adapters as ad
from plotweave.plans.pipelines import contour_run, stroke_run, study_run
from plotweave.segment import HeuristicSegmenter, ModelSegmenter
from plotweave.sources import firmware, models, sinks
from plotweave.streaming.serial import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Pixels


@query(f"WITH {ad.PX} SELECT image_id, y, x, gray FROM px WHERE gray <= 127")
def thresh_inv(spark: SparkSession, d: str) -> DataFrame:
    return ad.pixels8(spark, d).where(px.dark_or_equal(F.col("gray"))).select("image_id", "y", "x", "gray")


@query(f"WITH {ad.PX} SELECT image_id, y, x, gray FROM px WHERE gray < 127")
def thresh_strict(spark: SparkSession, d: str) -> DataFrame:
    return ad.pixels8(spark, d).where(px.darker(F.col("gray"))).select("image_id", "y", "x", "gray")


@query(f"WITH {ad.PX} SELECT image_id, y, x, CASE WHEN gray > 127 THEN 255 ELSE 0 END AS black, CASE WHEN gray > 127 THEN 0 ELSE 255 END AS white FROM px")
def thresh_pair(spark: SparkSession, d: str) -> DataFrame:
    black, white = px.line_pair(F.col("gray"))
    return ad.pixels8(spark, d).select("image_id", "y", "x", black.alias("black"), white.alias("white"))


@query(f"WITH {ad.PX} SELECT image_id, y, x, CASE WHEN gray < 127 THEN 255 ELSE 0 END AS level FROM px")
def mask_to_image(spark: SparkSession, d: str) -> DataFrame:
    return ad.pixels8(spark, d).select("image_id", "y", "x", px.mask_level(px.darker(F.col("gray"))).alias("level"))


_LOGITS = """z AS (SELECT vec_id AS image_id, c AS x, 10 * CAST(embedding[c * 3 + 1] AS DOUBLE) AS a, 10 * CAST(embedding[c * 3 + 2] AS DOUBLE) AS b, 10 * CAST(embedding[c * 3 + 3] AS DOUBLE) AS e
  FROM embeddings, (SELECT unnest(range(0, 21)) AS c) n),
p AS (SELECT image_id, CAST(x AS INTEGER) AS x, exp(a - greatest(a, b, e)) AS p0, exp(b - greatest(a, b, e)) AS p1, exp(e - greatest(a, b, e)) AS p2 FROM z)"""


@query(f"WITH {_LOGITS} SELECT image_id, x, round(p0 / (p0 + p1 + p2), 6) AS p0, round(p1 / (p0 + p1 + p2), 6) AS p1, round(p2 / (p0 + p1 + p2), 6) AS p2 FROM p")
def softmax_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.logits3(spark, d).withColumn("p", px.probabilities(F.col("z")))
    return rows.select("image_id", "x", *[r6(F.get("p", k)).alias(f"p{k}") for k in range(3)])


@query(f"WITH {_LOGITS} SELECT image_id, CAST(x AS INTEGER) AS x, round(1 / (1 + exp(-a)), 6) AS p FROM z")
def sigmoid_channel(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.logits3(spark, d).withColumn("p", px.probabilities(F.slice("z", 1, 1)))
    return rows.select("image_id", "x", r6(F.get("p", 0)).alias("p"))


@query(f"WITH {_LOGITS} SELECT image_id, x, 'line' AS kind FROM p WHERE p2 / (p0 + p1 + p2) >= 0.5 UNION ALL SELECT image_id, x, 'node' FROM p WHERE p1 / (p0 + p1 + p2) >= 0.5")
def masks_from_probs(spark: SparkSession, d: str) -> DataFrame:
    lines, found, _ = px.probability_masks(ad.logits3(spark, d).withColumn("p", px.probabilities(F.col("z"))))
    return lines.select("image_id", "x", F.lit("line").alias("kind")).unionByName(found.select("image_id", "x", F.lit("node").alias("kind")))


# Morphology

_DILATED = "dil AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM mask, box WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"
_AT = ["image_id", "y", "x"]


@query(f"WITH {ad.MASK}, {ad.BOX}, {_DILATED} SELECT * FROM dil")
def dilate(spark: SparkSession, d: str) -> DataFrame:
    return mo.dilate(ad.mask8(spark, d)).select(*_AT)


@query(f"WITH {ad.MASK}, {ad.BOX} SELECT image_id, y + dy AS y, x + dx AS x FROM mask, box GROUP BY image_id, y + dy, x + dx HAVING count(*) = 9")
def erode(spark: SparkSession, d: str) -> DataFrame:
    return mo.erode(ad.mask8(spark, d)).select(*_AT)


@query(f"WITH {ad.MASK}, {ad.BOX}, {_DILATED} SELECT image_id, y + dy AS y, x + dx AS x FROM dil, box GROUP BY image_id, y + dy, x + dx HAVING count(*) = 9")
def close(spark: SparkSession, d: str) -> DataFrame:
    return mo.close(ad.mask8(spark, d)).select(*_AT)


_NEED = "(least(y + dy + 1, 7) - greatest(y + dy - 1, 0) + 1) * (least(x + dx + 1, 7) - greatest(x + dx - 1, 0) + 1)"
_INSIDE = "y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7"


@query(f"""WITH {ad.MASK}, {ad.BOX}, {_DILATED},
atp AS (SELECT image_id, y + dy AS y, x + dx AS x, {_NEED} AS need FROM dil, box WHERE {_INSIDE})
SELECT image_id, y, x FROM atp GROUP BY image_id, y, x, need HAVING count(*) = need""")
def close_cv(spark: SparkSession, d: str) -> DataFrame:
    return mo.close_open(ad.mask8(spark, d), close_size=3).select(*_AT)


@query(f"""WITH {ad.MASK}, {ad.BOX},
atp AS (SELECT image_id, y + dy AS y, x + dx AS x, {_NEED} AS need FROM mask, box WHERE {_INSIDE}),
er AS (SELECT image_id, y, x FROM atp GROUP BY image_id, y, x, need HAVING count(*) = need)
SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM er, box WHERE {_INSIDE}""")
def open_cv(spark: SparkSession, d: str) -> DataFrame:
    return mo.close_open(ad.mask8(spark, d), open_size=3).select(*_AT)


@query(f"WITH {ad.MASK}, {ad.CODE} SELECT image_id, y, x, code FROM code")
def neighbor_code(spark: SparkSession, d: str) -> DataFrame:
    return mo.neighbour_code(ad.mask8(spark, d)).select(*_AT, "code")


@query(f"WITH {ad.MASK}, {ad.CODE} SELECT image_id, y, x, CAST(bit_count(code) AS INTEGER) AS n FROM code")
def neighbor_count(spark: SparkSession, d: str) -> DataFrame:
    return mo.neighbour_count(ad.mask8(spark, d)).select(*_AT, "n")


@query(f"WITH {ad.MASK}, {ad.CODE} SELECT image_id, y, x, CAST(bit_count((255 - code) & ((code >> 1) | ((code & 1) << 7))) AS INTEGER) AS t FROM code")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    return mo.transitions(ad.mask8(spark, d)).select(*_AT, "t")


@query()
def thin_zs(spark: SparkSession, d: str) -> DataFrame:
    return mo.thin(ad.mask8(spark, d)).select(*_AT)


def _pass_sql(source: str, out: str, first: bool) -> str:
    """SQL of one sub-pass of thinning of table ``source`` into ``out``."""
    code = ad.CODE.replace(ad.RING + ", ", "").replace("code AS (", f"{out}c AS (").replace("mask", source)
    three = "NOT (code & 21 = 21) AND NOT (code & 84 = 84)" if first else "NOT (code & 69 = 69) AND NOT (code & 81 = 81)"
    turns = "bit_count((255 - code) & ((code >> 1) | ((code & 1) << 7)))"
    return f"{code}, {out} AS (SELECT image_id, y, x FROM {out}c WHERE NOT (bit_count(code) BETWEEN 2 AND 6 AND {turns} = 1 AND {three}))"


@query(f"WITH {ad.MASK}, {ad.RING}, {_pass_sql('mask', 'one', True)}, {_pass_sql('one', 'two', False)} SELECT image_id, y, x FROM two")
def thin_round(spark: SparkSession, d: str) -> DataFrame:
    return mo.thin_round(ad.mask8(spark, d)).select(*_AT)


@query()
def skel_morph(spark: SparkSession, d: str) -> DataFrame:
    return mo.skeleton_by_opening(ad.mask8(spark, d)).select(*_AT)


# Components


def _labels_sql(source: str, out: str, near: str = "true") -> str:
    """SQL of the least pixel number that each pixel of ``source`` reaches."""
    return f"""{out}r AS (SELECT image_id, y * 8 + x AS a, y * 8 + x AS b FROM {source} UNION
  SELECT r.image_id, r.a, n.y * 8 + n.x FROM {out}r r JOIN {source} n ON n.image_id = r.image_id AND abs(n.y - r.b // 8) <= 1 AND abs(n.x - r.b % 8) <= 1 AND {near}),
{out} AS (SELECT image_id, CAST(a // 8 AS INTEGER) AS y, CAST(a % 8 AS INTEGER) AS x, CAST(min(b) AS BIGINT) AS label FROM {out}r GROUP BY image_id, a)"""


@query(f"WITH RECURSIVE {ad.MASK}, {_labels_sql('mask', 'lab')} SELECT image_id, y, x, label FROM lab")
def components(spark: SparkSession, d: str) -> DataFrame:
    return mo.components(ad.mask8(spark, d)).select(*_AT, "label")


@query(f"WITH RECURSIVE {ad.MASK}, {_labels_sql('mask', 'lab', 'abs(n.y - r.b // 8) + abs(n.x - r.b % 8) <= 1')} SELECT image_id, y, x, label FROM lab")
def components4(spark: SparkSession, d: str) -> DataFrame:
    return mo.components(ad.mask8(spark, d), 4).select(*_AT, "label")


@query(f"WITH RECURSIVE {ad.MASK}, {_labels_sql('mask', 'lab')} SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM lab) q WHERE n >= 5")
def remove_small(spark: SparkSession, d: str) -> DataFrame:
    return mo.drop_small(ad.mask8(spark, d), 5).select(*_AT)


# Skeleton graph

_KIND = """CASE WHEN bit_count(code) = 1 THEN 'endpoint' WHEN bit_count(code) >= 3 THEN 'junction'
  WHEN bit_count(code) = 2 AND NOT (code & 17 = 17 OR code & 34 = 34 OR code & 68 = 68 OR code & 136 = 136) THEN 'corner' END"""
_NODES = f"nodes AS (SELECT * FROM (SELECT image_id, y, x, {_KIND} AS kind FROM code) q WHERE kind IS NOT NULL)"


@query(f"WITH {ad.MASK}, {ad.CODE}, {_NODES} SELECT image_id, y, x, kind FROM nodes")
def skeleton_nodes(spark: SparkSession, d: str) -> DataFrame:
    return sk.nodes(ad.mask8(spark, d)).select(*_AT, "kind")


@query(f"WITH {ad.MASK}, {ad.CODE}, {_NODES} SELECT image_id, y, x FROM nodes UNION SELECT m.image_id, m.y, m.x FROM mask m WHERE m.y = m.x")
def node_hint(spark: SparkSession, d: str) -> DataFrame:
    mask = ad.mask8(spark, d)
    hint = ad.pixels8(spark, d).where("y = x").drop("gray")
    return sk.with_hint(sk.nodes(mask), hint, mask).select(*_AT)


@query(f"""WITH {ad.MASK}, {ad.RING}, to_ AS (SELECT image_id, y, x, CAST(k AS INTEGER) AS k, CAST(y + dy AS INTEGER) AS ny, CAST(x + dx AS INTEGER) AS nx FROM mask CROSS JOIN ring)
SELECT t.image_id, t.y, t.x, t.k, t.ny, t.nx FROM to_ t JOIN mask n ON n.image_id = t.image_id AND n.y = t.ny AND n.x = t.nx""")
def pixel_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return sk.pixel_links(ad.mask8(spark, d))


@query(f"WITH {ad.MASK}, {ad.RING} SELECT DISTINCT m.image_id, least(m.y * 8 + m.x, n.y * 8 + n.x) AS a, greatest(m.y * 8 + m.x, n.y * 8 + n.x) AS b FROM mask m, ring, mask n WHERE n.image_id = m.image_id AND n.y = m.y + dy AND n.x = m.x + dx")
def edge_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = sk.pixel_links(ad.mask8(spark, d)).select("image_id", sk.edge_key(F.col("y"), F.col("x"), F.col("ny"), F.col("nx")).alias("e")).distinct()
    return rows.select("image_id", (F.col("e.a.y") * 8 + F.col("e.a.x")).alias("a"), (F.col("e.b.y") * 8 + F.col("e.b.x")).alias("b"))


_VERTICES = f"""seeds AS (SELECT image_id, y, x FROM nodes UNION ALL SELECT image_id, CAST(min(y * 8 + x) // 8 AS INTEGER), CAST(min(y * 8 + x) % 8 AS INTEGER) FROM mask WHERE image_id NOT IN (SELECT image_id FROM nodes) GROUP BY image_id),
grown AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM seeds, box WHERE {_INSIDE}),
{_labels_sql('grown', 'lab')},
mid AS (SELECT s.image_id, label, sum(s.y) / CAST(count(*) AS DOUBLE) AS cy, sum(s.x) / CAST(count(*) AS DOUBLE) AS cx FROM seeds s JOIN lab USING (image_id, y, x) GROUP BY s.image_id, label),
onit AS (SELECT m.image_id, m.y, m.x, l.label, (m.y - cy) * (m.y - cy) + (m.x - cx) * (m.x - cx) AS d FROM mask m JOIN lab l USING (image_id, y, x) JOIN mid ON mid.image_id = m.image_id AND mid.label = l.label),
best AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY d, y, x) AS rn, count(*) OVER (PARTITION BY image_id, label) AS n FROM onit),
vert AS (SELECT image_id, label, y, x, n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) - 1 AS INTEGER) AS id FROM best WHERE rn = 1)"""
_GRAPH = f"WITH RECURSIVE {ad.MASK}, {ad.BOX}, {ad.CODE}, {_NODES}, {_VERTICES}"


@query(f"{_GRAPH} SELECT image_id, id, CAST(x AS DOUBLE) AS x_px, CAST(y AS DOUBLE) AS y_px, CAST(n AS INTEGER) AS pixel_count FROM vert")
def cluster_vertices(spark: SparkSession, d: str) -> DataFrame:
    mask = ad.mask8(spark, d)
    return sk.cluster(sk.nodes(mask), mask)[0]


@query(f"{_GRAPH} SELECT o.image_id, o.y, o.x, v.id AS vertex_id FROM onit o JOIN vert v ON v.image_id = o.image_id AND v.label = o.label")
def vertex_labels(spark: SparkSession, d: str) -> DataFrame:
    mask = ad.mask8(spark, d)
    return sk.cluster(sk.nodes(mask), mask)[1]


def _end_sql(p: str, up: bool) -> str:
    """SQL for row, column and direction into the run of the end at place ``p``; names begin with ``p``."""
    d = [4, 5, 2, 3] if up else [0, 1, 6, 7]
    return f"""CASE k WHEN 2 THEN same ELSE {p} END AS {p}y, CASE k WHEN 0 THEN same WHEN 1 THEN same - {p} WHEN 2 THEN {p} ELSE {p} - same END AS {p}x,
  CASE k {' '.join(f'WHEN {n} THEN {v}' for n, v in enumerate(d))} END AS {p}d"""


_TRACE = f"""{_GRAPH}, lbl AS (SELECT o.image_id, o.y, o.x, v.id AS vid FROM onit o JOIN vert v ON v.image_id = o.image_id AND v.label = o.label),
un AS (SELECT c.image_id, c.y, c.x, CASE code WHEN 17 THEN 0 WHEN 34 THEN 1 WHEN 68 THEN 2 WHEN 136 THEN 3 END AS k FROM code c LEFT JOIN lbl l ON l.image_id = c.image_id AND l.y = c.y AND l.x = c.x WHERE l.vid IS NULL),
ln AS (SELECT image_id, k, CASE k WHEN 0 THEN x WHEN 1 THEN y + x WHEN 2 THEN y ELSE y - x END AS same, CASE k WHEN 2 THEN x ELSE y END AS p FROM un WHERE k IS NOT NULL),
isl AS (SELECT image_id, k, same, p, p - row_number() OVER (PARTITION BY image_id, k, same ORDER BY p) AS g FROM ln),
run AS (SELECT image_id, k, same, min(p) - 1 AS lo, max(p) + 1 AS hi FROM isl GROUP BY image_id, k, same, g),
en AS (SELECT image_id, k, hi - lo AS steps, {_end_sql('lo', True)}, {_end_sql('hi', False)} FROM run),
ve AS (SELECT en.*, a.vid AS lov, b.vid AS hiv FROM en JOIN lbl a ON a.image_id = en.image_id AND a.y = loy AND a.x = lox JOIN lbl b ON b.image_id = en.image_id AND b.y = hiy AND b.x = hix),
od AS (SELECT *, (lov < hiv OR lov = hiv AND (loy < hiy OR loy = hiy AND (lox < hix OR lox = hix AND lod <= hid))) AS fwd FROM ve),
ed AS (SELECT image_id, steps, k, CASE WHEN fwd THEN lov ELSE hiv END AS sv, CASE WHEN fwd THEN hiv ELSE lov END AS ev, CASE WHEN fwd THEN loy ELSE hiy END AS sy, CASE WHEN fwd THEN lox ELSE hix END AS sx,
  CASE WHEN fwd THEN hiy ELSE loy END AS ey, CASE WHEN fwd THEN hix ELSE lox END AS ex, CASE WHEN fwd THEN lod ELSE hid END AS sd FROM od)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY sv, sy, sx, sd) - 1 AS INTEGER) AS id, sv AS start_vertex, ev AS end_vertex,
  round(steps * CASE WHEN k % 2 = 1 THEN sqrt(2.0) ELSE 1.0 END, 6) AS pixel_length, CAST(sx AS DOUBLE) AS x0, CAST(sy AS DOUBLE) AS y0, CAST(ex AS DOUBLE) AS x1, CAST(ey AS DOUBLE) AS y1 FROM ed"""


def _edge_rows(edges: DataFrame) -> DataFrame:
    a, b = F.get("path", 0), F.get("path", 1)
    return edges.select("image_id", "id", "start_vertex", "end_vertex", r6("pixel_length").alias("pixel_length"), a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))


def _on_drawings(sql: str) -> str:
    """A statement on images of side 8 as one on the drawings of side 32."""
    sql = sql.replace(ad.MASK, ad.DRAWN)
    for a, b in (("y * 8 + x", "y * 32 + x"), ("n.y * 8 + n.x", "n.y * 32 + n.x"), ("r.b // 8", "r.b // 32"), ("r.b % 8", "r.b % 32"), ("a // 8", "a // 32"), ("a % 8", "a % 32"), (") // 8", ") // 32"), (") % 8", ") % 32"), ("BETWEEN 0 AND 7", "BETWEEN 0 AND 31")):
        sql = sql.replace(a, b)
    return sql


@query(_TRACE)
def trace_edges(spark: SparkSession, d: str) -> DataFrame:
    mask = ad.mask8(spark, d)
    return _edge_rows(sk.trace(mask, sk.cluster(sk.nodes(mask), mask)[1]))


@query(_on_drawings(_TRACE))
def trace_drawings(spark: SparkSession, d: str) -> DataFrame:
    mask = ad.drawings(spark, d).drop("gray")
    return _edge_rows(sk.trace(mask, sk.cluster(sk.nodes(mask), mask)[1]))


@query()
def stroke_graph(spark: SparkSession, d: str) -> DataFrame:
    return _edge_rows(sk.build_graph(ad.drawings(spark, d).drop("gray"))["edges"])


@query()
def heuristic_segmentation(spark: SparkSession, d: str) -> DataFrame:
    found = HeuristicSegmenter(min_component_area=5).segment(ad.pixels8(spark, d))
    return found.lines.select(*_AT, F.lit("line").alias("kind")).unionByName(found.nodes.select(*_AT, F.lit("node").alias("kind")))


# Contours

_P = ["image_id", "path_id"]
_MEASURES = """m AS (SELECT image_id, path_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM poly WINDOW w AS (PARTITION BY image_id, path_id ORDER BY seq)),
meas AS (SELECT image_id, path_id, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter, count(*) AS n FROM m GROUP BY image_id, path_id)"""


@query(f"WITH {ad.POLY}, {_MEASURES} SELECT image_id, path_id, round(area, 4) AS area, round(perimeter, 4) AS perimeter, n FROM meas")
def contour_measures(spark: SparkSession, d: str) -> DataFrame:
    return ct.measures(ad.paths(spark, d)).select(*_P, F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"), "n")


@query(f"WITH {ad.POLY}, {_MEASURES} SELECT image_id, path_id FROM meas WHERE area >= 500 AND perimeter >= 5000")
def contour_filter(spark: SparkSession, d: str) -> DataFrame:
    return ct.large(ct.measures(ad.paths(spark, d)), 500.0, 5000.0).select(*_P)


@query(f"WITH {ad.POLY}, {_MEASURES} SELECT image_id, path_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY area DESC, path_id) - 1 AS INTEGER) AS rank FROM meas")
def contour_sort(spark: SparkSession, d: str) -> DataFrame:
    return ct.by_area(ct.measures(ad.paths(spark, d))).select(*_P, "rank")


@query(f"WITH {ad.POLY}, {ad.CLOSED} SELECT * FROM closed")
def close_path(spark: SparkSession, d: str) -> DataFrame:
    return polyline.close_path(ad.paths(spark, d))


@query()
def find_contours(spark: SparkSession, d: str) -> DataFrame:
    return ct.find_contours(ad.mask8(spark, d)).drop("parent")


# Polylines

_SEGS = "seg AS (SELECT image_id, path_id, seq, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM closed WINDOW w AS (PARTITION BY image_id, path_id ORDER BY seq))"


@query(f"WITH {ad.POLY}, {ad.CLOSED}, {_SEGS} SELECT image_id, path_id, seq, round(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)), 6) AS len FROM seg WHERE x1 IS NOT NULL")
def seg_lengths(spark: SparkSession, d: str) -> DataFrame:
    return polyline.segments(polyline.close_path(ad.paths(spark, d))).select(*_P, "seq", r6("len").alias("len"))


_ARCS = """st AS (SELECT image_id, path_id, seq, x, y, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM {0} WINDOW w AS (PARTITION BY image_id, path_id ORDER BY seq)),
arc AS (SELECT image_id, path_id, seq, x, y, sum(step) OVER (PARTITION BY image_id, path_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM st)"""


@query(f"WITH {ad.POLY}, {_ARCS.format('poly')} SELECT image_id, path_id, seq, round(s, 4) AS s FROM arc")
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    return polyline.arc_length(ad.paths(spark, d)).select(*_P, "seq", F.round("s", 4).alias("s"))


@query(f"WITH {ad.POLY}, {_ARCS.format('poly')} SELECT image_id, path_id, round(max(s), 4) AS length FROM arc GROUP BY image_id, path_id")
def path_length(spark: SparkSession, d: str) -> DataFrame:
    return polyline.path_lengths(ad.paths(spark, d)).select(*_P, F.round("length", 4).alias("length"))


SPACING = 15.0


@query(f"""WITH {ad.POLY}, {ad.CLOSED}, {_ARCS.format('closed')},
sg AS (SELECT image_id, path_id, seq, x, y, s AS s0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(s) OVER w AS s1, max(s) OVER (PARTITION BY image_id, path_id) AS total FROM arc WINDOW w AS (PARTITION BY image_id, path_id ORDER BY seq)),
ks AS (SELECT image_id, path_id, k FROM (SELECT image_id, path_id, unnest(range(0, CAST(ceil(max(total) / {SPACING}) AS BIGINT))) AS k FROM sg GROUP BY image_id, path_id) q),
pt AS (SELECT ks.image_id, ks.path_id, CAST(k AS INTEGER) AS seq, x + (k * {SPACING} - s0) / (s1 - s0) * (x1 - x) AS x, y + (k * {SPACING} - s0) / (s1 - s0) * (y1 - y) AS y
  FROM ks JOIN sg ON sg.image_id = ks.image_id AND sg.path_id = ks.path_id AND x1 IS NOT NULL AND (k * {SPACING} > s0 AND k * {SPACING} <= s1 OR k = 0 AND sg.seq = 0))
SELECT image_id, path_id, seq, round(x, 4) AS x, round(y, 4) AS y FROM pt
UNION ALL SELECT image_id, path_id, CAST(ceil(max(s) / {SPACING}) AS INTEGER), round(arg_min(x, seq), 4), round(arg_min(y, seq), 4) FROM arc GROUP BY image_id, path_id""")
def resample(spark: SparkSession, d: str) -> DataFrame:
    out = polyline.resample(polyline.close_path(ad.paths(spark, d)), SPACING)
    return out.select(*_P, "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_ANGLES = """big AS (SELECT image_id, path_id, count(*) AS n FROM poly GROUP BY image_id, path_id HAVING count(*) >= 19),
tri AS (SELECT p.image_id, p.path_id, big.n, p.seq AS idx, p.x, p.y, a.x - p.x AS ux, a.y - p.y AS uy, b.x - p.x AS vx, b.y - p.y AS vy FROM poly p JOIN big USING (image_id, path_id)
  JOIN poly a ON a.path_id = p.path_id AND a.seq = (p.seq - 8 + big.n) % big.n JOIN poly b ON b.path_id = p.path_id AND b.seq = (p.seq + 8) % big.n),
ang AS (SELECT image_id, path_id, n, idx, x, y, degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))) AS angle_deg FROM tri WHERE sqrt(ux * ux + uy * uy) >= 1e-9 AND sqrt(vx * vx + vy * vy) >= 1e-9)"""


@query(f"WITH {ad.POLY}, {_ANGLES} SELECT image_id, path_id, idx, round(angle_deg, 4) AS angle_deg FROM ang")
def corner_angles(spark: SparkSession, d: str) -> DataFrame:
    return polyline.corner_angles(ad.paths(spark, d), 8).select(*_P, "idx", F.round("angle_deg", 4).alias("angle_deg"))


@query(f"WITH {ad.POLY}, {_ANGLES} SELECT image_id, path_id, idx FROM ang WHERE angle_deg <= 35")
def corner_candidates(spark: SparkSession, d: str) -> DataFrame:
    return polyline.corner_angles(ad.paths(spark, d), 8).where("angle_deg <= 35").select(*_P, "idx")


_NMS = """ord AS (SELECT image_id, path_id, n, idx, row_number() OVER (PARTITION BY path_id ORDER BY angle_deg, idx) AS k FROM ang WHERE angle_deg <= 140),
nms AS (SELECT path_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS acc FROM ord GROUP BY path_id
  UNION ALL SELECT nms.path_id, ord.k, CASE WHEN len(list_filter(nms.acc, lambda s: least(abs(ord.idx - s), ord.n - abs(ord.idx - s)) < 17)) > 0 THEN nms.acc ELSE list_append(nms.acc, CAST(ord.idx AS BIGINT)) END
  FROM nms JOIN ord ON ord.path_id = nms.path_id AND ord.k = nms.k + 1),
kept AS (SELECT path_id, unnest(arg_max(acc, k)) AS idx FROM nms GROUP BY path_id)"""


@query(f"WITH RECURSIVE {ad.POLY}, {_ANGLES}, {_NMS} SELECT path_id % 4 AS image_id, path_id, CAST(idx AS INTEGER) AS idx FROM kept")
def corner_nms(spark: SparkSession, d: str) -> DataFrame:
    return polyline.corners(ad.paths(spark, d), 140.0, 8, 17).select(*_P, "idx")


def _moved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Paths, and their points moved a little, as sampled paths."""
    raw = ad.paths(spark, d)
    return raw, raw.select(*_P, "seq", (F.col("x") + 0.25).alias("x"), (F.col("y") - 0.25).alias("y"))


@query(f"""WITH {ad.POLY}, {_ARCS.format('poly')},
pairs AS (SELECT a.image_id, a.path_id, a.seq, b.seq AS i, b.s, row_number() OVER (PARTITION BY a.path_id, a.seq ORDER BY (b.x - (a.x + 0.25)) * (b.x - (a.x + 0.25)) + (b.y - (a.y - 0.25)) * (b.y - (a.y - 0.25)), b.seq) AS rn FROM poly a JOIN arc b ON a.path_id = b.path_id)
SELECT image_id, path_id, seq, i, round(s, 4) AS s FROM pairs WHERE rn = 1""")
def nearest_vertex(spark: SparkSession, d: str) -> DataFrame:
    raw, sampled = _moved(spark, d)
    return polyline.nearest_vertex(sampled, raw).select(*_P, "seq", "i", F.round("s", 4).alias("s"))


@query()
def merge_points(spark: SparkSession, d: str) -> DataFrame:
    raw = polyline.close_path(ad.paths(spark, d))
    out = polyline.merge_corners(polyline.resample(raw, SPACING), raw, polyline.corners(raw, 140.0, 8, 17))
    return out.select(*_P, "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_FAR = """CASE WHEN a.x = b.x AND a.y = b.y THEN sqrt((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y))
  ELSE abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) END"""


@query(f"""WITH RECURSIVE {ad.POLY}, sp AS (SELECT path_id, CAST(0 AS BIGINT) AS lo, CAST(max(seq) AS BIGINT) AS hi FROM poly GROUP BY path_id
UNION ALL SELECT path_id, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END FROM (
  SELECT path_id, lo, hi, mid FROM (SELECT sp.path_id, lo, hi, arg_max(CAST(p.seq AS BIGINT), {_FAR}) AS mid, max({_FAR}) AS far
    FROM sp JOIN poly p ON p.path_id = sp.path_id AND p.seq > lo AND p.seq < hi JOIN poly a ON a.path_id = sp.path_id AND a.seq = lo JOIN poly b ON b.path_id = sp.path_id AND b.seq = hi
    GROUP BY sp.path_id, lo, hi) q WHERE far > 40) h, (SELECT unnest([0, 1]) AS side) s)
SELECT path_id % 4 AS image_id, path_id, round(x, 6) AS x, round(y, 6) AS y FROM poly p WHERE EXISTS (SELECT 1 FROM sp WHERE sp.path_id = p.path_id AND (p.seq = sp.lo OR p.seq = sp.hi))""")
def rdp(spark: SparkSession, d: str) -> DataFrame:
    # arg_max leaves open which of equally far points is the middle; DuckDB's hash join meets the last one first.
    return polyline.simplify(ad.paths(spark, d), 40.0, "last").select(*_P, r6("x").alias("x"), r6("y").alias("y"))


# Mapping

_LEFT = WorkArea(150.0, 270.0, 5.0, centred=False)


def _fit_sql(area: WorkArea) -> str:
    dw, dh = area.width_mm - 2 * area.margin_mm, area.height_mm - 2 * area.margin_mm
    off = f"{area.margin_mm} + ({dw} - w * s) / 2 AS ox, {area.margin_mm} + ({dh} - h * s) / 2 AS oy" if area.centred else f"{area.margin_mm} AS ox, {area.margin_mm} AS oy"
    return f"f AS (SELECT image_id, w, h, s, {off} FROM (SELECT image_id, w, h, least({dw} / CAST(w AS DOUBLE), {dh} / CAST(h AS DOUBLE)) AS s FROM sizes) q)"


def _map_sql(area: WorkArea) -> str:
    y = f"{area.height_mm} - (y * s + oy)" if area.flip_y else "y * s + oy"
    return f"WITH {ad.POLY}, {ad.SIZES}, {_fit_sql(area)} SELECT p.image_id, path_id, seq, round(x * s + ox, 6) AS x_mm, round({y}, 6) AS y_mm FROM poly p JOIN f ON f.image_id = p.image_id"


def _mapped(spark: SparkSession, d: str, area: WorkArea) -> DataFrame:
    points = ad.paths(spark, d)
    return mapping.map_points(points, ad.sizes(points), area)


@query(f"WITH {ad.POLY}, {ad.SIZES}, {_fit_sql(GANTRY_AREA)} SELECT image_id, w AS img_w_px, h AS img_h_px, round(s, 9) AS scale, round(w * s, 6) AS used_w, round(h * s, 6) AS used_h, round(ox, 6) AS ox, round(oy, 6) AS oy FROM f")
def fit_info(spark: SparkSession, d: str) -> DataFrame:
    t = mapping.transforms(ad.sizes(ad.paths(spark, d)), GANTRY_AREA).select("image_id", "transform.*")
    return t.select("image_id", "img_w_px", "img_h_px", F.round("scale_mm_per_px", 9).alias("scale"), r6("used_w_mm").alias("used_w"), r6("used_h_mm").alias("used_h"), r6("x_offset_mm").alias("ox"), r6("y_offset_mm").alias("oy"))


@query(_map_sql(A4_PAGE))
def map_a4(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, A4_PAGE).select(*_P, "seq", r6("x_mm").alias("x_mm"), r6("y_mm").alias("y_mm"))


@query(_map_sql(GANTRY_AREA))
def map_gantry(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, GANTRY_AREA).select(*_P, "seq", r6("x_mm").alias("x_mm"), r6("y_mm").alias("y_mm"))


@query(_map_sql(_LEFT))
def map_gantry_uncentred(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, _LEFT).select(*_P, "seq", r6("x_mm").alias("x_mm"), r6("y_mm").alias("y_mm"))


# Commands and metrics


@query(f"""WITH {ad.POLY}, {ad.SIZES}, {_fit_sql(GANTRY_AREA)}
SELECT p.image_id, row_number() OVER (PARTITION BY p.image_id ORDER BY path_id, seq) - 1 AS cmd_idx, round(x * s + ox, 6) AS x_mm, round(y * s + oy, 6) AS y_mm, CASE WHEN seq = 0 THEN 0 ELSE 1 END AS mode
FROM poly p JOIN f ON f.image_id = p.image_id""")
def emit_commands(spark: SparkSession, d: str) -> DataFrame:
    return cmd.emit(_mapped(spark, d, GANTRY_AREA)).select("image_id", "cmd_idx", r6("x_mm").alias("x_mm"), r6("y_mm").alias("y_mm"), "mode")


@query(f"""WITH {ad.CMDS}, bad AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cmd_idx) AS rn FROM cmds WHERE NOT (x_mm BETWEEN 0 AND 150 AND y_mm BETWEEN 0 AND 270))
SELECT i.image_id, 'Command ' || cmd_idx || ' outside gantry bounds: x=' || printf('%.2f', x_mm) || ', y=' || printf('%.2f', y_mm) || ', allowed X=0..150.0, Y=0..270.0' AS error
FROM (SELECT DISTINCT image_id FROM cmds) i LEFT JOIN bad ON bad.image_id = i.image_id AND rn = 1""")
def validate_first_error(spark: SparkSession, d: str) -> DataFrame:
    return cmd.first_fault(ad.commands(spark, d), 150.0, 270.0)


@query(f"WITH {ad.CMDS} SELECT image_id, cmd_idx, format('{{:.2f}}', x_mm) || ',' || format('{{:.2f}}', y_mm) || ',' || mode AS line FROM cmds")
def command_rows_text(spark: SparkSession, d: str) -> DataFrame:
    return ad.commands(spark, d).select("image_id", "cmd_idx", sinks.command_text().alias("line"))


@query(f"WITH {ad.POLY} SELECT image_id, path_id, seq, format('{{:.3f}}', x) || ', ' || format('{{:.3f}}', y) AS line FROM poly")
def point_rows_text(spark: SparkSession, d: str) -> DataFrame:
    return ad.paths(spark, d).select(*_P, "seq", F.concat_ws(", ", sinks.three_places("x"), sinks.three_places("y")).alias("line"))


_MOVES = """mv AS (SELECT *, coalesce(sqrt((x_mm - lag(x_mm) OVER w) * (x_mm - lag(x_mm) OVER w) + (y_mm - lag(y_mm) OVER w) * (y_mm - lag(y_mm) OVER w)), 0) AS dist, lag(mode) OVER w AS before FROM cmds WINDOW w AS (PARTITION BY image_id ORDER BY cmd_idx)),
tot AS (SELECT image_id, count(*) AS command_count, coalesce(sum(CASE WHEN mode = 1 THEN dist END), 0) AS draw_mm, coalesce(sum(CASE WHEN mode <> 1 THEN dist END), 0) AS travel_mm,
  sum(CASE WHEN before IS NULL OR before <> mode THEN 1 ELSE 0 END) AS mode_changes, min(x_mm) AS min_x_mm, max(x_mm) AS max_x_mm, min(y_mm) AS min_y_mm, max(y_mm) AS max_y_mm FROM mv GROUP BY image_id)"""


@query(f"WITH {ad.CMDS}, {_MOVES} SELECT image_id, round(draw_mm, 3) AS draw_mm, round(travel_mm, 3) AS travel_mm FROM tot")
def move_distance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distances(ad.commands(spark, d)).select("image_id", F.round("draw_mm", 3).alias("draw_mm"), F.round("travel_mm", 3).alias("travel_mm"))


@query(f"WITH {ad.CMDS}, {_MOVES} SELECT image_id, command_count, CAST(mode_changes AS BIGINT) AS mode_changes FROM tot")
def mode_changes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distances(ad.commands(spark, d)).select("image_id", "command_count", "mode_changes")


@query(f"WITH {ad.CMDS}, {_MOVES} SELECT image_id, min_x_mm, max_x_mm, min_y_mm, max_y_mm FROM tot")
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distances(ad.commands(spark, d)).select("image_id", "min_x_mm", "max_x_mm", "min_y_mm", "max_y_mm")


@query(f"WITH {ad.CMDS}, {_MOVES} SELECT image_id, round(draw_mm / 13.75, 3) AS draw_s, round(travel_mm / 22.5, 3) AS travel_s, round(CAST(mode_changes AS DOUBLE) * 1.225, 3) AS pen_s, round(draw_mm / 13.75 + travel_mm / 22.5 + CAST(mode_changes AS DOUBLE) * 1.225, 3) AS total_s FROM tot")
def plot_time(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.times(metrics.distances(ad.commands(spark, d)), firmware.DEFAULTS)
    return m.select("image_id", *[F.round(c, 3).alias(c) for c in ("draw_s", "travel_s", "pen_s", "total_s")])


@query(f"WITH {ad.CMDS}, {_MOVES}, ok AS (SELECT image_id, bool_and(x_mm BETWEEN 0 AND 1000 AND y_mm BETWEEN 0 AND 1000) AS passed FROM cmds GROUP BY image_id) SELECT image_id, passed FROM ok")
def bounds_passed(spark: SparkSession, d: str) -> DataFrame:
    return cmd.first_fault(ad.commands(spark, d), 1000.0, 1000.0).select("image_id", F.col("error").isNull().alias("passed"))


@query()
def metrics_json(spark: SparkSession, d: str) -> DataFrame:
    own = ad.commands(spark, d)
    names = ("vertex_count", "edge_count", "skeleton_pixel_count", "endpoint_count", "junction_pixel_count", "corner_pixel_count")
    # Events have no skeleton, so no graph to count.
    graph = F.struct(*[F.lit(0).alias(n) for n in names]).alias("graph")
    images = mapping.transforms(ad.sizes(ad.paths(spark, d)), GANTRY_AREA).join(metrics.stroke_counts(own), "image_id").select("*", graph)
    docs = metrics.documents(own, images, 1000.0, 1000.0, dict(firmware.DEFAULTS), "heuristic", None, [])
    return docs.select("image_id", F.to_json("metrics", {"ignoreNullFields": "false"}).alias("json"))


# Sources, plug-ins, device


@query(f"""WITH names AS (SELECT unnest({list(firmware.DEFAULTS)}) AS name, unnest({list(firmware.DEFAULTS.values())}) AS fallback),
lines AS (SELECT CASE p_partkey % 11 {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(firmware.DEFAULTS))} ELSE 'OTHER' END AS name, CAST(p_size AS DOUBLE) AS value, p_partkey FROM part),
last AS (SELECT name, arg_max(value, p_partkey) AS value FROM lines GROUP BY name)
SELECT n.name, coalesce(l.value, fallback) AS value FROM names n LEFT JOIN last l ON l.name = n.name""")
def firmware_constants(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[x for i, n in enumerate(firmware.DEFAULTS) for x in (F.lit(i), F.lit(n))])
    name = F.coalesce(F.try_element_at(names, (F.col("p_partkey") % 11).cast("int")), F.lit("OTHER"))
    text = F.concat(F.lit("const int "), name, F.lit(" = "), F.col("p_size").cast("string"), F.lit(";"))
    texts = ad.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), text.alias("value"))
    return firmware.constants(spark, texts).select("name", "value")


@query("""SELECT min(url) AS model_path FROM (SELECT url || CASE WHEN page_id % 3 = 0 THEN '/m.PT' ELSE '/m.txt' END AS url, page_id FROM pages) q WHERE page_id % 3 = 0 AND NOT contains('/' || url || '/', '/.venv/')""")
def model_discovery(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/m.PT").otherwise("/m.txt"))
    return models.first_model(ad.table(spark, d, "pages").select(path.alias("path")))


@query(f"""WITH {ad.PX}, s AS (SELECT image_id, y, x, 1 / (1 + exp(-(gray / 255.0 - 0.5) * 8)) AS p FROM px) SELECT image_id, y, x, round(p, 4) AS p FROM s""")
def predict_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = ModelSegmenter(lambda gray: (gray.astype(np.float64) - 0.5) * 8).probabilities(ad.pixels8(spark, d))
    return rows.select(*_AT, F.round(F.get("p", 0), 4).alias("p"))


@query()
def serial_replay(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("event_type") == "click", "READY").when(F.col("event_type") == "error", "ERROR limit").otherwise("OK")
    rows = ad.paths(spark, d).select(F.col("path_id").alias("device"), "seq", line.alias("line"))
    return replay(rows, 12)


# Whole runs


@query()
def run_contours(spark: SparkSession, d: str) -> DataFrame:
    return contour_run(ad.pixels8(spark, d)).commands.select("image_id", "cmd_idx", r6("x_mm").alias("x_mm"), r6("y_mm").alias("y_mm"), "mode")


@query()
def run_strokes(spark: SparkSession, d: str) -> DataFrame:
    return stroke_run(ad.drawings(spark, d, "supplier")).commands.select("image_id", "cmd_idx", r6("x_mm").alias("x_mm"), r6("y_mm").alias("y_mm"), "mode")


@query()
def run_study(spark: SparkSession, d: str) -> DataFrame:
    return study_run(ad.pixels8(spark, d))["nodes"].select(*_AT, "kind")
