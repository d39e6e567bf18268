"""Contours: border following, area, perimeter, filter and order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators.morphology import PIXEL
from plotweave.operators.polyline import PATH, POINT, close_path, segments

#: The eight neighbours clockwise from east, y down.
_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def follow_borders(grid: np.ndarray, external: bool) -> list[tuple[np.ndarray, bool, int]]:
    """Borders of a mask after Suzuki and Abe (1985): ((x, y) points, is hole, parent number or -1) in the order met.

    With ``external`` only the outermost outer borders are given.
    """
    f = np.zeros((grid.shape[0] + 2, grid.shape[1] + 2), np.int64)
    f[1:-1, 1:-1] = grid
    borders: list[tuple[np.ndarray, bool, int]] = []
    kinds, parents, number = {1: True}, {1: 0}, 1
    for i in range(1, f.shape[0] - 1):
        last = 1
        for j in np.flatnonzero(f[i]).tolist():
            v = f[i, j]
            outer, hole = v == 1 and f[i, j - 1] == 0, v >= 1 and f[i, j + 1] == 0
            if not outer and hole and v > 1:
                last = int(v)
            if outer or hole:
                number += 1
                is_hole = not outer
                kinds[number] = is_hole
                parents[number] = parents[last] if kinds[last] == is_hole else last
                start = 4 if outer else 0
                points = _follow(f, i, j, start, number)
                if not external or (not is_hole and parents[number] == 1):
                    borders.append((points, is_hole, parents[number]))
            if f[i, j] not in (0, 1):
                last = abs(int(f[i, j]))
    return borders


def _follow(f: np.ndarray, i: int, j: int, start: int, number: int) -> np.ndarray:
    """Walk one border from (i, j), whose background neighbour lies in direction ``start``, marking it with ``number``."""
    first = next((d for d in ((start + k) % 8 for k in range(8)) if f[i + _AROUND[d][0], j + _AROUND[d][1]]), None)
    if first is None:
        f[i, j] = -number
        return np.array([[j - 1, i - 1]])
    i1, j1 = i + _AROUND[first][0], j + _AROUND[first][1]
    y, x, came, out = i, j, first, []
    while True:
        out.append((x - 1, y - 1))
        east_empty = False
        for k in range(1, 9):
            d = (came - k) % 8
            if f[y + _AROUND[d][0], x + _AROUND[d][1]]:
                break
            east_empty |= d == 0
        if east_empty:
            f[y, x] = -number
        elif f[y, x] == 1:
            f[y, x] = number
        ny, nx = y + _AROUND[d][0], x + _AROUND[d][1]
        if (ny, nx) == (i, j) and (y, x) == (i1, j1):
            return np.array(out)
        y, x, came = ny, nx, (d + 4) % 8


def find_contours(mask: DataFrame, mode: str = "all") -> DataFrame:
    """``(image_id, path_id, seq, x, y, is_hole, parent)``: every border point of each image; mode is external or all.

    ``parent`` is the number of the enclosing border in the order met, null for none.
    """
    if mode not in ("all", "external"):
        raise ValueError(f"Unknown contour mode: {mode}")
    kind = mask.schema["image_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(rows.h.iloc[0]), int(rows.w.iloc[0])), bool)
        grid[rows.y, rows.x] = True
        parts = [pd.DataFrame({"path_id": k, "seq": np.arange(len(p)), "x": p[:, 0].astype(float), "y": p[:, 1].astype(float), "is_hole": hole, "parent": None if up < 2 or mode == "external" else up - 2}) for k, (p, hole, up) in enumerate(follow_borders(grid, mode == "external"))]
        out = pd.concat(parts)
        out["parent"] = out["parent"].astype("Int64")
        out.insert(0, "image_id", rows.image_id.iloc[0])
        return out

    return mask.select(*PIXEL).groupBy("image_id").applyInPandas(run, f"image_id {kind}, path_id int, seq int, x double, y double, is_hole boolean, parent int")


def measures(points: DataFrame) -> DataFrame:
    """``(image_id, path_id, area, perimeter, n)`` of loops: shoelace area and length, the way back to the first point included."""
    w = Window.partitionBy(*PATH).orderBy("seq")
    whole = Window.partitionBy(*PATH).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    rows = points.select(*POINT, nx.alias("nx"), ny.alias("ny"))
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    step = F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))
    return rows.groupBy(*PATH).agg((F.abs(F.sum(cross)) / 2).alias("area"), F.sum(step).alias("perimeter"), F.count("*").alias("n"))


def large(measured: DataFrame, min_area: float = 20.0, min_perimeter: float = 20.0) -> DataFrame:
    return measured.where((F.col("area") >= min_area) & (F.col("perimeter") >= min_perimeter))


def by_area(measured: DataFrame) -> DataFrame:
    """The measures with ``rank`` from 0 in each image: larger areas first, equal ones as they came."""
    return measured.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "path_id")) - 1)


def stats(raw: DataFrame, sampled: DataFrame, found: DataFrame) -> DataFrame:
    """One row a contour: area, perimeter, raw points, samples, corners, and the spacing that came out."""
    n = sampled.groupBy(*PATH).agg(F.count("*").alias("samples"))
    c = found.groupBy(*PATH).agg(F.count("*").alias("corners"))
    rows = measures(raw).join(n, PATH, "left").join(c, PATH, "left").fillna(0, ["samples", "corners"])
    return rows.withColumn("spacing", F.when(F.col("samples") > 1, F.col("perimeter") / (F.col("samples") - 1)))


def closed_length(points: DataFrame) -> DataFrame:
    """``(image_id, path_id, length)`` of paths after closing."""
    return segments(close_path(points)).groupBy(*PATH).agg(F.sum("len").alias("length"))
