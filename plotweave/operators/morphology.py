"""Stencils on sparse masks: a row a foreground pixel, ``(image_id, h, w, y, x)``.

A stencil explodes each pixel into what it contributes to its neighbours and groups by target: one shuffle, no join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.storage import unsent

#: Neighbours clockwise from north: bit k of a neighbour code is the k-th.
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
BOX = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
PIXEL = ["image_id", "h", "w", "y", "x"]


def _spread(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel at every offset from it, clipped to the image; repeats stay."""
    shifts = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])).alias("o")
    out = mask.select(*PIXEL, shifts).select("image_id", "h", "w", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return out.where("y >= 0 and x >= 0 and y < h and x < w")


def dilate(mask: DataFrame, iterations: int = 1, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Pixels that have a foreground pixel within the box (or at an offset); outside counts as background."""
    for _ in range(iterations):
        mask = _spread(mask, [(-dy, -dx) for dy, dx in offsets or BOX]).distinct()
    return mask


def erode(mask: DataFrame, iterations: int = 1, offsets: list[tuple[int, int]] | None = None, outside: bool = False) -> DataFrame:
    """Pixels all of whose box (or offsets) is foreground; what lies outside the image counts as ``outside``."""
    offsets = offsets or BOX
    ys, xs = [o[0] for o in offsets], [o[1] for o in offsets]
    need = F.lit(len(offsets))
    if outside and len(offsets) == (max(ys) - min(ys) + 1) * (max(xs) - min(xs) + 1):
        tall = F.least(F.col("y") + max(ys), F.col("h") - 1) - F.greatest(F.col("y") + min(ys), F.lit(0)) + 1
        wide = F.least(F.col("x") + max(xs), F.col("w") - 1) - F.greatest(F.col("x") + min(xs), F.lit(0)) + 1
        need = tall * wide
    elif outside:
        inside = [F.when((F.col("y") + dy >= 0) & (F.col("y") + dy < F.col("h")) & (F.col("x") + dx >= 0) & (F.col("x") + dx < F.col("w")), 1).otherwise(0) for dy, dx in offsets]
        need = sum(inside[1:], inside[0])
    for _ in range(iterations):
        mask = _spread(mask, [(-dy, -dx) for dy, dx in offsets]).groupBy(*PIXEL).agg(F.count("*").alias("n")).where(F.col("n") == need).select(*PIXEL)
    return mask


def close(mask: DataFrame, iterations: int = 1) -> DataFrame:
    """Dilation then erosion, as often as asked; pixels at the border go."""
    for _ in range(iterations):
        mask = erode(dilate(mask))
    return mask


def square(size: int) -> list[tuple[int, int]]:
    """Offsets of a square kernel with its anchor in the middle."""
    a = size // 2
    return [(dy, dx) for dy in range(-a, size - a) for dx in range(-a, size - a)]


def close_open(mask: DataFrame, close_size: int = 0, close_iterations: int = 1, open_size: int = 0, open_iterations: int = 1) -> DataFrame:
    """Closing and opening in the manner of image libraries: all dilations, then all erosions, without loss at the border."""
    if close_size:
        k = square(close_size)
        mask = erode(dilate(mask, close_iterations, k), close_iterations, k, outside=True)
    if open_size:
        k = square(open_size)
        mask = dilate(erode(mask, open_iterations, k, outside=True), open_iterations, k)
    return mask


def neighbour_code(mask: DataFrame) -> DataFrame:
    """The mask with ``code``: bit k is set if the k-th of RING is foreground."""
    shifts = F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate([*RING, (0, 0)])])
    out = mask.select(*PIXEL, F.explode(shifts).alias("o"))
    out = out.groupBy("image_id", "h", "w", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.bit_or("o.bit").alias("c"))
    return out.where("c >= 256").select(*PIXEL, F.col("c").bitwiseAND(F.lit(255)).alias("code"))


def neighbour_count(mask: DataFrame) -> DataFrame:
    """The mask with ``n``, the number of its eight neighbours that are foreground."""
    return neighbour_code(mask).select(*PIXEL, F.bit_count("code").alias("n"))


def transitions(mask: DataFrame) -> DataFrame:
    """The mask with ``t``, the number of steps from background to foreground on the way around each pixel."""
    turned = F.expr("shiftright(code, 1) | ((code & 1) * 128)")
    return neighbour_code(mask).withColumn("r", turned).select(*PIXEL, F.expr("bit_count(~code & r & 255)").cast("int").alias("t"))


def _grid(rows: pd.DataFrame) -> np.ndarray:
    """The mask of one image with a frame of background."""
    grid = np.zeros((int(rows.h.iloc[0]) + 2, int(rows.w.iloc[0]) + 2), bool)
    grid[rows.y + 1, rows.x + 1] = True
    return grid


def _ring(grid: np.ndarray) -> list[np.ndarray]:
    h, w = grid.shape
    out = []
    for dy, dx in RING:
        s = np.zeros_like(grid)
        s[1:-1, 1:-1] = grid[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]
        out.append(s)
    return out


def _removable() -> tuple[np.ndarray, np.ndarray]:
    """For each neighbour code, whether the first and the second sub-pass of thinning remove the pixel."""
    code = np.arange(256)
    bit = [(code >> k) & 1 for k in range(8)]
    b = sum(bit)
    a = sum((1 - bit[k]) & bit[(k + 1) % 8] for k in range(8))
    base = (b >= 2) & (b <= 6) & (a == 1)
    n, e, s, w = bit[0], bit[2], bit[4], bit[6]
    return base & (n * e * s == 0) & (e * s * w == 0), base & (n * e * w == 0) & (n * s * w == 0)


_PASSES = _removable()


def _per_image(mask: DataFrame, step) -> DataFrame:  # noqa: ANN001
    """Run ``step(grid) -> grid`` on each image's framed mask; images are grouped by a shuffle on their id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = np.nonzero(step(_grid(rows))[1:-1, 1:-1])
        first = rows.iloc[0]
        return pd.DataFrame({"image_id": first.image_id, "h": first.h, "w": first.w, "y": y, "x": x})

    return mask.groupBy("image_id").applyInPandas(run, mask.select(*PIXEL).schema)


def thin(mask: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Thinning after Zhang and Suen (1984): two sub-passes a round, each removing at once, until neither removes a pixel."""

    def step(grid: np.ndarray) -> np.ndarray:
        for _ in range(max_rounds):
            before = grid.sum()
            for table in _PASSES:
                code = sum(r.astype(np.int64) << k for k, r in enumerate(_ring(grid)))
                grid = grid & ~table[code]
            if grid.sum() == before:
                break
        return grid

    return _per_image(mask.select(*PIXEL), step)


def thin_round(mask: DataFrame) -> DataFrame:
    """One round of thinning as two relational sub-passes, for images that don't fit in one task."""
    for table in _PASSES:
        keep = F.array(*[F.lit(not bool(v)) for v in table])
        mask = neighbour_code(mask).where(F.element_at(keep, F.col("code") + 1)).select(*PIXEL)
    return mask


def skeleton_by_opening(mask: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Morphological skeleton: the union of what erosion by a cross loses that dilation doesn't restore, until nothing is left.

    The border doesn't erode, so an image all of foreground stays: the loop ends when a round changes nothing.
    """

    def cross(grid: np.ndarray, join, edge: bool) -> np.ndarray:  # noqa: ANN001
        g = grid.copy()
        g[0], g[-1], g[:, 0], g[:, -1] = edge, edge, edge, edge
        out = g.copy()
        out[1:-1, 1:-1] = join(join(join(g[1:-1, 1:-1], g[:-2, 1:-1]), join(g[2:, 1:-1], g[1:-1, :-2])), g[1:-1, 2:])
        out[0], out[-1], out[:, 0], out[:, -1] = False, False, False, False
        return out

    def step(grid: np.ndarray) -> np.ndarray:
        skeleton = np.zeros_like(grid)
        for _ in range(max_rounds):
            less = cross(grid, np.logical_and, True)
            skeleton |= grid & ~cross(less, np.logical_or, False)
            if not less.any() or (less == grid).all():
                break
            grid = less
        return skeleton

    return _per_image(mask.select(*PIXEL), step)


def components(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """The mask with ``label``: the least ``y * w + x`` of the pixel's component, so labels order as components are met row by row."""
    around = RING if connectivity == 8 else RING[::2]
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    schema = mask.select(*PIXEL).schema.add("label", "long")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        w = int(rows.w.iloc[0])
        rows = rows.sort_values(["y", "x"]).reset_index(drop=True)
        place = (rows.y.to_numpy(np.int64) + 1) * (w + 2) + rows.x.to_numpy(np.int64) + 1
        links = []
        for dy, dx in around:
            at = np.searchsorted(place, place + dy * (w + 2) + dx)
            at = np.minimum(at, len(place) - 1)
            links.append(np.where(place[at] == place + dy * (w + 2) + dx, at, np.arange(len(place))))
        label = np.arange(len(place))
        while True:
            low = np.minimum.reduce([label[k] for k in links] + [label])
            np.minimum.at(low, label, low)
            low = low[low]
            if (low == label).all():
                break
            label = low
        rows["label"] = rows.y.to_numpy(np.int64)[label] * w + rows.x.to_numpy(np.int64)[label]
        return rows

    return mask.select(*PIXEL).groupBy("image_id").applyInPandas(run, schema)


def drop_small(mask: DataFrame, min_area: int, connectivity: int = 8) -> DataFrame:
    """Components of at least ``min_area`` pixels; 1 or less leaves the mask as it is."""
    if min_area <= 1:
        return mask.select(*PIXEL)
    labelled = components(mask, connectivity)
    big = labelled.groupBy("image_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_area)
    return labelled.join(unsent(big), ["image_id", "label"], "left_semi").select(*PIXEL)

